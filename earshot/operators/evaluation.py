"""Label quality: confusion matrix, accuracies, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """expected, predicted, n over the square of the label domain, zeros included."""
    spark = pairs.sparkSession
    square = spark.createDataFrame([(a, b) for a in labels for b in labels], "expected string, predicted string")
    counts = pairs.groupBy("expected", "predicted").agg(F.count("*").alias("n"))
    return F.broadcast(square).join(counts, ["expected", "predicted"], "left").select("expected", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def report(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """precision, recall, f1 and support of each label; a division by zero is 0."""
    cm = confusion(pairs, labels)
    hit = cm.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    said = cm.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    p, r = ratio(F.col("hits"), F.col("said")), ratio(F.col("hits"), F.col("support"))
    return hit.join(said, "label").select("label", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def averages(per_label: DataFrame) -> DataFrame:
    weight = F.col("support")
    macro = per_label.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    weighted = per_label.agg(F.lit("weighted avg").alias("label"), *(ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support"))
    return macro.unionByName(weighted)


def accuracy(cases: DataFrame) -> DataFrame:
    """cases: expected_mood, predicted (null: failed). Strict leaves mixed cases out; lenient counts them right with a polarity."""
    done, mixed = F.col("predicted").isNotNull(), F.col("expected_mood") == "mixed"
    right = F.col("expected_mood") == F.col("predicted")
    covered = mixed & F.col("predicted").isin("positive", "negative")
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if(~done).alias("failed_cases"), F.count_if(done & mixed).alias("mixed_cases"), F.count_if(done & covered).alias("mixed_covered"),
        F.avg(F.when(done & ~mixed, right.cast("int"))).alias("accuracy"),
        F.try_divide(F.count_if(done & ((~mixed & right) | covered)), F.count_if(done)).alias("accuracy_lenient"),
    )


def record_run(metrics: DataFrame, path: str) -> None:
    """Appends a run, one row of figures, as a JSON document with the time."""
    metrics.select(F.to_json(F.struct("*")).alias("metrics"), F.current_timestamp().alias("created_at")).coalesce(1).write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The figures of one run as a JSON file (in a folder of that name)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
