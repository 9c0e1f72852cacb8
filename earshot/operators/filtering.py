"""The stage filter: which comments are worth an expensive look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIGH_CONFIDENCE = 0.85
DENSE = 5


def flags(labelled: DataFrame, *, threshold: float = HIGH_CONFIDENCE, dense: int = DENSE) -> DataFrame:
    """strong_negative, high_confidence, dense_cluster (where a cluster_id is given; null is in no cluster) and flagged."""
    out = labelled.withColumn("strong_negative", F.col("sentiment").isin("negative", "critical_escalation")).withColumn("high_confidence", F.col("confidence") >= threshold)
    if "cluster_id" in labelled.columns:
        # sizes are combined before they are shuffled, and a cluster of any size can be split in the join; fewer than two comments are no cluster
        sizes = labelled.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("in_cluster"))
        out = out.join(sizes, "cluster_id", "left").withColumn("dense_cluster", F.coalesce(F.col("in_cluster") >= max(2, dense), F.lit(False))).drop("in_cluster").select(*labelled.columns, "strong_negative", "high_confidence", "dense_cluster")
    else:
        out = out.withColumn("dense_cluster", F.lit(False))
    return out.withColumn("flagged", F.col("strong_negative") | F.col("high_confidence") | F.col("dense_cluster"))


def dense_by_size(labelled: DataFrame, *, dense: int = DENSE) -> DataFrame:
    """As the window, for clusters of any size: one aggregated row for each cluster joins its members."""
    sizes = labelled.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return labelled.join(sizes, "cluster_id").withColumn("dense_cluster", F.col("cluster_size") >= dense)


def strict_labels(comments: DataFrame, labels: DataFrame) -> DataFrame:
    """comments with their labels; a comment that lacks them stops the query, in the same pass."""
    joined = comments.join(labels, comments["id"] == labels["comment_id"], "left")
    missing = F.raise_error(F.concat(F.lit("no label for comment "), F.col("id")))
    columns = [F.when(F.col("comment_id").isNull(), missing.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in labels.schema if f.name != "comment_id"]
    return joined.select(*(comments[c] for c in comments.columns), *columns)


def select_flagged(labelled: DataFrame, **limits) -> DataFrame:
    return flags(labelled, **limits).filter("flagged").orderBy("pos")


def usable(comments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Comments that have an embedding."""
    return comments.join(embeddings, comments["id"] == embeddings["comment_id"], "left_semi")


def candidates(comments: DataFrame, intents: DataFrame, kind: str) -> DataFrame:
    """Comments whose intent label says is_request or is_confusion; without a label they are left out."""
    return comments.join(intents.filter(F.col(f"is_{kind}")), comments["id"] == intents["comment_id"], "left_semi")
