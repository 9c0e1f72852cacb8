"""Adapters from stored tables and API payloads to the engine's records.

Order matters to the engine, so every corpus carries ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schemas import EVAL_CASE

#: What an event type says.
EVENT_SENTIMENT = {"purchase": "strongly_positive", "signup": "positive", "view": "neutral", "click": "negative", "error": "critical_escalation"}
MOODS = ("positive", "negative", "neutral", "mixed")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, video_id, timestamp, sentiment, confidence out of the event stream."""
    known = F.create_map(*(F.lit(x) for pair in EVENT_SENTIMENT.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("v"), (F.col("user_id") % 20).cast("string")).alias("video_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        known[F.col("event_type")].alias("sentiment"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
    )


def document_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pos, text, video_id, platform, timestamp out of the documents."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text", F.col("source").alias("video_id"), F.col("lang").alias("platform"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("timestamp"),
    )


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top comment and an array of replies for each conversation."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("c"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("all")).select("conv_id", F.get("all", 0).alias("top"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("replies"))


def flatten_threads(nested: DataFrame) -> DataFrame:
    """One row for the top comment and one for each reply; a thread without replies keeps its top."""
    flat = nested.select("conv_id", F.posexplode(F.concat(F.array("top"), F.coalesce("replies", F.expr("slice(array(top), 2, 1)")))).alias("at", "c"))
    return flat.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("c.turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("video_id"), F.col("c.role").alias("author_handle"), F.col("c.text").alias("text"), (F.col("at") > 0).alias("is_reply"))


def from_snippets(raw: DataFrame) -> DataFrame:
    """API snippets (id, video_id, snippet STRUCT, is_reply) to comments; rows without text go."""
    s = F.col("snippet")
    body = F.coalesce(F.nullif(s["textOriginal"], F.lit("")), F.nullif(s["textDisplay"], F.lit("")))
    picked = raw.select("id", F.lit("youtube").alias("platform"), body.alias("text"), s["authorDisplayName"].alias("author_handle"), s["authorChannelId"]["value"].alias("author_id"), F.coalesce(F.to_timestamp(s["publishedAt"]), F.current_timestamp()).alias("timestamp"), "video_id", F.coalesce(s["likeCount"], F.lit(0)).cast("int").alias("like_count"), "is_reply").filter("text is not null")
    return X.clean_urls(picked).withColumn("text", X.sanitize(F.col("text")))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """The labelled evaluation set, one JSON array, with the ids that predictions go by; a label outside the domain is an error."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(EVAL_CASE)).alias("all"))
    cases = text.select(F.posexplode("all").alias("case_no", "c")).select(F.col("case_no").cast("bigint").alias("case_no"), F.format_string("eval-%03d", "case_no").alias("comment_id"), "c.*")
    bad = cases.filter(~F.coalesce(F.col("expected_mood").isin(*MOODS), F.lit(False))).limit(5).collect()
    if bad:
        raise ValueError(f"labels outside {MOODS}: {[r['expected_mood'] for r in bad]}")
    return cases
