"""Declared record types of the engine; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Label domains, and what a sentiment counts for.
SENTIMENTS = ("strongly_positive", "positive", "neutral", "negative", "critical_escalation")
SCORES = {"strongly_positive": 1.0, "positive": 0.5, "neutral": 0.0, "negative": -0.5, "critical_escalation": -1.0}
INTENTS = ("request", "confusion", "praise", "criticism", "other")
STAGES = ("ingestion", "stage_a_sentiment", "stage_a_embedding", "stage_b", "stage_c")
COARSE = ("positive", "negative", "neutral")
STATUSES = ("pending", "running", "completed", "failed", "cancelled")


def _fields(*pairs: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in pairs])


S, B, L, D, I = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.IntegerType()  # noqa: E741
COMMENT = _fields(("id", S, False), ("platform", S, False), ("text", S, False), ("author_handle", S, True), ("author_id", S, True), ("timestamp", T.TimestampType(), False), ("video_id", S, True), ("like_count", I, False), ("is_reply", B, False), ("pos", L, False))
SENTIMENT = _fields(("comment_id", S, False), ("sentiment", S, False), ("confidence", D, False))
INTENT = _fields(("comment_id", S, False), ("intent", S, False), ("is_request", B, False), ("is_confusion", B, False))
EMBEDDING = _fields(("comment_id", S, False), ("vector", T.ArrayType(D), False))
SENTIMENT_BATCH = T.StructType([T.StructField("results", T.ArrayType(SENTIMENT))])
INTENT_BATCH = T.StructType([T.StructField("results", T.ArrayType(INTENT))])
EVAL_CASE = _fields(("text", S, True), ("platform", S, True), ("expected_mood", S, True))
CHECKPOINT = _fields(("job_id", S, False), ("stage", S, False), ("batch_key", S, False), ("status", S, False), ("result", S, True), ("error", S, True), ("completed_at", T.TimestampType(), True))
REQUEST_INSIGHT = _fields(("theme", S, False), ("quotes", T.ArrayType(S), False), ("suggested_title", S, True), ("mention_count", L, False))
CONFUSION_INSIGHT = _fields(("sticking_point", S, False), ("quotes", T.ArrayType(S), False), ("timestamp_hint", S, True), ("mention_count", L, False))
MOOD_INSIGHT = _fields(("video_id", S, False), ("title", S, True), ("score", D, False), ("delta", D, False), ("driver", S, True), ("quotes", T.ArrayType(S), True))
#: How many quotes a draft may carry.
QUOTES = {"request": (2, 3), "confusion": (1, 5), "mood": (1, 3)}


def score(sentiment: Column) -> Column:
    out = F.when(sentiment == SENTIMENTS[0], SCORES[SENTIMENTS[0]])
    for label in SENTIMENTS[1:]:
        out = out.when(sentiment == label, SCORES[label])
    return out


def coarse(sentiment: Column) -> Column:
    """Five labels to three; null stays null."""
    return F.when(sentiment.isin("strongly_positive", "positive"), "positive").when(sentiment.isin("negative", "critical_escalation"), "negative").when(sentiment.isNotNull(), "neutral")


def valid_sentiment(item: Column) -> Column:
    return F.coalesce(item["comment_id"].isNotNull() & item["sentiment"].isin(*SENTIMENTS) & item["confidence"].between(0.0, 1.0), F.lit(False))


def valid_intent(item: Column) -> Column:
    return F.coalesce(item["comment_id"].isNotNull() & item["intent"].isin(*INTENTS) & item["is_request"].isNotNull() & item["is_confusion"].isNotNull(), F.lit(False))


def valid_quotes(quotes: Column, kind: str) -> Column:
    low, high = QUOTES[kind]
    return F.coalesce(F.size(quotes).between(low, high) & ~F.exists(quotes, lambda q: q.isNull()), F.lit(False))
