"""From labelled, embedded comments to a report whose every quote is in its source."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clustering, filtering, mood, prefix, quotes
from ..operators.models import offline_synthesis
from ..schemas import QUOTES
from ..session import scratch, side_by_side

#: What a draft may also say.
HINTS = {"request": "suggested_title", "confusion": "timestamp_hint"}
KEYS = {"request": "theme", "confusion": "sticking_point", "mood": "top_negative_driver"}


def verbatim(quotes, texts):
    """Column: every quote is part of some text, case and all; without texts there is nothing to hold them against."""
    return F.when(texts.isNull(), F.lit(True)).otherwise(F.forall(quotes, lambda q: F.exists(texts, lambda t: F.contains(t, q))))


def shaped_draft(kind: str, answer: str) -> dict | None:
    """A draft whose shape is right; None otherwise."""
    try:
        draft = json.loads(answer)
        quotes = draft["quotes"]
        low, high = QUOTES[kind]
        fine = isinstance(draft[KEYS[kind]], str) and isinstance(quotes, list) and low <= len(quotes) <= high and all(isinstance(q, str) for q in quotes)
    except (ValueError, TypeError, KeyError):
        return None
    return draft if fine else None


def checked_draft(kind: str, answer: str, texts: list[str]) -> dict | None:
    """A draft whose shape is right and whose quotes are all verbatim; None otherwise."""
    draft = shaped_draft(kind, answer)
    return draft if draft and all(any(q in t for t in texts) for q in draft["quotes"]) else None


def synthesize(groups: DataFrame, kind: str, write: Callable[[str, list[str]], str] = offline_synthesis, *, prompt_rows: int = 500) -> DataFrame:
    """(group, kind, headline, quotes, mention_count) of each group of (group, pos, text); a failed or invalid draft gives no row.

    A call takes at most prompt_rows texts, and all texts of a group are put to the model: a group of more is drafted in
    slices, and then once more from what the slices' drafts quote, in as many rounds as it takes. mention_count is that
    of the whole group, and quotes are held against all its texts.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("at")["text"].tolist()
        try:
            draft = shaped_draft(kind, write(kind, texts))
        except Exception:  # noqa: BLE001  one failed group doesn't fail the report
            draft = None
        hint = draft and draft.get(HINTS.get(kind))
        rows = [] if draft is None else [(pdf["group"].iloc[0], int(pdf["slice"].iloc[0]), draft[KEYS[kind]], draft["quotes"], hint if isinstance(hint, str) else None)]
        return pd.DataFrame(rows, columns=["group", "slice", "headline", "quotes", "hint"])

    if prompt_rows < 10:
        raise ValueError("slices of 10 texts at least: a round must leave fewer texts than it took")
    named = groups.select(F.col("group").cast("string").alias("group"), "pos", "text")
    numbered = prefix.scan(named, ["pos", "text"], keys=["group"], number="at")  # written; a group fills as many slices as it needs
    held = _stored(numbered.select("group", "at", "text"), "synthesis-texts")
    rest, finals = held, []
    while True:
        sliced = rest.withColumn("slice", F.floor((F.col("at") - 1) / prompt_rows))
        drafts = _stored(sliced.groupBy("group", "slice").applyInPandas(run, "group string, slice long, headline string, quotes array<string>, hint string"), "synthesis-drafts")
        more = sliced.groupBy("group").agg(F.max("slice").alias("last")).filter("last > 0").select("group")
        several = _stored(more, "synthesis-groups")
        finals.append(drafts.join(several, "group", "left_anti"))
        if several.isEmpty():
            break
        said = drafts.join(several, "group").select("group", "slice", F.posexplode("quotes").alias("nth", "text"))
        rest = prefix.scan(said, ["slice", "nth"], keys=["group"], number="at").select("group", "at", "text")
    final = finals[0]
    for part in finals[1:]:
        final = final.unionByName(part)
    asked = final.select("group", "headline", "quotes", "hint", F.explode_outer("quotes").alias("quote"))
    met = quotes.find(asked, held, by=["group"]).withColumn("found", F.lit(True))
    size = held.groupBy("group").agg(F.count("*").alias("mention_count"))
    judged = asked.join(met, ["group", "quote"], "left").groupBy("group", "headline", "quotes", "hint").agg(F.bool_and(F.col("quote").isNull() | F.coalesce("found", F.lit(False))).alias("sound"))
    hints = [F.when(F.lit(kind == k), F.col("hint")).alias(name) for k, name in HINTS.items()]
    return judged.filter("sound").join(size, "group").select("group", F.lit(kind).alias("kind"), "headline", "quotes", "mention_count", *hints)


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Written and read again, so that a model's answer is asked for once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clustered(comments: DataFrame, embeddings: DataFrame, *, most: int = 3) -> DataFrame:
    """(group, pos, text) of the biggest clusters of at least two comments."""
    own = comments.join(embeddings, comments["id"] == embeddings["comment_id"])
    assigned = clustering.cluster_all(own, id_col="id", vector="vector", clusters=lambda n: 1 if n < 2 else max(1, min(most, n // 2)))
    labelled = comments.join(assigned, "id")
    return labelled.join(clustering.biggest(labelled, most=most).select("cluster_id"), "cluster_id").select(F.col("cluster_id").alias("group"), "pos", "text")


def report(comments: DataFrame, sentiments: DataFrame, intents: DataFrame, embeddings: DataFrame, *, titles: DataFrame | None = None, write: Callable[[str, list[str]], str] = offline_synthesis) -> DataFrame:
    """Requests, confusion points and the videos that landed badly, one row each; these with title, score and delta."""
    def said(kind: str) -> DataFrame:
        return synthesize(clustered(filtering.candidates(comments, intents, kind), embeddings), kind, write)

    labelled = comments.join(sentiments, comments["id"] == sentiments["comment_id"])
    worst = mood.underperforming(labelled.drop("text"))

    def driven() -> DataFrame:
        sample = mood.driver_sample(labelled.drop("text").join(worst.select("video_id"), "video_id", "left_semi"))
        texts = comments.select("id", "pos", "text").join(F.broadcast(sample.select("id", "pos", F.col("video_id").alias("group"))), ["id", "pos"])  # 20 a video
        return synthesize(texts.select("group", "pos", "text"), "mood", write)

    *parts, driven = side_by_side(comments.sparkSession, lambda: said("request"), lambda: said("confusion"), driven)
    named = mood.with_titles(worst, titles) if titles is not None else worst.withColumn("title", F.col("video_id"))
    # a video without a valid draft keeps its numbers
    moods = named.select(F.col("video_id").alias("group"), "title", F.col("video_avg").alias("score"), "delta").join(driven.drop("kind"), "group", "left").withColumn("kind", F.lit("mood"))
    return parts[0].unionByName(parts[1]).unionByName(moods, allowMissingColumns=True)
