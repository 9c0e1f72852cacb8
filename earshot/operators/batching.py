"""Batched labelling with a guard: positions become batches, batches become JSON, answers are checked or split.

The split runs inside the worker that holds the batch. A Spark task retry would repeat calls that were paid for, so
a stage is given a log of its batches (checkpoints.StageLog).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EMBEDDING, INTENT, INTENTS, SENTIMENT, SENTIMENTS
from . import checkpoints, prefix
from .calls import Bucket, pooled

ITEMS = {"sentiment": SENTIMENT, "intent": INTENT}


def dense_pos(comments: DataFrame, by: str = "pos") -> DataFrame:
    """Adds `at`, 0.. in order of `by`."""
    return prefix.scan(comments, [by], number="_nth").withColumn("at", F.col("_nth") - 1).drop("_nth")


def positional(comments: DataFrame, size: int, by: str = "pos") -> DataFrame:
    """Adds batch_start (0, size, 2 size ..), the batch's key as text, and the alias in the batch."""
    at = dense_pos(comments, by)
    return at.withColumn("batch_start", F.col("at") - F.col("at") % size).withColumn("batch_key", F.col("batch_start").cast("string")).withColumn("alias", (F.col("at") % size).cast("string"))


def payloads(batched: DataFrame) -> DataFrame:
    """One JSON array of {comment_id: alias, text} for each batch; a batch is of bounded size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("alias").cast("int").alias("n"), "text"))), lambda s: F.struct(s["n"].cast("string").alias("comment_id"), s["text"].alias("text")))
    return batched.groupBy("batch_key").agg(F.to_json(items).alias("payload"))


def guard(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """batch_key, n_in, n_out, ok: the answer has every alias once and no other."""
    marked = asked.select("batch_key", "alias", F.lit(1).alias("asked"), F.lit(0).alias("said")).unionByName(answered.select("batch_key", "alias", F.lit(0).alias("asked"), F.lit(1).alias("said")))
    per_alias = marked.groupBy("batch_key", "alias").agg(F.sum("asked").alias("asked"), F.sum("said").alias("said"))
    return per_alias.groupBy("batch_key").agg(F.sum("asked").alias("n_in"), F.sum("said").alias("n_out"), F.bool_and((F.col("asked") == 1) & (F.col("said") == 1)).alias("ok"))


def _valid(kind: str, item) -> bool:
    if not isinstance(item, dict) or not isinstance(item.get("comment_id"), str):
        return False
    if kind == "sentiment":
        c = item.get("confidence")
        return item.get("sentiment") in SENTIMENTS and isinstance(c, (int, float)) and not isinstance(c, bool) and 0 <= c <= 1
    return item.get("intent") in INTENTS and isinstance(item.get("is_request"), bool) and isinstance(item.get("is_confusion"), bool)


def parse(kind: str, answer: str) -> list[dict] | None:
    """The items of an answer; None for anything that isn't a valid one."""
    try:
        items = json.loads(answer)["results"]
    except (ValueError, TypeError, KeyError):
        return None
    return items if isinstance(items, list) and all(_valid(kind, i) for i in items) else None


def label_batch(provider, kind: str, rows: list[tuple[str, str]], *, depth: int = 0, deepest: int = 16) -> list[dict]:
    """Items with the real ids. A wrong answer splits the batch in halves; a wrong answer for one text is an error."""
    if not rows:
        return []
    items = parse(kind, provider.label([(str(k), text) for k, (_, text) in enumerate(rows)]))
    wanted = {str(k): real for k, (real, _) in enumerate(rows)}
    if items is not None and len(items) == len(rows) and {i["comment_id"] for i in items} == set(wanted):
        return [i | {"comment_id": wanted[i["comment_id"]]} for i in items]
    if len(rows) == 1 or depth >= deepest:
        raise ValueError(f"no valid {kind} label for {rows[0][0]!r}")
    half = len(rows) // 2
    return [*label_batch(provider, kind, rows[:half], depth=depth + 1), *label_batch(provider, kind, rows[half:], depth=depth + 1)]


def classify(comments: DataFrame, provider, kind: str, *, size: int = 50, **calls) -> DataFrame:
    """Labels of all comments (id, text, pos); `calls` as called() takes them."""

    def work(rows: list[tuple[str, str]]) -> list[dict]:
        return label_batch(provider, kind, rows)

    return called(comments, work, ITEMS[kind], size=size, **calls)


def ordered_vectors(answer: str, n: int) -> list[list[float]]:
    """The vectors of an answer {"data": [{index, embedding}]} in the order of the texts; a missing, surplus or doubled one is an error."""
    items = sorted(json.loads(answer)["data"], key=lambda i: i["index"])
    if [i["index"] for i in items] != list(range(n)):
        raise ValueError(f"{len(items)} embeddings for {n} texts")
    return [[float(x) for x in i["embedding"]] for i in items]


def embed(comments: DataFrame, provider, *, size: int = 100, **calls) -> DataFrame:
    """(comment_id, vector) of all comments (id, text, pos), a call for each `size` of them; no comment, no call.

    Vectors of another width than the first of their batch are an error; hold the whole with one_width().
    """

    def work(rows: list[tuple[str, str]]) -> list[dict]:
        vectors = ordered_vectors(provider.embed([text for _, text in rows]), len(rows))
        if len({len(v) for v in vectors}) > 1:
            raise ValueError(f"embeddings of {sorted({len(v) for v in vectors})} numbers in one answer")
        return [{"comment_id": real, "vector": v} for (real, _), v in zip(rows, vectors)]

    return called(comments, work, EMBEDDING, size=size, **calls)


def called(comments: DataFrame, work: Callable[[list[tuple[str, str]]], list[dict]], item: T.StructType, *, size: int, log: checkpoints.StageLog | None = None, partitions: int | None = None, at_once: int = 8, per_second: float | None = None) -> DataFrame:
    """The items that work((id, text) rows of a batch) gives for all batches of `size` comments (id, text, pos).

    Every task keeps `at_once` calls in flight, at most per_second of them a second. With a log each batch is checkpointed, and
    only those are called for that have no completed row; without one the frame is a plain plan that calls when it runs.
    """
    batched = positional(comments.select("id", "text", "pos"), size).select("id", "text", "at", "batch_start")
    bucket = (lambda: Bucket(per_second)) if per_second else None
    if log is not None:
        done = log.run(batched, "batch_start", _by_batch, work, deal=lambda rows: _dealt(rows, partitions), at_once=at_once, bucket=bucket)
        return checkpoints.results(done, item)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in pooled((rows for _, rows in _by_batch(frames)), work, at_once=at_once, bucket=bucket() if bucket else None):
            yield pd.DataFrame(rows, columns=item.names)

    return _dealt(batched, partitions).mapInPandas(run, item)


def one_width(vectors: DataFrame, vector: str = "vector") -> int | None:
    """The width that all vectors have; more than one is an error, none is None."""
    low, high = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"embeddings of {low} to {high} numbers")
    return low


def _by_batch(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[tuple[str, str]]]]:
    """(key, (id, text) rows) of each batch, of rows sorted by batch."""
    key, held = None, []
    for frame in frames:
        for real, text, start in zip(frame["id"], frame["text"], frame["batch_start"]):
            if start != key:
                if held:
                    yield str(key), held
                key, held = start, []
            held.append((real, text or ""))
    if held:
        yield str(key), held


def _dealt(batched: DataFrame, partitions: int | None) -> DataFrame:
    """Whole batches in a partition, in order."""
    parts = partitions or int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batched.repartition(parts, "batch_start").sortWithinPartitions("batch_start", "at").select("id", "text", "batch_start")


def vector_widths(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """The distinct widths: exactly one is expected."""
    return vectors.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
