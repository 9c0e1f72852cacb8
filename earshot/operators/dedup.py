"""Duplicate removal by fingerprint: first sighting, time to live, bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def first_seen(comments: DataFrame, fingerprint: str = "fp") -> DataFrame:
    """The least pos of each fingerprint; a hot fingerprint is combined before it is shuffled."""
    firsts = comments.groupBy(fingerprint).agg(F.min("pos").alias("first_pos"), F.count("*").alias("copies"))
    return firsts


def keep_first(comments: DataFrame, fingerprint: str = "fp") -> DataFrame:
    firsts = comments.groupBy(fingerprint).agg(F.min("pos").alias("pos")).select("pos")
    return comments.join(firsts, "pos", "left_semi")


def fold(recorded: float | None, at: float, ttl: float) -> tuple[float | None, bool]:
    """One sighting: what is on record afterwards, and whether it is fresh.

    A sighting within the time to live is a duplicate and renews nothing; a
    later one clears the record and is fresh, so the next is fresh as well.
    """
    if recorded is None:
        return at, True
    if at - recorded < ttl:
        return recorded, False
    return None, True


def ttl(rows: DataFrame, *, key: str, at: str, pos: str, seconds: float) -> DataFrame:
    """Adds `fresh`. Rows stream through by key in order of time; a key has one number of state."""
    schema = T.StructType([*rows.schema.fields, T.StructField("fresh", T.BooleanType())])
    place = {c: rows.columns.index(c) for c in (key, at)}
    timed = rows.withColumn("_at", F.col(at).cast("timestamp").cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, recorded = object(), None
        for batch in batches:
            fresh = []
            for k, t in zip(batch.column(place[key]).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if k != last:
                    last, recorded = k, None
                recorded, new = fold(recorded, t, seconds)
                fresh.append(new)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fresh, pa.bool_())], schema=pa.schema([*list(batch.schema)[:-1], pa.field("fresh", pa.bool_())]))

    return timed.repartition(key).sortWithinPartitions(key, "_at", pos).mapInArrow(run, schema)


def by_mode(rows: DataFrame, mode: str = "batch", *, fingerprint: str = "fp", pos: str = "pos", at: str | None = None, seconds: float = 86400) -> DataFrame:
    """The rows that are fresh, by the rule that a setting names: batch (first sighting), ttl, or exact_lru."""
    if mode == "batch":
        return keep_first(rows, fingerprint)
    from .lru import exact_lru  # which folds as this module does

    rules = {"ttl": lambda: ttl(rows, key=fingerprint, at=at, pos=pos, seconds=seconds), "exact_lru": lambda: exact_lru(rows, fingerprint=fingerprint, at=at, pos=pos, seconds=seconds)}
    if mode not in rules:
        raise ValueError(f"no dedup mode {mode!r}")
    if at is None:
        raise ValueError(f"dedup mode {mode!r} needs the time of a row")
    return rules[mode]().filter("fresh").drop("fresh", "_at")
