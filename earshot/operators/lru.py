"""Time to live under a bounded memory, exactly, over many partitions.

The rule is one fold over all rows in order of time: at most ``capacity``
fingerprints are on record, and the least recently met goes first. What a slice of
the rows does depends on the rest only through the memory it begins with, so
slices are worked on side by side from guessed memories, and again where a guess was wrong:

1. Rows are range-partitioned by time and written: slices, whatever the fingerprint.
2. The guess. Each fingerprint is folded alone, as if memory had no bound, and leaves its
   last sighting in each slice; a slice's ``capacity`` latest are merged, slice after
   slice, into the memory at each slice's beginning. That is right wherever no record
   that went would have been met again in time.
3. Every slice is folded from its guess and gives the memory at its end. Where the next
   slice began with another one, it takes that and is folded again, until none differs.
   The first slice begins with nothing, so each round settles one slice more at least,
   and the result is the fold's, whatever the guess was.
4. The rows are read once more and marked.

A task holds one memory. In step 2 a fingerprint's sightings stream through one task in constant memory, as in dedup.ttl(). The merge in step 2 streams through one task: slices times
capacity rows at most, both of them parameters, however many rows there are.

Defined results: a null fingerprint is one fingerprint; a row without a time comes first, is fresh and
leaves no record; rows that are equal in time are taken by ``pos``, rows that are equal in both
in any order; an empty table gives none; columns named as the working ones below are an error.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch
from .dedup import fold

_WORKING = ("_slice", "_at", "_rank", "_key", "_record")


class Memory:
    """The fold over all rows: what is on record, the least recently met first."""

    def __init__(self, capacity: int, seconds: float):
        self.records: OrderedDict = OrderedDict()
        self.capacity, self.seconds = capacity, seconds

    def load(self, key, recorded: float) -> None:
        self.records[key] = recorded

    def put(self, key, recorded: float | None) -> None:
        if recorded is None:
            self.records.pop(key, None)
            return
        self.records[key] = recorded
        self.records.move_to_end(key)
        if len(self.records) > self.capacity:
            self.records.popitem(last=False)

    def meet(self, key, at: float | None) -> bool:
        if at is None:
            return True
        recorded, fresh = fold(self.records.get(key), at, self.seconds)
        self.put(key, recorded)
        return fresh


def exact_lru(rows: DataFrame, *, fingerprint: str, at: str, pos: str, seconds: float, capacity: int = 10_000, slices: int | None = None) -> DataFrame:
    """Adds `fresh`: as dedup.ttl(), with at most `capacity` records."""
    if taken := {*_WORKING, "fresh"} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    if capacity < 1:
        raise ValueError("a memory of no record")
    spark = rows.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    timed = rows.withColumn("_at", F.col(at).cast("timestamp").cast("double"))
    held = _written(timed.repartitionByRange(count, "_at", pos).withColumn("_slice", F.spark_partition_id()), "lru-rows")
    sightings = held.select("_slice", "_at", pos, F.col(fingerprint).alias("_key"))
    starts = _written(_guess(sightings, pos, seconds, capacity), "lru-starts")
    wrong: list[int] | None = None
    while wrong is None or wrong:
        some = (lambda df: df) if wrong is None else (lambda df, wrong=wrong: df.filter(F.col("_slice").isin(wrong)))
        ends = _written(_fold(some(sightings), some(starts), pos, seconds, capacity, count), "lru-ends")
        wrong = _differing(ends, starts if wrong is None else starts.filter(F.col("_slice").isin([w + 1 for w in wrong])), count)
        if wrong:
            given = ends.withColumn("_slice", F.col("_slice") + 1).filter(F.col("_slice").isin(wrong))
            starts = _written(starts.filter(~F.col("_slice").isin(wrong)).unionByName(given), "lru-starts")
    return _marked(held, starts, rows, fingerprint, pos, seconds, capacity, count)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _states(key: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("_slice", T.IntegerType()), T.StructField("_rank", T.LongType()), T.StructField("_key", key), T.StructField("_record", T.DoubleType())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _guess(sightings: DataFrame, pos: str, seconds: float, capacity: int) -> DataFrame:
    """The memory that each slice begins with if no record that went is met again in time."""
    kept = sightings.filter("_at IS NOT NULL").select("_slice", "_at", pos, "_key")
    left = T.StructType([*kept.schema.fields, T.StructField("_record", T.DoubleType())])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, recorded, row = None, None, None
        for batch in batches:
            out = []
            for now in zip(*(c.to_pylist() for c in batch.columns)):
                if row is not None and (now[3] != row[3] or now[0] != row[0]):
                    out.append((*row, recorded))
                if row is None or now[3] != row[3]:
                    recorded = None
                recorded, _ = fold(recorded, now[1], seconds)
                row = now
            last = pa.schema([*batch.schema, pa.field("_record", pa.float64())])
            yield _batch(out, last)
        if row is not None:
            yield _batch([(*row, recorded)], last)

    latest = kept.repartition("_key").sortWithinPartitions("_key", "_at", pos).mapInArrow(alone, left)
    recent = Window.partitionBy("_slice").orderBy(F.desc("_at"), F.desc(pos))
    top = latest.withColumn("_rank", F.row_number().over(recent)).filter(F.col("_rank") <= capacity).select("_slice", "_at", pos, "_key", "_record")
    schema = _states(sightings.schema["_key"].dataType)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, at = Memory(capacity, seconds), None
        shape = None
        for batch in batches:
            shape = shape or pa.schema([("_slice", pa.int32()), ("_rank", pa.int64()), ("_key", batch.schema.field("_key").type), ("_record", pa.float64())])
            for s, key, recorded in zip(*(batch.column(c).to_pylist() for c in ("_slice", "_key", "_record"))):
                if at is not None and s != at:
                    for begun in range(at + 1, s + 1):
                        yield _batch([(begun, k, *x) for k, x in enumerate(memory.records.items())], shape)
                at = s
                memory.put(key, recorded)

    return top.repartition(1).sortWithinPartitions("_slice", "_at", pos).mapInArrow(merge, schema)


def _ordered(sightings: DataFrame, starts: DataFrame, pos: str, count: int) -> DataFrame:
    """Each slice's memory, then its rows in order."""
    return sightings.unionByName(starts, allowMissingColumns=True).repartition(count, "_slice").sortWithinPartitions("_slice", F.asc_nulls_last("_rank"), "_at", pos)


def _fold(sightings: DataFrame, starts: DataFrame, pos: str, seconds: float, capacity: int, count: int) -> DataFrame:
    """The memory at the end of each slice."""
    lean = _ordered(sightings, starts, pos, count).select("_slice", "_rank", "_at", "_key", "_record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, at, shape = Memory(capacity, seconds), None, None
        for batch in batches:
            shape = shape or pa.schema([batch.schema.field(c) for c in ("_slice", "_rank", "_key", "_record")])
            for s, rank, t, key, recorded in zip(*(c.to_pylist() for c in batch.columns)):
                if s != at:
                    if at is not None:
                        yield _batch([(at, k, *x) for k, x in enumerate(memory.records.items())], shape)
                    memory, at = Memory(capacity, seconds), s
                if rank is None:
                    memory.meet(key, t)
                else:
                    memory.load(key, recorded)
        if at is not None:
            yield _batch([(at, k, *x) for k, x in enumerate(memory.records.items())], shape)

    return lean.mapInArrow(run, _states(sightings.schema["_key"].dataType))


def _differing(ends: DataFrame, begun: DataFrame, count: int) -> list[int]:
    """Slices that began with another memory than the one before them ended with: slices' numbers only reach the driver."""
    given = ends.select((F.col("_slice") + 1).alias("_slice"), "_rank", F.struct("_key", "_record").alias("given")).filter(F.col("_slice") < count)
    both = given.join(begun.select("_slice", "_rank", F.struct("_key", "_record").alias("begun")), ["_slice", "_rank"], "full")
    return sorted(r["_slice"] for r in both.filter(~F.col("given").eqNullSafe(F.col("begun"))).select("_slice").distinct().collect())


def _marked(held: DataFrame, starts: DataFrame, rows: DataFrame, fingerprint: str, pos: str, seconds: float, capacity: int, count: int) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("fresh", T.BooleanType())])
    whole, names = _ordered(held, starts, pos, count), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, at = Memory(capacity, seconds), None
        for batch in batches:
            fresh, of_rows = [], []
            for s, rank, t, own, key, recorded in zip(*(batch.column(c).to_pylist() for c in ("_slice", "_rank", "_at", fingerprint, "_key", "_record"))):
                if s != at:
                    memory, at = Memory(capacity, seconds), s
                of_rows.append(rank is None)
                if rank is None:
                    fresh.append(memory.meet(own, t))
                else:
                    memory.load(key, recorded)
            kept = batch.filter(pa.array(of_rows, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(fresh, pa.bool_())], schema=pa.schema([*(kept.schema.field(c) for c in names), pa.field("fresh", pa.bool_())]))

    return whole.mapInArrow(run, schema)
