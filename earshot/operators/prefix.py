"""Running counts and sums over a global order, without one window over all rows.

A two-level prefix scan. Rows are range-partitioned by key and order, and written:
slices of about equal size, whatever the key. Each slice is summed by key. What
comes before a slice concerns its least key alone, since every other key of a
slice begins in it: so the offsets are at most one row a slice, and are
broadcast. A window over each slice adds what lies before a row there. A key
with any share of all rows is thus spread over as many slices as it fills.

Defined results: null keys are one key, null orders come where the order says;
null amounts count as 0; rows that are equal in key and order follow each other
in any order (give an order that tells rows apart if that matters); an empty
table gives none. Columns named as the working ones below are an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

_SLICE, _OFFSET = "_slice", "_before"


def scan(rows: DataFrame, order: Sequence[str | Column], *, keys: Sequence[str] = (), number: str | None = None, sums: Mapping[str, str] | None = None, slices: int | None = None) -> DataFrame:
    """Adds `number` (1, 2, .. in order within the keys) and, for each name of `sums`, the running total of that column up to the row.

    The ranged rows are written to the shared folder, so ranges are drawn once and a lost executor costs a re-read.
    """
    sums = dict(sums or {})
    if taken := {_SLICE, _OFFSET, *sums, *([number] if number else [])} & set(rows.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    spark = rows.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    path = scratch(spark, "prefix")
    rows.repartitionByRange(count, *by).withColumn(_SLICE, F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    amounts = {**({number: F.lit(1)} if number else {}), **{name: F.coalesce(F.col(c), F.lit(0)) for name, c in sums.items()}}
    return _add(held, before(held, keys, amounts), by[len(keys):], keys, amounts)


def before(held: DataFrame, keys: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    """What lies in earlier slices, for those keys of a slice that began there: one row a slice at most."""
    parts = held.groupBy(_SLICE, *keys).agg(*(F.sum(a).alias(n) for n, a in amounts.items()))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.select(_SLICE, *keys, F.struct(*(F.sum(n).over(earlier).alias(n) for n in amounts)).alias(_OFFSET))
    return summed.filter(F.col(_OFFSET)[next(iter(amounts))].isNotNull())


def _add(held: DataFrame, offsets: DataFrame, order: Sequence[Column], keys: Sequence[str], amounts: Mapping[str, Column]) -> DataFrame:
    renamed = offsets.select(F.col(_SLICE).alias("_of"), *(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), _OFFSET)
    same = held[_SLICE] == renamed["_of"]
    for i, k in enumerate(keys):
        same &= held[k].eqNullSafe(renamed[f"_key{i}"])
    joined = held.join(F.broadcast(renamed), same, "left")
    upto = Window.partitionBy(_SLICE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = {n: F.coalesce(F.col(_OFFSET)[n], F.lit(0)) + F.sum(a).over(upto) for n, a in amounts.items()}
    return joined.select(*(c for c in held.columns if c != _SLICE), *(t.alias(n) for n, t in totals.items()))
