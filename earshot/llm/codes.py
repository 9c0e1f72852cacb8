"""Product quantisation of vectors in integers, with conservative filters in place of most distances.

A vector's components x become floor(``scale`` * x); it is cut into ``n_parts``
equal consecutive parts, and each part is named by the nearest of
``n_entries`` codebook entries (squared Euclidean distance, ties to the lower
index). Codebooks start as the parts of the vectors of least id and are improved
by ``rounds`` of assignment and componentwise mean, rounded down; an entry that
no part is assigned to stays.

Nearest entries are found coarse to fine. A vector and an entry cut into blocks,
with block means m and residual norms r, are at least
sum(block length * (m_x - m_c)^2) + (r_x - r_c)^2 apart (the residuals are
orthogonal to the means; then the triangle inequality). For 1, 2, 4, .. blocks
those entries whose bound is above the exact distance of the entry of least bound so far are
dropped, which can't lose the nearest or a tie; survivors get exact integer
distances. Bounds are made in floating point and lowered by more than its error.

The integer vectors are written once as packed int32; a round is one map over
them and a sum of at most n_parts * n_entries rows a task. The driver holds
the codebooks alone.

Defined results: vectors that are null, or hold null or non-finite components,
are dropped, as are those of another length than most have (of several such
lengths the least); a length that n_parts doesn't divide is filled up
with zeros; components beyond what keeps a squared distance within 63 bits are
cut to that (over half a million at 64 parts of 8); repeated and null ids are rows like
others, null ids come last; with fewer than n_entries vectors there are as many
entries; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, drop_table, lean, materialize, small_batches


def integers(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 8, scale: int = 4096) -> tuple[DataFrame, int]:
    """(vec_id, label, packed int32 components) of the kept vectors, written, and the length of a part."""
    small_batches(vectors.sparkSession)
    held = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    held = held.filter("v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    width = held.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = width["width"] if width else 0
    size = max(1, -(-width // n_parts))
    most = min(math.isqrt(((1 << 63) - 1) // size) // 2, (1 << 31) - 1)
    schema = T.StructType([held.schema["vec_id"], held.schema["label"], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            whole = np.zeros((batch.num_rows, size * n_parts), "<i4")
            whole[:, :width] = np.clip(np.floor(x * scale), -most, most)
            packed = pa.array([row.tobytes() for row in whole], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), packed], names=schema.names)

    return materialize(held.filter(F.size("v") == width).mapInArrow(lean(run), schema), "integer-vectors"), size


def _unpack(column: pa.Array, n_parts: int, size: int) -> np.ndarray:
    """Rows x parts x components."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, "<i4").astype(np.int64).reshape(len(column), n_parts, size)


def _levels(size: int) -> list[np.ndarray]:
    """Block bounds of each level: 1, 2, 4, .. blocks, while they have at least two components."""
    out, blocks = [], 1
    while blocks == 1 or size // blocks >= 2:
        out.append(np.linspace(0, size, blocks + 1).astype(np.int64))
        blocks *= 2
    return out


def summarise(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x: the block means times the root of the block's length, and the norm of what the means leave."""
    length = np.diff(bounds).astype(float)
    sums = np.add.reduceat(x, bounds[:-1], axis=-1).astype(float)
    square = (x.astype(float) ** 2).sum(-1)
    means = sums / np.sqrt(length)
    return means, np.sqrt(np.maximum(square - (means**2).sum(-1), 0.0))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of each row's nearest entry (the lower of equals), the exact squared distance, and how many distances it took."""
    rows = np.arange(len(x))
    alive = np.ones((len(x), len(entries)), bool)
    exact = np.full(alive.shape, np.iinfo(np.int64).max)

    def distances(r: np.ndarray, e: np.ndarray) -> None:
        exact[r, e] = ((x[r] - entries[e]) ** 2).sum(-1)

    upper, taken = None, 0
    for bounds in _levels(x.shape[-1]):
        (xm, xr), (cm, cr) = summarise(x, bounds), summarise(entries, bounds)
        r, e = np.nonzero(alive) if upper is not None else (np.repeat(rows, len(entries)), np.tile(np.arange(len(entries)), len(x)))
        bound = ((xm[r] - cm[e]) ** 2).sum(-1) + (xr[r] - cr[e]) ** 2
        norm = (x.astype(float) ** 2).sum(-1)[r] + (entries.astype(float) ** 2).sum(-1)[e]
        bound = bound * (1 - 1e-9) - 1e-9 * norm - 1.0  # below the true distance, whatever the rounding
        if upper is None:
            lowest = np.argmin(bound.reshape(alive.shape), 1)
            distances(rows, lowest)
            upper, taken = exact[rows, lowest].astype(float), len(x)
        alive[r, e] = bound <= upper[r] * (1 + 1e-12)
    r, e = np.nonzero(alive & (exact == np.iinfo(np.int64).max))
    distances(r, e)
    best = exact.argmin(1)  # the first of equals; entries that were dropped stand at the highest number
    return best, exact[rows, best], taken + len(r)


def first_codebooks(held: DataFrame, n_parts: int, size: int, n_entries: int) -> np.ndarray:
    """Parts x entries x components, from the vectors of least id."""
    rows = held.orderBy(F.asc_nulls_last("vec_id"), "packed").select("packed").limit(n_entries).collect()
    return np.stack([np.frombuffer(r["packed"], "<i4").astype(np.int64).reshape(n_parts, size) for r in rows], 1)


def improve(held: DataFrame, books: np.ndarray) -> np.ndarray:
    """A round: every part to its nearest entry, then each entry the mean of its parts, rounded down."""
    n_parts, n_entries, size = books.shape
    shared = held.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            x = _unpack(batch.column("packed"), n_parts, size)
            for p in range(n_parts):
                own, _, _ = nearest(x[:, p], books[p])
                np.add.at(total[p], own, x[:, p])
                count[p] += np.bincount(own, minlength=n_entries)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    summed = F.array(*(F.sum(F.get("sums", F.lit(k))) for k in range(size)))
    parts = held.select("packed").mapInArrow(lean(run), "part int, entry int, n long, sums array<long>")
    rows = parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), summed.alias("sums")).collect()  # at most one a codebook entry
    new = books.copy()
    for r in rows:
        new[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return new


def train(held: DataFrame, size: int, *, n_parts: int = 8, n_entries: int = 16, rounds: int = 6) -> np.ndarray | None:
    """The codebooks; None without a vector."""
    if held.isEmpty():
        return None
    books = first_codebooks(held, n_parts, size, n_entries)
    for _ in range(rounds):
        books = improve(held, books)
    return books


def encode(held: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): the entries' indexes in part order, two hex digits each, and the squared distances, summed."""
    n_parts, _, size = books.shape
    shared = held.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([held.schema["vec_id"], held.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            x = _unpack(batch.column("packed"), n_parts, size)
            code, error = np.zeros((len(x), n_parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(n_parts):
                code[:, p], far, _ = nearest(x[:, p], books[p])
                error += far
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], names=schema.names)

    return held.mapInArrow(lean(run), schema)


def decode(codes: DataFrame, books: np.ndarray, *, scale: int = 4096) -> DataFrame:
    """Adds `vector`: the middle of the cell that the entries of a code stand for, in the components' own unit."""
    flat = F.array(*(F.array(*(F.array(*(F.lit((int(v) + 0.5) / scale) for v in entry)) for entry in book)) for book in books))
    digit = lambda k: F.conv(F.substring("code", 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*(flat[k][digit(k)] for k in range(len(books)))))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error: errors added up by label (null is one), on written codes.

    Totals are made with partial sums, so a label of any share costs a row a task. They are broadcast if they are few; else
    those of labels with over one row in BROADCAST_ROWS are, of which there can't be more than that, and the others are shuffled.
    """
    totals = materialize(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors").withColumnRenamed("label", "of_label")
    on = codes["label"].eqNullSafe(F.col("of_label"))
    drop = ("of_label", "n")
    if totals.count() <= BROADCAST_ROWS:
        return codes.join(F.broadcast(totals), on, "left").drop(*drop)
    often = totals.filter(F.col("n") * BROADCAST_ROWS > totals.agg(F.sum("n")).first()[0])
    hot = codes.join(F.broadcast(often), on).drop(*drop)
    rest = codes.join(F.broadcast(often), on, "left_anti")
    return hot.unionByName(rest.join(totals.hint("shuffle_merge"), rest["label"].eqNullSafe(totals["of_label"])).drop(*drop))


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", n_parts: int = 8, n_entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray | None]:
    """The codes of all kept vectors with the error of each label, and the codebooks."""
    if not 1 <= n_entries <= 256:
        raise ValueError("an index is two hex digits: n_entries from 1 to 256")
    held, size = integers(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, n_parts=n_parts, scale=scale)
    books = train(held, size, n_parts=n_parts, n_entries=n_entries, rounds=rounds)
    if books is None:
        return held.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    codes = materialize(encode(held, books), "codes")
    drop_table(held)
    return with_label_error(codes), books
