"""Importance resampling towards a target: hashed n-gram features, an external sort-count, and a draw with Gumbel noise.

Features are all runs of 1 to ``max_n`` words (of letters, digits and characters
beyond ASCII; only A-Z is lower-cased), joined by one space, repeats counted. A
feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``n_buckets`` (65,536
at most, so that a bucket fits 16 bits).

1. One pass over the texts writes their features as packed streams: a row holds
   the ids of some documents, the bounds of each in the stream, and the buckets
   as little-endian uint16. It is about a third of the text's size, and the
   texts are not read again.
2. Counting reads the streams alone: a task sorts a batch of streams (16-bit
   keys), run-length encodes them, and Spark adds the runs up, so at most
   n_buckets rows a task are shuffled and the driver gets n_buckets counts.
3. A bucket's gain is floor(1000 ln ((t + 1)(S + n_buckets) / ((s + 1)(T + n_buckets)))),
   where it holds t of the target's T features and s of the documents' S. A
   second pass over the streams gathers the gains and adds them up by document
   (np.add.reduceat); a document's weight is their mean, rounded down.
4. score = weight + floor(-1000 ln(-ln u)), where u is drawn from the SHA-256 of
   seed and id: the highest scores are a sample without replacement with
   probabilities in proportion to exp(weight / 1000). Ranks come from a prefix
   scan over the range-sorted scores; no task orders all rows.

Defined results: null and empty texts have no feature and weight 0; a null id
counts as an empty one in the hash and comes last among equal scores; repeated
rows are weighed each, and equal ones are ranked in any order; an empty table
gives none, an empty target gains from S alone; other columns are not read. A
text is worked on in parts of bounded size, cut between words; a word is never
cut, however long.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import prefix
from . import words
from .common import drop_table, lean, materialize, small_batches

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer features are hashed one by one, so a step of the loop over byte places never serves a handful of them.
_LONG = 48


@functools.cache
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of bytes: a table step for the k-th byte of all spans that have one."""
    table, size = _crc_table(), ends - starts
    order = np.argsort(-size, kind="stable")
    at, length = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longer = int(np.searchsorted(-length, -_LONG, side="left"))
    for k in range(longer):
        crc[k] = zlib.crc32(data[at[k] : at[k] + length[k]]) ^ 0xFFFFFFFF
    for k in range(int(length[longer]) if longer < len(length) else 0):
        n = int(np.searchsorted(-length, -k, side="left"))  # spans of more than k bytes
        part = crc[longer:n]
        crc[longer:n] = table[(part ^ data[at[longer:n] + k]) & 0xFF] ^ (part >> np.uint32(8))
    out = np.empty(len(crc), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _parts(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of parts of about `most` bytes that end where no word does."""
    at = 0
    while at < len(data):
        end = min(at + most, len(data))
        if end < len(data) and _WORD[data[end]] and _WORD[data[end - 1]]:
            gaps = np.flatnonzero(~_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            while end < len(data) and not len(gaps):  # a word longer than a part: on to its end
                gaps = np.flatnonzero(~_WORD[data[end : end + most]])
                end = end + int(gaps[0]) if len(gaps) else min(end + most, len(data))
        yield at, end
        at = end


def features(texts: list[str], *, max_n: int = 1, n_buckets: int = 10_000, part: int = words.CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (uint16) of all features, text after text; where each text's begin (one more entry); words of each text."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
    text_ends = np.cumsum(np.fromiter((len(e) + 1 for e in encoded), np.int64, len(encoded)))
    n_words = np.zeros(len(texts), np.int64)
    found, owners = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
    kept, kept_owner = b"", np.zeros(0, np.int64)  # the last max_n - 1 words, for runs that go on in the next part
    for lo, hi in _parts(data, part):
        inside = np.concatenate([[False], _WORD[data[lo:hi]], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        owner = np.searchsorted(text_ends, starts + lo, side="right")
        n_words += np.bincount(owner, minlength=len(texts))
        if max_n == 1:
            found.append((crc32(_LOWER[data[lo:hi]], starts, ends) % n_buckets).astype(np.uint16))
            owners.append(owner)
            continue
        # the words anew, one space after each, behind those that were kept
        low, size = _LOWER[data[lo:hi]], ends - starts
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        spaced = np.full(int(begin[-1]), 32, np.uint8)
        spaced[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[_WORD[low]]
        spaced = np.concatenate([np.frombuffer(kept, np.uint8), spaced])
        stops = np.flatnonzero(spaced == 32)
        first, of = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops, np.concatenate([kept_owner, owner])
        before = len(kept_owner)
        for n in range(1, max_n + 1):
            last = np.arange(max(before, n - 1), len(stops))
            last = last[of[last - n + 1] == of[last]]
            found.append((crc32(spaced, first[last - n + 1], stops[last]) % n_buckets).astype(np.uint16))
            owners.append(of[last])
        keep = min(max_n - 1, len(stops))
        kept, kept_owner = (spaced[first[-keep] :].tobytes(), of[-keep:]) if keep else (b"", of[:0])
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    if max_n > 1:
        buckets = buckets[np.argsort(owner, kind="stable")]
    return buckets, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]), n_words


def streams(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, n_buckets: int = 10_000) -> DataFrame:
    """The packed streams: rows of (ids, bounds, n_words, stream), each of about a quarter of a million characters of text or of one longer text."""
    if not 1 <= n_buckets <= 1 << 16:
        raise ValueError("buckets are 16 bits: n_buckets from 1 to 65536")
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("ids", T.ArrayType(source.schema["doc_id"].dataType)), T.StructField("bounds", T.ArrayType(T.LongType())), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("stream", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a, b in words.groups(texts):
                buckets, bounds, n_words = features(texts[a:b], max_n=max_n, n_buckets=n_buckets)
                row = [pa.ListArray.from_arrays([0, b - a], ids.slice(a, b - a)), pa.ListArray.from_arrays([0, b - a + 1], pa.array(bounds, pa.int64())), pa.ListArray.from_arrays([0, b - a], pa.array(n_words, pa.int64())), pa.array([buckets.astype("<u2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=schema.names)

    return source.mapInArrow(lean(run), schema)


def _buckets(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_buffer(), "<u2")


def bucket_counts(packed: DataFrame, n_buckets: int) -> np.ndarray:
    """How many features of the streams each bucket holds: runs sorted and run-length encoded by task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _buckets(batch.column("stream")):
                ordered = np.sort(own, kind="stable")  # a radix sort for 16-bit keys
                first = np.flatnonzero(np.concatenate([[len(ordered) > 0], ordered[1:] != ordered[:-1]]))
                runs = np.diff(np.append(first, len(ordered)))
                yield pa.RecordBatch.from_arrays([pa.array(ordered[first].astype(np.int32)), pa.array(runs.astype(np.int64))], names=["bucket", "n"])

    counts = np.zeros(n_buckets, np.int64)
    for r in packed.select("stream").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # n_buckets rows at most
        counts[r["bucket"]] = r["n"]
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the target's over the documents' smoothed share) of each bucket."""
    k = float(len(own))
    above = (target + 1.0) * (float(own.sum()) + k)
    return np.floor(1000 * np.log(above / ((own + 1.0) * (float(target.sum()) + k)))).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 1, n_buckets: int = 10_000) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document, written."""
    packed = materialize(streams(docs, id_col=id_col, text_col=text_col, max_n=max_n, n_buckets=n_buckets), "bucket-streams")
    aims = streams(target.select(F.lit(0).alias("id"), F.col(target_col).alias("text")), id_col="id", max_n=max_n, n_buckets=n_buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(packed, n_buckets), bucket_counts(aims, n_buckets)))  # n_buckets numbers
    schema = T.StructType([T.StructField("doc_id", packed.schema["ids"].dataType.elementType), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for k, own in enumerate(_buckets(batch.column("stream"))):
                bounds = batch.column("bounds").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
                n = np.diff(bounds)
                total = np.zeros(len(n), np.int64)
                if len(own):
                    total[n > 0] = np.add.reduceat(gain[own], bounds[:-1][n > 0])
                columns = [batch.column("ids").slice(k, 1).flatten(), batch.column("n_words").slice(k, 1).flatten(), pa.array(n), pa.array(total // np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    weighed = materialize(packed.mapInArrow(lean(run), schema), "weights")
    drop_table(packed)
    return weighed


def draw(weighed: DataFrame, *, percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Adds score and rank: floor(percent N / 100) of the N documents of at least min_words words are ranked 1, 2, .., the others null."""
    code = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((code + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("eligible", F.col("n_words") >= min_words)
    drawn = percent * weighed.filter(F.col("n_words") >= min_words).count() // 100
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    ranked = prefix.scan(scored, order, number="place")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 10, min_words: int = 20, seed: int = 2024, **features_of) -> DataFrame:
    """The drawn documents, all columns; documents of one id are drawn together, when any of them is."""
    from .common import with_ids

    ranked = draw(weigh(docs, target, id_col=id_col, text_col=text_col, **features_of), percent=percent, min_words=min_words, seed=seed)
    return with_ids(docs, materialize(ranked.filter("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct(), "drawn"), id_col)
