"""Language-model scoring by cross-entropy difference.

Two bigram models, one of the target documents and one of all documents, share
one vocabulary (every word of the corpus, and one unknown word), one order and
one smoothing, so their losses differ by what the texts say and not by how the
models are made:

    p(w | v) = (n(v, w) + m p(w)) / (n(v) + m),   p(w) = (n(w) + 1) / (n + words + 1)

v is the word before, or the start of the text. A document's score is the mean
over its tokens of the target model's loss less the background model's: the
lower, the more it reads like the target. A document is held out of the models
that score it: its own counts are taken off those of the background and, if it
is a target document, those of the target.

No table of the models is gathered anywhere; they stay keyed by n-gram, with as
many entries as the corpus has n-grams. Documents are written in blocks of about
``BLOCK_CHARS`` characters, one compressed row each. A block adds up its own
n-grams and deals them out by ranges of their hashes: one row for each range, with
the sorted hashes (as differences, about 6 bytes each) and counts. A range's
task adds up what the blocks sent and answers each with the totals of its
n-grams, in the same order. Blocks and answers meet by block. So a common n-gram
has one entry a block, not one a token, hashes are spread evenly over the ranges,
and what moves is the compressed texts, the hashes and the totals, once each.

Defined results: a null or empty text has no token, losses and the difference 0;
a target without documents leaves its smoothed model; repeated rows count and
are scored each; rows without an id take part; other columns are not read. A
text longer than a block is a block of its own: its words are held whole (about
100 bytes each), its characters are scanned in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import BROADCAST_ROWS, drop_table, lean, materialize, shuffle_width, small_batches

BLOCK_CHARS = 1 << 22
_START = np.uint64(0x5851F42D4C957F2D)
_MUL = np.uint64(0xD6E8FEB86659FD93)


def flag_target(docs: DataFrame, target_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, target. The ids are broadcast if a count shows that they are few."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("target_id")).filter("target_id is not null").distinct()
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return source.join(side, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("target"))


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_batches(batches).combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def in_blocks(flagged: DataFrame) -> DataFrame:
    """(block, rows): doc_id, text and target of a block's rows, written, so that they are the same ones ever after."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def settle() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(held)], pa.binary())], names=["block", "rows"])

        for batch in batches:
            for a, b in words.groups(batch.column("text").to_pylist()):
                part = batch.slice(a, b - a)
                if held and size + part.nbytes > BLOCK_CHARS:
                    yield settle()
                    block, held, size = block + 1, [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield settle()

    return materialize(flagged.mapInArrow(lean(gather), "block long, rows binary"), "lm-blocks")


def gram_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each word (even) and of it with the word before (odd)."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[bounds[:-1][np.diff(bounds) > 0]] = _START
    with np.errstate(over="ignore"):
        pairs = words.mix(hashes + words.mix(before * _MUL))
    return hashes & ~np.uint64(1), pairs | np.uint64(1)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word keys, bigram keys, each token's text, and where the texts' tokens begin."""
    hashes, bounds = words.hash_words(texts)
    single, double = gram_keys(hashes, bounds)
    return single, double, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 8 bytes, their first bytes together, then their second ones and so on, compressed."""
    raw = np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unpack(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").ravel().astype(np.uint64)


_COUNT = T.StructType([T.StructField("range", T.LongType()), T.StructField("block", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("keys", "n", "of_target"))])
_ANSWER = T.StructType([*_COUNT.fields[:2], *(T.StructField(c, T.BinaryType()) for c in ("n", "of_target")), *(T.StructField(c, T.LongType()) for c in ("words", "tokens", "target_tokens"))])


def count_grams(blocks: DataFrame, ranges: int) -> DataFrame:
    """A row (range, block, keys, n, of_target) for each block and range: the different n-grams, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                table = _unpacked(rows.as_py())
                single, double, owner, _ = _tokens(table.column("text").to_pylist())
                marks = np.array(table.column("target").to_pylist(), bool)[np.concatenate([owner, owner])]
                keys, place = np.unique(np.concatenate([single, double]), return_inverse=True)
                n, of_target = np.bincount(place, minlength=len(keys)), np.bincount(place, marks, len(keys)).astype(np.int64)
                of = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                edges = np.searchsorted(of, np.arange(ranges + 1, dtype=np.uint64))
                spans = [(k, a, b) for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if b > a]
                packed = [[_pack(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in spans], [_pack(n[a:b]) for _, a, b in spans], [_pack(of_target[a:b]) for _, a, b in spans]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in spans], pa.int64()), pa.array([block] * len(spans), pa.int64()), *(pa.array(c, pa.binary()) for c in packed)], names=_COUNT.names)

    return blocks.mapInArrow(lean(run), _COUNT)


def total_grams(counts: DataFrame) -> DataFrame:
    """A row for each of counts: the totals of its n-grams over all blocks. One of each range also tells, in words, tokens
    and target_tokens, how many different words the range has and how often they occur; the others have 0 there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        held: list[tuple[int, np.ndarray, bytes, bytes]] = []

        def settle() -> Iterator[pa.RecordBatch]:
            keys, place = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
            n, of_target = (np.bincount(place, np.concatenate([_unpack(h[c]) for h in held]).astype(float), len(keys)).astype(np.int64) for c in (2, 3))
            single = keys & np.uint64(1) == 0
            sums, first = (int(single.sum()), int(n[single].sum()), int(of_target[single].sum())), 0
            for block, own, *_ in held:
                mine = place[first : first + len(own)]
                first += len(own)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((at, pa.int64()), (block, pa.int64()), (_pack(n[mine]), pa.binary()), (_pack(of_target[mine]), pa.binary()), *((x, pa.int64()) for x in sums))], names=_ANSWER.names)
                sums = (0, 0, 0)

        for batch in batches:
            for k, block, keys, n, of_target in zip(*(batch.column(c).to_pylist() for c in _COUNT.names)):
                if k != at:
                    if held:
                        yield from settle()
                    at, held = k, []
                with np.errstate(over="ignore"):
                    held.append((block, np.cumsum(_unpack(keys), dtype=np.uint64), n, of_target))
        if held:
            yield from settle()

    parts = shuffle_width(counts.sparkSession)
    return counts.repartition(parts, "range").sortWithinPartitions("range", "block").mapInArrow(lean(run), _ANSWER)


def score_block(texts: list[str], target: np.ndarray, answers: tuple[np.ndarray, np.ndarray], totals: dict[str, int], strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text of a block, and its mean losses under the target's model and the background's.

    answers: of the block's n-grams, in the order of their keys, the target's and the background's counts.
    """
    single, double, owner, bounds = _tokens(texts)
    size = np.diff(bounds)
    if not len(single):
        return size, np.zeros(len(texts)), np.zeros(len(texts))
    keys, place = np.unique(np.concatenate([single, double]), return_inverse=True)
    word, pair = place[: len(single)], place[len(single) :]
    starts = bounds[:-1][size > 0]
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[starts] = 0
    opening = np.zeros(len(word), bool)
    opening[starts] = True
    cells, of = np.unique(np.concatenate([owner, owner]) * np.int64(len(keys)) + place, return_inverse=True)
    own = np.bincount(of)[of]  # how often a token's n-gram occurs in its own text
    own_word, own_pair = own[: len(word)], own[len(word) :]
    own_before = np.empty_like(own_word)
    own_before[1:] = own_word[:-1]
    out = []
    for counts, tokens, docs, out_of in ((answers[0], totals["target_tokens"], totals["target_docs"], target), (answers[1], totals["tokens"], totals["docs"], np.ones(len(texts), bool))):
        less = out_of[owner]
        p = (counts[word] - own_word * less + 1) / (tokens - size[owner] * less + totals["words"] + 1)
        context = np.where(opening, docs - less, counts[before] - own_before * less)
        p = (counts[pair] - own_pair * less + strength * p) / (context + strength)
        out.append(np.bincount(owner, -np.log(p), len(texts)) / np.maximum(size, 1))
    return size, out[0], out[1]


def score(flagged: DataFrame, *, strength: float = 50.0) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss (nats a token) and difference of every row of flag_target()."""
    spark = flagged.sparkSession
    small_batches(spark)
    blocks = in_blocks(flagged)
    answers = materialize(total_grams(count_grams(blocks, shuffle_width(spark))), "lm-answers")
    sums = answers.agg(*(F.sum(c).alias(c) for c in ("words", "tokens", "target_tokens"))).first()
    spoken = flagged.filter(F.col("text").rlike(r"[^\x00-/:-@\[-`{-\x7f]")).agg(F.count("*").alias("docs"), F.count_if("target").alias("target_docs")).first()
    totals = {k: int(v or 0) for k, v in (sums.asDict() | spoken.asDict()).items()}
    fields = [flagged.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("target_loss", T.DoubleType()), ("background_loss", T.DoubleType()), ("difference", T.DoubleType())))]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by block and range, the block's own rows first."""
        rows: pa.Table | None = None
        told: list[list[np.ndarray]] = [[], []]

        def settle() -> Iterator[pa.RecordBatch]:
            said = tuple(np.concatenate([np.zeros(0), *(x.astype(float) for x in c)]) for c in told)
            n, t, g = score_block(rows.column("text").to_pylist(), np.array(rows.column("target").to_pylist(), bool), said, totals, strength)
            yield from pa.Table.from_arrays([rows.column("doc_id"), pa.array(n), pa.array(t), pa.array(g), pa.array(t - g)], names=schema.names).to_batches()

        for batch in batches:
            for own, n, of_target in zip(*(batch.column(c).to_pylist() for c in ("rows", "n", "of_target"))):
                if own is not None:
                    if rows is not None:
                        yield from settle()
                    rows, told = _unpacked(own), [[], []]
                else:
                    told[0].append(_unpack(of_target))
                    told[1].append(_unpack(n))
        if rows is not None:
            yield from settle()

    null = lambda c: F.lit(None).cast("binary").alias(c)
    asked = blocks.select("block", F.lit(-1).cast("long").alias("range"), "rows", null("n"), null("of_target"))
    met = asked.unionByName(answers.select("block", "range", null("rows"), "n", "of_target")).repartition(shuffle_width(spark), "block").sortWithinPartitions("block", "range")
    scored = materialize(met.mapInArrow(lean(run), schema), "lm-scores")
    for done in (blocks, answers):
        drop_table(done)
    return scored
