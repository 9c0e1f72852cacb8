"""N-gram Jaccard join by chosen paths.

A document is the set of its 5-word shingles. In one run a set walks down a
random tree: at a node it moves to the child of every shingle whose hash under
that node falls below 1 / (threshold * set size), about 1 / threshold children.
Which shingles are chosen depends on node and shingle alone, so sets that share
many shingles share paths, and a set finds its paths without seeing any other.
Two sets at the threshold share a node of depth d with the survival probability
p(d) of a branching process with one expected shared child, p(d) = 1 -
exp(-p(d - 1)); ``runs`` is the least number with 1 - (1 - p(DEPTH)) ** runs
at or above ``recall``.

Sets that meet in a node of depth ``DEPTH`` are a bucket, and every pair of a
bucket is compared. Small buckets are compared pair by pair, on fixed-size
sketches first; pairs found are verified on the exact sets. Larger ones are dealt
out over parts of about ``PART`` sets (fewer if they are long), and every pair of
parts is a block, a task's work: its pairs are compared exactly in one product of
incidence matrices and give the links that span what they connect, and how many
links each set has, instead of every pair. A pair that meets in several large
buckets is compared in the one of least key alone, and not in small ones, so it
counts once.

Exact copies are one set, with their number; they cost nothing further.

Defined results: null and empty texts and those without a word have no shingle
and are classes of their own; texts of under five words are one shingle;
repeated rows are copies; documents without an id (null) take part and form
classes by their text; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import BROADCAST_ROWS, lean, materialize, one_of_each, shuffle_width, small_batches, with_ids
from .components import components

WIDTH = 5
DEPTH = 3
SKETCH = 64
SMALL = 24
PART = 400
PART_TOKENS = 1 << 17
COLUMNS = 2048
_MUL = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = words.mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def runs_for(recall: float, depth: int = DEPTH) -> int:
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    hashes, bounds = words.hash_words(texts)
    short = np.diff(bounds) < WIDTH
    found, at = words.shingles(hashes, bounds, WIDTH)
    sets = []
    for k in range(len(texts)):
        if short[k]:
            n = int(bounds[k + 1] - bounds[k])
            sets.append(words.shingles(hashes[bounds[k] : bounds[k + 1]], np.array([0, n]), n)[0] if n else np.zeros(0, np.uint64))
        else:
            sets.append(np.unique(found[at[k] : at[k + 1]]))
    return sets


def chosen_paths(own: np.ndarray, threshold: float, runs: int) -> np.ndarray:
    """Nodes of depth DEPTH that the set reaches."""
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) / (threshold * len(own)))))
    nodes = words.mix(np.arange(1, runs + 1, dtype=np.uint64) * _MUL)
    with np.errstate(over="ignore"):
        for _ in range(DEPTH):
            drawn = (own[None, :] ^ nodes[:, None]) * _MUL
            drawn ^= drawn >> np.uint64(32)
            drawn *= _MUL
            of, token = np.nonzero(drawn < limit)
            nodes = words.mix(nodes[of] * np.uint64(31) + own[token])
    return np.unique(nodes)


def sketch(own: np.ndarray) -> bytes:
    """The low bytes of SKETCH min-hashes: the share of equal ones estimates the Jaccard similarity."""
    least = np.empty(SKETCH, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, SKETCH, 16):
            least[at : at + 16] = ((own[None, :] ^ _SEEDS[at : at + 16, None]) * _MUL).min(1)
    return words.mix(least).astype(np.uint8).tobytes()


def set_id(own: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    with np.errstate(over="ignore"):
        return np.array([own.sum(dtype=np.uint64), words.mix(own * _MUL).sum(dtype=np.uint64)], np.uint64).tobytes()


def describe(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, runs: int) -> DataFrame:
    """doc_id, mark (a hash of the text), sid (the set's identity), n, sketch and paths of every row."""
    text = F.coalesce(text_col, F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("mark", T.LongType()), *(T.StructField(n, t) for n, t in (("sid", T.BinaryType()), ("n", T.IntegerType()), ("sketch", T.BinaryType()), ("paths", T.ArrayType(T.LongType()))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                sid, n, sk, paths = [], [], [], []
                for own in shingle_sets(texts[a:b]):
                    n.append(len(own))
                    sid.append(set_id(own))
                    paths.append((chosen_paths(own, threshold, runs) if len(own) else own).view(np.int64))
                    sk.append(sketch(own) if len(own) else b"\0" * SKETCH)
                arrays = [pa.array(sid, pa.binary()), pa.array(n, pa.int32()), pa.array(sk, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "mark")), *arrays], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def _close_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) within small buckets, rows of (key, sid, n, sketch), whose sizes fit and whose sketches agree."""
    close = max(0.0, threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> Iterator[tuple[bytes, bytes]]:
            n, sk = np.array([h[1] for h in held]), np.stack([np.frombuffer(h[2], np.uint8) for h in held])
            for i in range(1, len(held)):
                fits = np.minimum(n[:i], n[i]) >= threshold * np.maximum(n[:i], n[i])
                for j in np.flatnonzero(fits & ((sk[:i] == sk[i]).mean(1) >= close)):
                    yield held[i][0], held[j][0]

        def flush(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            found = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "sid", "n", "sketch"))):
                if k != key:
                    found.extend(pairs() if len(held) > 1 else ())
                    key, held = k, []
                held.append(row)
            yield flush(found)
        if len(held) > 1:
            yield flush(list(pairs()))

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key").sortWithinPartitions("key", "sid")
    return dealt.mapInArrow(lean(run), "a binary, b binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of some sets share."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[column] > 1
    kept, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(kept), COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        block = np.zeros((len(sets), min(COLUMNS, len(kept) - at)), np.float32)
        block[row[here], column[here] - at] = 1
        common += block @ block.T
    return common


def block_links(sets: list[np.ndarray], part: np.ndarray, before: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of a block link at the threshold, by exact similarity: all pairs if it holds one part, else those over
    both; not those that share one of the nodes `before`, where they are compared."""
    due = part[:, None] != part[None, :] if part.min() < part.max() else ~np.eye(len(sets), dtype=bool)
    due &= shared_counts(before) == 0
    linked = np.zeros_like(due)
    busy = np.flatnonzero(due.any(1))
    if len(busy):
        n = np.array([len(sets[k]) for k in busy])
        common = shared_counts([sets[k] for k in busy])
        linked[np.ix_(busy, busy)] = common >= threshold * (n[:, None] + n[None, :] - common)
    return linked & due


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that span what a matrix of links connects."""
    waiting = np.ones(len(linked), bool)
    out: list[tuple[int, int]] = []
    for first in range(len(linked)):
        if waiting[first]:
            waiting[first] = False
            queue = [first]
            while queue:
                k = queue.pop()
                for m in np.flatnonzero(linked[k] & waiting).tolist():
                    out.append((m, k))
                    queue.append(m)
                waiting &= ~linked[k]
    return out


def _spanned(rows: DataFrame, threshold: float) -> DataFrame:
    """Of the blocks of large buckets, rows of (key, i, j, part, sid, nodes, tokens): exact links (a, b) that span them, and
    rows (a, null, links) with the number of a set's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, sid, before, sets = None, [], [], [], []

        def links() -> list[tuple[bytes, bytes | None, int | None]]:
            if len(sets) < 2 or block[1] != block[2] and len(set(part)) < 2:
                return []
            linked = block_links(sets, np.array(part), before, threshold)
            degree = linked.sum(1)
            return [*((sid[a], sid[b], None) for a, b in spanning(linked)), *((sid[k], None, int(degree[k])) for k in np.flatnonzero(degree))]

        def flush(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], names=["a", "b", "links"])

        for batch in batches:
            found = []
            nodes, tokens = batch.column("nodes"), batch.column("tokens")
            for at, own in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "part", "sid")))):
                if own[:3] != block:
                    found.extend(links())
                    block, part, sid, before, sets = own[:3], [], [], [], []
                part.append(own[3])
                sid.append(own[4])
                reached = nodes[at].values.to_numpy()
                before.append(reached[reached < own[0]])
                sets.append(tokens[at].values.to_numpy())
            yield flush(found)
        yield flush(links())

    dealt = rows.repartition(shuffle_width(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lean(run), "a binary, b binary, links long")


def buckets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small buckets, (key, sid, n, sketch), and large ones, (key, sid, parts, part), both written."""
    paths = sets.select("sid", "n", F.explode("paths").alias("key"))
    sizes = paths.groupBy("key").agg(F.count("*").alias("met"), F.sum("n").alias("tokens")).filter("met > 1")  # nodes of one set go
    met = materialize(paths.select("sid", "key").join(sizes, "key"), "jaccard-met")
    small = met.filter(F.col("met") <= SMALL).select("key", "sid").join(sets.select("sid", "n", "sketch"), "sid")
    parts = F.greatest(F.ceil(F.col("met") / PART), F.ceil(F.col("tokens") / PART_TOKENS)).cast("int")
    large = met.filter(F.col("met") > SMALL).withColumn("parts", parts)
    large = large.select("key", "sid", "parts", F.pmod(F.xxhash64("sid", "key"), "parts").cast("int").alias("part"))
    return materialize(small, "jaccard-small"), materialize(large, "jaccard-large")


def blocks(large: DataFrame) -> DataFrame:
    """(key, i, j, part, sid): every part of a large bucket beside every part, itself too."""
    beside = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return beside.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "sid")


def tokens_of(docs: DataFrame, sets: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(sid, tokens) of the wanted sets, from one document that holds each."""
    holders = materialize(sets.join(wanted, "sid").select(F.col("doc_id").alias("holder")), "jaccard-holders")
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = with_ids(source, holders, "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                own = [s for s in shingle_sets(texts[a:b]) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["sid", "tokens"])

    # a holder's id may stand for other texts too
    return one_of_each(materialize(source.mapInArrow(lean(run), "sid binary, tokens array<bigint>").join(wanted, "sid", "left_semi"), "jaccard-tokens"), "sid")


def links(docs: DataFrame, sets: DataFrame, *, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b): verified links between different sets, of large buckets those that span them; and (sid, n_links), all of a set's."""
    small, large = buckets(sets)
    nodes = materialize(large.groupBy("sid").agg(F.collect_list("key").alias("nodes")), "jaccard-nodes")
    close = _close_pairs(small, threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    for c in "ab":
        close = close.join(nodes.select(F.col("sid").alias(c), F.col("nodes").alias(f"{c}_nodes")), c, "left")
    pairs = materialize(close.filter(~F.coalesce(F.arrays_overlap("a_nodes", "b_nodes"), F.lit(False))).select("a", "b"), "jaccard-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(nodes.select("sid")).distinct(), "jaccard-wanted")
    tokens = tokens_of(docs, sets, wanted, id_col=id_col, text_col=text_col)
    left, right = (tokens.select(F.col("sid").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("same", F.size(F.array_intersect("a_tokens", "b_tokens")))
    verified = materialize(both.filter(F.col("same") >= threshold * (F.size("a_tokens") + F.size("b_tokens") - F.col("same"))).select("a", "b"), "jaccard-verified")
    whole = materialize(tokens.join(nodes, "sid"), "jaccard-whole")
    spanned = materialize(_spanned(blocks(large).join(whole, "sid"), threshold), "jaccard-spanned")
    found = verified.unionByName(spanned.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    ends = verified.select(F.explode(F.array("a", "b")).alias("sid"), F.lit(1).cast("long").alias("links"))
    counted = ends.unionByName(spanned.filter("b is null").select(F.col("a").alias("sid"), "links"))
    return found, counted.groupBy("sid").agg(F.sum("links").alias("n_links"))


def _row_classes(docs: DataFrame, *, id_col: str, text_col: str, threshold: float, recall: float) -> DataFrame:
    """(doc_id, mark, class, class_id, n_links, n_copies) of every row; class is null for a text without a word."""
    small_batches(docs.sparkSession)
    rows = materialize(describe(docs, id_col=id_col, text_col=text_col, threshold=threshold, runs=runs_for(recall)), "jaccard-rows")
    sets = materialize(rows.filter("n > 0").groupBy("sid").agg(F.min(F.struct("doc_id", "n", "sketch", "paths")).alias("x"), F.min("doc_id").alias("own"), F.count("*").alias("n_copies")).select("sid", "x.*", "own", "n_copies"), "jaccard-sets")
    found, degree = links(docs, sets, id_col=id_col, text_col=text_col, threshold=threshold)
    roots = components(found)
    linked = sets.select("sid", "own").join(roots, F.col("sid") == F.col("node")).select("sid", "own", "root")
    least = linked.groupBy("root").agg(F.min("own").alias("class_id"))
    of_set = sets.select("sid", "own", "n_copies").join(linked.select("sid", "root"), "sid", "left").join(least, "root", "left").join(degree, "sid", "left")
    of_set = of_set.select("sid", F.coalesce("root", "sid").alias("class"), "n_copies", F.coalesce("class_id", "own").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    of_set = materialize(of_set, "jaccard-of-set")  # a join of two plain scans: AQE can split the rows of a large group of copies
    return rows.select("doc_id", "mark", "sid").join(of_set, "sid", "left").select("doc_id", "mark", "class", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) of every row.

    class_id is the least id of the class: texts connected by links of at least
    the threshold, and all copies of them. n_links counts the other texts that
    were found and verified to link to the row's own, n_copies the rows whose text
    has the same shingles.
    """
    return _row_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold, recall=recall).select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.99) -> DataFrame:
    """One row of each class, with all its columns: the one of least id, of least text hash if that id has several texts.

    Rows are told apart by id and text, so texts without an id, or of one id, stay if they are of different classes; a row
    without an id stays for its class only if no other has one. Texts without a word all stay.
    """
    found = _row_classes(docs, id_col=id_col, text_col=text_col, threshold=threshold, recall=recall).filter("class is not null")
    found = materialize(found.groupBy(F.col("doc_id").alias("found_id"), "mark", "class").agg(F.count("*").alias("rows")), "jaccard-classes")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("found_id").isNull().alias("without"), "found_id", "mark")).alias("first"))
    chosen = F.col("found_id").eqNullSafe(F.col("first.found_id")) & (F.col("mark") == F.col("first.mark"))
    judged = materialize(found.join(first, "class").select("found_id", "mark", "rows", chosen.alias("chosen")), "jaccard-chosen")
    dropped, repeated = judged.filter("not chosen").select("found_id", "mark"), judged.filter("chosen and rows > 1").select("found_id", "mark")
    mark = F.xxhash64(F.coalesce(text_col, F.lit("")))

    def among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        return rows.join(side, rows[id_col].eqNullSafe(ids["found_id"]) & (mark == ids["mark"]), how)

    rows = among(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return rows
    return among(rows, repeated, "left_anti").unionByName(among(rows, repeated, "left_semi").dropDuplicates([id_col, text_col]))
