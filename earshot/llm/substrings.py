"""Substring deduplication by compact windows.

A document is the sequence of its 5-word shingles. Under one hash function a
compact window (l, c, r) stands for all subsequences that begin in l..c and end
in c..r: their min-hash is the shingle at c. Windows at least ``width`` shingles
wide are the nodes of the Cartesian tree over the hashes that are that wide;
their minima are minima of a sliding window of that width as well, so the tree
is built over those alone (about 2 / width of the places).

Interval join: hash functions are taken in twos. Where a window of the one
overlaps a window of the other by ``width`` or more, all subsequences in the
overlap have the same two min-hashes, their signature. Both windows are of one
text, so this join needs no shuffle. Subsequences of different texts that share
a signature are a group. An exact repeat of ``width`` shingles shares one
signature for every two functions, so none is missed; a near one, of similarity
0.8, shares one of three with a probability of 0.95 where it is no longer than
``width``, and more where it is longer.

A group gives links, not pairs. A member is linked to the least one (by text
and place) among those that share the signature and the half of ``width``
that follows the first centre, or that precedes the second: of an exact repeat
one of the two halves lies inside it. A member without company there, and the
least ones of these subgroups, are linked to the least of the group. All of this
depends on the texts alone, not on how they are laid out. Links grow with the
members, not with their square. Groups of more rows than a quarter of a task's
share, which a sample of rows points out, are linked by joins with their least
members instead of in one task; the links are the same.

Linked texts are verified on the shingles of the spans that their windows cover,
in both directions, so every place of a passage counts: a repeat is a run of
common shingles, over small gaps, of Jaccard similarity ``threshold`` or more and
``width`` or more shingles on both sides; failing that, exact runs of the width.

Repeats of a document that overlap are one passage; passages connected by
repeats are a class. Exact copies of whole documents are collapsed first and
share the passages of the one that stands for them.

Defined results: documents under ``min_words`` words, null and empty texts have
no passage; repeated rows are copies; rows without an id take part; a text that
repeats only within itself has no row; other columns are not read. Long texts
are hashed in bounded parts; a text's shingles are held whole (8 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import BROADCAST_ROWS, drop_table, lean, materialize, one_of_each, shuffle_width, small_batches
from .components import components

SHINGLE = 5
SLACK = 12
GAP = 10
#: Texts of a task that are remembered, so that copies give no further rows; those beyond are dropped after the shuffle.
SEEN = 1 << 16
#: Rows of a group below which one task links it.
LARGE = 1000
_MUL = np.uint64(0xD6E8FEB86659FD93)
def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` values, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r), places in h, of the windows at least `width` wide that lie in one text; ties go to the left.

    bounds: where the texts begin, and the end.
    """
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return none, none, none
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b - a >= width] or [none])
    if not len(starts):
        return none, none, none
    least = sliding_min(h, width)[starts]
    # a place is a candidate if it is the leftmost minimum of some run: it opens one, or enters at an end as less than
    # all before it, or takes over when the minimum before it leaves
    end = starts + width - 1
    opens = h[starts] == least
    follows = np.concatenate([[False], starts[1:] == starts[:-1] + 1])
    enters, takes = np.zeros(len(starts), bool), ~follows
    enters[1:] = follows[1:] & (h[end[1:]] < least[:-1])
    takes[1:] |= h[starts[:-1]] == least[:-1]
    rest = starts[takes & ~enters & ~opens]
    inside = np.array([s + int(np.argmin(h[s : s + width])) for s in rest.tolist()], np.int64)
    candidate = np.unique(np.concatenate([starts[opens], end[enters], inside]))
    text = np.searchsorted(bounds, candidate, side="right") - 1
    left, right = np.empty(len(candidate), np.int64), np.empty(len(candidate), np.int64)
    stack: list[int] = []
    place, value, owner = candidate.tolist(), h[candidate].tolist(), text.tolist()
    edges = bounds.tolist()
    last = -1
    for i, v in enumerate(value):
        if owner[i] != last:
            for k in stack:
                right[k] = edges[last + 1] - 1
            stack, last = [], owner[i]
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else edges[last]
        stack.append(i)
    for k in stack:
        right[k] = edges[last + 1] - 1
    wide = right - left + 1 >= width
    return left[wide], candidate[wide], right[wide]


def text_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each text's word sequence."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    with np.errstate(over="ignore"):
        parts = words.mix(hashes + words.mix(place.astype(np.uint64) * _MUL))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
        return words.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def run_hashes(found: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of `length` shingles that begin at each place; places too near the end have 0."""
    out = np.zeros(len(found), np.uint64)
    n = len(found) - length + 1
    if n > 0:
        with np.errstate(over="ignore"):
            for k in range(length):
                out[:n] = out[:n] * _MUL + found[k : k + n]
        out[:n] = words.mix(out[:n])
    return out


def signatures(found: np.ndarray, at: np.ndarray, width: int, functions: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each two functions: (key, l, r, first centre, last centre) of every overlap of their windows that is wide enough."""
    windows = []
    with np.errstate(over="ignore"):
        for j in range(functions):
            h = (found ^ words.mix(np.array([j + 1], np.uint64) * _MUL)) * _MUL
            left, centre, right = compact_windows(h, at, width)
            windows.append((np.maximum(left, centre - width + 1), left, centre, right, h[centre]))
        for band in range(functions // 2):
            (at_a, la, ca, ra, ha), (at_b, lb, cb, rb, hb) = windows[2 * band : 2 * band + 2]
            # a run of the width lies in one window of each function, so the places where runs change windows cut both alike
            begin = np.union1d(at_a, at_b)
            i, j = np.searchsorted(at_a, begin, side="right") - 1, np.searchsorted(at_b, begin, side="right") - 1
            key = words.mix(ha[i] + words.mix(hb[j] + np.uint64(band + 1)))
            yield key, np.maximum(la[i], lb[j]), np.minimum(ra[i], rb[j]), np.minimum(ca[i], cb[j]), np.maximum(ca[i], cb[j])


#: lr holds the window's first and last shingle, halves 32 bits of hash each of what follows and what precedes its centres.
_ROW = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "tid", "lr", "halves")])
_LINK = T.StructType([T.StructField(n, T.LongType()) for n in ("tid", "lr", "tid2", "lr2")])


def window_rows(texts: list[str], seen: set[int], width: int, functions: int) -> list[np.ndarray]:
    """The columns of _ROW for the texts that aren't in `seen`, which takes them up while it has room."""
    hashes, bounds = words.hash_words(texts)
    tids = text_ids(hashes, bounds)
    found, at = words.shingles(hashes, bounds, SHINGLE)
    half = (width + 1) // 2
    runs = run_hashes(found, half)
    fresh = np.zeros(len(texts), bool)
    for k, tid in enumerate(tids.tolist()):
        if tid not in seen:
            fresh[k] = True
            if len(seen) < SEEN:
                seen.add(tid)
    columns: list[list[np.ndarray]] = [[] for _ in _ROW.names]
    for key, lo, hi, first, last in signatures(found, at, width, functions):
        text = np.searchsorted(at, first, side="right") - 1
        # beyond the text's end or before its beginning there is no company
        alone = words.mix(tids[text].view(np.uint64) + first.astype(np.uint64))
        after = np.where(first + half <= at[text + 1], runs[first], alone)
        before = np.where(last - half + 1 >= at[text], runs[np.maximum(last - half + 1, 0)], ~alone)
        place = (lo - at[text]) << 32 | (hi - at[text])
        own = fresh[text]
        halves = (after & ~np.uint64(0xFFFFFFFF)) | before >> np.uint64(32)
        for column, values in zip(columns, (key.view(np.int64), tids[text], place, halves.view(np.int64))):
            column.append(values[own])
    return [np.concatenate(c) for c in columns]


def link_groups(key: np.ndarray, tid: np.ndarray, lr: np.ndarray, halves: np.ndarray) -> list[np.ndarray]:
    """Links (tid, lr, tid2, lr2) of whole groups; rows sorted by key, tid and lr."""
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (tid[1:] != tid[:-1]) | (lr[1:] != lr[:-1])])
    key, tid, lr, halves = (x[new] for x in (key, tid, lr, halves))
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.repeat(opens, np.diff(np.append(opens, len(key))))
    last = np.repeat(np.append(opens[1:], len(key)) - 1, np.diff(np.append(opens, len(key))))
    shared = tid[first] != tid[last]
    key, tid, lr, halves = (x[shared] for x in (key, tid, lr, halves))
    if not len(key):
        return [np.zeros(0, np.int64)] * 4
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = np.repeat(opens, np.diff(np.append(opens, len(key))))
    near = np.zeros(len(key), bool)
    a, b = [], []
    for half in (halves >> 32, halves & 0xFFFFFFFF):
        order = np.lexsort((half, first))  # stable: by text and place within a subgroup
        change = np.concatenate([[True], (first[order][1:] != first[order][:-1]) | (half[order][1:] != half[order][:-1])])
        least = order[np.flatnonzero(change)][np.cumsum(change) - 1]
        member = tid[order] != tid[least]
        near[order[member]] = True
        a.append(order[member])
        b.append(least[member])
    rest = np.flatnonzero(~near & (tid != tid[first]))
    a, b = np.concatenate([*a, rest]), np.concatenate([*b, first[rest]])
    return [tid[a], lr[a], tid[b], lr[b]]


def links_between(docs: DataFrame, *, width: int, functions: int) -> tuple[DataFrame, DataFrame]:
    """(tid, lr, tid2, lr2): links between the windows of a group; and the written windows, which they read."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in window_rows(texts[a:b], seen, width, functions)], names=_ROW.names)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * len(_ROW.names)

        def links(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in link_groups(*columns)], names=_LINK.names)

        for batch in batches:
            held = [np.concatenate([h, batch.column(n).to_numpy()]) for h, n in zip(held, _ROW.names)]
            open_at = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            yield from links([h[:open_at] for h in held])
            held = [h[open_at:] for h in held]
        yield from links(held)

    parts = shuffle_width(docs.sparkSession)
    table = materialize(docs.select("text").mapInArrow(lean(scan), _ROW), "substring-windows")
    rows = table.count()
    share = max(rows // (4 * parts), LARGE)
    hot = materialize(table.sample(min(1.0, 50 / share), seed=1).groupBy("key").count().filter(F.col("count") >= min(40, share)).select("key"), "substring-hot")  # some 4 * parts keys
    some = not hot.isEmpty()
    rest = table.join(F.broadcast(hot), "key", "left_anti") if some else table
    found = rest.repartition(parts, "key").sortWithinPartitions("key", "tid", "lr").mapInArrow(lean(link), _LINK)
    if some:
        large = table.join(F.broadcast(hot), "key").select("*", F.shiftright("halves", 32).alias("after"), F.col("halves").bitwiseAND(0xFFFFFFFF).alias("before"))
        for by in (["key"], ["key", "after"], ["key", "before"]):
            shared = large.groupBy(*by).agg(F.min(F.struct("tid", "lr")).alias("least"), F.max("tid").alias("most")).filter("least.tid < most").drop("most")
            shared = materialize(shared, "substring-least")
            side = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
            found = found.unionByName(large.join(side, by).filter("tid <> least.tid").select("tid", "lr", F.col("least.tid").alias("tid2"), F.col("least.lr").alias("lr2")))
    return found, table


def candidates(links: DataFrame) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi): linked texts, and the spans of their windows."""
    turned = F.col("tid") < F.col("tid2")
    a, b = (F.when(turned, F.col(x)).otherwise(F.col(y)) for x, y in (("lr", "lr2"), ("lr2", "lr")))
    last = lambda c: c.bitwiseAND(0xFFFFFFFF)
    spans = [F.min(F.shiftright(a, 32)).alias("a_lo"), F.max(last(a)).alias("a_hi"), F.min(F.shiftright(b, 32)).alias("b_lo"), F.max(last(b)).alias("b_hi")]
    return links.groupBy(F.least("tid", "tid2").alias("a"), F.greatest("tid", "tid2").alias("b")).agg(*spans)


def repeats_of(a: np.ndarray, b: np.ndarray, *, width: int, threshold: float) -> list[tuple[int, int, int, int]]:
    """Repeated stretches (first, end in a; first, end in b), in shingles."""
    order = np.argsort(b, kind="stable")
    at = np.minimum(np.searchsorted(b[order], a), max(0, len(b) - 1))
    match = b[order][at] == a if len(b) else np.zeros(len(a), bool)
    hit = np.flatnonzero(match)
    if len(hit) < width * threshold / 2:
        return []
    where = order[at[hit]]
    if len(b) and (np.diff(b[order]) == 0).any():  # shingles that b repeats: go on along the diagonal where that fits
        said, there, tokens = hit.tolist(), b.tolist(), a[hit].tolist()
        follow = where.tolist()
        for k in range(1, len(said)):
            ahead = follow[k - 1] + said[k] - said[k - 1]
            if ahead < len(there) and there[ahead] == tokens[k]:
                follow[k] = ahead
        where = np.array(follow)

    def runs(gap: int) -> list[np.ndarray]:
        cut = np.flatnonzero((np.diff(hit) > gap + 1) | (np.abs(np.diff(where) - np.diff(hit)) > SLACK)) + 1
        return np.split(np.arange(len(hit)), cut)

    found: list[tuple[int, int, int, int]] = []
    for gap in (GAP, 0):
        for run in runs(gap):
            first, end, first_b, end_b = hit[run[0]], hit[run[-1]] + 1, where[run].min(), where[run].max() + 1
            if any(first >= f[0] and end <= f[1] for f in found):
                continue
            union = (end - first) + (end_b - first_b) - len(run)
            if end - first >= width and end_b - first_b >= width and len(run) >= threshold * union:
                found.append((int(first), int(end), int(first_b), int(end_b)))
    return found


def passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, threshold: float = 0.8, functions: int = 6) -> DataFrame:
    """(doc_id, start_word, end_word, class_id): every passage that another document repeats; class_id is the least doc_id of its class."""
    small_batches(docs.sparkSession)
    width = max(1, min_words - SHINGLE + 1)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    id_type = source.schema["doc_id"].dataType

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                hashes, bounds = words.hash_words(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(text_ids(hashes, bounds)), pa.array(np.diff(bounds))], names=["doc_id", "tid", "n_words"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("tid", T.LongType()), T.StructField("n_words", T.LongType())])
    rows = materialize(source.mapInArrow(lean(name), schema), "substring-rows").filter(F.col("n_words") >= min_words)
    texts = materialize(rows.groupBy("tid").agg(F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("*").alias("copies")), "substring-texts")
    linked, windows = links_between(source, width=width, functions=functions)
    pairs = materialize(candidates(linked), "substring-pairs")
    drop_table(windows)

    # shingles of the spans that candidates need, one row for each text; 32 bits tell apart what two texts hold, and a
    # repeat takes some forty common ones in a row
    needed = pairs.select("a", "a_lo", "a_hi").unionByName(pairs.select(F.col("b").alias("a"), F.col("b_lo").alias("a_lo"), F.col("b_hi").alias("a_hi"))).groupBy(F.col("a").alias("tid")).agg(F.min("a_lo").alias("lo"), F.max("a_hi").alias("hi"))
    spans = materialize(needed.join(texts.select("tid", F.col("doc_id").alias("holder")), "tid"), "substring-needed")
    side_rows = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS else spans  # four numbers a row
    fetched = source.join(side_rows, source["doc_id"].eqNullSafe(spans["holder"])).select("text", "tid", "lo", "hi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, tid, lo, hi = (batch.column(c).to_pylist() for c in ("text", "tid", "lo", "hi"))
            for a, b in words.groups(t):
                hashes, bounds = words.hash_words(t[a:b])
                same = text_ids(hashes, bounds) == np.array(tid[a:b], np.int64)
                found, at = words.shingles(hashes, bounds, SHINGLE)
                own = [k for k in range(b - a) if same[k]]
                blobs = [found[at[k] + lo[a + k] : at[k] + hi[a + k] + 1].astype("<u4").tobytes() for k in own]
                yield pa.RecordBatch.from_arrays([pa.array([tid[a + k] for k in own], pa.int64()), pa.array([lo[a + k] for k in own], pa.int64()), pa.array(blobs, pa.binary())], names=["tid", "lo", "shingles"])

    blobs = one_of_each(materialize(fetched.mapInArrow(lean(cut), "tid long, lo long, shingles binary"), "substring-spans"), "tid")

    def with_span(rows: DataFrame, c: str) -> DataFrame:
        """Adds the shingles of the pair's own span on the side c."""
        held = blobs.select(F.col("tid").alias(c), "lo", "shingles")
        cut_out = F.substring("shingles", ((F.col(f"{c}_lo") - F.col("lo")) * 4 + 1).cast("int"), ((F.col(f"{c}_hi") - F.col(f"{c}_lo") + 1) * 4).cast("int"))
        return rows.join(held, c).withColumn(f"{c}_shingles", cut_out).drop("lo", "shingles")

    both = with_span(with_span(pairs, "a"), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, fa, fb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_lo", "b_lo", "a_shingles", "b_shingles"))):
                x, y = np.frombuffer(sa, "<u4"), np.frombuffer(sb, "<u4")
                own = dict.fromkeys(repeats_of(x, y, width=width, threshold=threshold))
                own |= dict.fromkeys((lo2, hi2, lo, hi) for lo, hi, lo2, hi2 in repeats_of(y, x, width=width, threshold=threshold))
                out.extend((a, lo + fa, hi + fa, b, lo2 + fb, hi2 + fb) for lo, hi, lo2, hi2 in own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=["a", "a_lo", "a_hi", "b", "b_lo", "b_hi"])

    found = materialize(both.mapInArrow(lean(verify), "a long, a_lo long, a_hi long, b long, b_lo long, b_hi long"), "substring-repeats")

    whole = texts.filter("copies > 1").select("tid", F.lit(0).cast("long").alias("lo"), (F.col("n_words") - SHINGLE + 1).alias("hi"))
    ends = found.select(F.col("a").alias("tid"), F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).unionByName(found.select(F.col("b").alias("tid"), F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"))).unionByName(whole).distinct()
    order = Window.partitionBy("tid").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.sum(F.when(before.isNull() | (F.col("lo") >= before), 1).otherwise(0)).over(order)
    marked = ends.withColumn("part", opened)
    nodes = materialize(marked.withColumn("node", F.xxhash64("tid", "part")), "substring-nodes")
    extent = nodes.groupBy("node").agg(F.first("tid").alias("tid"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    place = lambda c: nodes.select(F.col("tid").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi"), F.col("node").alias(f"{c}_node"))
    linked = found.join(place("a"), ["a", "a_lo", "a_hi"]).join(place("b"), ["b", "b_lo", "b_hi"]).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    roots = components(linked).withColumnRenamed("node", "of_node")
    classed = extent.join(roots, extent["node"] == roots["of_node"], "left").join(texts.select("tid", F.col("doc_id").alias("least")), "tid").withColumn("root", F.coalesce("root", "node"))
    classed = materialize(classed.select("node", "tid", "lo", "hi", "root", "least"), "substring-classes")
    for done in (pairs, spans, found, nodes):
        drop_table(done)
    by_class = classed.groupBy("root").agg(F.min("least").alias("class_id"))
    named = classed.join(by_class, "root").select("tid", "lo", "hi", "class_id")
    return rows.join(named, "tid").select("doc_id", F.col("lo").alias("start_word"), (F.col("hi") + SHINGLE - 1).alias("end_word"), "class_id")
