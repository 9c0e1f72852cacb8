"""Benchmark decontamination: a BM25 index of test items, searched with every passage of every document.

The index holds, for each term, the posting list of the test items that have it
with their BM25 impacts, each divided by the item's score against itself: 1
means that the passage holds all of an item. Postings of a list lie in blocks, by
ranges of ``RANGE`` items; each block keeps its largest impact (block-max).
Document frequencies and mean length are those of all items, and items are
indexed by length class (the power of two at or above their words): a passage
is a window of twice the class's words, moved on by as many, so an item
lies in one whole, and its score depends on no other item's length.

Block-max WAND: every passage is a query, and all items at or above ``threshold``
are wanted, so the threshold is fixed and its bounds can be tested for a batch of
passages at once. A passage goes on only if the largest impacts of its terms add
up to the threshold (else there is no pivot anywhere); then only if its terms'
block maxima do so in some range of items. What terms add that are so common that
together they give no item more than a third of the threshold is added as a slack instead of from
their blocks. For the passages left the same is tested on their different terms,
since two halves may count one twice, and the few that pass are searched one at a time: lists in the
order of their next item, the pivot where the largest impacts reach the threshold,
the pivot's block maxima checked, items before the next block skipped if they fail,
else the item scored.

All items found are then verified: the share of the item's 5-word shingles that
the passage holds, over all, over its question (the first two thirds of its
words) and over its answer (the rest).

A worker's index takes about four times the items' text. Items are read in
sets of ``block_chars`` characters, one pass over the documents each.

Defined results: null and empty texts hold nothing; items without a word are
never found; items of fewer than five words are verified as one shingle;
repeated rows and items are reported each; other columns are not read. Of long
texts the words are held whole (8 bytes each), the characters in parts.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import words
from .common import lean, small_batches

K1, B = 1.2, 0.75
RANGE = 8
SHORTEST = 8
WIDTH = 5
#: Sums of a batch of passages by ranges of items: cells at once.
CELLS = 1 << 20
_MASK = np.uint64((1 << 20) - 1)
_EPS = 1e-9


class Corpus:
    """What BM25 counts over all items: how many, their mean length, and terms with their document frequencies."""

    def __init__(self, items: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.items, self.mean, self.terms, self.df = items, mean, terms, df

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        hashes, bounds = words.hash_words(texts)
        terms, number = np.unique(hashes, return_inverse=True)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        pairs = np.unique(number * np.int64(max(1, len(texts))) + owner)
        return cls(len(texts), max(1.0, len(hashes) / max(1, len(texts))), terms, np.bincount(pairs // max(1, len(texts)), minlength=len(terms)))


def length_class(n: int) -> int:
    return max(SHORTEST, 1 << max(0, n - 1).bit_length())


class Index:
    """Posting lists of items of one length class."""

    def __init__(self, items: list[tuple[object, np.ndarray]], step: int, threshold: float, corpus: Corpus):
        self.threshold, self.step = threshold, step
        self.ids = [i for i, _ in items]
        own = [h for _, h in items]
        lengths = np.array([len(h) for h in own], np.int64)
        self.terms, number = np.unique(np.concatenate(own), return_inverse=True)
        pairs, tf = np.unique(number * np.int64(len(items)) + np.repeat(np.arange(len(items)), lengths), return_counts=True)
        term, item = pairs // len(items), pairs % len(items)  # by term, then by item: the posting lists
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (corpus.items - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / corpus.mean))
        impact = impact / np.bincount(item, impact, len(items))[item]
        self.offsets = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(impact, self.offsets[:-1])
        block = term * np.int64(len(items)) + item // RANGE
        opens = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        self.block_range, self.block_most = item[opens] // RANGE, np.maximum.reduceat(impact, opens)
        self.block_offsets = np.searchsorted(term[opens], np.arange(len(self.terms) + 1))
        self.ranges = -(-len(items) // RANGE)
        # the commonest terms, while no item gets a third of the threshold from them
        place = np.empty(len(self.terms), np.int64)
        place[np.lexsort((np.arange(len(self.terms)), -df))] = np.arange(len(self.terms))
        order = np.argsort(place[term], kind="stable")
        mass = np.zeros(len(items))
        cut = len(self.terms)
        for k in order.tolist():
            mass[item[k]] += impact[k]
            if mass[item[k]] > threshold / 3:
                cut = int(place[term[k]])
                break
        self.rare = place >= cut
        common = ~self.rare[term]
        slack = np.bincount(item[common], impact[common], len(items))
        self.needed = threshold - np.maximum.reduceat(slack, np.arange(0, len(items), RANGE)) - _EPS
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.terms & _MASK).astype(np.int64)] = True
        self.items, self.impacts = item.tolist(), impact.tolist()
        self.ranges_of, self.tops = self.block_range.tolist(), self.block_most.tolist()
        self.parts = []
        for o in own:
            split = -(-2 * len(o) // 3)
            self.parts.append(tuple(_shingles(x) for x in (o, o[:split], o[split:])))

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and the terms' numbers."""
        at = np.flatnonzero(self.known[(hashes & _MASK).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        same = self.terms[number] == hashes[at]
        return at[same], number[same]

    def passages(self, at: np.ndarray, number: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, first word, end) of the passages whose block maxima can reach the threshold.

        A passage is two cells of `step` words; what both cells add up to bounds what it holds.
        """
        if not len(at):
            return
        steps = np.maximum(-(-np.diff(bounds) // self.step), 1)
        base = np.concatenate([[0], np.cumsum(steps)])
        owner = np.searchsorted(bounds, at, side="right") - 1
        cell = base[owner] + (at - bounds[owner]) // self.step
        pairs = np.unique(cell * np.int64(len(self.terms)) + number)
        cell, number = pairs // len(self.terms), pairs % len(self.terms)
        last_cell = np.zeros(int(base[-1]), bool)
        last_cell[base[1:] - 1] = True

        def with_next(sums: np.ndarray, last: np.ndarray) -> np.ndarray:
            following = np.zeros_like(sums)
            following[:-1] = sums[1:]
            following[last] = 0
            return sums + following

        able = with_next(np.bincount(cell, self.most[number], int(base[-1])), last_cell) >= self.threshold - _EPS
        wanted = able.copy()
        wanted[1:] |= able[:-1] & ~last_cell[:-1]  # the cells of those passages
        rare = wanted[cell] & self.rare[number]
        cell, number = cell[rare], number[rare]
        cells = np.flatnonzero(wanted)
        size = max(2, CELLS // self.ranges)
        for lo in range(0, len(cells), size - 1):  # a cell more than is moved on by, for the passage that goes over the edge
            own = cells[lo : lo + size]
            first, end = np.searchsorted(cell, (own[0], own[-1] + 1))
            counts = self.block_offsets[number[first:end] + 1] - self.block_offsets[number[first:end]]
            block = np.repeat(self.block_offsets[number[first:end]] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            row = np.repeat(np.searchsorted(own, cell[first:end]), counts)
            sums = np.bincount(row * self.ranges + self.block_range[block], self.block_most[block], len(own) * self.ranges).reshape(len(own), self.ranges)
            apart = np.ones(len(own), bool)
            apart[:-1] = last_cell[own[:-1]] | (own[1:] != own[:-1] + 1)
            hit = able[own] & (with_next(sums, apart) >= self.needed).any(1)
            if lo + size < len(cells):
                hit[-1] = False  # the next turn's first
            for c in own[hit].tolist():
                text = int(np.searchsorted(base, c, side="right")) - 1
                begin = int(bounds[text]) + (c - int(base[text])) * self.step
                yield text, begin, min(int(bounds[text + 1]), begin + 2 * self.step)

    def wand(self, terms: list[int]) -> Iterator[tuple[int, float]]:
        """(item, score) of every item at or above the threshold, for one passage's terms, by block-max WAND."""
        items, ranges, tops, least = self.items, self.ranges_of, self.tops, self.threshold - _EPS
        lists = [[items[self.offsets[t]], int(self.offsets[t]), int(self.offsets[t + 1]), float(self.most[t]), int(self.block_offsets[t]), int(self.block_offsets[t + 1])] for t in terms]

        def move(own: list, to: int) -> None:
            own[1] = bisect_left(items, to, own[1], own[2])
            own[0] = items[own[1]] if own[1] < own[2] else math.inf

        while True:
            lists.sort()
            bound, k = 0.0, -1
            for k, own in enumerate(lists):
                if own[0] == math.inf:
                    return
                bound += own[3]
                if bound >= least:
                    break
            else:
                return
            pivot = lists[k][0]
            while k + 1 < len(lists) and lists[k + 1][0] == pivot:
                k += 1
            part = pivot // RANGE
            bound = 0.0
            for own in lists[: k + 1]:
                own[4] = bisect_left(ranges, part, own[4], own[5])
                if own[4] < own[5] and ranges[own[4]] == part:
                    bound += tops[own[4]]
            if bound < least:  # no item of this range before the next list's item
                beyond = min((part + 1) * RANGE, lists[k + 1][0] if k + 1 < len(lists) else math.inf)
                for own in lists[: k + 1]:
                    move(own, beyond)
            elif lists[0][0] == pivot:
                score = sum(self.impacts[own[1]] for own in lists[: k + 1])
                if score >= least:
                    yield pivot, score
                for own in lists[: k + 1]:
                    move(own, pivot + 1)
            else:
                for own in lists[: k + 1]:
                    if own[0] < pivot:
                        move(own, pivot)

    def search(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, first word, end) of every passage and item at or above the threshold."""
        at, number = self.lookup(hashes)
        for text, begin, end in self.passages(at, number, bounds):
            lo, hi = np.searchsorted(at, (begin, end))
            terms = np.unique(number[lo:hi])
            if self.reaches(terms):
                for item, score in self.wand(terms.tolist()):
                    yield text, item, score, begin, end

    def reaches(self, terms: np.ndarray) -> bool:
        """Whether the block maxima of a passage's different terms reach the threshold in some range of items."""
        rare = terms[self.rare[terms]]
        first = self.block_offsets[rare]
        counts = self.block_offsets[rare + 1] - first
        block = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return bool((np.bincount(self.block_range[block], self.block_most[block], self.ranges) >= self.needed).any())

    def verify(self, item: int, passage: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, its question's and its answer's that the passage holds."""
        return tuple(1.0 if not len(own) else float(np.isin(own, _shingles(passage, width)).mean()) for own, width in self.parts[item])


def _shingles(hashes: np.ndarray, width: int | None = None):
    size = width or max(1, min(WIDTH, len(hashes)))
    found = np.unique(words.shingles(hashes, np.array([0, len(hashes)]), size)[0])
    return found if width else (found, size)


def build(items: list[tuple[object, str]], threshold: float, corpus: Corpus | None = None) -> list[Index]:
    """An index for each length class of the items."""
    hashes, bounds = words.hash_words([t for _, t in items])
    corpus = corpus or Corpus.of([t for _, t in items])
    classes: dict[int, list[tuple[object, np.ndarray]]] = {}
    for (name, _), a, b in zip(items, bounds[:-1].tolist(), bounds[1:].tolist()):
        if b > a:
            classes.setdefault(length_class(b - a), []).append((name, hashes[a:b]))
    return [Index(own, step, threshold, corpus) for step, own in sorted(classes.items())]


def _leaks(parts: list[Index], texts: list[str], least: float, least_part: float) -> Iterator[tuple[int, object, float, float, float, float]]:
    for a, b in words.groups(texts):
        hashes, bounds = words.hash_words(texts[a:b])
        for index in parts:
            best: dict[tuple[int, int], list[float]] = {}
            top: dict[tuple[int, int], float] = {}
            for text, item, score, begin, end in index.search(hashes, bounds):
                key = text, item
                top[key] = max(top.get(key, 0.0), score)
                shares = index.verify(item, hashes[begin:end])
                if shares[0] >= least and min(shares[1:]) >= least_part:
                    best[key] = list(map(max, best.get(key, (0.0,) * 3), shares))
            for key, shares in sorted(best.items()):
                yield a + key[0], index.ids[key[1]], top[key], *shares


def index_blocks(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", threshold: float = 0.5, block_chars: int = 16_000_000) -> Iterator[list[Index]]:
    """Indexes of the items, a bounded number of characters at a time; counts are those of all items."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_chars))
    if count == 1:
        yield build(sorted((tuple(r) for r in rows.collect()), key=repr), threshold)
        return

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, k in zip(batch.column("text").to_pylist(), batch.column("k").to_pylist()):
                hashes, _ = words.hash_words([text])
                own = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own) + 1, k)), pa.array([None, *own.tolist()], pa.int64()), pa.array(np.append(len(hashes), np.zeros(len(own), np.int64)))], names=["k", "term", "n"])

    rows = rows.withColumn("k", F.pmod(F.xxhash64("id", "text"), F.lit(count)))
    held = rows.select("text", "k").mapInArrow(lean(terms), "k long, term long, n long")
    n, length = held.filter("term is null").agg(F.count("*"), F.sum("n")).first()
    df = held.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    for k in range(count):
        own = held.filter((F.col("k") == k) & F.col("term").isNotNull()).select("term").distinct()
        counted = sorted(tuple(r) for r in own.join(df, "term").select(F.col("term"), "df").collect())  # no more than the set's words
        term, number = (np.array([c[j] for c in counted], np.int64) for j in (0, 1))
        order = np.argsort(term.view(np.uint64))
        corpus = Corpus(n, max(1.0, length / n), term.view(np.uint64)[order], number[order])
        yield build(sorted((tuple(r) for r in rows.filter(F.col("k") == k).select("id", "text").collect()), key=repr), threshold, corpus)


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = 0.5, least: float = 0.8, least_part: float = 0.5, block_chars: int = 16_000_000) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of every verified leak."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("item_id", items.schema[item_col].dataType), *(T.StructField(n, T.DoubleType()) for n in ("score", "overlap", "question_overlap", "answer_overlap"))])
    item_type = to_arrow_type(schema["item_id"].dataType)
    out = None
    for index in index_blocks(items, id_col=item_col, threshold=threshold, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = list(_leaks(shared.value, batch.column("text").to_pylist(), least, least_part))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], item_type), *(pa.array([r[k] for r in rows], pa.float64()) for k in range(2, 6))], names=schema.names)

        found = source.mapInArrow(lean(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", threshold: float = 0.5, least: float = 0.8, least_part: float = 0.5, block_chars: int = 16_000_000) -> DataFrame:
    """The rows, with all their columns, of documents that leak no item."""
    small_batches(docs.sparkSession)
    for index in index_blocks(items, id_col=item_col, threshold=threshold, block_chars=block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r[0] for r in _leaks(shared.value, pc.fill_null(batch.column(at), "").to_pylist(), least, least_part)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
