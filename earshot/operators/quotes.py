"""Quotes held against a whole corpus: which of them are part of some text, case and all.

Many patterns in one pass of the texts. Every quote is stood for by an anchor, a
run of 32 of its characters (16, 8, .. for shorter quotes): of up to 16 runs spread over it
the one that fewest quotes have, so a common opening costs nothing. A worker hashes all
runs of a text by running sums (a few array steps a length, whatever the number of
quotes), looks them up among the anchors, and holds what surrounds a hit against
the quotes of that anchor by hash; the first place of each quote in a text is then
compared character by character, so what is reported is exact.

The quotes are sent to the workers in blocks of at most ``block_chars``
characters (their texts, and 48 bytes a quote), each one pass; a block
holds over 100,000 quotes of a comment's length. Texts stream by, in parts that
overlap by the longest quote, and nothing is kept of them but (scope, quote) rows.

Defined results: null quotes and texts are left out; the empty quote is part of
every text; repeated quotes are one; with ``by`` columns a quote is looked
for in texts of each scope apart (nulls are a scope); empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTHS = (32, 16, 8, 4, 2, 1)
#: Runs of a quote, spread over it, of which its anchor is chosen.
TRIED = 16
#: Characters of texts worked on at once.
PART = 1 << 17
#: Places looked into at once.
SLICE = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Sums:
    """Hashes of any spans of a row of characters, from running sums of a polynomial modulo 2 ** 64."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        with np.errstate(over="ignore"):
            up, self.down = np.full(n + 1, _P), np.full(n + 1, _BACK)
            up[0] = self.down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(self.down, out=self.down)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * up[:n], dtype=np.uint64)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            h = (h ^ (h >> np.uint64(31))) * _MIX
            return h ^ (h >> np.uint64(29))


@dataclass
class Patterns:
    """A block of quotes: for each anchor length, the sorted anchors, and of each quote its anchor's place, length and hash."""

    quotes: list[str]
    anchors: dict[int, np.ndarray]
    quote: dict[int, np.ndarray]  # numbers of quotes, in the order of the anchors
    offset: np.ndarray
    length: np.ndarray
    whole: np.ndarray
    longest: int


def patterns(quotes: list[str]) -> Patterns:
    quotes = [q for q in quotes if q]
    size = np.fromiter(map(len, quotes), np.int64, len(quotes))
    whole, offset = np.zeros(len(quotes), np.uint64), np.zeros(len(quotes), np.int64)
    length = np.array(LENGTHS)[np.argmax(size[:, None] >= np.array(LENGTHS), 1)] if len(quotes) else size
    tried = np.minimum(size - length + 1, TRIED)
    of, place, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    edges = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + (1 << 20), 1 << 20)[1:], side="left") + 1
    for lo, hi in zip(np.concatenate([[0], edges[:-1]]), edges):  # quotes of about a million characters at a time
        lo, hi = min(int(lo), len(quotes)), min(int(hi), len(quotes))
        if lo == hi:
            continue
        begin = np.cumsum(size[lo:hi]) - size[lo:hi]
        sums = Sums(_points("".join(quotes[lo:hi])))
        whole[lo:hi] = sums.hashes(begin, begin + size[lo:hi])
        own = np.repeat(np.arange(lo, hi), tried[lo:hi])
        nth = np.arange(len(own)) - np.repeat(np.cumsum(tried[lo:hi]) - tried[lo:hi], tried[lo:hi])
        at = nth * (size[own] - length[own]) // np.maximum(tried[own] - 1, 1)  # spread over the quote
        h.append(sums.hashes(begin[own - lo] + at, begin[own - lo] + at + length[own]))
        of.append(own)
        place.append(at)
    of, place, h = map(np.concatenate, (of, place, h))
    # of a quote's runs the rarest, the first of equals
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    order = np.lexsort((place, times[at], of))
    least = order[np.cumsum(tried) - tried]
    offset[:] = place[least]
    anchors, number = {}, {}
    for k in LENGTHS:
        own = np.flatnonzero(length == k)
        if len(own):
            number[k] = own[np.argsort(h[least[own]], kind="stable")]
            anchors[k] = h[least[number[k]]]
    return Patterns(quotes, anchors, number, offset, size, whole, int(size.max(initial=0)))


def _hits(points: np.ndarray, owner_of: np.ndarray, ends: np.ndarray, known: Patterns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, quote, place) of quotes in the joined texts; a text's characters end at ends[text]."""
    sums = Sums(points)
    n = len(points)
    for k, anchors in known.anchors.items():
        if n < k:
            continue
        marked = np.zeros(1 << 16, bool)
        marked[(anchors & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.arange(n - k + 1)
        h = sums.hashes(at, at + k)
        at = np.flatnonzero(marked[(h & np.uint64(0xFFFF)).astype(np.int64)])
        h = h[at]
        low, high = np.searchsorted(anchors, h), np.searchsorted(anchors, h, side="right")
        met = high > low
        at, low, high = at[met], low[met], high[met]
        reach = np.concatenate([[0], np.cumsum(high - low)])
        done = 0
        while done < len(at):  # an anchor that many quotes share is looked into bit by bit
            upto = max(done + 1, int(np.searchsorted(reach, reach[done] + SLICE, side="right")) - 1)
            times = (high - low)[done:upto]
            place = np.repeat(at[done:upto], times)
            nth = np.arange(len(place)) - np.repeat(reach[done:upto] - reach[done], times)
            quote = known.quote[k][np.repeat(low[done:upto], times) + nth]
            start = place - known.offset[quote]
            end = start + known.length[quote]
            fits = (start >= 0) & (end <= n)
            start, end, quote = start[fits], end[fits], quote[fits]
            text = owner_of[start]
            fits = (end <= ends[text]) & (sums.hashes(start, end) == known.whole[quote])
            yield text[fits], quote[fits], start[fits]
            done = upto


def found_in(texts: list[str], known: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(text, quote) numbers, each pair once."""
    texts_of, quotes_of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(PART, 4 * known.longest)

    def look(part: list[tuple[int, str]]) -> None:
        points = np.concatenate([p for _, t in part for p in (_points(t), np.zeros(1, "<u4"))])
        length = np.fromiter((len(t) for _, t in part), np.int64, len(part))
        begin = np.concatenate([[0], np.cumsum(length + 1)])
        owner_of = np.repeat(np.arange(len(part)), length + 1)
        pairs: dict[tuple[int, int], int] = {}
        for text, quote, start in _hits(points, owner_of, begin[:-1] + length, known):
            key = text * len(known.quotes) + quote
            _, once = np.unique(key, return_index=True)
            for t, q, s in zip(text[once].tolist(), quote[once].tolist(), start[once].tolist()):
                pairs.setdefault((t, q), s)
        sound = [(part[t][0], q) for (t, q), s in pairs.items() if part[t][1].startswith(known.quotes[q], s - int(begin[t]))]
        if sound:
            texts_of.append(np.array([t for t, _ in sound]))
            quotes_of.append(np.array([q for _, q in sound]))

    held, total = [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text)), step):
            piece = text[at : at + step + max(0, known.longest - 1)]
            held.append((k, piece))
            total += len(piece)
            if total >= step:
                look(held)
                held, total = [], 0
    if held:
        look(held)
    pair = np.unique(np.concatenate(texts_of) * max(1, len(known.quotes)) + np.concatenate(quotes_of))
    return pair // max(1, len(known.quotes)), pair % max(1, len(known.quotes))


def find(quotes: DataFrame, texts: DataFrame, *, quote: str = "quote", text: str = "text", by: Sequence[str] = (), block_chars: int = 16_000_000) -> DataFrame:
    """(by columns, quote): the distinct quotes that are part of some text of a scope.

    `quotes` is a stated query set, sent to the workers in blocks by hash; it must give the same rows when it is read again.
    """
    spark = quotes.sparkSession
    asked = quotes.select(F.col(quote).alias("quote")).filter("quote IS NOT NULL").distinct()
    scope = [f"k{i}" for i in range(len(by))]
    source = texts.select(*(F.col(c).alias(n) for c, n in zip(by, scope)), F.col(text).alias("text")).filter("text IS NOT NULL")
    schema = T.StructType([*(source.schema[n] for n in scope), T.StructField("quote", T.StringType())])
    chars = asked.agg(F.sum(F.char_length("quote") + 8)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    hits = []
    for number in range(blocks):
        block = [r["quote"] for r in asked.filter(F.pmod(F.xxhash64("quote"), F.lit(blocks)) == number).toLocalIterator()]  # about block_chars characters
        shared = spark.sparkContext.broadcast((patterns(block), "" in block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, blank = shared.value
            for batch in batches:
                texts = batch.column("text").to_pylist()
                of, quote = found_in(texts, known) if known.quotes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                said = [known.quotes[q] for q in quote.tolist()]
                if blank:
                    of, said = np.concatenate([of, np.arange(len(texts))]), [*said, *[""] * len(texts)]
                own = batch.take(pa.array(of)).select(scope) if scope else None
                columns = [*(own.columns if scope else []), pa.array(said, pa.string())]
                rows = pa.Table.from_arrays(columns, names=schema.names).group_by(schema.names).aggregate([]) if said else pa.Table.from_arrays(columns, names=schema.names)
                yield from rows.select(schema.names).to_batches()

        hits.append(source.mapInArrow(run, schema))
    together = hits[0]
    for more in hits[1:]:
        together = together.unionByName(more)
    return together.distinct().select(*(F.col(n).alias(c) for n, c in zip(scope, by)), "quote")
