"""Language identification: word frequencies first, then ever shorter character n-grams.

A word is a run of letters of the lower-cased text, 64 at most (a longer run
is as many words as it fills). A word that training knows scores by its log
frequency in each language. For one that it doesn't, the n-grams of 5 characters
(marks at both ends of the word) that training knows score, by their mean; if it
knows none of them, those of 4, then of 3, 2 and 1; else the word says nothing.
Frequencies are smoothed towards the token's share over all languages. A text's
evidence is the sum over its words divided by the root of their number, as words of a text are not
independent, plus the log share of the language among the rows learnt from; the
score is the probability that follows for the language with most of it.

Training counts on a sample of about ``max_rows`` rows a language, drawn by the
hash of id and text, and keeps the ``max_words`` most frequent words and the ``max_grams`` most
frequent n-grams of each length, so what is sent to the workers is bounded:
(max_words + 5 max_grams) (8 + 4 languages) bytes, of at most ``max_languages`` languages.
Prediction is a map over the texts.

Defined results: ``und`` with score 0 for a null text, one without a letter, and
every text if no row could be learnt from; null and repeated ids and repeated rows
are rows like others; rows of null language or text teach nothing; an empty
table gives none; other columns are not read. Very long texts are worked on in
parts that are cut where no word is.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, lean, materialize, small_batches

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
#: Letters of a word at most; parts of a text end at multiples of it, counted from a run's first letter.
LONGEST = 64
PART = 1 << 17
_MARK = 32


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tokens: dict[int, np.ndarray] = field(default_factory=dict)  # sorted hashes; of words under 0, of n-grams under their length
    scores: dict[int, np.ndarray] = field(default_factory=dict)  # a row a token, a column a language


def held_out(doc_id: Column) -> Column:
    """The fold whose languages the registered query doesn't learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def parts(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For about PART characters at a time: code points with marks for all but letters, and of each word first place, end, and text."""
    letter = _letters()
    held, owners, total = [], [], 0
    for k, text in enumerate(texts):
        lowered, at = text.lower(), 0
        while at < len(lowered):
            points = _points(lowered[at : at + PART])
            inside = letter[points]
            end = at + len(points)
            if end < len(lowered):
                gaps = np.flatnonzero(~inside)
                keep = int(gaps[-1]) + 1 if len(gaps) else len(points) - len(points) % LONGEST
                points, inside, end = points[:keep], inside[:keep], at + keep
            held.append(np.append(np.where(inside, points, _MARK), _MARK).astype(np.uint32))
            owners.append(k)
            total += len(held[-1])
            at = end
            if total >= PART:
                yield _words(held, owners)
                held, owners, total = [], [], 0
    if held:
        yield _words(held, owners)


def _words(held: list[np.ndarray], owners: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.concatenate([np.array([_MARK], np.uint32), *held])
    inside = data != _MARK
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    owner = np.asarray(owners, np.int64)[np.searchsorted(np.cumsum([len(h) for h in held]), starts - 1, side="right")]
    if len(starts) and int((ends - starts).max()) > LONGEST:
        pieces = -(-(ends - starts) // LONGEST)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = (np.repeat(starts, pieces) + nth * LONGEST)[nth > 0]
        data, owner = np.insert(data, cut, _MARK), np.repeat(owner, pieces)
        inside = data != _MARK
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
    return data, starts, ends, owner


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' n-grams (of length 1: their letters) and the word of each; a mark stands before and after a word."""
    first, last = (starts, ends) if n == 1 else (starts - 1, ends + 1)
    count = np.maximum(last - first - n + 1, 0)
    of = np.repeat(np.arange(len(starts)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    return words.span_hashes(data, place, place + n, salt=n), of


def _count(token: np.ndarray, language: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((language, token))
    token, language = token[order], language[order]
    first = np.flatnonzero(np.concatenate([[len(token) > 0], (token[1:] != token[:-1]) | (language[1:] != language[:-1])]))
    return token[first], language[first], np.diff(np.append(first, len(token)))


def train(docs: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", exclude: Column | None = None, max_rows: int = 5000, max_words: int = 50_000, max_grams: int = 20_000, max_languages: int = 200, pseudo: float = 1.0) -> LanguageModel:
    """Learns from the rows with a language and a text that `exclude` doesn't hold for."""
    small_batches(docs.sparkSession)
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if exclude is not None:
        rows = rows.filter(~F.coalesce(exclude, F.lit(False)))
    known = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not known:
        return LanguageModel()
    known = sorted(known, key=lambda r: r["lang"])
    number, size = {r["lang"]: k for k, r in enumerate(known)}, np.array([r["count"] for r in known], float)
    table = F.create_map(*(x for r in known for x in (F.lit(r["lang"]), F.struct(F.lit(number[r["lang"]]).alias("k"), F.lit(min(1.0, max_rows / r["count"])).alias("share")))))
    sample = rows.select(F.get(F.array(table), F.lit(0))[F.col(lang_col).cast("string")].alias("own"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(id_col, text_col, F.lit("language")), F.lit(1 << 20)) / float(1 << 20)).alias("u"))
    sample = sample.filter("u < own.share").select(F.col("own.k").alias("language"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column("text").to_pylist(), np.array(batch.column("language").to_pylist(), np.int32)
            for a, b in words.groups(texts):
                for data, starts, ends, owner in parts(texts[a:b]):
                    language = own[a:b][owner]
                    for n in (0, *LENGTHS):
                        token, of = (words.span_hashes(data, starts, ends), np.arange(len(starts))) if n == 0 else grams(data, starts, ends, n)
                        token, spoken, times = _count(token, language[of])
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), n, np.int32)), pa.array(token.view(np.int64)), pa.array(spoken), pa.array(times.astype(np.int64))], names=["kind", "token", "language", "n"])

    counted = sample.mapInArrow(lean(count), "kind int, token long, language int, n long").groupBy("kind", "token", "language").agg(F.sum("n").alias("n"))
    cells = materialize(counted.groupBy("kind", "token").agg(F.sum("n").alias("total"), F.collect_list(F.struct("language", "n")).alias("by")), "language-counts")  # a token's list has an entry a language
    model = LanguageModel([r["lang"] for r in known], np.log(size / size.sum()))
    for n in (0, *LENGTHS):
        own = cells.filter(F.col("kind") == n)
        top = own.orderBy(F.desc("total"), "token").limit(max_grams if n else max_words).toArrow()  # bounded by these parameters
        token = top.column("token").to_numpy().view(np.uint64)
        by = top.column("by").combine_chunks()
        flat = by.flatten()
        times = np.zeros((len(token), len(known)))
        times[np.repeat(np.arange(len(token)), by.value_lengths().to_numpy(zero_copy_only=False)), flat.field("language").to_numpy(zero_copy_only=False)] = flat.field("n").to_numpy(zero_copy_only=False)
        spoken = np.maximum(times.sum(0), 1.0)
        share = times.sum(1) / max(times.sum(), 1.0)
        order = np.argsort(token)
        strength = pseudo * max(len(token), 1)
        model.tokens[n] = token[order]
        model.scores[n] = np.log((times + strength * share[:, None]) / (spoken + strength))[order].astype(np.float32)
    drop_table(cells)
    return model


def _look_up(model: LanguageModel, n: int, token: np.ndarray) -> np.ndarray:
    """Row of each token in the model's table, -1 for one it doesn't hold."""
    known = model.tokens[n]
    if not len(known):
        return np.full(len(token), -1)
    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
    return np.where(known[at] == token, at, -1)


def evidence(texts: list[str], model: LanguageModel) -> np.ndarray:
    """Prior and words' scores of each text, a column a language."""
    n_words, total = np.zeros(len(texts)), np.zeros((len(texts), len(model.languages)))
    for data, starts, ends, owner in parts(texts):
        score = np.zeros((len(starts), len(model.languages)), np.float32)
        row = _look_up(model, 0, words.span_hashes(data, starts, ends))
        score[row >= 0] = model.scores[0][row[row >= 0]]
        left = np.flatnonzero(row < 0)
        for n in LENGTHS:
            if not len(left):
                break
            token, of = grams(data, starts[left], ends[left], n)
            at = _look_up(model, n, token)
            of, at = of[at >= 0], at[at >= 0]
            times = np.bincount(of, minlength=len(left))
            met = np.flatnonzero(times)
            if len(met):  # `of` ascends, so a word's n-grams stand together
                first = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1])
                score[left[met]] = np.add.reduceat(model.scores[n][at], first, axis=0) / times[met][:, None]
            left = left[times == 0]
        n_words += np.bincount(owner, minlength=len(texts))
        if len(owner):
            first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
            np.add.at(total, owner[first], np.add.reduceat(score, first, axis=0, dtype=np.float64))
    return model.prior + total / np.sqrt(np.maximum(n_words, 1))[:, None]


def predict(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each text."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).otherwise("").alias("text"))
    if not model.languages:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train()'s parameters
    schema = T.StructType([source.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                x = evidence(texts[a:b], model)
                x = np.exp(x - x.max(1, keepdims=True))
                best = x.argmax(1)
                score = 1 / x.sum(1)
                spoken = [t != "" for t in texts[a:b]]
                said = [model.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), spoken)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(said, pa.string()), pa.array(np.where(spoken, score, 0.0))], names=schema.names)

    return source.mapInArrow(lean(run), schema)
