"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words and the beginnings of words (``PREFIXES`` bytes), so compounds
and inflected forms of a term are met as well; a word scores as the best token
it has. A token's weight of evidence comes from log-odds between toxic and clean
labelled texts (there a token counts once a text, since some texts repeat a word
hundreds of times; the scan takes every place) under an informative Dirichlet prior (pseudo counts in
proportion to the pooled frequencies); tokens whose log-odds are at least ``min_odds`` and ``min_z`` standard errors
above zero make up the lexicon. A token's score is the log
likelihood ratio between a toxic passage (a share ``density`` of lexicon
tokens) and clean text, so scores fall on average over clean text. The linear-time scan
for all maximal scoring segments finds the passages; a segment of score S in a
text of n tokens has the E-value K n exp(-lambda S), where K and lambda are those of
the extreme-value law fitted to the best scores of clean texts, and those under
``max_e`` are significant. A document's evidence is the
log of its least E-value, negated; a logistic fit turns it into a score.

The fit uses a bounded sample of labelled rows (``max_rows`` of least hash, a
documented parameter). Scoring runs where the texts are, without a shuffle.

Defined results: null and empty texts have no segment and score low; null labels
are passed over; repeated rows are scored each; without labels of both kinds
every score is 0; other columns are not read. Long texts are scanned in bounded
parts that no word is cut by, and only the places of lexicon words are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import drop_table, lean, materialize, small_batches

PREFIXES = (4, 5, 6, 8)


@dataclass
class ToxicityModel:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of the lexicon
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    drift: float = -0.1  # of every other token
    k: float = 0.1
    scale: float = 1.0  # lambda
    intercept: float = -30.0
    slope: float = 0.0


def maximal_segments(position: np.ndarray, value: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) where `position` holds tokens of positive `value` and every other token scores `drift` < 0.

    The stack keeps disjoint candidates with the running total left (before) and
    right (after) of each, and the place of the nearest one below that began on a
    lower total; a new positive token joins candidates back to such a one, as
    long as that raises the total. Searches follow those places, so the scan is
    linear in the number of positive tokens.
    """
    stack: list[tuple[float, float, int, int, int]] = []
    total, at = 0.0, 0
    for p, v in zip(position.tolist(), value.tolist()):
        total += drift * (p - at)
        left, right, first, end = total, total + v, p, p + 1
        total, at = right, p + 1
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= left:
                k = stack[k][4]
            if k < 0 or stack[k][1] >= right:
                stack.append((left, right, first, end, k))
                break
            left, first = stack[k][0], stack[k][2]
            del stack[k:]
    return [(r - le, f, e) for le, r, f, e, _ in stack]


def tokenize(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For about words.CHUNK characters at a time: hashes of the words (first column) and of their beginnings (0: the word
    isn't longer), and each word's text."""
    for of, parts in words.whole_words(texts):
        if len(parts) == 1 and len(parts[0]) > words.CHUNK:
            yield _long(parts[0]), np.asarray(of, np.int64)
            continue
        data, starts, ends, owner = words.scan(parts)
        columns = [words.span_hashes(data, starts, ends)]
        for size in PREFIXES:
            prefix = words.span_hashes(data, starts, np.minimum(starts + size, ends), salt=size)
            columns.append(np.where(ends - starts > size, prefix, np.uint64(0)))
        yield np.stack(columns, 1), np.asarray(of, np.int64)[owner]


def _long(word: str) -> np.ndarray:
    """The row of one word that is longer than words.CHUNK."""
    data = np.frombuffer(word[: words.CHUNK].encode("utf-8", "replace"), np.uint8)
    first = np.zeros(1, np.int64)
    return np.array([[words.mix(words.long_word(word)), *(words.span_hashes(data, first, first + size, salt=size)[0] for size in PREFIXES)]])


def segments(texts: list[str], model: ToxicityModel) -> tuple[np.ndarray, list[list[tuple[float, int, int]]]]:
    """Words of each text, and its maximal segments."""
    n = np.zeros(len(texts), np.int64)
    hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for tokens, owner in tokenize(texts):
        count = np.bincount(owner, minlength=len(texts))
        if len(model.tokens) and len(tokens):
            at = np.minimum(np.searchsorted(model.tokens, tokens), len(model.tokens) - 1)
            score = np.where(model.tokens[at] == tokens, model.scores[at], 0.0).max(1)
            begin = np.cumsum(count) - count
            hit = np.flatnonzero(score > 0)
            for k in np.unique(owner[hit]).tolist():
                own = hit[owner[hit] == k]
                hits.setdefault(k, []).append((own - begin[k] + n[k], score[own]))
        n += count
    found: list[list[tuple[float, int, int]]] = [[] for _ in texts]
    for k, own in hits.items():
        found[k] = maximal_segments(np.concatenate([p for p, _ in own]), np.concatenate([s for _, s in own]), model.drift)
    return n, found


def evidence(n: np.ndarray, found: list[list[tuple[float, int, int]]], model: ToxicityModel) -> np.ndarray:
    """-log of the least E-value; a text without a segment has the score 0 as its best."""
    return np.array([model.scale * max((s for s, *_ in own), default=0.0) - math.log(model.k * max(int(m), 1)) for m, own in zip(n, found)])


def fit_extremes(top: np.ndarray, n: np.ndarray, least: float) -> tuple[float, float]:
    """(lambda, K) of the law P(S < x) = exp(-K n exp(-lambda x)) of the best score S of a text of n words, by maximum
    likelihood over texts whose S is known only where it reaches `least`, the lowest score that a segment can have.

    For a given lambda the best K is in closed form; lambda is searched on a grid. Fewer than ten texts with a segment
    say too little of the slope, and lambda is 1, which log-likelihood scores have in theory.
    """
    n, met = np.maximum(n, 1), top > 0
    x = np.where(met, top, least)

    def given(scale: float) -> tuple[float, float]:
        mass = float((n * np.exp(-scale * x)).sum())
        k = max(0.5, float(met.sum())) / max(mass, 1e-300)
        return met.sum() * math.log(k * scale) - scale * float(x[met].sum()) - k * mass, k

    grid = [1.0] if met.sum() < 10 else [0.1 + 0.02 * step for step in range(146)]
    scale = max(grid, key=lambda g: given(g)[0])
    return scale, min(1.0, max(1e-12, given(scale)[1]))


def train(docs: DataFrame, sample: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", prior_share: float = 0.01, min_z: float = 2.3, min_odds: float = 3.0, min_docs: int = 5, density: float = 0.1) -> ToxicityModel:
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("label").alias("label"))  # copies of a text are one witness
    chosen = materialize(chosen, "toxicity-chosen")
    try:
        return _train(chosen, prior_share, min_z, min_odds, min_docs, density)
    finally:
        drop_table(chosen)


def _train(chosen: DataFrame, prior_share: float, min_z: float, min_odds: float, min_docs: int, density: float) -> ToxicityModel:

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column("text").to_pylist(), np.array(batch.column("label").to_pylist())
            for a, b in words.groups(texts):
                held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for units, owner in tokenize(texts[a:b]):  # a token counts once a text: repetition in one text is no evidence
                    order = np.lexsort((np.repeat(owner, units.shape[1]), units.ravel()))
                    unit, of = units.ravel()[order], np.repeat(owner, units.shape[1])[order]
                    first = np.concatenate([[True], (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])]) if len(unit) else np.zeros(0, bool)
                    held[0].append(unit[first])
                    held[1].append(of[first])
                unit, of = map(np.concatenate, held)
                order = np.lexsort((of, unit))
                unit, of = unit[order], of[order]
                if len(unit):
                    first = np.concatenate([[True], (unit[1:] != unit[:-1]) | (of[1:] != of[:-1])])
                    unit, of = unit[first], of[first]
                tokens, token = np.unique(unit, return_inverse=True)
                toxic = label[a:b][of] == 1
                cells = [np.bincount(token, toxic, len(tokens)), np.bincount(token, ~toxic, len(tokens))]
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cells)], names=["token", "toxic", "clean"])

    counts = chosen.mapInArrow(lean(count), "token long, toxic long, clean long").filter("token <> 0").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = counts.persist()
    n_t, n_c = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not n_t or not n_c:
        counts.unpersist()
        return ToxicityModel()
    prior = prior_share * (n_t + n_c)  # in proportion, so the evidence a token needs doesn't depend on the sample's size
    alpha = F.lit(prior) * (F.col("toxic") + F.col("clean")) / F.lit(float(n_t + n_c))
    odds = lambda y, n: F.log((y + alpha) / (F.lit(n + prior) - y - alpha))
    spread = F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("clean") + alpha))
    excess = odds(F.col("toxic"), n_t) - odds(F.col("clean"), n_c)
    rows = counts.filter((F.col("toxic") >= min_docs) & (excess >= min_odds) & (excess >= min_z * spread)).select("token", "toxic", ((F.col("clean") + alpha) / (n_c + prior)).alias("null")).collect()  # significant tokens of the bounded sample
    counts.unpersist()
    if not rows:
        return ToxicityModel()
    token = np.array([r["token"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(token)
    share = np.array([r["toxic"] for r in rows], float)[order]
    null = np.array([r["null"] for r in rows], float)[order]
    listed = float(null.sum())
    scores = np.log(density * share / share.sum() / null)
    model = ToxicityModel(token[order][scores > 0], scores[scores > 0], math.log((1 - density) / max(1e-9, 1 - min(listed, density / 2))))
    return _calibrate(chosen, model)


def _calibrate(chosen: DataFrame, model: ToxicityModel) -> ToxicityModel:
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, label = batch.column("text").to_pylist(), batch.column("label").to_pylist()
            for a, b in words.groups(texts):
                n, found = segments(texts[a:b], model)
                top = [max((s for s, *_ in own), default=0.0) for own in found]
                yield pa.RecordBatch.from_arrays([pa.array(label[a:b], pa.int32()), pa.array(n, pa.int64()), pa.array(top, pa.float64())], names=["label", "n", "top"])

    rows = chosen.mapInArrow(lean(best), "label int, n long, top double").collect()  # as many as the bounded sample
    label, n, top = (np.array([r[k] for r in rows], float) for k in range(3))
    clean = label == 0
    model.scale, model.k = fit_extremes(top[clean], n[clean], float(model.scores.min()) if len(model.scores) else 1.0)
    x = np.clip(model.scale * top - np.log(model.k * np.maximum(n, 1)), -20, 20)
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    for _ in range(50):  # Newton steps of a logistic regression with a weak ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - label) + 1e-2 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    model.intercept, model.slope = float(w[0]), float(max(w[1], 0.0))
    return model


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", max_e: float = 0.05) -> DataFrame:
    """The id, score, evidence and the significant segments (first word, end, score) of each text."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the significant tokens
    inner = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("score", T.DoubleType())])
    schema = T.StructType([source.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType()), T.StructField("segments", T.ArrayType(inner))])
    arrow = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                n, found = segments(texts[a:b], model)
                x = np.clip(evidence(n, found, model), -20, 20)
                y = 1 / (1 + np.exp(-np.clip(model.intercept + model.slope * x, -30, 30)))
                kept = [[{"first_word": f, "end_word": e, "score": s} for s, f, e in own if model.k * max(int(m), 1) * math.exp(-model.scale * s) <= max_e] for m, own in zip(n, found)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(y), pa.array(x), pa.array(kept, arrow)], names=schema.names)

    return source.mapInArrow(lean(run), schema)
