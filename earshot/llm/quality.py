"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole
text is encoded: signed hashed words beside measures of its shape (shares of
character classes, word lengths, repetition). A small network embeds passages;
gated attention (tanh and sigmoid branches) weighs them; the score is the
logistic of the weighted mean embedding. Encoder, attention and output are
learnt together from document labels alone.

The fit runs on the driver over a bounded sample of labelled rows (``max_rows``
rows of least hash, a documented parameter); scoring runs where the texts are,
in batches, without a shuffle.

Defined results: a null or empty text is one empty passage and gets a score; null
labels are passed over, a doc_id that is labelled more than once counts once
(its lowest label), one with more than one text is learnt from the least of
them; repeated rows are scored each; no labels at all give the score 0.5
everywhere; other columns are not read. Texts are encoded stretch by stretch, so a
passage's features are the same in a text of any length; a run of over ``RUN``
bytes without white space counts as several words, in any text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import lean, small_batches

PASSAGE = 64
STRETCH = 16
RUN = 1024
HASHED = 48
#: Character classes by byte: 0 lower case, 1 upper case, 2 digit, 3 white space, 4 sentence mark, 5 bar, 6 exclamation, 7 beyond ASCII, 8 other symbol, 9 line break.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9, 11, 12, 13, 0]], _CLASS[[ord(c) for c in ".,;:?'\"()-"]], _CLASS[ord("|")], _CLASS[ord("!")], _CLASS[10] = 3, 4, 5, 6, 9
CLASSES = 10
WIDTH = HASHED + CLASSES + 7


_STRETCH = re.compile(rb"[\0\t-\r ]*+(?:[^\0\t-\r ]{1,%d}+[\0\t-\r ]*+){1,%d}+" % (RUN, PASSAGE * STRETCH))


def _sections(text: str) -> Iterator[bytes]:
    """The text in whole stretches, about words.CHUNK bytes at a time."""
    data = text.encode("utf-8", "replace")
    begin = at = 0
    while len(data) - begin > words.CHUNK and (m := _STRETCH.match(data, at)):
        if m.end() - begin > words.CHUNK and at > begin:
            yield data[begin:at]
            begin = at
        at = m.end()
    yield data[begin:]


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of the texts as rows of features, and the text of each."""
    features, bags = [np.zeros((0, WIDTH), np.float32)], [np.zeros(0, np.int64)]

    def flush() -> None:
        x, bag = _encode(held)
        features.append(x)
        bags.append(np.asarray(owner, np.int64)[bag])

    held, owner, total = [], [], 0
    for k, text in enumerate(texts):
        for section in _sections(text):
            if held and total + len(section) > words.CHUNK:
                flush()
                held, owner, total = [], [], 0
            held.append(section)
            owner.append(k)
            total += len(section)
    if held:
        flush()
    return np.concatenate(features), np.concatenate(bags)


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts, ends, owner = words.scan(texts, by_space=True)
    if (ends - starts > RUN).any():
        pieces = -(-(ends - starts) // RUN)
        of = np.repeat(np.arange(len(starts)), pieces)
        starts = starts[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * RUN
        ends, owner = np.minimum(starts + RUN, ends[of]), owner[of]
    hashes = words.span_hashes(data, starts, ends)
    n = len(texts)
    per_text = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    passages = np.maximum(-(-per_text // PASSAGE), 1)
    base = np.concatenate([[0], np.cumsum(passages)])
    count = int(base[-1])
    of_word = base[owner] + (np.arange(len(owner)) - first[owner]) // PASSAGE
    stretch = of_word - (of_word - base[owner]) % STRETCH
    features = np.zeros((count, WIDTH), np.float32)
    size = np.bincount(of_word, minlength=count).astype(np.float32)
    per = np.maximum(size, 1)
    # a text's first passage begins with the text, the others with their first word: no byte counts for another text
    text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    opens = np.zeros(count, np.int64)
    opens[base[:-1]] = text_starts
    later = np.flatnonzero(np.diff(of_word, prepend=-1)) if len(owner) else np.zeros(0, np.int64)
    later = later[~np.isin(of_word[later], base[:-1])]
    opens[of_word[later]] = starts[later]
    of_byte = np.repeat(np.arange(count), np.diff(np.append(opens, len(data) if n else 0)))
    kind = _CLASS[data[: len(of_byte)]]
    kind[np.append(text_starts[1:], len(data))[:n] - 1] = CLASSES  # what joins the texts is no part of them
    classes = np.bincount(of_byte * (CLASSES + 1) + kind, minlength=count * (CLASSES + 1)).reshape(count, CLASSES + 1)[:, :CLASSES].astype(np.float32)
    features[:, HASHED : HASHED + CLASSES] = classes / np.maximum(classes.sum(1, keepdims=True), 1)
    if len(owner):
        sign = ((hashes >> np.uint64(40)) & np.uint64(1)).astype(np.float32) * 2 - 1
        bucket = (hashes % np.uint64(HASHED)).astype(np.int64)
        features[:, :HASHED] = np.bincount(of_word * HASHED + bucket, sign, count * HASHED).reshape(count, HASHED) / per[:, None]
        length = (ends - starts).astype(np.float32)
        rest = features[:, HASHED + CLASSES :]
        rest[:, 0] = np.bincount(of_word, length, count) / per / 10
        rest[:, 1] = np.bincount(of_word, length <= 3, count) / per
        rest[:, 2] = np.bincount(of_word, length > 14, count) / per
        same = np.zeros(len(hashes), np.float32)
        same[1:] = (hashes[1:] == hashes[:-1]) & (stretch[1:] == stretch[:-1])
        rest[:, 3] = np.bincount(of_word, same, count) / per
        tagged = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        new = np.concatenate([[True], tagged[1:] != tagged[:-1]])
        rest[:, 4] = np.bincount((tagged[new] >> np.uint64(40)).astype(np.int64), minlength=count) / per
        whole = np.flatnonzero(stretch[2:] == stretch[:-2])  # three words of one stretch
        with np.errstate(over="ignore"):
            triple = hashes[whole] * np.uint64(3) + hashes[whole + 1] * np.uint64(5) + hashes[whole + 2] * np.uint64(7)
            keyed = words.mix(triple + stretch[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keyed)
        equal = keyed[order][1:] == keyed[order][:-1]
        again = np.zeros(len(hashes), np.float32)
        again[whole[order[1:][equal]]] = 1
        again[whole[order[:-1][equal]]] = 1
        rest[:, 5] = np.bincount(of_word, again, count) / per
    features[:, -1] = np.log1p(size) / 5
    return features, np.repeat(np.arange(n), passages)


class AttentionModel:
    """h = tanh(x E); a = softmax over a bag of (tanh(h V) * sigmoid(h U)) w; p = sigmoid((sum a h) c + d)."""

    def __init__(self, width: int, *, hidden: int = 24, gate: int = 12, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"E": draw(width + 1, hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate, 1), "c": draw(hidden, 1), "d": np.zeros((1, 1), np.float32)}
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, np.ones((len(z), 1), np.float32)]).astype(np.float32)

    def _forward(self, z: np.ndarray, bag: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(z @ p["E"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = ((t * s) @ p["w"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        m = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))[:, 0]
        return {"h": h, "t": t, "s": s, "a": a, "m": m, "y": y}

    def predict(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """bag: numbers from 0 on, ascending, none left out."""
        return self._forward(self._inputs(x), bag, np.flatnonzero(np.diff(bag, prepend=-1)))["y"]

    def fit(self, x: np.ndarray, bag: np.ndarray, label: np.ndarray, *, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> AttentionModel:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z, first = self._inputs(x), np.flatnonzero(np.diff(bag, prepend=-1))
        weight = np.ones(len(label), np.float32) / len(label)
        first_moment = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            f, p = self._forward(z, bag, first), self.p
            dy = ((f["y"] - label) * weight)[:, None].astype(np.float32)
            dm = (dy @ p["c"].T)[bag]
            da = (dm * f["h"]).sum(1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, first)[bag])
            gate = f["t"] * f["s"]
            dgate = de[:, None] * p["w"].T
            dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
            dh = f["a"][:, None] * dm + dt @ p["V"].T + ds @ p["U"].T
            g = {"c": f["m"].T @ dy, "d": dy.sum(0, keepdims=True), "w": gate.T @ de[:, None], "V": f["h"].T @ dt, "U": f["h"].T @ ds, "E": z.T @ (dh * (1 - f["h"] ** 2))}
            for k in p:
                grad = g[k] + decay * p[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                p[k] = (p[k] - rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def labelled_sample(labels: DataFrame, *, label_col: str, max_rows: int, id_col: str = "doc_id", exclude=None) -> DataFrame:
    """max_rows rows (doc_id, label) of least hash, so any run takes the same ones; its size is bounded by that parameter."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if exclude is not None:
        rows = rows.filter(~exclude)
    return rows.groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, sample: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> AttentionModel | None:
    """Fits on all passages of the sampled documents, one text an id: the driver gets 65 numbers a passage of the bounded sample."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    chosen = source.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("x")).select("doc_id", "x.*")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels, ids = (batch.column(c).to_pylist() for c in ("text", "label", "doc_id"))
            for a, b in words.groups(texts):
                x, bag = encode(texts[a:b])
                rows = [own.tobytes() for own in np.split(x, np.flatnonzero(np.diff(bag)) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in ids[a:b]]), pa.array(labels[a:b], pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])

    rows = sorted(tuple(r) for r in chosen.mapInArrow(lean(bags), "doc_id string, label int, x binary").collect())  # at most as many as the sample
    if len({r[1] for r in rows}) < 2:
        return None
    sets = [np.frombuffer(r[2], np.float32).reshape(-1, WIDTH) for r in rows]
    return AttentionModel(WIDTH).fit(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.array([r[1] for r in rows], np.float32))


def score(docs: DataFrame, model: AttentionModel | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (or the columns of `keep`) and score."""
    keep = keep or [id_col]
    fields = [docs.schema[c] for c in keep]
    small_batches(docs.sparkSession)
    source = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(text_col, F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in words.groups(texts):
                y = model.predict(*encode(texts[a:b])) if model else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(y.astype(np.float64))], names=[*keep, "score"])

    return source.mapInArrow(lean(run), T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, model: AttentionModel | None, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score at the threshold or above."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            good = [model.predict(*encode(texts[a:b])) >= threshold if model else np.ones(b - a, bool) for a, b in words.groups(texts)]
            yield batch.filter(pa.array(np.concatenate([*good, np.zeros(0, bool)])))

    return docs.mapInArrow(lean(run), docs.schema)
