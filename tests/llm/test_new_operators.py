"""Resampling, vector codes and language identification: brute force, edge rows, long texts, held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import codes, language, resampling
from earshot.llm.registry import QUERIES

from .fixtures import SF, edge_frames, edge_texts

LONG = "x" * 1_000_000


def resampled_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, max_n=1, n_buckets=10_000):
    w = resampled_words(text)
    return [zlib.crc32(" ".join(w[k : k + n]).encode()) % n_buckets for n in range(1, max_n + 1) for k in range(len(w) - n + 1)]


def drawn(rows, target, max_n=1, n_buckets=10_000):
    own, aims = Counter(), Counter()
    for _, text in rows:
        own.update(buckets_of(text, max_n, n_buckets))
    for text in target:
        aims.update(buckets_of(text, max_n, n_buckets))
    s, t = sum(own.values()), sum(aims.values())
    gain = [math.floor(1000 * math.log((aims[b] + 1.0) * (s + float(n_buckets)) / ((own[b] + 1.0) * (t + float(n_buckets))))) for b in range(n_buckets)]
    out = []
    for doc_id, text in rows:
        held = [gain[b] for b in buckets_of(text, max_n, n_buckets)]
        weight = sum(held) // len(held) if held else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(held), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(resampled_words(text))])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted((r[:5] for r in out), key=repr)


@pytest.mark.parametrize("max_n,part", [(1, 7), (1, 1 << 17), (3, 7), (3, 1 << 17)])
def test_features_are_those_of_the_definition(max_n, part):
    texts = [t or "" for t in edge_texts()[:9]] + ["A_b  ÄÖ1-x", "é" * 90 + " B" * 3, "\0a\0", "x" * 300 + " tail", "a", "b c"]
    found, bounds, n_words = resampling.features(texts, max_n=max_n, part=part)
    for k, text in enumerate(texts):
        assert sorted(found[bounds[k] : bounds[k + 1]].tolist()) == sorted(buckets_of(text, max_n))
        assert n_words[k] == len(resampled_words(text))


def test_resampling_by_brute_force(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, aims = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    assert sorted((list(r) for r in QUERIES["op11_importance_resampling"](spark, SF).collect()), key=repr) == drawn(rows, aims)
    pairs = resampling.draw(resampling.weigh(docs, target, max_n=2, n_buckets=60_000)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((list(r) for r in pairs), key=repr) == drawn(rows, aims, 2, 60_000)
    kept = resampling.resample(docs, target)
    assert kept.columns == docs.columns and kept.count() == sum(r[4] is not None for r in drawn(rows, aims))


def test_resampling_edges(spark):
    target = spark.createDataFrame([(1, "mail w001x w002x"), (2, None), (None, "")], "item_id bigint, text string")
    for _, df in edge_frames(spark):
        df = df.unionByName(df.limit(1).withColumn("text", F.lit(f"{LONG} {LONG}!" + " w003x" * 30)))
        out = resampling.draw(resampling.weigh(df, target), percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
        expected = drawn([(r.doc_id, r.text) for r in df.collect()], ["mail w001x w002x"])
        assert sorted([list(r)[:4] for r in out], key=repr) == sorted([r[:4] for r in expected], key=repr)
        able = sum(len(resampled_words(r.text)) >= 20 for r in df.collect())
        assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, able // 2 + 1))
        nothing = resampling.weigh(df, target.limit(0))
        assert nothing.count() == df.count()
    with pytest.raises(ValueError):
        resampling.streams(df, n_buckets=1 << 17)


def lloyd(rows, n_parts=8, n_entries=16, rounds=6):
    """Plain product quantisation over (id, label, integer vector)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    size = -(-len(rows[0][2]) // n_parts)
    x = [np.array([*r[2], *[0] * (size * n_parts - len(r[2]))]).reshape(n_parts, size) for r in rows]
    books = [[v[p].copy() for v in x[:n_entries]] for p in range(n_parts)]
    pick = lambda v, p: min((int(((v[p] - c) ** 2).sum()), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(n_parts):
            own = [pick(v, p)[1] for v in x]
            for e in range(len(books[p])):
                if held := [v[p] for v, o in zip(x, own) if o == e]:
                    books[p][e] = np.array([int(s) // len(held) for s in np.sum(held, 0)])
    found = [[pick(v, p) for p in range(n_parts)] for v in x]
    error, labels = [sum(d for d, _ in f) for f in found], Counter()
    for r, e in zip(rows, error):
        labels[r[1]] += e
    spelt = hashlib.sha256(",".join(str(int(v)) for p in books for c in p for v in c).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), err, labels[r[1]]) for r, f, err in zip(rows, found, error)), key=repr), spelt


def test_codes_by_brute_force(spark):
    rows = [(r.vec_id, r.label, [math.floor(4096 * x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    expected, spelt = lloyd(rows)
    out = QUERIES["op12_vector_codes"](spark, SF).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out), key=repr) == expected
    assert {r.codebooks_sha256 for r in out} == {spelt}


def test_code_edges(spark):
    rng = random.Random(4)
    nan, inf = float("nan"), float("inf")
    plain = [(k % 40, k % 3 if k % 4 else None, [rng.choice([-1.0, 0.0, 0.25, rng.uniform(-2, 2)]) for _ in range(12)]) for k in range(90)]
    plain += [(None, 1, [0.5] * 12), (None, None, [0.5] * 12)] + [(7, 2, [0.0] * 12)] * 20
    bad = [(1, 1, None), (2, 1, [None] * 12), (3, 1, [nan] * 12), (4, 1, [inf] + [0.0] * 11), (5, 1, [-inf] + [0.0] * 11), (6, 1, []), (0, 1, [1.0] * 5)]
    schema = "vec_id long, label int, embedding array<float>, code string, packed int, v int, error int"
    for rows in (plain + bad, plain[:5], bad[:5], []):
        df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)
        out, books = codes.compress(df)
        got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr)
        kept = [r for r in rows if r[2] is not None and len(r[2]) == 12 and all(x is not None and math.isfinite(x) for x in r[2])]
        if not kept:
            assert got == [] and books is None
            continue
        single = [(i, label, [math.floor(4096 * float(np.float32(x))) for x in v]) for i, label, v in kept]
        expected, spelt = lloyd(single)
        assert got == expected and codes.digest(books) == spelt
    decoded = codes.decode(out.limit(0), np.zeros((8, 2, 3), np.int64)).schema["vector"].dataType.simpleString()
    assert decoded == "array<double>"


def test_filter_loses_nothing_and_saves_distances():
    r = np.random.default_rng(2)
    for size, spread in ((8, 2000), (3, 2), (1, 5), (32, 1 << 20), (8, 1 << 28)):
        centres = r.integers(-spread, spread, (16, size))
        x = centres[r.integers(0, 16, 2000)] + r.integers(-max(1, spread // 20), max(2, spread // 20), (2000, size))
        best, far, taken = codes.nearest(x, centres)
        every = ((x[:, None] - centres[None]) ** 2).sum(-1)
        assert (best == every.argmin(1)).all() and (far == every.min(1)).all()
        if spread > 1000:
            assert taken < 0.35 * every.size


def test_labels_beyond_what_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "BROADCAST_ROWS", 5)
    rows = [(k, None if k % 3 == 0 else k % 11, "00", k) for k in range(300)]
    out = codes.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, code string, error long")).collect()
    total = Counter()
    for _, label, _, e in rows:
        total[label] += e
    assert sorted((r.vec_id, r.label_error) for r in out) == [(k, total[label]) for k, label, _, _ in rows]


def test_language_accuracy_of_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op13_word_backoff_language"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 2000 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.99


def test_languages_of_the_held_out_fold_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = language.held_out(F.col("doc_id"))
    turned = docs.withColumn("lang", F.when(fold, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (language.predict(docs, language.train(d, exclude=fold)).orderBy("doc_id").collect() for d in (docs, turned))
    assert a == b


def backoff(text, model):
    """The score of a text word by word, from the definition."""
    tables = {n: {int(t): s for t, s in zip(model.tokens[n], model.scores[n].astype(float))} for n in model.tokens}
    data = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    h = lambda s, salt: int(language.words.span_hashes(data(s), np.array([0]), np.array([len(s)]), salt=salt)[0])
    total, n_words = np.zeros(len(model.languages)), 0
    for run in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for k in range(0, len(run), 64):
            word = run[k : k + 64]
            n_words += 1
            if (own := tables[0].get(h(word, 0))) is not None:
                total += own
                continue
            for n in language.LENGTHS:
                padded = word if n == 1 else f" {word} "
                known = [s for j in range(len(padded) - n + 1) if (s := tables[n].get(h(padded[j : j + n], n))) is not None]
                if known:
                    total += np.mean(known, 0)
                    break
    return model.prior + total / math.sqrt(max(n_words, 1))


def test_backoff_by_brute_force(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(docs, max_words=300, max_grams=200)
    texts = [r.text for r in docs.limit(60).collect()] + ["zzzqx", "日本語 text", "", "ab" * 200 + " und", "x" * 130, "1 2 3"]
    for part in (1 << 17, 128):
        monkeypatch.setattr(language, "PART", part)
        for text, own in zip(texts, language.evidence(texts, model)):
            assert np.allclose(own, backoff(text, model), rtol=1e-5, atol=1e-3), text[:80]


def test_language_edges(spark):
    learnt = spark.createDataFrame([(1, "der die das und nicht", "de"), (2, "the and not of", "en"), (None, "la casa", "es"), (3, None, "fr"), (4, "mot", None)], "doc_id long, text string, lang string")
    model = language.train(learnt)
    assert model.languages == ["de", "en", "es"]
    for name, df in edge_frames(spark):
        df = df.unionByName(df.limit(1).withColumn("text", F.lit(LONG + " the " + LONG))).unionByName(df.limit(1).withColumn("text", F.lit("12 34 _ ٣ Ⅷ ²")))
        out = language.predict(df, model).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        undecided = df.filter(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).count()
        assert sum(r.lang_pred == "und" for r in out) == undecided
        assert {r.lang_pred for r in out} <= {"und", "de", "en", "es"}
        own = language.train(df)
        assert own.languages == ([] if name == "empty" else ["en"])
    nothing = language.predict(learnt, language.train(learnt.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
