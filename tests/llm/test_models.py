"""Quality, toxicity and language-model scoring: held-out accuracy, brute force, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.llm import cross_entropy, quality, toxicity, words
from earshot.llm.common import held_out
from earshot.llm.registry import QUERIES

from .fixtures import SF, edge_frames, edge_texts

BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name,label,threshold,least", [("op1_attention_quality", "quality", 0.3, 0.97), ("op4_toxic_segments", "toxic", 0.5, 0.97)])
def test_held_out_accuracy(spark, name, label, threshold, least):
    out = QUERIES[name](spark, BIG)
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    assert out.count() == docs.count()
    rows = out.join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500
    assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1 for r in rows)


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [quality.score(docs, quality.train(docs, quality.labelled_sample(table, label_col="quality", max_rows=500, exclude=held_out(F.col("doc_id"))))).orderBy("doc_id").collect() for table in (labels, turned)]
    assert scores[0] == scores[1]


def test_edges(spark):
    labels = spark.createDataFrame([(5, 1), (6, 1), (6, 0), (9, 0), (11, None), (None, 1), (12, 0), (7, 1)], "doc_id bigint, quality int")
    for name, df in edge_frames(spark):
        sample = quality.labelled_sample(labels, label_col="quality", max_rows=100)
        model = quality.train(df, sample)
        assert (model is None) == (name == "empty")
        out = quality.score(df, model).collect()
        assert len(out) == df.count() and all(0 <= r.score <= 1 for r in out)
        assert quality.keep_good(df, model).columns == df.columns
        toxic = toxicity.score(df, toxicity.train(df, sample)).collect()
        assert len(toxic) == len(out) and all(0 <= r.score <= 1 for r in toxic)
    assert all(r.score == 0.5 for r in quality.score(edge_frames(spark)[0][1], None).collect())


def test_gradient_of_the_attention_model():
    r = np.random.default_rng(0)
    x, bag = r.standard_normal((40, 6)).astype(np.float32), np.repeat(np.arange(8), 5)
    y = (np.array([x[bag == k, 0].max() for k in range(8)]) > 1.0).astype(np.float32)
    model = quality.AttentionModel(6, hidden=8, gate=4).fit(x, bag, y, steps=400)
    assert ((model.predict(x, bag) > 0.5) == (y > 0.5)).all()


def test_maximal_segments_against_the_definition():
    """All maximal segments: by the definition, the best one (the shortest of equals) first, then what lies left and right of it."""
    r = np.random.default_rng(1)

    def brute(scores, at=0):
        best = max(((sum(scores[i:j]), i - j, -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*brute(scores[:i], at), (best[0], at + i, at + j), *brute(scores[j:], at + j)]

    for _ in range(200):
        n, drift = int(r.integers(1, 14)), -float(r.integers(1, 4))
        scores = [float(r.integers(1, 9)) if r.random() < 0.4 else drift for _ in range(n)]
        position = np.array([k for k, s in enumerate(scores) if s > 0], int)
        found = toxicity.maximal_segments(position, np.array([scores[k] for k in position]), drift)
        expected = brute(scores)
        assert math.isclose(sum(s for s, *_ in found), sum(s for s, *_ in expected))
        assert sorted(round(s, 6) for s, *_ in found) == sorted(round(s, 6) for s, *_ in expected)


def test_every_place_of_a_toxic_word_is_scanned():
    """Words that stand scattered first and together later; and two passages of the same words."""
    bad = [f"bad{k}" for k in range(6)]
    model = toxicity.ToxicityModel(np.sort(words.hash_words([" ".join(bad)])[0]), np.full(6, 3.0))
    clean = [f"c{k}" for k in range(200)]
    scattered = [w for b in bad for w in (b, *clean)]
    _, found = toxicity.segments([" ".join([*scattered, *bad]), " ".join([*bad, *clean, *bad])], model)
    at = len(scattered)
    assert any(f == at and e == at + 6 and math.isclose(s, 18.0) for s, f, e in found[0])
    assert [(f, e) for _, f, e in found[1]] == [(0, 6), (206, 212)]


def test_word_hashes_depend_on_the_word_alone():
    texts = [t or "" for t in edge_texts()]
    import re

    hashes, bounds = words.hash_words(texts)
    seen = {}
    for k, text in enumerate(texts):
        own = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if w]
        assert len(own) == bounds[k + 1] - bounds[k]
        for w, h in zip(own, hashes[bounds[k] : bounds[k + 1]].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_run_longer_than_a_part_has_the_hash_of_the_whole(monkeypatch):
    texts = ["a" * 500 + " bb " + "ß" * 333, "x" * 1000, "", "one two " * 40, "\U0001f642y" * 70]
    whole = [words.hash_words(texts, by_space=by) for by in (False, True)]
    for size in (16, 50, 77):
        monkeypatch.setattr(words, "CHUNK", size)
        for by, (hashes, bounds) in zip((False, True), whole):
            got = words.hash_words(texts, by_space=by)
            assert (got[0] == hashes).all() and (got[1] == bounds).all()


def test_tokens_are_the_same_however_a_text_is_cut(monkeypatch):
    texts = ["a" * 500 + " bb " + "ß" * 333, "x" * 1000, "", "one two " * 40, "\U0001f642y" * 70, "ab,cd-efghijk;" * 30, "kill" + "z" * 300 + "!kill"]

    def rows():
        found = [[] for _ in texts]
        for units, owner in toxicity.tokenize(texts):
            for unit, k in zip(units.tolist(), owner.tolist()):
                found[k].append(tuple(unit))
        return found

    whole = rows()
    assert [len(r) for r in whole] == [3, 1, 0, 80, 1, 90, 2]
    for size in (16, 17, 50, 77, 333, 500):
        monkeypatch.setattr(words, "CHUNK", size)
        assert rows() == whole


def test_long_texts_without_a_space(spark):
    texts = ["x" * 1_500_000, "kill " * 200_000, "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(quality.score(df, quality.AttentionModel(quality.WIDTH)).collect()) == 3
    model = toxicity.ToxicityModel(words.hash_words(["kill"])[0], np.full(1, 3.0))
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert [(s.first_word, s.end_word) for s in out[1].segments] == [(0, 200_000)] and not out[0].segments
    flagged = cross_entropy.flag_target(df, spark.createDataFrame([(1,)], "doc_id bigint"))
    assert [r.n_tokens for r in cross_entropy.score(flagged).orderBy("doc_id").collect()] == [1, 200_000, 6]


def test_scores_of_the_attention_model_by_hand(spark):
    """Every document's score, from features and weights, in plain steps."""
    r = np.random.default_rng(5)
    model = quality.AttentionModel(quality.WIDTH)
    model.mean, model.scale = r.random(quality.WIDTH).astype(np.float32), r.random(quality.WIDTH).astype(np.float32) + 0.5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {x.doc_id: x.score for x in quality.score(docs, model).collect()}
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for row in docs.collect():
        x, _ = quality.encode([row.text or ""])
        hidden, weight = [], []
        for passage in x.astype(float):
            z = np.append(np.clip((passage - model.mean) / model.scale, -6, 6), 1.0)
            h = np.tanh(z @ p["E"])
            gate = [math.tanh(h @ p["V"][:, k]) * sigmoid(h @ p["U"][:, k]) for k in range(p["V"].shape[1])]
            hidden.append(h)
            weight.append(math.exp(sum(g * w for g, w in zip(gate, p["w"][:, 0]))))
        mean = sum(w * h for w, h in zip(weight, hidden)) / sum(weight)
        assert abs(out[row.doc_id] - sigmoid(float(mean @ p["c"][:, 0] + p["d"][0, 0]))) < 1e-4


def test_features_depend_on_the_text_alone():
    texts = [t or "" for t in edge_texts()] + ["  led by space", "\n\n | ", "a b c", "a b c a b c", "\t"]
    x, bag = quality.encode(texts)
    for k, text in enumerate(texts):
        assert np.allclose(x[bag == k], quality.encode([text])[0], atol=1e-6)


def test_passages_are_the_same_however_a_text_is_cut(monkeypatch):
    r = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in r.integers(0, 400, 5000))
    texts = ["  " + long + " \n", "short one", "", "ß" * 5000 + " end", "\t" * 300, long[:9000]]
    whole = quality.encode(texts)
    assert np.bincount(whole[1]).tolist() == [79, 1, 1, 1, 1, -(-len(long[:9000].split()) // 64)]
    for size in (64, 1000, 9001):
        monkeypatch.setattr(words, "CHUNK", size)
        x, bag = quality.encode(texts)
        assert (bag == whole[1]).all() and np.allclose(x, whole[0], atol=1e-6)


def test_passages_are_counted_in_plain_words():
    """Shares that the encoder gives, counted by hand, over a text of several passages."""
    text = " ".join(["abc", "DEF", "12", "abc"] * 40)
    x, bag = quality.encode([text, ""])
    assert bag.tolist() == [0, 0, 0, 1] and np.allclose(x[:3, -1], np.log1p([64, 64, 32]) / 5)
    assert np.allclose(x[0, quality.HASHED + quality.CLASSES + 1], 1.0)  # words of three letters at most
    assert np.allclose(x[0, quality.HASHED + quality.CLASSES + 4], 3 / 64)  # different words


def test_toxic_scores_of_the_query_by_hand(spark):
    """The whole query: tokens by a regular expression, lexicon words by look-up, segments by the definition's greedy form."""
    import re

    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, quality.labelled_sample(labels, label_col="toxic", max_rows=20000, exclude=held_out(F.col("doc_id"))), min_docs=2)
    lexicon = dict(zip(model.tokens.tolist(), model.scores.tolist()))
    assert lexicon
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    for row in docs.collect():
        found = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (row.text or "").lower())
        best, run = 0.0, 0.0
        for w in found:
            raw = w.encode()
            options = [words.hash_words([w])[0][0]]
            for size in toxicity.PREFIXES:
                if len(raw) > size:
                    data = np.frombuffer(raw + b"\0", np.uint8)
                    options.append(words.span_hashes(data, np.array([0]), np.array([size]), salt=size)[0])
            run = max(0.0, run) + (max((lexicon.get(int(o), 0.0) for o in options)) or model.drift)
            best = max(best, run)
        x = min(20, max(-20, model.scale * best - math.log(model.k * max(1, len(found)))))
        assert abs(out[row.doc_id].score - 1 / (1 + math.exp(-min(30, max(-30, model.intercept + model.slope * x))))) < 1e-6


def test_the_extreme_value_law_is_found_again():
    """Best scores drawn from the law, seen only above a least score."""
    r = np.random.default_rng(1)
    n = r.integers(50, 2000, 4000)
    for scale, k in ((0.7, 0.02), (1.3, 0.005)):
        top = np.log(k * n / -np.log(r.random(len(n)))) / scale
        got = toxicity.fit_extremes(np.where(top >= 3, top, 0), n, 3.0)
        error = scale / math.sqrt((top >= 3).sum())  # the estimate's standard error
        assert abs(got[0] - scale) < 3 * error + 0.01 and abs(math.log(got[1] / k)) < 3 * error * top.max()
    assert toxicity.fit_extremes(np.zeros(50), n[:50], 3.0)[0] == 1.0


def test_toxic_scores_ignore_the_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [toxicity.score(docs, toxicity.train(docs, quality.labelled_sample(t, label_col="toxic", max_rows=500, exclude=held_out(F.col("doc_id"))))).orderBy("doc_id").collect() for t in (labels, turned)]
    assert scores[0] == scores[1]


@pytest.mark.parametrize("block", [1, 20, 1 << 22])
def test_cross_entropy_against_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(cross_entropy, "BLOCK_CHARS", block)
    texts = ["a b a b c", "a b b", "", None, "c c d e", "a", "x y z a b", "a b b"]
    target = {0, 1}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = spark.createDataFrame([(k,) for k in target], "doc_id bigint")
    out = {r.doc_id: r for r in cross_entropy.score(cross_entropy.flag_target(df, ids), strength=2.0).collect()}
    from collections import Counter

    vocabulary = len({w for t in texts for w in (t or "").split()})

    def model(docs):
        pairs, single = Counter(), Counter()
        for t in docs:
            w = (t or "").split()
            pairs.update(zip(["<"] + w, w))
            single.update(w)
        total = sum(single.values())
        before = single | Counter({"<": sum(bool(t) for t in docs)})
        return lambda a, b: -math.log((pairs[a, b] + 2.0 * (single[b] + 1) / (total + vocabulary + 1)) / (before[a] + 2.0))

    for k, text in enumerate(texts):
        w = (text or "").split()
        pairs = list(zip(["<"] + w, w))
        assert out[k].n_tokens == len(w)
        losses = [model([t for j, t in enumerate(texts) if j != k and j in chosen]) for chosen in (target, set(range(len(texts))))]  # held out
        for name, loss in zip(("target_loss", "background_loss"), losses):
            assert abs(out[k][name] - sum(loss(*p) for p in pairs) / max(1, len(pairs))) < 1e-9


def test_cross_entropy_edges(spark):
    for _, df in edge_frames(spark):
        for ids in ([(6,), (6,), (None,)], []):
            flagged = cross_entropy.flag_target(df, spark.createDataFrame(ids, "doc_id bigint"))
            out = cross_entropy.score(flagged)
            assert out.count() == df.count() and out.filter("n_tokens = 0 and difference <> 0").count() == 0
