"""Decontamination, chosen-path join and compact windows against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from earshot.llm import components, decontamination, jaccard, substrings, words
from earshot.llm.registry import QUERIES

from .fixtures import DOC, SF, edge_frames, rows, shingle_set
from .fixtures import words as make

SF1 = "/root/testdata/sf0.01"


# ---- decontamination --------------------------------------------------------------------------


def overlap(item, text):
    own, there = shingle_set(item), shingle_set(text, min(5, max(1, len(item.split()))))
    return len(own & there) / len(own) if own else 0


def test_leaks_against_brute_force(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op2_benchmark_leaks"](spark, SF1).collect()}
    items = spark.read.parquet(f"{SF1}/benchmark.parquet").collect()
    docs = spark.read.parquet(f"{SF1}/documents.parquet").collect()
    by_shingle = defaultdict(set)
    for i in items:
        for s in shingle_set(i.text):
            by_shingle[s].add(i.item_id)
    sizes = {i.item_id: len(shingle_set(i.text)) for i in items}
    expected = set()
    for d in docs:
        hits = Counter(i for s in shingle_set(d.text) for i in by_shingle.get(s, ()))
        expected |= {(d.doc_id, i) for i, n in hits.items() if n >= 0.8 * sizes[i]}
    assert expected and found == expected


def test_every_passage_above_the_threshold_is_retrieved():
    """Block-max WAND against the sums over all items; an item's scores don't depend on its neighbours' lengths."""
    rng = random.Random(4)
    items = [(k, " ".join(make(rng, rng.randrange(3, 60), 200))) for k in range(90)]
    texts = [" ".join([*make(rng, rng.randrange(0, 200), 200), *t.split()[: rng.randrange(1, 60)], *make(rng, 20, 200)]) for _, t in items] + ["", "w001x"]
    hashes, bounds = words.hash_words(texts)
    corpus = decontamination.Corpus.of([t for _, t in items])
    split = {i: words.hash_words([t])[0].tolist() for i, t in items}
    df = Counter(h for own in split.values() for h in set(own))
    mean = sum(map(len, split.values())) / len(split)

    def impacts(own):
        raw = {h: math.log(1 + (len(items) - df[h] + 0.5) / (df[h] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(own) / mean)) for h, n in Counter(own).items()}
        return {h: v / sum(raw.values()) for h, v in raw.items()}

    own = {i: impacts(h) for i, h in split.items()}
    found = retrieved = 0
    for index in decontamination.build(items, 0.5, corpus):
        got = {(t, index.ids[i], b): s for t, i, s, b, _ in index.search(hashes, bounds)}
        expected = {}
        for t in range(len(texts)):
            said = hashes[bounds[t] : bounds[t + 1]].tolist()
            for at in range(0, max(1, len(said)), index.step):
                terms = set(said[at : at + 2 * index.step])
                for i in index.ids:
                    score = sum(own[i].get(h, 0.0) for h in terms)
                    if abs(score - 0.5) > 1e-6 and score >= 0.5:
                        expected[t, i, int(bounds[t]) + at] = score
        assert set(expected) <= set(got)
        assert all(abs(got[k] - s) < 1e-9 for k, s in expected.items()) and all(s >= 0.5 - 1e-6 for s in got.values())
        found, retrieved = found + len(expected), retrieved + len(got)
    assert found > 100 and retrieved <= found + 2


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (4, "a b c d"), (5, "null id text of some words here"), (None, "zz yy xx ww vv uu")], "item_id bigint, text string")
    for name, df in edge_frames(spark):
        found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, items).collect()}
        assert found == (set() if name == "empty" else {(3, 3), (4, 4), (None, 5)})
        clean = decontamination.decontaminate(df, items)
        assert clean.columns == df.columns and clean.count() == df.count() - (0 if name == "empty" else 3)
    assert decontamination.find_leaks(df, items.limit(0)).count() == 0


def test_sets_of_items_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.find_leaks(docs, items).collect()}
    assert whole == {(r.doc_id, r.item_id, round(r.score, 9)) for r in decontamination.find_leaks(docs, items, block_chars=3000).collect()}
    named = items.withColumn("item_id", items["item_id"].cast("string"))
    assert {(d, str(i)) for d, i, _ in whole} == {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, named).collect()}


# ---- chosen-path join -------------------------------------------------------------------------


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_classes(pairs):
    sets = {}
    for doc, text in pairs:
        sets.setdefault(shingle_set(text or ""), []).append(doc)
    keys = [k for k in sets if k]
    parent = list(range(len(keys)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    held = defaultdict(list)
    links = Counter()
    for n, k in enumerate(keys):
        hits = Counter(m for s in k for m in held[s])
        for m, v in hits.items():
            if v / (len(k) + len(keys[m]) - v) >= 0.8:
                links[n] += 1
                links[m] += 1
                parent[root(n)] = root(m)
        for s in k:
            held[s].append(n)
    groups = defaultdict(list)
    for n, k in enumerate(keys):
        groups[root(n)] += sets[k]
    return {d: min(g) for g in groups.values() for d in g}, sum(links.values()) // 2


def test_classes_of_documents(spark):
    out = QUERIES["op8_chosen_path_join"](spark, SF1).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()]
    expected, _ = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in out} == expected


def test_large_groups_of_near_copies_and_recall(spark):
    rng = random.Random(9)
    texts = near_copies(rng, make(rng, 220), 150, 3)  # more than a small bucket
    for _ in range(60):
        texts += near_copies(rng, make(rng, rng.randrange(60, 300), 3000), 3, 2)
    texts += [" ".join(make(rng, 100, 3000)) for _ in range(300)]
    texts += texts[:40]
    df = spark.createDataFrame(rows(texts), DOC)
    out = {r.doc_id: r for r in jaccard.classes(df).collect()}
    expected, _ = brute_classes(list(enumerate(texts)))
    wrong = sum(out[d].class_id != c for d, c in expected.items())
    assert wrong <= 0.01 * len(texts)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in out.values()})


def test_every_pair_of_a_bucket_of_many_parts_is_compared(spark, monkeypatch):
    """In one run, so that a pair meets in few nodes: a common passage fills them with sets that don't link."""
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "PART", 4)
    rng = random.Random(12)
    passage = " ".join(make(rng, 100, 3000))
    texts = []
    for _ in range(100):  # 0.83 within a pair, 0.77 across pairs
        own = make(rng, 4, 3000)
        texts += [" ".join([passage, *own, *make(rng, 10, 3000)]) for _ in range(2)]
    paths = [set(jaccard.chosen_paths(own, 0.8, jaccard.runs_for(0.3)).tolist()) for own in jaccard.shingle_sets(texts)]
    meet = [bool(paths[k] & paths[k + 1]) for k in range(0, len(texts), 2)]
    assert sum(meet) > 10
    out = {r.doc_id: r.class_id for r in jaccard.classes(spark.createDataFrame(rows(texts), DOC), recall=0.3).collect()}
    assert [out[k + 1] == k for k in range(0, len(texts), 2)] == meet


def test_links_of_a_large_bucket_are_all_counted(spark):
    rng = random.Random(15)
    texts = near_copies(rng, make(rng, 220, 3000), 60, 1)
    _, linked = brute_classes(list(enumerate(texts)))
    out = jaccard.classes(spark.createDataFrame(rows(texts), DOC)).collect()
    assert 0.99 * linked <= sum(r.n_links for r in out) / 2 <= linked


def test_jaccard_edges(spark):
    for name, df in edge_frames(spark):
        out = jaccard.classes(df).collect()
        assert len(out) == df.count()
        if name == "empty":
            continue
        ids = sorted(r.doc_id for r in out if r.class_id == 6)
        assert ids == [6, 6, 7, 8]
        assert all(r.n_copies == 4 for r in out if r.class_id == 6)
        kept = jaccard.keep_one(df)
        assert kept.columns == df.columns and kept.filter("doc_id = 6").count() == 1


def test_rows_of_one_id_are_told_apart(spark):
    """Texts without an id, and two texts under one id, are not each other's copies."""
    rng = random.Random(21)
    a, b, c, d = (" ".join(make(rng, 120, 3000)) for _ in range(4))
    near = " ".join([*a.split()[:-1], "other"])
    given = [(None, b), (None, c), (None, near), (5, a), (7, d), (7, c), (7, d), (8, ""), (8, "")]
    kept = jaccard.keep_one(spark.createDataFrame(given, "doc_id bigint, text string")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in kept) == sorted([("None", b), ("5", a), ("7", d), ("7", c), ("8", ""), ("8", "")])


def test_copies_that_link_to_their_base_alone(spark):
    """More than a part of a bucket: every link of the star is found."""
    rng = random.Random(23)
    base = make(rng, 200, 50_000)
    texts = [" ".join(base)]
    for k in range(900):
        w = list(base)
        for j in range(4):
            w[rng.randrange(j * 50 + 5, j * 50 + 45)] = f"x{k}y{j}"
        texts.append(" ".join(w))
    expected, linked = brute_classes(list(enumerate(texts)))
    out = jaccard.classes(spark.createDataFrame(rows(texts), DOC)).collect()
    assert sum(r.class_id != expected[r.doc_id] for r in out) <= 0.01 * len(texts)
    assert sum(r.n_links for r in out) >= 2 * 0.99 * linked


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    parent = {}

    def root(k):
        parent.setdefault(k, k)
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    out = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    linked = {k for a, b in links if a != b for k in (a, b)}
    assert out == {k: root(k) for k in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- compact windows --------------------------------------------------------------------------


def test_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(1)
    for trial in range(300):
        n, width = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        h = rng.integers(0, 20 if trial % 2 else 10**9, n).astype(np.uint64)
        bounds = np.array(sorted({0, n, int(rng.integers(0, n + 1))}))
        left, centre, right = substrings.compact_windows(h, bounds, width)
        covered = Counter((p, q, c) for a, c, e in zip(left.tolist(), centre.tolist(), right.tolist()) for p in range(a, c + 1) for q in range(c, e + 1) if q - p + 1 >= width)
        needed = {(p, q, p + int(np.argmin(h[p : q + 1]))) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()) for p in range(x, y) for q in range(p + width - 1, y)}
        assert set(covered) == needed and (not covered or max(covered.values()) == 1)


def test_planted_passages(spark):
    rng = random.Random(6)
    shared = [" ".join(make(rng, n, 4000)) for n in (55, 80, 120, 400)]
    line = " ".join(make(rng, 14, 4000))
    texts, planted = [], defaultdict(list)
    for k in range(240):
        parts = [" ".join(make(rng, rng.randrange(60, 200), 4000))]
        if k % 3 == 0:
            parts.append(line)
        if k % 6 == 1:
            p = rng.randrange(4)
            planted[p].append(k)
            parts.append(shared[p])
        rng.shuffle(parts)
        texts.append(" ".join([*parts, *make(rng, 30, 4000)]))
    texts += texts[:3]
    df = spark.createDataFrame(rows(texts), DOC)
    out = substrings.passages(df).collect()
    found = defaultdict(list)
    for r in out:
        found[r.doc_id].append(r)
    for p, docs in planted.items():
        words_of = shared[p].split()
        for d in docs:
            at = texts[d].split()
            start = next(k for k in range(len(at)) if at[k : k + len(words_of)] == words_of)
            hit = [r for r in found[d] if r.start_word <= start and r.end_word >= start + len(words_of)]
            assert hit
            assert d < 3 or hit[0].class_id == min(docs)
    clean = set(range(3, 240)) - {d for docs in planted.values() for d in docs}
    assert not clean & set(found)  # a shared line of 14 words is no passage


def test_repeats_of_documents_against_brute_force(spark):
    out = QUERIES["op3_compact_windows"](spark, SF1).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF1}/documents.parquet").collect()}
    import re

    runs = defaultdict(set)
    split = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in docs.items()}
    for d, w in split.items():
        for k in range(len(w) - 49):
            runs[tuple(w[k : k + 50])].add(d)
    expected = {d for held in runs.values() if len(held) > 1 for d in held if True}
    prose = {d for run, held in runs.items() if len(held) > 1 and len(set(run)) > 15 for d in held}
    found = {r.doc_id for r in out}
    assert len(prose - found) <= 0.01 * len(prose)
    assert len(found - expected) <= 0.05 * len(found)  # near copies, of at least the threshold


def passages_by_hand(texts, width=50):
    """Of each document, the word positions that lie in a run of `width` words which another document has."""
    held = defaultdict(set)
    split = {d: words.hash_words([t or ""])[0].tolist() for d, t in texts.items()}
    for d, w in split.items():
        for k in range(len(w) - width + 1):
            held[tuple(w[k : k + width])].add(d)
    return {d: [k for k in range(len(w) - width + 1) if len(held[tuple(w[k : k + width])]) > 1] for d, w in split.items()}, held, split


def test_passages_spans_and_classes_whatever_the_layout(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF1}/documents.parquet").select("doc_id", "text")
    runs = [sorted(map(tuple, substrings.passages(docs.repartition(n)).collect())) for n in (1, 16, 64)]
    assert runs[0] == runs[1] == runs[2]
    starts, held, split = passages_by_hand({r.doc_id: r.text for r in docs.collect()})
    spans = defaultdict(list)
    for d, lo, hi, c in runs[0]:
        spans[d].append((lo, hi, c))
    inside = {(d, k): [c for lo, hi, c in spans[d] if lo <= k and k + 50 <= hi] for d, at in starts.items() for k in at}
    assert sum(map(bool, inside.values())) >= 0.98 * len(inside)
    # all places of one run are in one class
    of_run = defaultdict(set)
    for (d, k), found in inside.items():
        of_run[tuple(split[d][k : k + 50])].update(found[:1])
    assert sum(len(c) == 1 for c in of_run.values()) >= 0.95 * len(of_run)
    assert all(c <= d for d, _, _, c in runs[0])
    # large groups by joins: the same
    monkeypatch.setattr(substrings, "LARGE", 2)
    assert sorted(map(tuple, substrings.passages(docs).collect())) == runs[0]


def test_near_passages(spark):
    """Passages of 50 to 300 words with words changed, of similarity 0.8 or more, in texts of their own."""
    rng = random.Random(31)
    texts, similar = [], []
    for k in range(300):
        n = rng.randrange(50, 300)
        own = make(rng, n, 50_000)
        changed = list(own)
        for _ in range(max(1, n // 60)):
            changed[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
        a, b = (frozenset(zip(*(x[j:] for j in range(5)))) for x in (own, changed))
        for x in (own, changed):
            texts.append(" ".join([*make(rng, rng.randrange(20, 80), 50_000), *x, *make(rng, rng.randrange(20, 80), 50_000)]))
        if len(a & b) / len(a | b) >= 0.8:
            similar.append(2 * k)
    out = defaultdict(set)
    for r in substrings.passages(spark.createDataFrame(rows(texts), DOC)).collect():
        out[r.doc_id].add(r.class_id)
    assert len(similar) > 200 and sum(bool(out[k] & out[k + 1]) for k in similar) >= 0.95 * len(similar)


def test_every_place_of_a_passage_is_reported(spark):
    rng = random.Random(33)
    shared = make(rng, 60, 4000)
    twice = [*make(rng, 40, 4000), *shared, *make(rng, 300, 4000), *shared, *make(rng, 40, 4000)]
    other = [*make(rng, 30, 4000), *shared, *make(rng, 30, 4000)]
    for order in ((twice, other), (other, twice)):
        df = spark.createDataFrame(rows([" ".join(t) for t in order]), DOC)
        at = sorted((r.start_word, r.end_word) for r in substrings.passages(df).collect() if r.doc_id == order.index(twice))
        assert len(at) == 2 and all(lo <= x and hi >= x + 60 for (lo, hi), x in zip(at, (40, 400)))


def test_substring_edges(spark):
    for name, df in edge_frames(spark):
        out = substrings.passages(df).collect()
        assert {r.doc_id for r in out} == (set() if name == "empty" else {6, 7, 8})
        assert sorted((r.start_word, r.end_word, r.class_id) for r in out) == ([] if name == "empty" else [(0, 200, 6)] * 4)
