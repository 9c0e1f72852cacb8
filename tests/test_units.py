"""Exact values and properties of the engine's own functions, fault injection, resume."""

import datetime
import hashlib
import json
import random
import re
import time
import urllib.parse

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot import schemas
from earshot.functions import text as X
from earshot.operators import batching, clustering, dedup, evaluation, filtering, jobs, lru, models, mood
from earshot.plans import analysis, insights, preflight
from earshot.schemas import valid_intent, valid_quotes, valid_sentiment
from earshot.sources import corpus, paged
from earshot.streaming import streams


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column(F.col(schema.split()[0]))).collect()]


def test_pages_and_cluster_counts(spark):
    assert values(spark, [0, 1, 99, 100, 101, 250, 10000, -3], "n bigint", X.comment_pages) == [0, 1, 1, 1, 2, 3, 100, 0]
    assert values(spark, [0, 1, 2, 10, 30, 100, 2000], "n bigint", X.filter_clusters) == [1, 1, 2, 2, 2, 6, 60]
    assert values(spark, [0, 1, 2, 6, 100], "n bigint", X.synthesis_clusters) == [1, 1, 1, 3, 3]


def test_sanitize(spark):
    cases = {"a  b\t c": "a b c", "x \n y": "x\ny", "a\n\n\n\nb": "a\n\nb", "“quoted”": "quoted", "mail jane.doe+news@sub.example.co.uk now": "mail [EMAIL] now", "+1 555 123 4567 and 555-867-5309": "[PHONE] and [PHONE]", "  ": "", '" x "': "x", "call +١٢٣ 4567 8901": "call [PHONE]"}
    assert values(spark, list(cases), "t string", X.sanitize) == list(cases.values())


def test_urls(spark):
    cases = {
        "see https://x.example/post?utm_source=x&utm_medium=cpc&id=42 ok": "see https://x.example/post?id=42 ok",
        "https://x.example/?gclid=1": "https://x.example/", "https://x.example/a?b=&UTM_ID=2#f": "https://x.example/a?b=#f", "https://x.example/a?q=a b": "https://x.example/a?q=a b", "http://[bad?utm_id=1": "http://[bad?utm_id=1", "none": "none", None: None,
    }
    df = spark.createDataFrame([(k, i) for i, k in enumerate(cases)], "text string, pos int")
    assert [r.text for r in X.clean_urls(df).orderBy("pos").collect()] == list(cases.values())


def test_fingerprint(spark):
    texts = ["Hello  World", " hello\nworld ", "STRASSE", "straße", "other"]
    native = values(spark, texts, "t string", X.fingerprint)
    assert native[0] == native[1] and native[2] == native[3] and len(set(native)) == 3
    exact = values(spark, [*texts, "ﬁn", None], "t string", X.fingerprint_exact)
    assert exact[:5] == native and exact[5] == hashlib.sha256(b"fin").hexdigest() and exact[6] is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\"'.-+(@)5", max_size=30), min_size=1, max_size=20))
def test_sanitize_against_plain_python(spark, texts):
    def plain(t):
        t = re.sub(X.EMAIL, "[EMAIL]", t)
        t = re.sub(X.PHONE_LOCAL, "[PHONE]", re.sub(X.PHONE_INTERNATIONAL, "[PHONE]", t))
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", t)))
        return t.strip().strip(X.QUOTES).strip()

    assert values(spark, texts, "t string", X.sanitize) == [plain(t) for t in texts]


def test_references(spark):
    cases = {
        "UC" + "a" * 22: ("channel_id", "UC" + "a" * 22), "@some.one": ("handle", "@some.one"), "https://www.youtube.com/watch?v=abcdefghijk": ("video", "abcdefghijk"), "youtu.be/abcdefghijk?t=3": ("video", "abcdefghijk"), "https://youtu.be/short": ("error", None),
        "m.youtube.com/shorts/ABCDEFGHI_-": ("video", "ABCDEFGHI_-"), "https://YouTube.com/channel/whatever": ("channel_id", "whatever"), "youtube.com/user/Name": ("legacy_username", "Name"), "youtube.com/@h/videos": ("handle", "@h"), "youtube.com/c/Old": ("error", None),
        "": ("error", None), "   ": ("error", None), "https://example.com/watch?v=abcdefghijk": ("error", None), "youtube.com/watch?list=x&v=abcdefghijk": ("video", "abcdefghijk"), "youtube.com/watch?v=bad": ("error", None), "youtube.com": ("error", None), "youtube.com/shorts/bad": ("error", None), "  @padded  ": ("handle", "@padded"),
    }
    got = values(spark, list(cases), "t string", X.parse_reference)
    assert [(r.kind, r.video_id or r.channel_id or r.handle or r.legacy_username) for r in got] == list(cases.values())


def test_markdown_and_labels(spark):
    assert values(spark, ["![](https://a.b/p?u=c)", "a\n> b", "$x$ *y* _z_"], "t string", X.escape_markdown) == [r"\!\[\]\(https://a\.b/p?u=c\)", r"a \> b", r"\$x\$ \*y\* \_z\_"]
    assert values(spark, [None, "stage_b", "new"], "t string", X.stage_label) == ["Starting…", "Classifying requests & confusion (Stage B)", "new"]
    assert values(spark, ["openrouter/a/b", "x/y/z"], "t string", X.bare_model) == ["a/b", "x/y/z"] and values(spark, ["a/b/c"], "t string", X.vendor) == ["b"]


def test_ttl_fold():
    def kept(times, ttl):
        recorded, out = None, []
        for t in times:
            recorded, fresh = dedup.fold(recorded, t, ttl)
            out += [t] * fresh
        return out

    assert kept([0, 5, 12, 13, 14, 30], 10) == [0, 12, 13, 30]


def test_ttl_and_lru_over_rows(spark):
    df = spark.createDataFrame([(k, "a", t) for k, t in enumerate([0, 5, 12, 13, 14, 30])] + [(10, "b", 3), (11, None, 4), (12, None, 5)], "pos bigint, fp string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    out = {r.pos: r.fresh for r in dedup.ttl(df, key="fp", at="ts", pos="pos", seconds=10).collect()}
    assert [p for p in sorted(out) if out[p]] == [0, 2, 3, 5, 10, 11]
    bounded = {r.pos: r.fresh for r in lru.exact_lru(df, fingerprint="fp", at="ts", pos="pos", seconds=10, capacity=1).collect()}
    assert bounded[1] and bounded[10] and bounded[11] and bounded[12]  # a at 5 took the one place


def folded(rows, seconds, capacity):
    """(pos, fingerprint, seconds or None) in one plain pass."""
    records, fresh = {}, {}
    for pos, fp, t in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        held = records.pop(fp, None) if t is not None else None
        fresh[pos] = held is None or t - held >= seconds
        if t is not None and (held is None or t - held < seconds):
            records[fp] = t if held is None else held
            if len(records) > capacity:
                del records[next(iter(records))]
    return fresh


@pytest.mark.parametrize("seed, keys, capacity, seconds, slices", [(1, 30, 8, 200, 1), (2, 30, 8, 200, 7), (3, 400, 60, 3000, 12), (4, 12, 100, 40, 9), (5, 300, 1, 10**6, 5), (6, 900, 350, 900, 16)])
def test_bounded_memory_over_many_slices_is_the_fold_over_all_rows(spark, seed, keys, capacity, seconds, slices):
    rng = random.Random(seed)
    pick = lambda: None if rng.random() < 0.02 else "hot" if rng.random() < 0.3 else f"k{int(keys * rng.random() ** 2)}"
    rows = [(k, pick(), None if rng.random() < 0.01 else rng.randrange(4000)) for k in range(2500)]
    df = spark.createDataFrame(rows, "pos bigint, fp string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    out = lru.exact_lru(df, fingerprint="fp", at="ts", pos="pos", seconds=seconds, capacity=capacity, slices=slices)
    assert out.columns == [*df.columns, "fresh"]
    assert {r.pos: r.fresh for r in out.collect()} == folded(rows, seconds, capacity)


def test_bounded_memory_of_nothing_and_of_taken_names(spark):
    empty = spark.createDataFrame([], "pos bigint, fp string, ts timestamp")
    assert lru.exact_lru(empty, fingerprint="fp", at="ts", pos="pos", seconds=5).collect() == []
    with pytest.raises(ValueError, match="_key"):
        lru.exact_lru(empty.withColumn("_key", F.lit(1)), fingerprint="fp", at="ts", pos="pos", seconds=5)


def test_stream_keeps_what_the_fold_keeps(spark, tmp_path):
    rows = [(k, "a", t) for k, t in enumerate([0, 5, 12, 13, 14, 30])]
    spark.createDataFrame(rows, "pos bigint, fp string, t bigint").withColumn("timestamp", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos bigint, fp string, t bigint, timestamp timestamp").parquet(str(tmp_path / "in"))
    query = streams.dedup_exact(stream, seconds=10).writeStream.format("memory").queryName("folded").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.pos for r in spark.table("folded").collect()) == [0, 2, 3, 5]
    got = []
    streams.sink_batches(stream, lambda df, n: got.append(df.count()), str(tmp_path / "c")).awaitTermination()
    assert sum(got) == 6


MOOD = [("c0", 0, "good", "strongly_positive"), ("c1", 1, "good", "strongly_positive"), ("c2", 2, "bad", "negative"), ("c3", 3, "bad", "critical_escalation")]


def test_mood_by_video(spark):
    df = spark.createDataFrame(MOOD, "id string, pos bigint, video_id string, sentiment string")
    assert mood.channel_average(df).first().channel_avg == 0.125
    stats = {r.video_id: (r.video_avg, r.delta) for r in mood.video_mood(df).collect()}
    assert stats == {"good": (1.0, 0.875), "bad": (-0.75, -0.875)}
    assert [r.video_id for r in mood.underperforming(df).collect()] == ["bad"]
    assert mood.underperforming(df.filter("video_id = 'bad'")).count() == 0
    nameless = df.unionByName(spark.createDataFrame([("c4", 4, None, "negative"), ("c5", 5, "", "negative"), ("c5", 6, "", "negative")], df.schema))
    assert mood.channel_average(nameless).first().n == 6 and mood.video_mood(nameless).count() == 2
    assert mood.channel_average(df.limit(0)).first().channel_avg is None
    titled = mood.with_titles(mood.video_mood(df), spark.createDataFrame([("good", "Good one")], "video_id string, title string"))
    assert {r.title for r in titled.collect()} == {"Good one", "bad"}


def test_flags(spark):
    cases = [("a", 0, "negative", 0.1, 1), ("b", 1, "critical_escalation", 0.2, 2), ("c", 2, "strongly_positive", 0.85, 3), ("d", 3, "neutral", 0.5, 4)] + [(f"e{k}", 4 + k, "neutral", 0.3, 9) for k in range(5)]
    df = spark.createDataFrame(cases, "id string, pos bigint, sentiment string, confidence double, cluster_id int")
    assert [r.id for r in filtering.select_flagged(df).collect()] == ["a", "b", "c", "e0", "e1", "e2", "e3", "e4"]
    labels = df.select(F.col("id").alias("comment_id"), F.lit(1).alias("x")).filter("comment_id <> 'a'")
    with pytest.raises(Exception, match="no label for comment a"):
        filtering.strict_labels(df, labels).collect()
    assert filtering.strict_labels(df.filter("id <> 'a'"), labels).count() == len(cases) - 1


def test_validity(spark):
    rows = [("x", "positive", 0.5), ("x", "odd", 0.5), ("x", "neutral", 1.5), (None, "neutral", 0.5), ("x", None, 0.1)]
    df = spark.createDataFrame([(r,) for r in rows], "s struct<comment_id:string,sentiment:string,confidence:double>")
    assert [r[0] for r in df.select(valid_sentiment(F.col("s"))).collect()] == [True, False, False, False, False]
    df = spark.createDataFrame([(("x", "request", True, None),), (("x", "praise", True, False),)], "s struct<comment_id:string,intent:string,is_request:boolean,is_confusion:boolean>")
    assert [r[0] for r in df.select(valid_intent(F.col("s"))).collect()] == [False, True]
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a"] * 4,), (None,), (["a", None],)], "q array<string>")
    assert [r[0] for r in df.select(valid_quotes(F.col("q"), "request")).collect()] == [False, False, True, False, False, False]


def blobs():
    r = np.random.default_rng(0)
    return np.concatenate([r.normal(c, 0.25, (40, 8)) for c in (0, 6, 12)])


def test_kmeans_finds_blobs_and_repeats_itself():
    labels = clustering.kmeans(blobs(), 3)
    assert (labels == clustering.kmeans(blobs(), 3)).all()
    groups = [set(labels[k : k + 40]) for k in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
    assert (clustering.kmeans(np.zeros((0, 3)), 2) == np.zeros(0)).all() and (clustering.kmeans(np.ones((1, 3)), 5) == 0).all()
    assert len(clustering.kmeans(np.ones((6, 2)), 3)) == 6 and set(clustering.kmeans(blobs()[:4], 9)) == set(range(4))
    with pytest.raises(ValueError):
        clustering.kmeans(np.ones((3, 2)), 0)
    with pytest.raises(ValueError):
        clustering.kmeans(np.ones(3), 1)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(1, 8), st.integers(0, 9))
def test_kmeans_leaves_no_cluster_empty_among_distinct_points(n, k, seed):
    points = np.random.default_rng(seed).normal(size=(n, 3))
    labels = clustering.kmeans(points, k, seed=seed)
    assert set(labels) == set(range(min(k, n)))


def test_distributed_kmeans_is_the_one_in_a_worker(spark):
    cloud = np.random.default_rng(1).normal(size=(90, 3))
    for points, k in ((blobs(), 3), (cloud, 5), (np.repeat(cloud[:2], 20, 0), 3)):
        df = spark.createDataFrame([(str(n), row.tolist()) for n, row in enumerate(points)], "id string, vector array<double>").repartition(4)
        here, there = ({int(r.id): r.cluster_id for r in clustering.cluster_all(df, id_col="id", vector="vector", clusters=lambda n: k, one_worker=limit, restarts=3, rounds=12).collect()} for limit in (1000, 10))
        assert here == there and len(here) == len(points)
    assert [len({clustering.kmeans(blobs(), 3)[n] for n in range(a, a + 40)}) for a in (0, 40, 80)] == [1, 1, 1]


def test_nearest_in_blocks_of_centroids(spark):
    draw = np.random.default_rng(2)
    points = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(draw.normal(size=(60, 3)))], "id long, vector array<double>")
    centroids = spark.createDataFrame([(n % 20, p.tolist()) for n, p in enumerate(draw.normal(size=(20, 3)))], "cluster_id int, centroid array<double>")
    one, many = (sorted(map(tuple, clustering.nearest(points, centroids, id_col="id", vector="vector", at_once=n).collect())) for n in (1000, 6))
    assert one == many and len(one) == 60


class Faulty:
    """Answers wrongly while a batch holds more than `most` texts."""

    def __init__(self, kind, fault, most):
        self.kind, self.fault, self.most, self.calls = kind, fault, most, 0

    def label(self, batch):
        self.calls += 1
        answer = models.HashProvider(self.kind).label(batch)
        if len(batch) <= self.most:
            return answer
        items = json.loads(answer)["results"]
        if self.fault == "dropped":
            items = items[1:]
        elif self.fault == "wrong id":
            items[0]["comment_id"] = "zz"
        elif self.fault == "twice":
            items[0]["comment_id"] = items[1]["comment_id"]
        elif self.fault == "value":
            items[0]["sentiment"] = "furious"
        elif self.fault == "not json":
            return answer[:-3]
        return json.dumps({"results": items})


@pytest.mark.parametrize("fault", ["dropped", "wrong id", "twice", "value", "not json"])
def test_guard_splits_a_wrong_answer(fault):
    rows = [(f"id{k}", f"text {k}") for k in range(8)]
    provider = Faulty("sentiment", fault, 4)
    items = batching.label_batch(provider, "sentiment", rows)
    assert provider.calls == 3 and [i["comment_id"] for i in items] == [r[0] for r in rows]
    with pytest.raises(ValueError):
        batching.label_batch(Faulty("sentiment", fault, 0) if fault != "twice" else Faulty("sentiment", "dropped", 0), "sentiment", rows[:1])
    assert batching.label_batch(provider, "sentiment", []) == []


def test_retry_and_fallback():
    class Down:
        def __init__(self, failure, times=99):
            self.failure, self.times, self.calls = failure, times, 0

        def label(self, batch):
            self.calls += 1
            if self.calls <= self.times:
                raise models.ModelError(self.failure)
            return "ok"

    F_ = models.Failure
    chain = lambda *p: models.Chain(list(p), sleep=lambda s: None)
    good = models.HashProvider("sentiment")
    for failure, calls, falls in ((F_.SERVER, 4, True), (F_.TIMEOUT, 4, True), (F_.RATE_LIMIT, 1, True), (F_.NOT_FOUND, 1, True), (F_.AUTH, 1, False), (F_.BAD_REQUEST, 1, False), (F_.PERMISSION, 1, False), (F_.UNPROCESSABLE, 1, False)):
        down = Down(failure)
        if falls:
            assert json.loads(chain(down, good).label([("0", "x")]))
        else:
            with pytest.raises(models.ModelError):
                chain(down, good).label([("0", "x")])
        assert down.calls == calls
    assert chain(Down(F_.SERVER, 2)).label([]) == "ok"
    with pytest.raises(models.ModelError):
        chain(Down(F_.SERVER), Down(F_.RATE_LIMIT)).label([])


def test_batches_by_position(spark):
    df = spark.createDataFrame([(k * 3 + 1, f"t{k}") for k in range(120)], "pos bigint, text string").repartition(7)
    assert {r.batch_key for r in batching.positional(df, 50).collect()} == {"0", "50", "100"}
    assert {r.batch_key for r in batching.positional(df, 100).collect()} == {"0", "100"}
    got = sorted((r.pos, r.at) for r in batching.dense_pos(df).collect())
    assert got == [(k * 3 + 1, k) for k in range(120)]
    assert batching.positional(df.limit(0), 50).count() == 0


def test_classify_covers_every_comment(spark):
    df = spark.createDataFrame([(f"c{k}", k, f"text {k}") for k in range(130)], "id string, pos bigint, text string")
    out = batching.classify(df, Faulty("intent", "dropped", 20), "intent").collect()
    assert sorted(r.comment_id for r in out) == sorted(f"c{k}" for k in range(130))


def test_evaluation(spark):
    cases = [("positive", "positive"), ("negative", "negative"), ("neutral", "neutral"), ("mixed", "positive")]
    df = spark.createDataFrame(cases, "expected_mood string, predicted string")
    r = evaluation.accuracy(df).first()
    assert (r.accuracy, r.accuracy_lenient, r.mixed_cases, r.mixed_covered, r.failed_cases) == (1.0, 1.0, 1, 1, 0)
    none = evaluation.accuracy(df.limit(0)).first()
    assert none.accuracy is None and none.accuracy_lenient is None
    pairs = spark.createDataFrame([("positive", "positive"), ("positive", "negative")], "expected string, predicted string")
    rep = {r.label: r for r in evaluation.report(pairs, ["positive", "negative", "neutral"]).collect()}
    assert rep["positive"].precision == 1.0 and rep["positive"].recall == 0.5 and rep["neutral"].f1 == 0.0
    assert {r.label for r in evaluation.averages(evaluation.report(pairs, ["positive", "negative", "neutral"])).collect()} == {"macro avg", "weighted avg"}


def test_quotes_must_be_verbatim():
    texts = ["I love the intro", "please do a part two"]
    draft = lambda *q: json.dumps({"theme": "t", "quotes": list(q)})
    assert insights.checked_draft("request", draft("love the intro", "part two"), texts)
    for quotes in (["Love the intro", "part two"], ["they love it", "part two"], ["part two"], ["a"] * 4, [], ["please do a part two now", "part two"]):
        assert insights.checked_draft("request", draft(*quotes), texts) is None
    assert insights.checked_draft("request", "{", texts) is None


def test_verbatim_column(spark):
    df = spark.createDataFrame([(["a b", ""], ["x a b y"]), (["A b"], ["x a b y"]), (["q"], None)], "q array<string>, t array<string>")
    assert [r[0] for r in df.select(insights.verbatim(F.col("q"), F.col("t"))).collect()] == [True, False, True]


def test_a_failed_draft_drops_its_group_only(spark):
    df = spark.createDataFrame([("a", 0, "one two"), ("a", 1, "three"), ("b", 2, "x"), ("b", 3, "y")], "group string, pos bigint, text string")

    def write(kind, texts):
        if "x" in texts:
            raise RuntimeError
        return models.offline_synthesis(kind, texts)

    rows = insights.synthesize(df, "request", write).collect()
    assert [(r.group, r.mention_count) for r in rows] == [("a", 2)]


def test_quotes_are_held_against_the_whole_group(spark):
    rows = [("a", 0, "one two"), *(("a", k, "three") for k in range(1, 30)), ("a", 30, "the late one"), ("b", 3, "x"), ("b", 4, "y"), ("b", 4, "y")]
    df = spark.createDataFrame(rows, "group string, pos bigint, text string")
    write = lambda kind, texts: json.dumps({"theme": "t", "quotes": ["x", "late one"] if "x" in texts else ["late one", "one two"]})
    found = insights.synthesize(df, "request", write, prompt_rows=10).collect()
    assert [(r.group, r.quotes, r.mention_count) for r in found] == [("a", ["late one", "one two"], 31)]


def test_statuses():
    from earshot.sources import paged

    kinds = {}
    for status in (200, 429, 503, 403, 400):
        try:
            kinds[status] = paged.check_status(status)
        except Exception as e:  # noqa: BLE001
            kinds[status] = type(e)
    assert kinds == {200: None, 429: paged.Transient, 503: paged.Transient, 403: paged.Forbidden, 400: RuntimeError}
    met = {s: models.embedding_failure(s) for s in (200, 401, 403, 404, 429, 500)}
    assert met[200] is None and not met[401].fall_back and not met[403].fall_back and met[404].fall_back and not met[404].retry
    assert met[429].retry and met[500].retry


def test_preflight_probes(spark):
    full = dict.fromkeys(preflight.REQUIRED, "x")
    wired = preflight.probes(spark, sentiment=models.HashProvider("sentiment"), intent=models.HashProvider("intent"), embedder=models.HashEmbedder(8), write=models.offline_synthesis, width=8, environment=full)
    assert {r.status for r in preflight.run_checks(spark, wired).collect()} == {"ok"}
    crossed = preflight.probes(spark, sentiment=models.HashProvider("intent"), embedder=models.HashEmbedder(8), write=lambda kind, texts: "{}", width=9, environment={})
    found = {r.name: r.status for r in preflight.run_checks(spark, crossed).collect()}
    assert found == {"settings": "fail", "store": "ok", "sentiment model": "fail", "intent model": "skip", "synthesis": "fail", "embeddings": "fail"}


def test_dedup_by_mode(spark):
    df = spark.sql("SELECT pos, fp, timestamp_seconds(t) AS at FROM VALUES (0L, 'a', 0), (1L, 'a', 5), (2L, 'b', 6), (3L, 'a', 20) AS v(pos, fp, t)")
    kept = {m: sorted(r.pos for r in dedup.by_mode(df, m, at="at", seconds=10).collect()) for m in ("batch", "ttl", "exact_lru")}
    assert kept == {"batch": [0, 2], "ttl": [0, 2, 3], "exact_lru": [0, 2, 3]}
    for wrong in ({"mode": "redis"}, {"mode": "ttl"}):
        with pytest.raises(ValueError):
            dedup.by_mode(df, **wrong)


def test_resume_skips_completed_batches(spark, tmp_path):
    path = str(tmp_path / "checkpoints")
    batches = spark.createDataFrame([(str(k),) for k in (0, 50, 100)], "batch_key string")
    ran = []

    def work(fail):
        def run(df):
            keys = sorted(r.batch_key for r in df.collect())
            ran.append(keys)
            rows = [("j", "stage_b", k, "failed" if k in fail else "completed", None, None, datetime.datetime(2024, 1, 1, len(ran))) for k in keys]
            return spark.createDataFrame(rows, "job_id string, stage string, batch_key string, status string, result string, error string, completed_at timestamp")

        return run

    step = lambda fail: sorted(r.batch_key for r in jobs.run_stage(spark, path=path, job_id="j", stage="stage_b", batches=batches, work=work(fail)).collect())
    assert step({"50"}) == ["0", "100"]
    assert step(set()) == ["0", "100", "50"]
    assert step(set()) == ["0", "100", "50"] and ran == [["0", "100", "50"], ["50"], []]


def test_one_claim_wins(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(10) as pool:
        assert sum(pool.map(lambda _: jobs.claim(str(tmp_path), "job"), range(10))) == 1


def test_ledger_rolls_over():
    day = ["mon"]
    ledger = jobs.Ledger(10, lambda: day[0])
    ledger.charge(7)
    assert ledger.remaining == 3
    with pytest.raises(RuntimeError):
        ledger.require(4)
    day[0] = "tue"
    ledger.require(10)


def test_content_key_follows_the_content(spark):
    a = spark.createDataFrame([("x",), ("y",)], "fp string")
    assert jobs.content_key("c", a) == jobs.content_key("c", a.orderBy(F.desc("fp"))) != jobs.content_key("c", a.limit(1))


class Pages:
    """150 comments of v2 over two pages, a duplicate in v1, comments off for v4."""

    def page(self, video, token):
        if video == "v4":
            raise paged.Forbidden
        if video == "v1":
            return [{"top": {"id": "a", "textOriginal": "hi"}, "replies": [{"id": "b", "textDisplay": "HI "}, {"id": "n", "textOriginal": ""}]}], None
        first = 0 if token is None else 100
        return [{"top": {"id": f"v2-{k}", "textOriginal": f"comment {k} me@x.example", "likeCount": k}} for k in range(first, min(150, first + 100))], "next" if token is None else None


def test_paged_source(spark):
    df = paged.comments(spark, Pages, [("v1", 2), ("v2", 150), ("v3", 0), ("v4", 5)])
    rows = df.orderBy("pos").collect()
    assert len(rows) == 152 and [r.id for r in rows[:3]] == ["a", "b", "v2-0"] and [r.is_reply for r in rows[:2]] == [False, True]
    clean = analysis.prepare(df.select("id", "pos", "text", "video_id"))
    assert clean.count() == 151 and clean.filter("text LIKE '%[EMAIL]%'").count() == 150


def test_retry_of_a_page():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise paged.Transient
        return 7

    assert paged.with_retry(call, pause=0) == 7 and len(calls) == 3


def test_eval_cases(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"text": "a", "platform": "p", "expected_mood": "mixed"}]))
    assert corpus.eval_cases(spark, str(tmp_path / "e.json")).count() == 1
    (tmp_path / "e.json").write_text(json.dumps([{"text": "a", "platform": "p", "expected_mood": "angry"}]))
    with pytest.raises(ValueError):
        corpus.eval_cases(spark, str(tmp_path / "e.json"))


def test_cleaned_urls_are_what_urllib_says(spark):
    rng = random.Random(4)
    names = ["utm_source", "UTM_ID", "q", "a b", "x~y", "ü", "fbclid", "star*", "%zz", ""]
    urls = []
    for _ in range(300):
        pairs = "&".join(rng.choice(["", f"{rng.choice(names).replace(' ', '+')}={rng.choice(['1', '%20z', 'é', 'a+b', '*~', ''])}", rng.choice(names).replace(" ", "%20")]) for _ in range(rng.randrange(4)))
        urls.append(f"{rng.choice(['https', 'HTTP'])}://a.example/{rng.choice(['', 'p/q'])}?{pairs}{rng.choice(['', '#', '#f?x'])}")

    def expected(url):
        parts = urllib.parse.urlsplit(url)
        pairs = urllib.parse.parse_qsl(parts.query, keep_blank_values=True)
        rest = [p for p in pairs if p[0].lower() not in X.TRACKING]
        return url if len(rest) == len(pairs) else parts._replace(query=urllib.parse.urlencode(rest)).geturl()

    df = spark.createDataFrame([(i, f"see {u} and {u}") for i, u in enumerate(urls)], "pos int, text string")
    for r in X.clean_urls(df).collect():
        u = urls[r.pos]
        if "%zz" not in u:  # a broken escape stays in one and is written as %25 in the other
            assert r.text == f"see {expected(u)} and {expected(u)}"


def test_fingerprints_fold_case_fully(spark):
    texts = ["Straße ﬁn", "ΣΑΣ ς", "İstanbul", "a\x1cb", "plain  Text", "µ ſ ŉ", None]
    df = X.with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "pos int, text string"))
    for r in df.collect():
        t = texts[r.pos]
        assert r.fp == (None if t is None else hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest())


class CountingModel:
    """Writes a line for each text that it is asked about."""

    def __init__(self, path, kind):
        self.path, self.inner = path, models.HashProvider(kind)

    def label(self, batch):
        with open(self.path, "a") as f:
            f.write("".join(f"{hashlib.sha256(t.encode()).hexdigest()}\n" for _, t in batch))
        return self.inner.label(batch)


def test_no_comment_is_labelled_twice(spark, tmp_path):
    rng = random.Random(8)
    rows = [(str(k), "p", f"comment {k} {rng.random()}", None, None, datetime.datetime(2024, 1, 1), f"v{k % 3}", 0, False, k) for k in range(230)]
    comments = spark.createDataFrame(rows, schemas.COMMENT)
    asked = {k: str(tmp_path / k) for k in ("sentiment", "intent")}
    kept = jobs.stage_tables(spark, str(tmp_path / "stages"), "j")
    run = lambda: sorted(map(repr, analysis.analyze(comments, sentiment=CountingModel(asked["sentiment"], "sentiment"), intent=CountingModel(asked["intent"], "intent"), store=kept).collect()))
    first = run()
    calls = {k: open(p).read().split() for k, p in asked.items()}
    assert first and all(len(c) == len(set(c)) for c in calls.values()) and len(calls["sentiment"]) == 230
    assert run() == first and {k: open(p).read().split() for k, p in asked.items()} == calls


def test_dense_clusters_pass_the_filter(spark):
    rows = [("a", "neutral", 0.1, 1)] * 5 + [("b", "neutral", 0.1, 2)] + [("c", "neutral", 0.1, None)] * 6 + [("d", "negative", 0.1, None)]
    out = filtering.flags(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "id string, sentiment string, confidence double, cluster_id int, pos int")).collect()
    assert {r.id for r in out if r.flagged} == {"a", "d"} and {r.id for r in out if r.dense_cluster} == {"a"}


def test_embeddings_are_ordered_and_counted(spark):
    df = spark.createDataFrame([(str(k), f"t{k}", k) for k in range(250)], "id string, text string, pos bigint")
    found = batching.embed(df, models.HashEmbedder(4))
    for r in found.collect():
        assert r.vector == [int(hashlib.sha256(f"t{r.comment_id}".encode()).hexdigest()[4 * k : 4 * k + 4], 16) / 65536 for k in range(4)]
    assert found.count() == 250 and batching.one_width(found) == 4 and batching.embed(df.limit(0), None).count() == 0
    for answer in ('{"data": [{"index": 0, "embedding": [1]}]}', '{"data": [{"index": 0, "embedding": [1]}, {"index": 0, "embedding": [2]}]}'):
        with pytest.raises(ValueError):
            batching.ordered_vectors(answer, 2)
    with pytest.raises(ValueError):
        batching.one_width(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>"))


def test_a_job_runs_is_cancelled_and_reaped(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path / "log"))
    done = log.start("@x")
    assert jobs.run_job(log, done, lambda check: check(), beat=60) == "completed"
    log.write(done, completed_units=5)
    log.write(done, more_units=2)
    state = log.read(done)
    assert (state.status, state.completed_units, state.channel_ref) == ("completed", 7, "@x")
    stop = log.start("@y")

    def work(check):
        log.cancel(stop)
        for _ in range(400):
            check()
            time.sleep(0.05)

    assert jobs.run_job(log, stop, work, beat=0.2) == "cancelled"

    def late(check):
        for _ in range(400):
            check()
            time.sleep(0.05)

    assert jobs.run_job(log, log.start("@z"), late, deadline=0.3, beat=60) == "failed"
    silent = log.start("@s")
    log.write(silent, status="running", heartbeat_at=datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc))
    assert log.progress(silent).status == "failed" and log.read(done).status == "completed"


def test_evaluation_runs_are_kept(spark, tmp_path):
    figures = spark.createDataFrame([(30, 0.9)], "total_cases int, accuracy double")
    for _ in range(2):
        evaluation.record_run(figures, str(tmp_path / "runs"))
    evaluation.write_metrics(figures, str(tmp_path / "metrics.json"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2 and spark.read.json(str(tmp_path / "metrics.json")).first().total_cases == 30
