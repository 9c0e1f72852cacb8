"""Prefix scan, calls in flight, batch checkpoints, resumable ingestion, quotes over a corpus, synthesis of whole groups."""

import datetime
import itertools
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from earshot import schemas
from earshot.operators import batching, calls, checkpoints, jobs, models, prefix, quotes
from earshot.plans import analysis, insights
from earshot.sources import paged, resumable


# ---- prefix scan ------------------------------------------------------------------------------


@pytest.mark.parametrize("slices", [1, 3, 40])
def test_prefix_scan_against_plain_sums(spark, slices):
    rng = random.Random(slices)
    rows = [(k, rng.choice(["hot", "hot", "hot", "b", None, f"k{rng.randrange(30)}"]), rng.choice([None, *range(-3, 9)]), rng.random()) for k in range(900)]
    df = spark.createDataFrame(rows, "pos long, day string, units int, x double").repartition(7)
    out = prefix.scan(df, [F.desc("x"), "pos"], keys=["day"], number="nth", sums={"spent": "units"}, slices=slices)
    assert out.columns == ["pos", "day", "units", "x", "nth", "spent"]
    expected = []
    for day in {r[1] for r in rows}:
        total = 0
        for nth, r in enumerate(sorted((r for r in rows if r[1] == day), key=lambda r: -r[3]), 1):
            total += r[2] or 0
            expected.append((r[0], nth, total))
    assert sorted((r.pos, r.nth, r.spent) for r in out.collect()) == sorted(expected)
    one = prefix.scan(df, ["pos"], number="nth", slices=slices).collect()
    assert all(r.nth == r.pos + 1 for r in one) and len(one) == 900
    assert prefix.scan(df.limit(0), ["pos"], number="nth").count() == 0
    with pytest.raises(ValueError):
        prefix.scan(df, ["pos"], number="day")


def test_a_hot_key_is_spread_and_offsets_are_few(spark):
    df = spark.range(20_000).select("id", F.lit("hot").alias("day"), F.lit(1).alias("units"))
    out = prefix.scan(df, ["id"], keys=["day"], sums={"spent": "units"}, slices=10)
    assert out.filter("spent <> id + 1").count() == 0
    held = spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0])
    sizes = [r["count"] for r in held.groupBy("_slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * 20_000 / 10
    assert prefix.before(held, ["day"], {"spent": F.col("units")}).count() == 9


# ---- calls in flight --------------------------------------------------------------------------


def test_calls_keep_their_order_and_number():
    flying, most, lock, begun = 0, 0, threading.Lock(), []

    def call(k):
        nonlocal flying, most
        with lock:
            begun.append(k)
            flying += 1
            most = max(most, flying)
        time.sleep(0.3 if k == 0 else 0.01)  # the first is slow, as one that is retried
        with lock:
            flying -= 1
        return k * k

    began = time.monotonic()
    assert list(calls.pooled(range(60), call, at_once=8)) == [k * k for k in range(60)]
    assert most == 8 and time.monotonic() - began < 0.55  # one after the other they would take 0.9 s
    endless = calls.pooled(itertools.count(), lambda k: k, at_once=2, ahead=4)
    assert [next(endless) for _ in range(10)] == list(range(10))
    endless.close()


def test_an_error_comes_at_its_turn():
    def call(k):
        if k == 5:
            raise RuntimeError("five")
        return k

    out = []
    with pytest.raises(RuntimeError, match="five"):
        for r in calls.pooled(range(100), call, at_once=3):
            out.append(r)
    assert out == [0, 1, 2, 3, 4]


def test_bucket_spaces_calls():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    bucket = calls.Bucket(2, burst=3, now=lambda: now[0], sleep=sleep)
    for _ in range(7):
        bucket.take()
    assert sum(slept) == pytest.approx(2.0) and len(slept) == 4
    with pytest.raises(ValueError):
        calls.Bucket(0)


# ---- batch checkpoints ------------------------------------------------------------------------


class FailingModel:
    """Writes a line a call; fails, or ends its process, on a batch with a marked text while the mark is there."""

    def __init__(self, folder, kind="sentiment", how="raise"):
        self.folder, self.inner, self.how = str(folder), models.HashProvider(kind), how

    def label(self, batch):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(batch[0][1] + "\n")
        if any("bad" in t for _, t in batch) and os.path.exists(f"{self.folder}/broken"):
            if self.how == "exit":
                time.sleep(1.5)  # the others are through and stored
                os._exit(3)
            raise models.ModelError(models.Failure.RATE_LIMIT, "no more today")
        return self.inner.label(batch)


def comments_of(spark, n, bad=-1):
    rows = [(str(k), "p", f"{'bad' if k == bad else 'fine'} comment {k}", None, None, datetime.datetime(2024, 1, 1), f"v{k % 3}", 0, False, k) for k in range(n)]
    return spark.createDataFrame(rows, schemas.COMMENT)


@pytest.mark.parametrize("how", ["raise", "exit"])
def test_a_stage_that_dies_pays_for_one_batch_again(spark, tmp_path, how):
    comments = comments_of(spark, 1000, bad=995)
    open(f"{tmp_path}/broken", "w").close()
    model = FailingModel(tmp_path, how=how)
    log = checkpoints.StageLog(spark, str(tmp_path / "stages"), "j", "stage_a_sentiment", flush=1)
    run = lambda: batching.classify(comments, model, "sentiment", size=10, log=log, partitions=1)
    with pytest.raises(checkpoints.StageFailed if how == "raise" else Exception):
        run()
    made = open(f"{tmp_path}/calls").read().splitlines()
    assert len(set(made)) == 100
    rows = {r.batch_key: r for r in log.rows().collect()}
    assert sum(r.status == "completed" for r in rows.values()) == 99
    if how == "raise":
        assert rows["990"].status == "failed" and "no more today" in rows["990"].error and rows["990"].result is None
    os.remove(f"{tmp_path}/broken")
    out = run()
    again = open(f"{tmp_path}/calls").read().splitlines()[len(made) :]
    assert again == ["fine comment 990"]
    plain = batching.classify(comments, models.HashProvider("sentiment"), "sentiment", size=10)
    assert sorted(out.collect()) == sorted(plain.collect()) and out.count() == 1000
    assert run().count() == 1000 and len(open(f"{tmp_path}/calls").read().splitlines()) == len(made) + 1
    assert not os.path.exists(log._segments) and {r.status for r in log.rows().collect()} == {"completed"}


def test_compaction_leaves_the_newest_rows(spark, tmp_path):
    def add(n, status):
        rows = [(job, stage, str(k), status, f"r{n}", None, datetime.datetime(2024, 1, 1, n)) for job in ("j", "k") for stage in ("stage_a_sentiment", "stage_b") for k in range(20)]
        spark.createDataFrame(rows[n:], schemas.CHECKPOINT).repartition(6).write.mode("append").partitionBy("job_id", "stage").parquet(str(tmp_path / "table"))

    for n, status in enumerate(("failed", "completed", "failed", "completed", "completed")):
        add(n, status)
    logs = [checkpoints.StageLog(spark, str(tmp_path), job, stage) for job in ("j", "k") for stage in ("stage_a_sentiment", "stage_b")]
    before = [sorted(map(repr, log.rows().collect())) for log in logs]
    files = len(list((tmp_path / "table").rglob("*.parquet")))
    for _ in range(2):
        checkpoints.compact(spark, str(tmp_path), files=2)
        assert [sorted(map(repr, log.rows().collect())) for log in logs] == before
    left = list((tmp_path / "table").rglob("*.parquet"))
    assert len(left) <= 8 < files and sum(spark.read.parquet(str(f)).count() for f in left) == 80


def test_a_task_takes_up_its_own_earlier_attempt(tmp_path):
    segments = checkpoints.Segments(str(tmp_path / "s"), "run", 1)
    segments.append(0, [{"batch_key": "0", "status": "completed"}, {"batch_key": "50", "status": "failed"}])
    segments.append(1, [{"batch_key": "100", "status": "completed"}])
    checkpoints.Segments(segments.folder, "other", 1).append(0, [{"batch_key": "150", "status": "completed"}])
    assert sorted(segments.earlier(0)) == ["0", "50"] and sorted(segments.earlier(1)) == ["100"] and segments.earlier(2) == {}


def test_the_analysis_resumes_within_a_stage(spark, tmp_path):
    comments = comments_of(spark, 400, bad=333)
    open(f"{tmp_path}/broken", "w").close()
    kept = jobs.stage_tables(spark, str(tmp_path / "tables"), "j")
    run = lambda: sorted(map(repr, analysis.analyze(comments, sentiment=FailingModel(tmp_path), store=kept).collect()))
    with pytest.raises(checkpoints.StageFailed):
        run()
    os.remove(f"{tmp_path}/broken")
    first = run()
    assert len(open(f"{tmp_path}/calls").read().splitlines()) == 8 + 1
    assert first == run() == sorted(map(repr, analysis.analyze(comments, store=jobs.stage_tables(spark, str(tmp_path / "fresh"), "k")).collect()))


# ---- resumable ingestion ----------------------------------------------------------------------


class Service:
    """Videos of `sizes` comments in pages of 10; a line a page that is asked for; fails at one page while told so."""

    def __init__(self, folder, sizes, off=(), stop=None):
        self.folder, self.sizes, self.off, self.stop = str(folder), sizes, off, stop

    def page(self, video, token):
        at = int(token or 0)
        with open(f"{self.folder}/pages", "a") as f:
            f.write(f"{video}:{at}\n")
        if video in self.off:
            raise paged.Forbidden("off")
        if self.stop == (video, at) and os.path.exists(f"{self.folder}/broken"):
            raise RuntimeError("the service is gone")
        rows = [{"top": {"id": f"{video}-{k}", "textOriginal": f"text {k}", "author": "a", "publishedAt": "2024-01-01T00:00:00Z", "likeCount": k}, "replies": [{"id": f"{video}-{k}r", "textDisplay": "reply"}] if k % 7 == 0 else []} for k in range(at, min(at + 10, self.sizes[video]))]
        return rows, str(at + 10) if at + 10 < self.sizes[video] else None


def asked_pages(folder):
    return sorted(open(f"{folder}/pages").read().split())


@pytest.mark.parametrize("per_batch", [100, 2])
def test_ingestion_goes_on_after_the_last_page(spark, tmp_path, per_batch):
    sizes = {"v0": 35, "v1": 8, "v2": 60, "v3": 5, "v4": 0, "v5": 21}
    videos = [(v, n) for v, n in sizes.items()]
    service = Service(tmp_path, sizes, off=("v3",), stop=("v2", 40))
    folder = str(tmp_path / "job")
    open(f"{tmp_path}/broken", "w").close()
    with pytest.raises(Exception, match="the service is gone"):
        resumable.ingest(spark, lambda: service, videos, folder, videos_per_batch=per_batch, partitions=2, at_once=1)
    before = asked_pages(tmp_path)
    os.remove(f"{tmp_path}/broken")
    got = resumable.ingest(spark, lambda: service, videos, folder, videos_per_batch=per_batch, partitions=2, at_once=1)
    pages = asked_pages(tmp_path)
    every = sorted(f"{v}:{at}" for v, n in sizes.items() if n for at in range(0, 10 if v == "v3" else n, 10))
    assert sorted(set(pages)) == every
    assert len(pages) - len(every) == before.count("v2:40")  # nothing but the page that failed was asked for again
    rows = got.orderBy("pos").collect()
    expected = [c for v, n in sizes.items() if v != "v3" for k in range(n) for c in ([f"{v}-{k}", f"{v}-{k}r"] if k % 7 == 0 else [f"{v}-{k}"])]
    assert [r.id for r in rows] == expected and len({r.pos for r in rows}) == len(rows)
    assert resumable.ingest(spark, lambda: service, videos, folder, videos_per_batch=per_batch, partitions=2).count() == len(rows)
    assert asked_pages(tmp_path) == pages
    with pytest.raises(Exception, match="another list"):
        resumable.ingest(spark, lambda: service, videos[:3], folder)


def test_a_channel_beyond_the_budget_is_not_begun(spark, tmp_path):
    ledger = jobs.Ledger(5, lambda: "today")
    service = Service(tmp_path, {"v0": 501})
    with pytest.raises(RuntimeError, match="units needed"):
        resumable.ingest(spark, lambda: service, [("v0", 501)], str(tmp_path / "job"), ledger=ledger)
    assert not os.path.exists(f"{tmp_path}/pages")
    assert resumable.ingest(spark, lambda: service, [], str(tmp_path / "none")).count() == 0


# ---- quotes -----------------------------------------------------------------------------------


def test_quotes_against_contains(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("ab é\n🙂") for _ in range(n))
    texts = [make(rng.randrange(0, 90)) for _ in range(150)] + ["", "x" * 200_000 + " the end of it, ab", "y" * 131_070 + "straddles the part", None]
    asked = [t[a : a + rng.randrange(0, 50)] for t in texts[:150] for a in (rng.randrange(0, 60),)] + [make(rng.randrange(1, 40)) for _ in range(150)]
    asked += ["", None, "the end of it", "straddles the part", "The end of it", "x" * 70_000, "x" * 200_001, "x"] + asked[:20]
    groups = [rng.choice(["g", "h", None]) for _ in texts]
    q = spark.createDataFrame([(t,) for t in asked], "quote string")
    df = spark.createDataFrame(list(zip(groups, texts)), "g string, text string")
    expected = {(g, a) for g, t in zip(groups, texts) for a in asked if a is not None and t is not None and a in t}
    for chars in (16_000_000, 60_000):
        out = [(r.g, r.quote) for r in quotes.find(q, df, by=["g"], block_chars=chars).collect()]
        assert len(out) == len(set(out)) and set(out) == expected
    assert {r.quote for r in quotes.find(q, df).collect()} == {a for _, a in expected}
    assert quotes.find(q.limit(0), df).count() == 0 and quotes.find(q, df.limit(0)).count() == 0
    assert quotes.find(spark.createDataFrame([("",)], "quote string"), df).count() == 1


def test_a_hundred_thousand_quotes_in_one_pass(spark):
    rng = random.Random(4)
    said = [" ".join(f"w{rng.randrange(3000)}" for _ in range(14)) for _ in range(20_000)]
    texts = [f"Thanks for the video. {s} and so on" for s in said[:5000]]
    asked = ["Thanks for the video. " + s for s in said] + said + [s[:-1] + "!" for s in said] + [s[5:60] for s in said] + [f"{s} and" for s in said]
    q, df = spark.createDataFrame([(a,) for a in asked], "quote string"), spark.createDataFrame([(t,) for t in texts], "text string")
    out = quotes.find(q, df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and said[0] not in plan
    began = time.monotonic()
    found = {r.quote for r in out.collect()}
    assert time.monotonic() - began < 60
    assert found >= {a for k, a in enumerate(asked) if k % 20_000 < 5000 and not 40_000 <= k < 60_000} and not any(a.endswith("!") for a in found)


def test_an_anchor_that_many_quotes_share():
    asked = ["a" * 40 + "b" * k for k in range(300)]
    known = quotes.patterns(asked)
    text, quote = quotes.found_in(["x" + "a" * 500 + "b" * 120, "a" * 39, "a" * 40], known)
    assert sorted(zip(text.tolist(), quote.tolist())) == [(0, k) for k in range(121)] + [(2, 0)]


# ---- synthesis of whole groups ----------------------------------------------------------------


def test_every_text_of_a_group_is_put_to_the_model(spark, tmp_path):
    folder = str(tmp_path)

    def write(kind, texts):
        with open(f"{folder}/{os.getpid()}-{random.random()}", "w") as f:
            json.dump(texts, f)
        return json.dumps({"theme": "t", "quotes": [texts[0], texts[-1]]})

    rows = [("big", k, f"text {k:04d}") for k in range(1234)] + [("small", k, f"few {k}") for k in range(3)] + [(None, 1, "alone"), (None, 2, "two")]
    out = {r.group: r for r in insights.synthesize(spark.createDataFrame(rows, "group string, pos long, text string"), "request", write, prompt_rows=50).collect()}
    prompts = [json.load(open(f"{folder}/{f}")) for f in os.listdir(folder)]
    assert {t for p in prompts for t in p} == {r[2] for r in rows} and max(map(len, prompts)) <= 50
    assert len(prompts) == 25 + 1 + 1 + 1  # slices of the big group and the one call that joins them; one for each of the others
    assert out["big"].mention_count == 1234 and out["big"].quotes == ["text 0000", "text 1233"] and out["small"].mention_count == 3
    false = insights.synthesize(spark.createDataFrame(rows, "group string, pos long, text string"), "request", lambda kind, texts: json.dumps({"theme": "t", "quotes": [texts[0], "never said"]}))
    assert false.count() == 0
