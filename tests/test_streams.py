"""State that expires, streams joined with streams, sliding and session windows; retrieval through the inverted file."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import retrieval
from earshot.streaming import streams

DAY = datetime.datetime(2024, 1, 1)


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


class Feed:
    """A stream fed by files, one micro-batch each."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, str(folder), schema, 0
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)

    def add(self, *rows):
        self.n += 1
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.folder)


@pytest.fixture
def feed(spark, tmp_path):
    def make(name, schema):
        (tmp_path / name).mkdir()
        return Feed(spark, tmp_path / name, schema)

    return make


COMMENT = "pos bigint, fp string, timestamp timestamp"


def test_expiring_state_goes_to_nothing(spark, feed):
    source = feed("in", COMMENT)
    rule = streams.dedup_expiring(source.stream, seconds=10, late="5 seconds")
    query = rule.writeStream.format("memory").queryName("expiring").outputMode("append").start()
    try:
        source.add((0, "a", at(0)), (1, "a", at(5)), (2, "b", at(6)), (3, None, at(7)), (4, "a", at(10)), (5, "a", at(19)))
        query.processAllAvailable()
        rows = lambda: sorted(r.pos for r in spark.table("expiring").collect())
        held = lambda: query.lastProgress["stateOperators"][0]["numRowsTotal"]
        assert rows() == [0, 2, 3, 4]  # 5 is within 10 seconds of 4, the sighting on record
        assert held() >= 1
        source.add((6, "z", at(100)))
        query.processAllAvailable()
        assert rows() == [0, 2, 3, 4, 6] and held() == 1  # a, b and null have expired
        source.add((7, "a", at(101)), (8, "b", at(50)))  # the second is behind the watermark
        query.processAllAvailable()
        source.add((9, "y", at(1000)))
        query.processAllAvailable()
        assert rows() == [0, 2, 3, 4, 6, 7, 9] and held() == 1
    finally:
        query.stop()


def test_dedup_within_the_watermark(spark, feed):
    source = feed("in", COMMENT)
    query = streams.dedup_within(source.stream, ttl="10 seconds").writeStream.format("memory").queryName("within").start()
    try:
        source.add((0, "a", at(0)), (1, "b", at(1)))
        source.add((2, "a", at(5)), (3, "c", at(60)))
        query.processAllAvailable()
        source.add((4, "a", at(61)))
        query.processAllAvailable()
        assert sorted(r.pos for r in spark.table("within").collect()) == [0, 1, 3, 4]
    finally:
        query.stop()


def test_labels_join_comments_as_they_come(spark, feed):
    comments, labels = feed("c", "id string, timestamp timestamp"), feed("l", "comment_id string, sentiment string, labelled_at timestamp")
    hour = 3600
    joined = streams.labelled(comments.stream, labels.stream).writeStream.format("memory").queryName("joined").start()
    mood = streams.labelled_mood(comments.stream, labels.stream, width="1 hour").writeStream.format("memory").queryName("moods").start()
    try:
        comments.add(("a", at(0)), ("b", at(60)), ("c", at(hour)))
        labels.add(("b", "positive", at(120)), ("nobody", "positive", at(130)))
        for q in (joined, mood):
            q.processAllAvailable()
        labels.add(("a", "negative", at(2 * hour)), ("c", "strongly_positive", at(3 * hour + 1)), ("b", "negative", at(30)))  # c's is a second too late, b's is before b
        for q in (joined, mood):
            q.processAllAvailable()
        assert sorted((r.id, r.sentiment) for r in spark.table("joined").collect()) == [("a", "negative"), ("b", "positive")]
        comments.add(("end", at(9 * hour)))
        labels.add(("end", "positive", at(9 * hour)))
        for q in (joined, mood):
            q.processAllAvailable()
        comments.add(("late", at(hour)))  # behind the watermark
        labels.add(("late", "positive", at(hour)))
        comments.add(("end2", at(20 * hour)))
        labels.add(("end2", "neutral", at(20 * hour)))
        for q in (joined, mood):
            q.processAllAvailable()
        assert "late" not in {r.id for r in spark.table("joined").collect()}
        assert sorted((r.window_start, r.mood, r.n) for r in spark.table("moods").collect())[0] == (at(0), 0.0, 2)
    finally:
        joined.stop()
        mood.stop()


def test_sliding_and_session_mood(spark, feed):
    source = feed("in", "timestamp timestamp, sentiment string")
    rows = [(at(0), "positive"), (at(600), "negative"), (at(5000), "strongly_positive"), (at(90_000), "neutral")]
    source.add(*rows)
    source.add((at(900_000), "neutral"))
    found = {}
    for name, how in (("sliding", {"width": "1 hour", "slide": "30 minutes"}), ("session", {"gap": "20 minutes"})):
        query = streams.mood(source.stream, late="1 minute", **how).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        found[name] = sorted((r.window_start, r.mood, r.n) for r in spark.table(name).collect())
    half = 1800
    assert found["sliding"] == [(at(-half), 0.0, 2), (at(0), 0.0, 2), (at(half), 1.0, 1), (at(2 * half), 1.0, 1), (at(49 * half), 0.0, 1), (at(50 * half), 0.0, 1)]
    assert found["session"] == [(at(0), 0.0, 2), (at(5000), 1.0, 1), (at(90_000), 0.0, 1)]


# ---- retrieval --------------------------------------------------------------------------------


def test_retrieval_against_all_rows(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 24)) * 2
    x = centres[r.integers(0, 12, 3000)] + r.standard_normal((3000, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] * 24), (3004, x[5].tolist())]
    df = spark.createDataFrame(rows, "pos bigint, vector array<double>")
    index = retrieval.build(df, str(tmp_path / "index"), sample=1000)
    assert index.table.count() == 3001 and 1 < len(index.centroids) <= 55
    asked = df.filter("pos % 10 = 0 OR pos = 3004")
    unit = np.array([x[5] if k == 3000 else x[k] for k in range(3001)])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([*range(3000), 3004])
    exact = {}
    for q in [*range(0, 3000, 10), 3004]:
        c = np.round(unit @ unit[3000 if q == 3004 else q], 6)
        exact[q] = [int(ids[j]) for j in np.lexsort((ids, -c))[:10]]
    out = {}
    for row in retrieval.search(index, asked, k=10, block=64).collect():
        out.setdefault(row.query_id, []).append((-row.cosine, row.pos))
    assert {q: [p for _, p in sorted(v)] for q, v in out.items()} == exact
    probed = {}
    for row in retrieval.search(index, asked, k=10, probes=max(1, len(index.centroids) // 4)).collect():
        probed.setdefault(row.query_id, set()).add(row.pos)
    recall = np.mean([len(probed.get(q, set()) & set(e)) / 10 for q, e in exact.items()])
    assert recall >= 0.9
    plan = retrieval.search(index, asked, k=10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    nothing = retrieval.build(df.limit(0), str(tmp_path / "none"))
    assert retrieval.search(nothing, asked).count() == 0 and retrieval.search(index, asked.limit(0)).count() == 0


def test_recall_of_the_probed_query(spark):
    from earshot.reference_queries import similar_comments, similar_comments_probed

    sf = "/root/testdata/sf0.1"
    exact, probed = ({(r.query_id, r.pos) for r in q(spark, sf).collect()} for q in (similar_comments, similar_comments_probed))
    assert len(exact) == 200 and len(exact & probed) / len(exact) >= 0.9
