"""What must not grow faster than the input: one cleaning of a text, large scopes in passes, questions sent once, state by bucket."""

import datetime
import random
import threading

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from earshot.functions import text as X
from earshot.operators import clustering, dedup, retrieval
from earshot.plans import analysis
from earshot.session import side_by_side
from earshot.streaming import streams


def test_large_scopes_of_kmeans_are_worked_on_side_by_side_as_in_one_worker(spark):
    cloud = np.random.default_rng(3).normal(size=(150, 4))
    rows = [(None if n % 5 == 0 else n % 3, n, p.tolist()) for n, p in enumerate(cloud)] + [(7, 1000, [1.0] * 4), (8, 1001, [0.0] * 4), (8, 1002, [2.0] * 4)]
    df = spark.createDataFrame(rows, "scope int, pos long, vector array<double>").repartition(3)
    how = dict(scope="scope", id_col="pos", vector="vector", clusters=lambda n: min(n, n // 10 + 1), restarts=3, rounds=15)
    here, there = (sorted(map(tuple, clustering.cluster_scopes(df, one_worker=most, **how).collect()), key=lambda r: r[1]) for most in (1000, 5))
    assert here == there and len(here) == len(rows)
    plan = clustering.cluster_scopes(df, one_worker=5, **how)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan


def test_a_text_is_cleaned_once(spark):
    rows = [("a", 0, "Mail me@here.org  now ", "v"), ("b", 1, "mail ME@here.org now", "v"), ("c", 2, " ", "v"), ("d", 3, None, "v")]
    prepared = analysis.prepare(spark.createDataFrame(rows, "id string, pos long, text string, video_id string"))
    assert [(r.pos, r.text) for r in prepared.collect()] == [(0, "Mail [EMAIL] now")]
    assert "[EMAIL]" not in prepared._jdf.queryExecution().toString()  # what follows reads the cleaned texts


def crowd(spark):
    """Vectors with many equal ones; of two lengths, whose cosines are the same."""
    draw = np.random.default_rng(5)
    few = draw.normal(size=(40, 6)).round(3)
    x = few[draw.integers(0, 40, 1500)] * draw.choice([1.0, 2.0], (1500, 1))
    return x, spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(x)], "pos long, vector array<double>").repartition(5)


def test_search_shuffles_the_best_alone_and_rounds_as_sql(spark, tmp_path):
    x, df = crowd(spark)
    index, asked = retrieval.build(df, str(tmp_path / "index")), df.filter("pos % 20 = 0")
    found = retrieval.search(index, asked, k=7, block=16)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()  # pairs are no rows
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    pairs = asked.select(F.col("pos").alias("query_id"), F.col("vector").alias("q")).crossJoin(df)
    scored = pairs.select("query_id", "pos", F.round(dot("vector", "q") / (F.sqrt(dot("vector", "vector")) * F.sqrt(dot("q", "q"))), 6).alias("cosine"))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "pos"))).filter("r <= 7").drop("r")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, best.collect()))
    halves = np.array([0.0000005, -0.0000005, 0.1234565, 0.9999995, 1.0, -0.25, 0.1234564999])
    assert retrieval._rounded(halves, 6).tolist() == [r[0] for r in spark.createDataFrame([(v,) for v in halves.tolist()], "x double").select(F.round("x", 6)).collect()]


def test_a_question_goes_to_the_workers_once_whatever_lists_it_probes(spark, tmp_path):
    x, df = crowd(spark)
    index, asked = retrieval.build(df, str(tmp_path / "index"), lists=12), df.filter("pos % 20 = 0")
    found = retrieval.search(index, asked, k=7, probes=6)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()  # no vectors by list in a broadcast
    every = {(r.query_id, r.pos): r.cosine for r in retrieval.search(index, asked, k=1500).collect()}
    near = retrieval._nearest(x, index.centroids, 6)
    lists = {r.pos: r.list for r in index.table.select("pos", "list").collect()}
    want = set()
    for q in range(0, 1500, 20):
        met = [(-every[q, p], p) for p in range(1500) if lists[p] in near[q]]
        want |= {(q, p, -c) for c, p in sorted(met)[:7]}
    assert {(r.query_id, r.pos, r.cosine) for r in found.collect()} == want


def sent(spark, work):
    """Bytes that the tasks of work() send to the driver."""
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = lambda: {s.stageId(): s.resultSize() for s in (found.apply(n) for found in [context._jsc.sc().statusStore().stageList(None, False, False, none, None)] for n in range(found.size()))}
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = stages()
    work()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(size for n, size in stages().items() if n not in before)


def test_the_driver_gets_the_sample_alone_however_many_tasks_there_are(spark, tmp_path):
    x = np.random.default_rng(8).normal(size=(6000, 64))
    df = spark.createDataFrame([(n, p.tolist()) for n, p in enumerate(x)], "pos long, vector array<double>").repartition(30)
    df.write.parquet(str(tmp_path / "points"))
    df = spark.read.parquet(str(tmp_path / "points"))
    with_split = {"spark.sql.files.maxPartitionBytes": "60k", "spark.sql.files.openCostInBytes": "60k"}
    kept = {key: spark.conf.get(key) for key in with_split}
    found = []
    try:
        for key, value in with_split.items():
            spark.conf.set(key, value)
        assert df.rdd.getNumPartitions() >= 20
        size = sent(spark, lambda: found.append(retrieval.build(df, str(tmp_path / "index"), lists=4, sample=300)))
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert size < 6000 * 64 * 8 / 3  # the vectors are 3 MB
    ids = [r.pos for r in df.orderBy(F.xxhash64("pos"), "pos").limit(300).collect()]
    units = x[ids] / np.sqrt((x[ids] ** 2).sum(1))[:, None]
    label = clustering.kmeans(units, 4, restarts=1, rounds=20)
    means = np.array([units[label == c].mean(0) for c in range(4)])
    assert np.allclose(found[0].centroids, means / np.linalg.norm(means, axis=1)[:, None])


def test_the_sample_is_whole_where_ids_hash_alike(spark):
    rows = [(n if n < 30 else None, [float(n + 1), 1.0] if n % 7 else None) for n in range(3000)]
    df = spark.createDataFrame(rows, "pos long, vector array<double>").repartition(6)
    total = sum(v is not None for _, v in rows)
    for most in (1, 20, 500, total, 5000):
        drawn = retrieval._drawn(df, most, total, "pos", "vector")
        assert drawn.num_rows == min(most, total)
    first = [r.vector for r in df.filter("vector IS NOT NULL").orderBy(F.xxhash64("pos"), "pos").limit(12).collect() if r.pos is not None]
    assert first and retrieval._drawn(df, 12, total, "pos", "vector").column("v").to_pylist()[: len(first)] == first  # the rest have one hash


def test_keys_share_state_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 4)
    draw, day = random.Random(6), datetime.datetime(2024, 1, 1)
    rows = sorted((draw.randrange(3000), n, None if n % 17 == 0 else f"k{draw.randrange(50)}") for n in range(400))
    schema = "pos bigint, fp string, timestamp timestamp"
    for at in range(0, 400, 100):  # one micro-batch each
        part = [(n, k, day + datetime.timedelta(seconds=t)) for t, n, k in rows[at : at + 100]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    recorded, want, folded, exact = {}, [], {}, []
    for t, n, k in rows:
        if k not in recorded or t - recorded[k] >= 40:
            recorded[k] = t
            want.append(n)
        folded[k], new = dedup.fold(folded.get(k), t, 40)
        exact += [n] if new else []
    for name, rule, fresh in (("expiring_b", lambda s: streams.dedup_expiring(s, seconds=40, late="10 seconds"), want), ("exact_b", lambda s: streams.dedup_exact(s, seconds=40), exact)):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = rule(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(r.pos for r in spark.table(name).collect()) == sorted(fresh)
        assert 1 <= max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 4


def test_texts_are_read_once_for_fingerprints(spark, tmp_path):
    spark.createDataFrame([(1, "Ab  c"), (2, "ﬁn"), (3, None)], "pos int, text string").write.parquet(str(tmp_path / "t"))
    plan = X.with_fingerprint(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("FileScan") == 1


def test_cleaning_that_skips_patterns_is_cleaning_by_all_of_them(spark):
    spaces, quotes = "(?U)^\\s+|\\s+$", f"^[{X.QUOTES}]+|[{X.QUOTES}]+$"
    steps = [(X.EMAIL, "[EMAIL]"), ("(?U)" + X.PHONE_INTERNATIONAL, "[PHONE]"), ("(?U)" + X.PHONE_LOCAL, "[PHONE]"), ("[ \\t]+", " "), (" ?\\n ?", "\n"), ("\\n{3,}", "\n\n"), (spaces, ""), (quotes, ""), (spaces, "")]
    draw = random.Random(4)
    pieces = [*" \t\n\r\f\x0b\x1c\x85  \xa0　​'\"“’@+()-.5a٣😀", "\n\n\n", "  ", " \n", "me@here.org", "+49 30 123 456", "(030) 123-456-7890", "٣٣٣ ٣٣٣ ٣٣٣٣", "a"]
    texts = [None, "", *("".join(draw.choices(pieces, k=draw.randint(1, 9))) for _ in range(3000))]
    plain = F.col("text")
    for pattern, by in steps:
        plain = F.regexp_replace(plain, pattern, by)
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert df.select(X.sanitize(F.col("text")).alias("here"), plain.alias("there")).filter("NOT here <=> there").collect() == []


def test_the_stage_filter_shuffles_texts_once(spark, tmp_path):
    rows = [(str(n), n, f"text {n}", "v") for n in range(40)]
    spark.createDataFrame(rows, "id string, pos long, text string, video_id string").write.parquet(str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    sentiments = corpus.select(F.col("id").alias("comment_id"), F.when(F.col("pos") % 4 == 0, "negative").otherwise("neutral").alias("sentiment"), F.lit(0.1).alias("confidence"))
    clusters = corpus.filter("pos % 2 = 1").select("id", F.when(F.col("pos") < 12, 1).otherwise(F.col("pos")).cast("int").alias("cluster_id"))
    chosen = analysis.flagged(corpus, sentiments, clusters)
    assert sorted(r.pos for r in chosen.collect()) == sorted({*range(0, 40, 4), *range(1, 12, 2)}) and chosen.columns == corpus.columns
    plan = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert sum("text#" in line for line in plan.splitlines() if "Relation" not in line and "Project" not in line) == 0 and "Sort" not in plan


def test_parts_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=20)
    assert side_by_side(spark, lambda: (both.wait(), spark.range(3).count())[1], lambda: (both.wait(), 7)[1]) == [3, 7]
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, lambda: 1 / 0, lambda: 2)
