from pyspark.sql import functions as F

import corpus_pipeline
from earshot.llm import pii, quality
from earshot.llm.common import held_out, materialize

from .fixtures import SF, edge_frames
from .test_duplicates import brute_classes, overlap
from .test_packing import check


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    state = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        state = materialize(stage(spark, state, SF), "test-stage")
        seen[name] = state
        if name != "best-fit packing":
            assert state.columns == columns
    good = quality.train(docs, quality.labelled_sample(spark.read.parquet(f"{SF}/labels.parquet"), label_col="quality", max_rows=3000, exclude=held_out(F.col("doc_id"))))
    accepted = {r.doc_id for r in quality.score(docs, good).collect() if r.score >= 0.3}
    assert {r.doc_id for r in seen["quality classifier"].collect()} == accepted
    pairs = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in accepted]
    classes, _ = brute_classes(pairs)
    assert {r.doc_id for r in seen["n-gram Jaccard join"].collect()} == set(classes.values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in pairs if d in set(classes.values()) and not any(overlap(i, t) >= 0.8 for i in items)}
    assert {r.doc_id: r.text for r in seen["benchmark decontamination"].collect()} == left
    clean = seen["PII"].collect()
    assert {r.doc_id for r in clean} == set(left) and all(r.n_chars == len(r.text) for r in clean)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.counts(pii.find(seen["PII"])).collect()) == 0
    check(seen["PII"], seen["best-fit packing"].collect())
    run = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, run.collect())) == sorted(map(key, seen["best-fit packing"].collect()))


def test_an_empty_corpus(spark):
    state = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        state = materialize(stage(spark, state, SF), "test-stage")
    assert state.count() == 0


def test_edge_rows_pass_every_stage(spark):
    """Nulls in every column, empty and long texts, repeats, and further columns with clashing names."""
    for name, df in edge_frames(spark):
        state = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = materialize(stage(spark, state, SF), "test-stage")
            assert state.columns == df.columns
        packed = materialize(corpus_pipeline.STAGES[-1][1](spark, state, SF), "test-stage")
        assert packed.select("doc_id", "piece").count() >= state.count()
        assert (name == "empty") == (state.count() == 0)
