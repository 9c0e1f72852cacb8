"""The whole analysis of a corpus: clean, deduplicate, label, filter, synthesise, with a table at each model stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import batching, clustering, dedup, filtering
from ..operators.models import HashEmbedder, HashProvider, offline_synthesis
from ..session import scratch, side_by_side
from . import insights


def prepare(comments: DataFrame) -> DataFrame:
    """Cleaned texts, the first sighting of each.

    They are written once: as a plan, every filter and branch behind the cleaning would clean all texts again. They are
    dealt out first, as a file of texts may be one task; fingerprints are worked out for the choice of rows alone.
    """
    spark = comments.sparkSession
    dealt = comments.filter("text <> ''").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pos")
    cleaned = X.clean_urls(dealt).withColumn("text", X.sanitize(F.col("text")))
    path = scratch(spark, "cleaned")
    cleaned.write.parquet(path)
    held = spark.read.schema(cleaned.schema).parquet(path).filter("text <> ''")
    firsts = dedup.first_seen(X.with_fingerprint(held).select("pos", "fp")).select(F.col("first_pos").alias("pos"))
    return held.join(firsts, "pos", "left_semi").select(*comments.columns)


def clusters_of(comments: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(id, cluster_id) of the comments that have an embedding, as many clusters as the stage filter asks for."""
    own = comments.join(embeddings, comments["id"] == embeddings["comment_id"]).select("id", "vector")
    return clustering.cluster_all(own, id_col="id", vector="vector", clusters=lambda n: 1 if n < 2 else min(max(2, n // 15), 60, n))


def flagged(corpus: DataFrame, sentiments: DataFrame, clusters: DataFrame) -> DataFrame:
    """The comments that pass the stage filter, chosen by id: their texts are shuffled once."""
    labelled = filtering.strict_labels(corpus.select("id", "pos"), sentiments).join(clusters, "id", "left")
    return corpus.join(filtering.flags(labelled).filter("flagged").select("id"), "id", "left_semi").select(*corpus.columns)


def analyze(comments: DataFrame, embeddings: DataFrame | None = None, *, sentiment=None, intent=None, embedder=None, titles: DataFrame | None = None, write=offline_synthesis, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The report of a corpus. store(df, name), as jobs.stage_tables() makes it, writes a stage once, so that no model call is made twice.

    A store with a log (jobs.stage_tables() has one) checkpoints every batch of the model stages as well.
    Without given embeddings there is a stage that makes them. Comments of dense clusters pass the filter whatever their sentiment.
    """
    log = getattr(store, "log", lambda stage: None)
    spark = comments.sparkSession
    corpus = store(lambda: prepare(comments), "ingestion")
    if embeddings is None:
        embeddings = store(lambda: batching.embed(corpus, embedder or HashEmbedder(), log=log("stage_a_embedding")), "stage_a_embedding")
        batching.one_width(embeddings)
    # passes of clustering leave cores idle; stages with a log take turns, as they append to one table
    sentiments, clusters = side_by_side(
        spark,
        lambda: store(lambda: batching.classify(corpus, sentiment or HashProvider("sentiment"), "sentiment", log=log("stage_a_sentiment")), "stage_a_sentiment"),
        lambda: store(lambda: clusters_of(corpus, embeddings), "clusters"),
    )
    chosen = store(lambda: flagged(corpus, sentiments, clusters), "flagged")
    intents = store(lambda: batching.classify(chosen, intent or HashProvider("intent"), "intent", log=log("stage_b")), "stage_b")
    return store(lambda: insights.report(corpus, sentiments, intents, embeddings, titles=titles, write=write), "stage_c")
