"""The engine's queries over the stored tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalogue import query
from .functions import text as X
from .operators import batching, clustering, dedup, evaluation, filtering, jobs, lru, mood, prefix, quotes, retrieval
from .operators.models import HashEmbedder, HashProvider
from .plans import analysis, insights, preflight
from .schemas import COARSE, INTENTS, SENTIMENTS, STAGES, coarse, score, valid_sentiment
from .session import scratch
from .sources import corpus
from .streaming import streams

LABELLED = """labelled AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id AS pos, 'v' || CAST(user_id % 20 AS VARCHAR) AS video_id, ts AS timestamp,
  CASE event_type WHEN 'purchase' THEN 'strongly_positive' WHEN 'signup' THEN 'positive' WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'negative' WHEN 'error' THEN 'critical_escalation' END AS sentiment,
  least(value / 100, 1.0) AS confidence FROM events)"""
SCORED = LABELLED + """, scored AS (SELECT *, CASE sentiment WHEN 'strongly_positive' THEN 1.0 WHEN 'positive' THEN 0.5 WHEN 'neutral' THEN 0.0 WHEN 'negative' THEN -0.5 WHEN 'critical_escalation' THEN -1.0 END::DOUBLE AS score FROM labelled WHERE sentiment IS NOT NULL)"""
MOOD = SCORED + """, channel AS (SELECT avg(score) AS channel_avg, count(*) AS n FROM scored), mood AS (SELECT video_id, avg(score) AS video_avg, count(*) AS n, min(pos) AS first_pos, avg(score) - (SELECT channel_avg FROM channel) AS delta FROM scored WHERE video_id <> '' GROUP BY video_id)"""
FLAGS = LABELLED + """, flags AS (SELECT *, sentiment IN ('negative', 'critical_escalation') AS strong_negative, confidence >= 0.85 AS high_confidence FROM labelled)"""
STUB = "('0x' || substr(sha256(text), 1, 4))::BIGINT"
STUB_SENTIMENT = f"CASE {STUB} % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SENTIMENTS)) + " END"
STUB_INTENT = f"CASE {STUB} % 5 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(INTENTS)) + " END"


# ---- mood -------------------------------------------------------------------------------------


@query("sentiment_distribution", f"WITH {LABELLED}, d(ord, sentiment) AS (VALUES {', '.join(f'({k}, {chr(39)}{s}{chr(39)})' for k, s in enumerate(SENTIMENTS))}) SELECT d.ord, d.sentiment, CAST(count(l.id) AS BIGINT) AS n FROM d LEFT JOIN labelled l ON l.sentiment = d.sentiment GROUP BY d.ord, d.sentiment")
def sentiment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood.distribution(corpus.labelled_comments(spark, sf_dir))


@query("channel_average", f"WITH {MOOD} SELECT channel_avg, n FROM channel")
def channel_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood.channel_average(corpus.labelled_comments(spark, sf_dir))


@query("video_mood", f"WITH {MOOD} SELECT video_id, video_avg, n, first_pos, delta FROM mood")
def video_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood.video_mood(corpus.labelled_comments(spark, sf_dir)).select("video_id", "video_avg", "n", "first_pos", "delta")


@query("underperforming_videos", f"WITH {MOOD} SELECT m.video_id, coalesce(t.title, m.video_id) AS title, m.video_avg, m.delta FROM (SELECT * FROM mood WHERE delta < 0 ORDER BY delta, first_pos LIMIT 2) m LEFT JOIN (SELECT 'v' || CAST(n_nationkey AS VARCHAR) AS video_id, n_name AS title FROM nation) t ON t.video_id = m.video_id")
def underperforming_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = corpus.table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), F.col("n_nationkey").cast("string")).alias("video_id"), F.col("n_name").alias("title"))
    return mood.with_titles(mood.underperforming(corpus.labelled_comments(spark, sf_dir)), titles).select("video_id", "title", "video_avg", "delta")


@query("driver_sample", f"WITH {SCORED} SELECT video_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score, pos) AS rank FROM scored WHERE video_id <> '') WHERE rank <= 20")
def driver_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood.driver_sample(corpus.labelled_comments(spark, sf_dir)).select("video_id", "id", "score", "rank")


@query("mood_windows", f"WITH {SCORED} SELECT CAST(date_trunc('day', timestamp) AS VARCHAR) AS day, avg(score) AS mood, count(*) AS n FROM scored GROUP BY 1".replace("CAST(date_trunc('day', timestamp) AS VARCHAR)", "strftime(timestamp, '%Y-%m-%d')"))
def mood_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mood.mood_windows(corpus.labelled_comments(spark, sf_dir)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "mood", "n")


# ---- the stage filter -------------------------------------------------------------------------


@query("flag_comments", f"WITH {FLAGS} SELECT id, strong_negative, high_confidence, strong_negative OR high_confidence AS flagged FROM flags")
def flag_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.flags(corpus.labelled_comments(spark, sf_dir)).select("id", "strong_negative", "high_confidence", "flagged")


@query("select_for_stage_b", f"WITH {FLAGS} SELECT id, pos FROM flags WHERE strong_negative OR high_confidence")
def select_for_stage_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.select_flagged(corpus.labelled_comments(spark, sf_dir)).select("id", "pos")


DENSE = FLAGS + """, sized AS (SELECT *, pos % 700 AS cluster_id FROM flags), dense AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) >= 15 AS dense_cluster FROM sized)"""


@query("flag_comments_in_clusters", f"WITH {DENSE} SELECT id, cluster_id, strong_negative, high_confidence, dense_cluster, strong_negative OR high_confidence OR dense_cluster AS flagged FROM dense")
def flag_comments_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments with given clusters: some are flagged for their cluster's size alone."""
    labelled = corpus.labelled_comments(spark, sf_dir).withColumn("cluster_id", F.col("pos") % 700)
    return filtering.flags(labelled, dense=15).select("id", "cluster_id", "strong_negative", "high_confidence", "dense_cluster", "flagged")


@query("embed_comments", "SELECT CAST(doc_id AS VARCHAR) AS comment_id, " + ", ".join(f"('0x' || substr(sha256(coalesce(text, '')), {4 * k + 1}, 4))::BIGINT / 65536.0::DOUBLE AS x{k}" for k in range(8)) + " FROM documents")
def embed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding stage over all texts: answers come out of order and are put back by index."""
    vectors = batching.embed(corpus.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("pos"), "text"), HashEmbedder())
    return vectors.select("comment_id", *(F.get("vector", k).alias(f"x{k}") for k in range(8)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.col("label").alias("cluster_id"))


@query("dense_cluster_flags", "SELECT vec_id AS pos, label AS cluster_id, count(*) OVER (PARTITION BY label) AS cluster_size, count(*) OVER (PARTITION BY label) >= 5 AS dense_cluster FROM embeddings")
def dense_cluster_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.dense_by_size(_vectors(spark, sf_dir)).select("pos", "cluster_id", "cluster_size", "dense_cluster")


@query("cluster_sizes", "SELECT label AS cluster_id, count(*) AS mention_count, min(vec_id) AS first_pos FROM embeddings GROUP BY label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.sizes(_vectors(spark, sf_dir))


@query("top_clusters", "SELECT label AS cluster_id, count(*) AS mention_count, min(vec_id) AS first_pos FROM embeddings GROUP BY label HAVING count(*) >= 2 ORDER BY 2 DESC, 3 LIMIT 3")
def top_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.biggest(_vectors(spark, sf_dir))


CENTROIDS = "SELECT label AS cluster_id, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)"


@query("nearest_centroid", f"WITH k AS ({CENTROIDS}), d AS (SELECT e.vec_id AS pos, k.cluster_id, list_sum(list_transform(list_zip(e.embedding::DOUBLE[], k.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d FROM embeddings e, k) SELECT pos, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY round(d, 9), cluster_id) AS r FROM d) WHERE r = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _vectors(spark, sf_dir)
    centroids = points.groupBy("cluster_id").agg(F.min_by("vector", "pos").alias("centroid"))
    return clustering.nearest(points, centroids, id_col="pos", vector="vector")


@query("kmeans_partition")
def kmeans_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters within each given label, as many as the stage filter asks for."""
    return clustering.cluster_scopes(_vectors(spark, sf_dir).withColumnRenamed("cluster_id", "scope"), scope="scope", id_col="pos", vector="vector", clusters=lambda n: 1 if n < 2 else min(max(2, n // 15), 60, n))


@query("cluster_count_formulas", "SELECT n, CASE WHEN n < 2 THEN 1 ELSE least(greatest(2, n // 15), 60, n) END AS filter_k, CASE WHEN n < 2 THEN 1 ELSE greatest(1, least(3, n // 2)) END AS synthesis_k FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT -1 - vec_id, vec_id FROM embeddings)")
def cluster_count_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = clustering.sizes(_vectors(spark, sf_dir)).select(F.col("mention_count").alias("n")).unionByName(corpus.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n")))
    return sizes.select("n", X.filter_clusters(F.col("n")).alias("filter_k"), X.synthesis_clusters(F.col("n")).alias("synthesis_k"))


# ---- text -------------------------------------------------------------------------------------

SANITIZED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'),
  '\+\d{1,3}[\s\-().]*\d{2,4}(?:[\s\-().]*\d{2,4}){1,4}', '[PHONE]', 'g'),
  '(?:\(\d{2,4}\)[\s\-]?)?\d{3}[\s\-]\d{3}[\s\-]\d{4}', '[PHONE]', 'g'),
  '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
  '^\s+|\s+$', '', 'g'), '^["''“”‘’]+|["''“”‘’]+$', '', 'g'), '^\s+|\s+$', '', 'g')"""


@query("sanitize_text", f"SELECT doc_id AS pos, {SANITIZED} AS text FROM documents")
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean_urls(corpus.document_comments(spark, sf_dir).select("pos", "text")).select("pos", X.sanitize(F.col("text")).alias("text"))


_TRACKED = "(" + "|".join(X.TRACKING) + ")"


@query("clean_urls", f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^?]*', 0) AS front, list_filter(string_split(regexp_extract(url, '[?](.*)$', 1), '&'), lambda p: p <> '') AS pairs FROM pages)
SELECT page_id, CASE WHEN len(list_filter(pairs, lambda p: regexp_matches(p, '^{_TRACKED}(=|$)', 'i'))) = 0 THEN url ELSE front || CASE WHEN len(list_filter(pairs, lambda p: NOT regexp_matches(p, '^{_TRACKED}(=|$)', 'i'))) = 0 THEN '' ELSE '?' || array_to_string(list_filter(pairs, lambda p: NOT regexp_matches(p, '^{_TRACKED}(=|$)', 'i')), '&') END END AS text FROM u""")
def clean_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.clean_urls(corpus.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")))


@query("pii_counts", r"""SELECT doc_id AS pos, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS emails, len(regexp_extract_all(text, '\+\d{1,3}[\s\-().]*\d{2,4}(?:[\s\-().]*\d{2,4}){1,4}')) AS phones FROM documents""")
def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_comments(spark, sf_dir).select("pos", F.regexp_count("text", F.lit(X.EMAIL)).cast("bigint").alias("emails"), F.regexp_count("text", F.lit("(?U)" + X.PHONE_INTERNATIONAL)).cast("bigint").alias("phones"))


FINGERPRINT = r"sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')))"


@query("fingerprints", f"SELECT doc_id AS pos, {FINGERPRINT} AS fp FROM documents")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_fingerprint(corpus.document_comments(spark, sf_dir).select("pos", "text")).select("pos", "fp")


@query("escape_markdown", r"""SELECT doc_id AS pos, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([\\`*_{}\[\]()#+\-.!|~<>$])', '\\\1', 'g') AS text FROM documents""")
def escape_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.document_comments(spark, sf_dir).select("pos", X.escape_markdown(F.col("text")).alias("text"))


# A reference of each form, around each page's number.
FORMS = ["'UC' || lpad(n, 22, '0')", "'@user' || n", "'https://www.youtube.com/watch?v=' || lpad(n, 11, 'a') || '&t=5'", "'youtu.be/' || lpad(n, 11, 'b')", "'https://m.youtube.com/shorts/' || lpad(n, 11, 'c')", "'youtube.com/channel/X' || n", "'https://youtube.com/user/u' || n", "'https://youtube.com/@h' || n || '/videos'", "'https://youtube.com/c/old' || n", "'https://example.com/watch?v=' || lpad(n, 11, 'd')", "'https://youtube.com/watch?v=short' || n", "'  '"]
_REFS = "refs AS (SELECT page_id, CASE page_id % 12 " + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS)) + " END AS raw FROM (SELECT page_id, CAST(page_id AS VARCHAR) AS n FROM pages))"


@query("parse_reference", f"""WITH {_REFS} SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'channel_id' WHEN 1 THEN 'handle' WHEN 2 THEN 'video' WHEN 3 THEN 'video' WHEN 4 THEN 'video' WHEN 5 THEN 'channel_id' WHEN 6 THEN 'legacy_username' WHEN 7 THEN 'handle' WHEN 10 THEN CASE WHEN length('short' || page_id) = 11 THEN 'video' ELSE 'error' END ELSE 'error' END AS kind,
  CASE page_id % 12 WHEN 0 THEN raw WHEN 1 THEN raw WHEN 2 THEN regexp_extract(raw, 'v=([^&]*)', 1) WHEN 3 THEN substr(raw, 10) WHEN 4 THEN regexp_extract(raw, 'shorts/(.*)', 1) WHEN 5 THEN regexp_extract(raw, 'channel/(.*)', 1) WHEN 6 THEN regexp_extract(raw, 'user/(.*)', 1) WHEN 7 THEN regexp_extract(raw, '(@[^/]*)', 1) WHEN 10 THEN CASE WHEN length('short' || page_id) = 11 THEN 'short' || page_id ELSE '' END ELSE '' END AS target FROM refs""")
def parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    raw = F.expr("CASE page_id % 12 " + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS)) + " END")
    refs = corpus.table(spark, sf_dir, "pages").select("page_id", n.alias("n")).select("page_id", X.parse_reference(raw).alias("r"))
    return refs.select("page_id", "r.kind", F.coalesce("r.video_id", "r.channel_id", "r.handle", "r.legacy_username", F.lit("")).alias("target"))


@query("comment_pages", "SELECT user_id AS video, n, CAST(CASE WHEN n <= 0 THEN 0 ELSE ceil(n / 100.0) END AS BIGINT) AS pages FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def comment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = corpus.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count("*").alias("n"))
    return counts.select("video", "n", X.comment_pages(F.col("n")).alias("pages"))


@query("quota_estimate", "SELECT CAST(sum(n) AS BIGINT) AS total_comments, CAST(sum(ceil(n / 100.0)) AS BIGINT) AS pull_units, count(*) AS videos, CAST(3 + sum(ceil(n / 100.0)) AS BIGINT) AS total_units, 3 + sum(ceil(n / 100.0)) <= 10000 AS affordable FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def quota_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = comment_pages(spark, sf_dir)
    return pages.agg(F.sum("n").alias("total_comments"), F.sum("pages").alias("pull_units"), F.count("*").alias("videos")).withColumn("total_units", F.col("pull_units") + 3).withColumn("affordable", F.col("total_units") <= 10000)


@query("stage_labels", "SELECT DISTINCT user_id AS job_id, event_type AS stage, event_type AS label FROM events UNION SELECT -1, NULL, 'Starting…' UNION SELECT -2, 'stage_b', 'Classifying requests & confusion (Stage B)'")
def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage")).distinct()
    known = spark.sql("SELECT -1L AS job_id, CAST(NULL AS STRING) AS stage UNION ALL SELECT -2L, 'stage_b'")
    return own.unionByName(known).withColumn("label", X.stage_label(F.col("stage")))


# ---- duplicates -------------------------------------------------------------------------------


@query("dedup_first_seen", f"SELECT fp, min(pos) AS first_pos, count(*) AS copies FROM (SELECT doc_id AS pos, {FINGERPRINT} AS fp FROM documents) GROUP BY fp")
def dedup_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_seen(fingerprints(spark, sf_dir))


TTL = 86400


_SIGHTINGS = "s AS (SELECT event_id AS pos, CAST(user_id AS VARCHAR) || event_type AS fp, epoch_us(ts) / 1000000.0 AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)"
_FOLDED = f"""{_SIGHTINGS},
f AS (SELECT pos, fp, t, rn, TRUE AS fresh, t AS rec FROM s WHERE rn = 1
  UNION ALL SELECT s.pos, s.fp, s.t, s.rn, f.rec IS NULL OR s.t - f.rec >= {TTL}, CASE WHEN f.rec IS NULL THEN s.t WHEN s.t - f.rec < {TTL} THEN f.rec END FROM f JOIN s ON s.fp = f.fp AND s.rn = f.rn + 1)"""


@query("dedup_ttl", f"WITH RECURSIVE {_FOLDED} SELECT pos, fp, fresh FROM f")
def dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.col("user_id").cast("string"), "event_type").alias("fp"), "ts")
    return dedup.ttl(rows, key="fp", at="ts", pos="pos", seconds=TTL).select("pos", "fp", "fresh")


@query("dedup_lru")
def dedup_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with at most 200 sightings on record, the least recently met going first: one fold over all rows, which SQL can't express."""
    rows = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.concat(F.col("user_id").cast("string"), "event_type").alias("fp"), "ts")
    return lru.exact_lru(rows, fingerprint="fp", at="ts", pos="pos", seconds=TTL, capacity=200).select("pos", "fp", "fresh")


@query("stream_dedup", f"WITH RECURSIVE {_FOLDED} SELECT fp, pos, CAST(t AS DOUBLE) AS at FROM f WHERE fresh")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rule on a stream of the events, run to its end."""
    return _run_stream(spark, streams.dedup_exact(_event_stream(spark, sf_dir), seconds=TTL), "append")


@query("stream_dedup_expiring", f"""WITH RECURSIVE {_SIGHTINGS}, f AS (SELECT pos, fp, t, rn, TRUE AS fresh, t AS rec FROM s WHERE rn = 1
  UNION ALL SELECT s.pos, s.fp, s.t, s.rn, s.t - f.rec >= {TTL}, CASE WHEN s.t - f.rec < {TTL} THEN f.rec ELSE s.t END FROM f JOIN s ON s.fp = f.fp AND s.rn = f.rn + 1)
SELECT fp, pos, CAST(t AS DOUBLE) AS at FROM f WHERE fresh""")
def stream_dedup_expiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of a store with expiring keys, on a stream of the events whose state expires with them."""
    return _run_stream(spark, streams.dedup_expiring(_event_stream(spark, sf_dir), seconds=TTL), "append")


@query("stream_labels", f"WITH {SCORED}, l AS (SELECT s.*, timestamp + to_minutes(pos % 180) AS labelled_at FROM scored s) SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, avg(score) AS mood, count(*) AS n FROM l WHERE labelled_at <= timestamp + INTERVAL 2 HOUR GROUP BY 1")
def stream_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events joined with labels of them that come up to three hours later, two streams; labels after two hours don't count. Mood by day of what was joined."""
    stream = _event_stream(spark, sf_dir)
    labels = _event_stream(spark, sf_dir).select(F.col("pos").alias("comment_id"), "sentiment", (F.col("timestamp") + F.make_dt_interval(mins=(F.col("pos") % 180).cast("int"))).alias("labelled_at"))
    joined = _run_stream(spark, streams.labelled(stream.select(F.col("pos").alias("id"), "timestamp"), labels), "append")
    return joined.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.avg(score(F.col("sentiment"))).alias("mood"), F.count("*").alias("n"))


@query("stream_mood", f"WITH {SCORED} SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d') AS day, avg(score) AS mood, count(*) AS n FROM scored GROUP BY 1")
def stream_mood(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _run_stream(spark, streams.mood(_event_stream(spark, sf_dir)), "complete")
    return found.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "mood", "n")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", name).parquet(folder)
    return stream.select(F.col("event_id").alias("pos"), F.concat(F.col("user_id").cast("string"), "event_type").alias("fp"), F.col("ts").cast("timestamp").alias("timestamp"), corpus_sentiment(F.col("event_type")).alias("sentiment"))


def corpus_sentiment(event_type):
    return F.create_map(*(F.lit(x) for pair in corpus.EVENT_SENTIMENT.items() for x in pair))[event_type]


def _run_stream(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream to its end into files; of a complete result the last batch counts."""
    folder = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}")

    streams.sink_batches(stream, write, f"{folder}/checkpoint", mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/*")


# ---- threads and snippets ---------------------------------------------------------------------


@query("flatten_threads", "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, CAST(conv_id AS VARCHAR) AS video_id, role AS author_handle, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS is_reply FROM conversations")
def flatten_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.flatten_threads(corpus.threads(spark, sf_dir))


@query("snippet_records", f"SELECT CAST(doc_id AS VARCHAR) AS id, {SANITIZED} AS text, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id END AS INT) AS like_count, doc_id % 2 = 1 AS is_reply FROM documents WHERE doc_id % 5 <> 0 AND text <> ''")
def snippet_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads whose text is in either field, or in none (each fifth), become records."""
    docs = corpus.table(spark, sf_dir, "documents")
    part = F.col("doc_id") % 5
    snippet = F.struct(
        F.when(part.isin(1, 2), F.col("text")).when(part == 3, "").alias("textOriginal"), F.when(part.isin(3, 4), F.col("text")).when(part == 1, "display").alias("textDisplay"),
        F.col("source").alias("authorDisplayName"), F.struct(F.col("lang").alias("value")).alias("authorChannelId"), F.lit("2024-01-01T00:00:00Z").alias("publishedAt"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("int")).alias("likeCount"),
    )
    raw = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("v").alias("video_id"), snippet.alias("snippet"), (F.col("doc_id") % 2 == 1).alias("is_reply"))
    return corpus.from_snippets(raw).select("id", "text", "like_count", "is_reply")


# ---- batches and guards -----------------------------------------------------------------------

AT = "numbered AS (SELECT doc_id AS pos, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)"


@query("positional_batches", f"WITH {AT} SELECT pos, CAST(n - n % 50 AS VARCHAR) AS batch_key, CAST(n % 50 AS VARCHAR) AS alias FROM numbered")
def positional_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.positional(corpus.document_comments(spark, sf_dir), 50).select("pos", "batch_key", "alias")


@query("batch_payload", f"WITH {AT} SELECT CAST(n - n % 50 AS VARCHAR) AS batch_key, CAST(n % 50 AS VARCHAR) AS comment_id, text FROM numbered")
def batch_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads, parsed again."""
    sent = batching.payloads(batching.positional(corpus.document_comments(spark, sf_dir), 50))
    return sent.select("batch_key", F.explode(F.from_json("payload", "array<struct<comment_id:string,text:string>>")).alias("item")).select("batch_key", "item.comment_id", "item.text")


@query("batch_guard", f"WITH {AT}, asked AS (SELECT CAST(n - n % 50 AS VARCHAR) AS k, n % 50 AS a, pos FROM numbered), said AS (SELECT k, a, pos FROM asked WHERE pos % 97 <> 0) SELECT k AS batch_key, count(*) AS n_in, CAST(count(*) FILTER (pos % 97 <> 0) AS BIGINT) AS n_out, bool_and(pos % 97 <> 0) AS ok FROM asked GROUP BY k")
def batch_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer that lost each comment whose pos 97 divides fails its batch."""
    asked = batching.positional(corpus.document_comments(spark, sf_dir), 50)
    return batching.guard(asked, asked.filter("pos % 97 <> 0"))


@query("pending_batches", f"WITH {AT} SELECT DISTINCT CAST(n - n % 50 AS VARCHAR) AS batch_key FROM numbered WHERE ((n - n % 50) // 50) % 3 <> 0")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = batching.positional(corpus.document_comments(spark, sf_dir), 50).select("batch_key", "batch_start").distinct()
    return jobs.pending(batches.select("batch_key"), batches.filter("(batch_start div 50) % 3 = 0"))


@query("stage_a_labels", f"SELECT CAST(doc_id AS VARCHAR) AS comment_id, {STUB_SENTIMENT} AS sentiment, ({STUB} % 101) / 100.0::DOUBLE AS confidence FROM documents")
def stage_a_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.classify(corpus.document_comments(spark, sf_dir), HashProvider("sentiment"), "sentiment")


@query("stage_b_labels", f"SELECT CAST(doc_id AS VARCHAR) AS comment_id, {STUB_INTENT} AS intent, {STUB} % 7 = 0 AS is_request, {STUB} % 11 = 0 AS is_confusion FROM documents WHERE {STUB} % 5 IN (3, 4) OR ({STUB} % 101) / 100.0::DOUBLE >= 0.85")
def stage_b_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = corpus.document_comments(spark, sf_dir)
    labelled = filtering.strict_labels(comments, stage_a_labels(spark, sf_dir))
    return batching.classify(filtering.select_flagged(labelled), HashProvider("intent"), "intent")


@query("request_candidates", f"SELECT doc_id AS pos FROM documents WHERE {STUB} % 7 = 0")
def request_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = corpus.document_comments(spark, sf_dir)
    return filtering.candidates(comments, batching.classify(comments, HashProvider("intent"), "intent"), "request").select("pos")


@query("usable_comments", "SELECT doc_id AS pos FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def usable_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).select(F.col("id").alias("comment_id"))
    return filtering.usable(corpus.document_comments(spark, sf_dir), vectors).select("pos")


@query("vector_width_check", "SELECT len(embedding) AS width, count(*) AS n FROM embeddings GROUP BY 1")
def vector_width_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.vector_widths(_vectors(spark, sf_dir)).select(F.col("width").cast("bigint").alias("width"), "n")


@query("response_validity", f"WITH {LABELLED} SELECT id, sentiment IS NOT NULL AND confidence BETWEEN 0 AND 1 AS is_valid FROM labelled")
def response_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.labelled_comments(spark, sf_dir).withColumn("answer", F.to_json(F.struct(F.col("id").alias("comment_id"), "sentiment", "confidence")))
    parsed = rows.withColumn("item", F.from_json("answer", "comment_id string, sentiment string, confidence double"))
    return parsed.select("id", valid_sentiment(F.col("item")).alias("is_valid"))


# ---- jobs -------------------------------------------------------------------------------------

_STAGE_SQL = "CASE event_type WHEN 'view' THEN 'ingestion' WHEN 'click' THEN 'stage_a_sentiment' WHEN 'signup' THEN 'stage_a_embedding' WHEN 'error' THEN 'stage_b' WHEN 'purchase' THEN 'stage_c' END"
CHECKPOINTS = f"checkpoints AS (SELECT CAST(user_id AS VARCHAR) AS job_id, {_STAGE_SQL} AS stage, CAST(event_id % 7 AS VARCHAR) AS batch_key, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, ts AS completed_at, event_id AS seq FROM events)"
JOBS = "jobs AS (SELECT CAST(user_id AS VARCHAR) AS job_id, 'c' || CAST(user_id % 10 AS VARCHAR) AS channel_ref, CASE WHEN user_id % 4 = 0 THEN 'running' WHEN user_id % 4 = 1 THEN 'failed' ELSE 'completed' END AS status, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN user_id % 8 <> 0 THEN max(ts) END AS heartbeat_at, min(ts) AS created_at, count(*) AS done, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 5 <> 1 THEN 80 END AS total, user_id % 3 AS total_comment_count FROM events GROUP BY user_id)"
NOW = "2024-01-30 00:00:00"


def _checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.expr(_STAGE_SQL).alias("stage"), (F.col("event_id") % 7).cast("string").alias("batch_key"), F.when(F.col("value") < 5, "failed").otherwise("completed").alias("status"), F.col("ts").cast("timestamp").alias("completed_at"), F.col("event_id").alias("seq"))


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    ts = F.col("ts").cast("timestamp")
    rows = corpus.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(ts).alias("started_at"), F.max(ts).alias("finished_at"), F.count("*").alias("done"))
    return rows.select(
        u.cast("string").alias("job_id"), F.concat(F.lit("c"), (u % 10).cast("string")).alias("channel_ref"), F.when(u % 4 == 0, "running").when(u % 4 == 1, "failed").otherwise("completed").alias("status"), "started_at", "finished_at",
        F.when(u % 8 != 0, F.col("finished_at")).alias("heartbeat_at"), F.lit(None).cast("timestamp").alias("claimed_at"), F.col("started_at").alias("created_at"), "done", F.when(u % 5 == 0, 0).when(u % 5 != 1, 80).alias("total"), (u % 3).alias("total_comment_count"),
    )


@query("latest_checkpoints", f"WITH {CHECKPOINTS} SELECT job_id, stage, batch_key, status, seq FROM (SELECT *, row_number() OVER (PARTITION BY job_id, stage, batch_key ORDER BY completed_at DESC, seq DESC) AS r FROM checkpoints) WHERE r = 1")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checkpoints(spark, sf_dir).select("job_id", "stage", "batch_key", "seq", "status", "completed_at")
    return jobs.latest(rows, ["job_id", "stage", "batch_key"], "completed_at").select("job_id", "stage", "batch_key", "status", "seq")


@query("stage_summary", f"WITH {CHECKPOINTS} SELECT job_id, stage, epoch_us(max(completed_at)) AS last_us, count(*) AS batches FROM checkpoints WHERE status = 'completed' GROUP BY job_id, stage")
def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_summary(_checkpoints(spark, sf_dir)).select("job_id", "stage", F.unix_micros("last_at").alias("last_us"), "batches")


@query("stage_durations", f"WITH {CHECKPOINTS}, {JOBS}, s AS (SELECT job_id, stage, max(completed_at) AS last_at, list_position(['{chr(39) + chr(44) + chr(39)}'], stage) AS ord FROM checkpoints WHERE status = 'completed' GROUP BY job_id, stage) SELECT s.job_id, s.stage, greatest(0.0::DOUBLE, (epoch_us(last_at) - epoch_us(coalesce(lag(last_at) OVER (PARTITION BY s.job_id ORDER BY ord), started_at)))::DOUBLE / 1000000) AS seconds FROM s JOIN jobs USING (job_id)".replace("['" + "','" + "']", str(list(STAGES))))
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stage_durations(jobs.stage_summary(_checkpoints(spark, sf_dir)), _jobs(spark, sf_dir))


@query("latest_completed", f"WITH {JOBS} SELECT channel_ref, total_comment_count, job_id FROM (SELECT *, row_number() OVER (PARTITION BY channel_ref, total_comment_count ORDER BY created_at DESC, job_id DESC) AS r FROM jobs WHERE status = 'completed') WHERE r = 1")
def latest_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reusable(_jobs(spark, sf_dir))


@query("stale_jobs", f"WITH {JOBS} SELECT job_id FROM jobs WHERE status = 'running' AND coalesce(heartbeat_at, created_at) < TIMESTAMP '{NOW}' - INTERVAL 300 SECOND")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.stale(_jobs(spark, sf_dir), F.to_timestamp(F.lit(NOW))).select("job_id")


@query("progress_fraction", f"WITH {JOBS} SELECT job_id, CASE WHEN total > 0 THEN least(1.0::DOUBLE, done::DOUBLE / total) END AS fraction FROM jobs")
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).select("job_id", jobs.fraction(F.col("done"), F.col("total")).alias("fraction"))


@query("throughput", f"WITH {JOBS}, t AS (SELECT job_id, done, (epoch_us(finished_at) - epoch_us(started_at))::DOUBLE / 1000000 AS elapsed FROM jobs) SELECT job_id, done > 0 AND elapsed > 0 AS measured, CASE WHEN done > 0 AND elapsed > 0 THEN round(done / elapsed, 9) END AS rate FROM t")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = jobs.throughput(F.col("done"), F.col("started_at"), F.col("finished_at"))
    elapsed = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return _jobs(spark, sf_dir).select("job_id", said.isNotNull().alias("measured"), F.when(said.isNotNull(), F.round(F.col("done") / elapsed, 9)).alias("rate"))


@query("quota_admission", "SELECT pos, day, CAST(spent AS BIGINT) AS spent, spent <= 100 AS admitted FROM (SELECT event_id AS pos, strftime(ts, '%Y-%m-%d') AS day, sum(1 + event_id % 3) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS spent FROM events)")
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (1 + F.col("event_id") % 3).alias("units"))
    return jobs.admission(requests, budget=100).select("pos", "day", "spent", "admitted")


@query("quota_day", "SELECT event_id AS pos, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles', '%Y-%m-%d') AS day FROM events")
def quota_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.date_format(X.quota_day(F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("day"))


# ---- evaluation -------------------------------------------------------------------------------

PAIRS = f"""pairs AS (SELECT d.doc_id, CASE WHEN l.doc_id % 10 = 0 THEN 'mixed' WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS expected,
  CASE WHEN l.doc_id % 17 = 0 THEN NULL WHEN {STUB} % 5 IN (0, 1) THEN 'positive' WHEN {STUB} % 5 IN (3, 4) THEN 'negative' ELSE 'neutral' END AS predicted FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
  strict AS (SELECT * FROM pairs WHERE expected <> 'mixed' AND predicted IS NOT NULL)"""
_DOMAIN = "d(label) AS (VALUES ('positive'), ('negative'), ('neutral'))"
_CM = f"{PAIRS}, {_DOMAIN}, cm AS (SELECT a.label AS expected, b.label AS predicted, CAST(count(s.doc_id) AS BIGINT) AS n FROM d a CROSS JOIN d b LEFT JOIN strict s ON s.expected = a.label AND s.predicted = b.label GROUP BY 1, 2)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold moods out of the labels, predictions out of the offline provider; some mixed, some failed."""
    gold = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 10 == 0, "mixed").when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("expected_mood"), (F.col("doc_id") % 17 == 0).alias("failed"))
    comments = corpus.document_comments(spark, sf_dir).join(gold.select("id"), "id", "left_semi")
    said = batching.classify(comments, HashProvider("sentiment"), "sentiment")
    return gold.join(said, gold["id"] == said["comment_id"]).select("id", "expected_mood", F.when(~F.col("failed"), coarse(F.col("sentiment"))).alias("predicted"))


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).filter("expected_mood <> 'mixed' AND predicted IS NOT NULL").withColumnRenamed("expected_mood", "expected")


@query("confusion_matrix", f"WITH {_CM} SELECT expected, predicted, n FROM cm")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_strict(spark, sf_dir), list(COARSE))


@query("classification_report", f"WITH {_CM}, h AS (SELECT expected AS label, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN expected = predicted THEN n ELSE 0 END) AS hits FROM cm GROUP BY 1), p AS (SELECT predicted AS label, sum(n) AS said FROM cm GROUP BY 1), r AS (SELECT label, CASE WHEN said > 0 THEN hits::DOUBLE / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits::DOUBLE / support ELSE 0 END AS recall, support FROM h JOIN p USING (label)) SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1, support FROM r")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = evaluation.report(_strict(spark, sf_dir), list(COARSE))
    return per.select("label", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("accuracy_strict_lenient", f"WITH {PAIRS} SELECT count(*) AS total_cases, count(*) FILTER (predicted IS NULL) AS failed_cases, count(*) FILTER (expected = 'mixed' AND predicted IS NOT NULL) AS mixed_cases, count(*) FILTER (expected = 'mixed' AND predicted IN ('positive', 'negative')) AS mixed_covered, round((SELECT avg(CASE WHEN expected = predicted THEN 1.0 ELSE 0.0 END) FROM strict), 9) AS accuracy, round((count(*) FILTER (expected <> 'mixed' AND expected = predicted) + count(*) FILTER (expected = 'mixed' AND predicted IN ('positive', 'negative')))::DOUBLE / count(*) FILTER (predicted IS NOT NULL), 9) AS accuracy_lenient FROM pairs")
def accuracy_strict_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.accuracy(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("accuracy", "accuracy_lenient")})


# ---- quotes and the whole report --------------------------------------------------------------


@query("verbatim_quotes", "SELECT b.item_id, bool_or(d.doc_id IS NOT NULL) AS is_verbatim FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id")
def verbatim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark passages are part of some document."""
    asked = corpus.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = quotes.find(asked, corpus.document_comments(spark, sf_dir)).withColumn("found", F.lit(True))
    return asked.join(met, "quote", "left").groupBy("item_id").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("is_verbatim"))


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select(F.col("id").alias("comment_id"), "vector")


@query("insights_report")
def insights_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    comments = corpus.document_comments(spark, sf_dir)
    keep = jobs.stage_tables(spark, scratch(spark, "report"), "report")  # each comment is labelled once
    sentiments = keep(batching.classify(comments, HashProvider("sentiment"), "sentiment"), "stage_a_sentiment")
    intents = keep(batching.classify(comments, HashProvider("intent"), "intent"), "stage_b")
    return insights.report(comments, sentiments, intents, _embeddings(spark, sf_dir))


@query("analyze_corpus")
def analyze_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = jobs.stage_tables(spark, scratch(spark, "analysis"), "analysis")
    return analysis.analyze(corpus.document_comments(spark, sf_dir), _embeddings(spark, sf_dir), store=keep)


_JOBS = """j AS (SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS seq, ts AS t, CASE event_type WHEN 'signup' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status, CASE WHEN event_type = 'view' THEN event_id % 50 END AS completed_units, CASE WHEN event_type = 'click' THEN event_id % 3 END AS more_units FROM events)"""


@query("job_state", f"WITH {_JOBS}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY t, seq) AS r FROM j), s AS (SELECT job_id, arg_max(status, r) FILTER (status IS NOT NULL) AS status, coalesce(max(r) FILTER (completed_units IS NOT NULL), 0) AS set_at FROM o GROUP BY job_id) SELECT o.job_id, s.status, CAST(sum(CASE WHEN r = set_at THEN completed_units WHEN r > set_at THEN coalesce(more_units, 0) ELSE 0 END) AS BIGINT) AS completed_units FROM o JOIN s USING (job_id) GROUP BY o.job_id, s.status")
def job_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended events folded to each job's state: events stand for what a job's driver writes."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "running").when(kind == "purchase", "completed").when(kind == "error", "failed")
    log = corpus.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"), F.when(kind == "view", F.col("event_id") % 50).alias("completed_units"), F.when(kind == "click", F.col("event_id") % 3).alias("more_units"), F.lit(None).cast("boolean").alias("cancel_requested"))
    return jobs.job_state(log).select("job_id", "status", "completed_units")


# ---- channels, scans and settings -------------------------------------------------------------
# Customers stand for channels, orders for their videos, line items for comments.


@query("channel_resolve", "SELECT o.o_orderkey AS video, c.c_custkey AS channel_id, c.c_name AS title, n.videos AS video_count FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN (SELECT o_custkey, count(*) AS videos FROM orders GROUP BY o_custkey) n ON n.o_custkey = c.c_custkey")
def channel_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A video's channel: analysing a video analyses all of it."""
    videos = corpus.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), F.col("o_custkey").alias("channel_id"))
    channels = corpus.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("title"))
    counts = videos.groupBy("channel_id").agg(F.count("*").alias("video_count"))
    return videos.join(channels.join(counts, "channel_id"), "channel_id").select("video", "channel_id", "title", "video_count")


@query("newest_videos", "SELECT channel_id, video, rank FROM (SELECT o_custkey AS channel_id, o_orderkey AS video, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5")
def newest_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _newest(spark, sf_dir, 5)


def _newest(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    videos = corpus.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_id"), F.col("o_orderkey").alias("video"), "o_orderdate")
    order = Window.partitionBy("channel_id").orderBy(F.desc("o_orderdate"), F.desc("video"))
    return videos.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("channel_id", "video", "rank")


@query("scan_plan", "WITH v AS (SELECT channel_id, video, rank FROM (SELECT o_custkey AS channel_id, o_orderkey AS video, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders) WHERE rank <= 5), n AS (SELECT l_orderkey AS video, count(*) AS comments FROM lineitem GROUP BY l_orderkey) SELECT channel_id, CAST(count(*) AS BIGINT) AS videos, CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(ceil(comments / 100.0)) AS BIGINT) AS units FROM v JOIN n USING (video) WHERE comments > 0 GROUP BY channel_id")
def scan_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pulling each channel's newest videos takes: those without metadata drop out, those without comments are not read."""
    counts = corpus.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.count("*").alias("comments"))
    wanted = _newest(spark, sf_dir, 5).join(counts, "video").filter("comments > 0")
    return wanted.groupBy("channel_id").agg(F.count("*").alias("videos"), F.sum("comments").alias("comments"), F.sum(X.comment_pages(F.col("comments"))).alias("units"))


@query("channel_order", "SELECT row_number() OVER (ORDER BY user_id, event_id) - 1 AS at, event_id FROM (SELECT user_id, event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 2 = 1)")
def channel_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpointed and freshly fetched comments in one order: by video, then by place in it."""
    events = corpus.table(spark, sf_dir, "events").select("user_id", "event_id")
    both = events.filter("event_id % 2 = 0").unionByName(events.filter("event_id % 2 = 1"))
    return prefix.scan(both, ["user_id", "event_id"], number="nth").select((F.col("nth") - 1).alias("at"), "event_id")


@query("done_units", f"WITH {CHECKPOINTS} SELECT job_id, stage, count(DISTINCT batch_key) AS done FROM (SELECT *, row_number() OVER (PARTITION BY job_id, stage, batch_key ORDER BY completed_at DESC, seq DESC) AS r FROM checkpoints) WHERE r = 1 AND status = 'completed' GROUP BY job_id, stage")
def done_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_checkpoints(spark, sf_dir).filter("status = 'completed'").groupBy("job_id", "stage").agg(F.count("*").alias("done"))


@query("eval_run_json", f"WITH {_CM}, a AS (SELECT count(*) AS total_cases, count(*) FILTER (predicted IS NULL) AS failed_cases FROM pairs) SELECT total_cases, failed_cases, (SELECT CAST(sum(n) AS BIGINT) FROM cm) AS scored FROM a")
def eval_run_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation run as the JSON document that is stored, and what is read back from it."""
    pairs = _pairs(spark, sf_dir)
    cm = evaluation.confusion(_strict(spark, sf_dir), list(COARSE)).agg(F.collect_list(F.struct("expected", "predicted", "n")).alias("confusion_matrix"))
    run = evaluation.accuracy(pairs).crossJoin(cm).select(F.to_json(F.struct("*")).alias("metrics"))  # one row each
    parsed = run.select(F.from_json("metrics", "total_cases bigint, failed_cases bigint, confusion_matrix array<struct<expected:string,predicted:string,n:bigint>>").alias("m"))
    return parsed.select("m.total_cases", "m.failed_cases", F.aggregate("m.confusion_matrix", F.lit(0).cast("bigint"), lambda s, c: s + c["n"]).alias("scored"))


@query("table_checks", "SELECT 'vec_id is unique' AS name, 0::BIGINT AS violations, 'ok' AS status UNION ALL SELECT 'vec_id is there', 0, 'ok' UNION ALL SELECT 'embedding of 64', count(*) FILTER (len(embedding) <> 64), CASE WHEN count(*) FILTER (len(embedding) <> 64) = 0 THEN 'ok' ELSE 'fail' END FROM embeddings UNION ALL SELECT 'label in its domain', count(*) FILTER (label NOT BETWEEN 0 AND 9), CASE WHEN count(*) FILTER (label NOT BETWEEN 0 AND 9) = 0 THEN 'ok' ELSE 'fail' END FROM embeddings")
def table_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.table_checks(corpus.table(spark, sf_dir, "embeddings"), key="vec_id", domains={"label": list(range(10))}, width=("embedding", 64))


@query("preflight_summary", "SELECT 1::BIGINT AS failed, 1::BIGINT AS skipped, FALSE AS ready")
def preflight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def skipped():
        raise preflight.Skip("no network")

    checks = {"documents": lambda: str(corpus.table(spark, sf_dir, "documents").schema.simpleString()), "remote models": skipped, "no such table": lambda: str(corpus.table(spark, sf_dir, "no_such_table"))}
    return preflight.summary(preflight.run_checks(spark, checks))


@query("quota_refusals", "SELECT user_id AS video, 'This analysis needs an estimated ' || CAST(ceil(n / 100.0) AS BIGINT) || ' more YouTube API quota units to pull ' || n || ' comments across 1 videos, but only 0 remain today (resets at midnight Pacific Time).' AS message FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def quota_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comment_pages(spark, sf_dir).select("video", X.quota_refusal(F.col("pages"), F.col("n"), F.lit(1), F.lit(0)).alias("message"))


@query("model_vendors", "SELECT DISTINCT 'v' || CAST(user_id % 5 AS VARCHAR) AS vendor, 'v' || CAST(user_id % 5 AS VARCHAR) || '/m' AS model FROM events")
def model_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = corpus.table(spark, sf_dir, "events").select(F.concat(F.lit("openrouter/v"), (F.col("user_id") % 5).cast("string"), F.lit("/m")).alias("name")).distinct()
    return names.select(X.vendor(F.col("name")).alias("vendor"), X.bare_model(F.col("name")).alias("model"))


@query("rendered_report")
def rendered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preflight.render(insights_report(spark, sf_dir))


@query("similar_comments", "WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.query_id, e.vec_id AS pos, round(list_cosine_similarity(q.v, e.embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings e) SELECT query_id, pos, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, pos) AS r FROM s) WHERE r <= 10")
def similar_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest comments to each question, by cosine, from every list of the index."""
    points = _vectors(spark, sf_dir)
    return retrieval.search(retrieval.build(points, scratch(spark, "vectors")), points.filter("pos % 100 = 0"), k=10)


@query("similar_comments_probed")
def similar_comments_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from as many of the lists nearest to a question as a sample of questions needs for a recall of 0.92; tests hold the recall against all rows."""
    points = _vectors(spark, sf_dir)
    index, asked = retrieval.build(points, scratch(spark, "vectors")), points.filter("pos % 100 = 0")
    return retrieval.search(index, asked, k=10, probes=retrieval.probes_for(index, points, k=10))
