"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, cross_entropy, decontamination, jaccard, language, oracles, packing, pii, quality, resampling, rules, substrings, toxicity
from .common import held_out, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


@query("op1_attention_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.train(docs, quality.labelled_sample(labels, label_col="quality", max_rows=3000, exclude=held_out(F.col("doc_id"))))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_benchmark_leaks", oracles.LEAKS)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("score", F.round("score", 6))


@query("op3_compact_windows")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(read(spark, sf_dir, "documents"), min_words=50, threshold=0.8)


@query("op4_toxic_segments")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, quality.labelled_sample(labels, label_col="toxic", max_rows=20000, exclude=held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments")


@query("op5_cross_entropy_difference", oracles.LOSSES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    scored = cross_entropy.score(cross_entropy.flag_target(read(spark, sf_dir, "documents"), good))
    return scored.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")))


@query("op6_disclosure", oracles.DISCLOSURE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find(read(spark, sf_dir, "documents")))


@query("op7_rule_votes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op8_chosen_path_join", oracles.CLASSES)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(read(spark, sf_dir, "documents"), threshold=0.8, recall=0.99)


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), seq_len=2048, end_id=0)


@query("op10_chat_formatting", oracles.CHATS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = spark.sql(r"SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.format_turns(rows.unionByName(same)))


@query("op11_importance_resampling", oracles.DRAWN)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = resampling.weigh(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), max_n=1, n_buckets=10_000)
    return resampling.draw(weighed, percent=10, min_words=20, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_vector_codes", oracles.CODES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(read(spark, sf_dir, "embeddings"), n_parts=8, n_entries=16, rounds=6, scale=4096)
    spelt = "" if books is None else codes.digest(books)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(spelt).alias("codebooks_sha256"))


@query("op13_word_backoff_language")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read(spark, sf_dir, "documents"), language.held_out(F.col("doc_id"))
    predicted = language.predict(docs, language.train(docs, exclude=fold))
    return predicted.select("doc_id", fold.alias("held_out"), "lang_pred", "score")
