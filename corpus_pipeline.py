"""The corpus pipeline: from raw documents to packed training sequences, one operator a stage.

Every stage takes all that the one before it kept, written to the shared folder
and read again; its decisions take effect. All but the last return the columns
of ``documents``.

Defined results, stage by stage: null and empty texts are scored like others, are
classes of their own, hold no test item and no personal data, and are packed as the end token
alone if the classifier keeps them; rows without an id and rows that share one
are told apart by their text; repeated rows and near copies leave the row of
least id, then of least text hash; very long texts are worked on whole, in bounded
parts; an empty table gives none; further columns of ``documents``, whatever
their names, are carried to the last stage, which returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import decontamination, jaccard, packing, pii, quality
from earshot.llm.common import held_out, materialize, read


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier scores under 0.3."""
    sample = quality.labelled_sample(read(spark, sf_dir, "labels"), label_col="quality", max_rows=3000, exclude=held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.train(docs, sample), threshold=0.3)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (similarity 0.8 of 5-word shingles) the document of least id stays."""
    return jaccard.keep_one(docs, threshold=0.8, recall=0.99)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Generalises personal data and removes terms that disclose it; n_chars follows."""
    return pii.sanitize(docs, length_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, seq_len=2048, end_id=0)


STAGES = [
    ("quality classifier", keep_good_documents),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", remove_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Models, candidate search and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
