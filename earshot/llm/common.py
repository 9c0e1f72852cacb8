"""Shared pieces of the corpus operators: where intermediate tables go, and how texts are read.

Intermediate tables are Parquet files in the folder that the session names in
``spark.checkpoint.dir``: every executor sees them, and a lost executor costs a
re-read, not a re-computation. Only a local session without that setting gets a
folder of its own.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def workspace(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="earshot-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/earshot"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df to the shared folder and returns a scan of it: cuts the lineage and freezes the rows."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote, once no plan reads it any more."""
    spark = df.sparkSession
    root = workspace(spark)
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/earshot/" in folder and root.rsplit(":", 1)[-1] in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn labels from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 4 << 20) -> None:
    """Python workers get texts in batches of at most so many rows and about so many bytes: a batch is what they hold at once.

    Lowers two Arrow settings of the session, and never raises them. They are read when a plan runs, so they stay lowered.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def lean(run, *caches):
    """run, a function over Arrow batches, after which the worker empties the caches and gives memory back: it lives on
    beside the workers of later stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.cache_clear()
            trim()

    return wrapped


#: Rows of 8-byte ids that may be broadcast, once counted: a few MB.
BROADCAST_ROWS = 200_000


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str = "left_semi") -> DataFrame:
    """docs whose id is (left_semi) or isn't (left_anti) among the one column of ids, a written table; nulls are equal.

    The ids are broadcast if a count shows that they are few; else both sides are shuffled.
    """
    name = ids.columns[0]
    side = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    return docs.join(side, docs[id_col].eqNullSafe(ids[name]), how)


def one_of_each(table: DataFrame, key: str) -> DataFrame:
    """A written table with one row of each key. Its wide rows are shuffled only if a count of the keys finds repeats."""
    rows, keys = table.agg(F.count("*"), F.count_distinct(key)).first()
    return table if rows == keys else table.dropDuplicates([key])
