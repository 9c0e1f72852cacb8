"""Stages of paid calls that lose at most the calls in flight: every batch of a stage is a checkpoint.

A stage's batches are rows of (batch_key, ..); a task turns each into a result or
an error and appends it to segment files in the shared folder as it goes, every
`flush` batches. When all are through, the rows go into one table, partitioned by job and stage, and
the segments are deleted. So

* a batch that fails is a row of status ``failed`` with its error; the others of its
  stage are done and kept, and the stage ends in StageFailed;
* a task that is lost finds its own segments when Spark runs it again;
* a stage that is killed finds all segments when it is run again: what is pending
  are the batches without a completed row, and calls are made for them alone.

A segment is written under another name and then moved, so one that is there is whole.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CHECKPOINT
from ..session import scratch
from .calls import Bucket, pooled
from .jobs import latest


class StageFailed(Exception):
    """Batches of a stage failed; the others are checkpointed."""


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, given as a path or a URI, and the path in it."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return pafs.LocalFileSystem(), folder


def put(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """A whole file or none."""
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    aside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    fs.move(aside, path)


def names(fs: pafs.FileSystem, folder: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True, recursive=False))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File and not f.base_name.startswith("_"))


@dataclass(frozen=True)
class Segments:
    """Where a stage's tasks append their rows."""

    folder: str
    run: str
    flush: int

    def earlier(self, part: int) -> dict[str, dict]:
        """Rows that attempts before this one wrote for this partition of this run."""
        fs, root = file_system(self.folder)
        rows = {}
        for name in names(fs, root):
            if name.startswith(f"{self.run}-{part}-"):
                with fs.open_input_stream(f"{root}/{name}") as f:
                    rows |= {r["batch_key"]: r for r in map(json.loads, f.read().decode().splitlines())}
        return rows

    def append(self, part: int, rows: list[dict]) -> None:
        fs, root = file_system(self.folder)
        put(fs, f"{root}/{self.run}-{part}-{uuid.uuid4().hex}.json", "\n".join(map(json.dumps, rows)).encode())


@dataclass
class StageLog:
    """The checkpoints of one stage of one job, under `path`, a folder that driver and executors share."""

    spark: SparkSession
    path: str
    job_id: str
    stage: str
    flush: int = 8

    @property
    def _segments(self) -> str:
        return f"{self.path}/segments/{self.job_id}/{self.stage}"

    def _there(self, folder: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def rows(self) -> DataFrame:
        """The newest row of each batch, completed or failed, from the table and from segments that a killed run left."""
        own = self.spark.createDataFrame([], CHECKPOINT)
        if self._there(f"{self.path}/table"):
            table = self.spark.read.schema(CHECKPOINT).parquet(f"{self.path}/table")
            own = own.unionByName(table.filter((F.col("job_id") == self.job_id) & (F.col("stage") == self.stage)).select(*CHECKPOINT.names))
        if self._there(self._segments):
            own = own.unionByName(self.spark.read.schema(CHECKPOINT).json(f"{self._segments}/*.json"))
        return latest(own, ["job_id", "stage", "batch_key"], "completed_at").select(*CHECKPOINT.names)

    def completed(self) -> DataFrame:
        return self.rows().filter("status = 'completed'")

    def run(self, rows: DataFrame, key: str, by_batch: Callable[[Iterator[pd.DataFrame]], Iterator[tuple[str, object]]], work: Callable[[object], object], *, deal: Callable[[DataFrame], DataFrame], at_once: int = 8, bucket: Callable[[], Bucket] | None = None) -> DataFrame:
        """Completed checkpoint rows of all batches; calls are made for those that have none.

        rows have a column `key`; deal() brings the rows of a batch together, sorted; by_batch() gives (key, batch) from the frames
        of a partition, and work(batch) a result that JSON can state.
        """
        done = self.completed().select(F.col("batch_key").alias("_done"))
        pending = deal(rows.join(done, F.col(key).cast("string") == F.col("_done"), "left_anti"))
        job_id, stage, segments = self.job_id, self.stage, Segments(self._segments, uuid.uuid4().hex, self.flush)
        run = _in_task(job_id, stage, segments, by_batch, work, at_once, bucket)
        pending.mapInPandas(run, CHECKPOINT).write.mode("append").partitionBy("job_id", "stage").parquet(f"{self.path}/table")
        # rows of killed runs are in segments alone: they join the table before those go
        if self._there(self._segments):
            left = self.spark.read.schema(CHECKPOINT).json(f"{self._segments}/*.json")
            known = self.spark.read.schema(CHECKPOINT).parquet(f"{self.path}/table").filter((F.col("job_id") == job_id) & (F.col("stage") == stage))
            lost = left.join(known.select("batch_key", "completed_at"), ["batch_key", "completed_at"], "left_anti").select(*CHECKPOINT.names)
            lost.write.mode("append").partitionBy("job_id", "stage").parquet(f"{self.path}/table")
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._segments)
            folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        failed = self.rows().filter("status = 'failed'").select("batch_key", "error").limit(5).collect()
        if failed:
            raise StageFailed(f"{stage}: " + "; ".join(f"batch {r['batch_key']}: {r['error']}" for r in failed))
        return self.completed()


def compact(spark: SparkSession, path: str, *, files: int = 8) -> None:
    """Leaves the newest row of each batch in the checkpoint table under `path`, in `files` files a stage by hash of the key.

    The rows are written beside the table first, and each stage's folder is then replaced by them (dynamic partition overwrite), so
    what a reader finds before and after is the same; a run of a stage that goes on meanwhile would lose its newest rows, so compact between runs.
    """
    table = f"{path}/table"
    newest = latest(spark.read.schema(CHECKPOINT).parquet(table), ["job_id", "stage", "batch_key"], "completed_at").select(*CHECKPOINT.names)
    aside = scratch(spark, "compacted")
    newest.write.parquet(aside)
    dealt = spark.read.schema(CHECKPOINT).parquet(aside).repartition(files, "job_id", "stage", F.pmod(F.xxhash64("batch_key"), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "stage").parquet(table)


def _in_task(job_id: str, stage: str, segments: Segments, by_batch, work, at_once: int, bucket):
    """The task's function: frames of a partition to checkpoint rows; rows of an earlier attempt are taken as they are."""

    def row(key: str, status: str, result, error: str | None) -> dict:
        return {"job_id": job_id, "stage": stage, "batch_key": key, "status": status, "result": None if status == "failed" else json.dumps(result), "error": error, "completed_at": datetime.datetime.now(datetime.timezone.utc).isoformat()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        part = context.partitionId()
        earlier = segments.earlier(part) if context.attemptNumber() else {}

        def one(item: tuple[str, object]) -> tuple[dict, bool]:
            key, batch = item
            if key in earlier and earlier[key]["status"] == "completed":
                return earlier[key], False
            try:
                return row(key, "completed", work(batch), None), True
            except Exception as e:  # noqa: BLE001  a failed batch is a row; the others go on
                return row(key, "failed", None, str(e)[:500]), True

        fresh: list[dict] = []

        def frame(rows: list[dict]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=CHECKPOINT.names).assign(completed_at=lambda d: pd.to_datetime(d["completed_at"], utc=True))

        try:
            for done, new in pooled(by_batch(frames), one, at_once=at_once, bucket=bucket() if bucket else None):
                if new:
                    fresh.append(done)
                if len(fresh) >= segments.flush:
                    segments.append(part, fresh)
                    fresh = []
                yield frame([done])
        finally:
            if fresh:
                segments.append(part, fresh)

    return run


def results(done: DataFrame, item: T.StructType) -> DataFrame:
    """The items of completed batches, whose results are arrays of them."""
    return done.select(F.explode(F.from_json("result", T.ArrayType(item))).alias("item")).select("item.*")
