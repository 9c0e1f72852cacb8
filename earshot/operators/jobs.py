"""Job state as append-only events and checkpoint tables; what is current is a query over them."""

from __future__ import annotations

import datetime
import os
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import STAGES, B, L, S, _fields
from . import prefix


def latest(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key (an upsert, read back)."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("row")).select(*keys, "row.*")


def write_checkpoints(rows: DataFrame, path: str) -> None:
    """Appends; a key that is written again replaces what was there, since reads take the latest."""
    rows.write.mode("append").partitionBy("job_id", "stage").parquet(path)


def completed(checkpoints: DataFrame, job_id: str, stage: str) -> DataFrame:
    """Completed batches of one job and stage: a pruned read."""
    own = checkpoints.filter((F.col("job_id") == job_id) & (F.col("stage") == stage))
    return latest(own, ["job_id", "stage", "batch_key"], "completed_at").filter("status = 'completed'")


def pending(batches: DataFrame, done: DataFrame) -> DataFrame:
    return batches.join(done.select("batch_key"), "batch_key", "left_anti")


def stage_summary(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter("status = 'completed'").groupBy("job_id", "stage").agg(F.max("completed_at").alias("last_at"), F.count("*").alias("batches"))


def stage_durations(summary: DataFrame, jobs: DataFrame) -> DataFrame:
    """Seconds from the stage before (that has checkpoints) to a stage's last checkpoint, never below 0."""
    order = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    timed = summary.withColumn("ord", order).filter("ord > 0").join(jobs.select("job_id", "started_at"), "job_id")
    before = F.coalesce(F.lag("last_at").over(Window.partitionBy("job_id").orderBy("ord")), F.col("started_at"))
    seconds = F.greatest(F.lit(0.0), (F.unix_micros("last_at") - F.unix_micros(before)) / 1e6)
    return timed.select("job_id", "stage", seconds.alias("seconds"))


def reusable(jobs: DataFrame) -> DataFrame:
    """The newest completed job of each channel and comment count."""
    return jobs.filter("status = 'completed'").groupBy("channel_ref", "total_comment_count").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def stale(jobs: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Running jobs that have given no sign for so long."""
    sign = F.coalesce("heartbeat_at", "claimed_at", "created_at")
    return jobs.filter((F.col("status") == "running") & (F.unix_micros(sign) < F.unix_micros(now) - seconds * 1_000_000))


def fraction(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(1.0), done / total))


def throughput(comments: Column, started: Column, finished: Column) -> Column:
    elapsed = (F.unix_micros(finished) - F.unix_micros(started)) / 1e6
    return F.when((comments > 0) & (elapsed > 0), F.format_string("Processed %d comments in %.1fs (%.1f comments/sec, end to end)", comments, elapsed, comments / elapsed))


def admission(requests: DataFrame, *, budget: int) -> DataFrame:
    """Running units by quota day in order of pos; admitted while they fit the budget. A day is spread over slices (prefix.scan)."""
    return prefix.scan(requests, ["pos"], keys=["day"], sums={"spent": "units"}).withColumn("admitted", F.col("spent") <= budget)


class Ledger:
    """Units spent today; a new day begins at zero. One for the whole process."""

    def __init__(self, budget: int, today):
        self.budget, self.today, self._day, self._spent = budget, today, None, 0

    @property
    def spent(self) -> int:
        if self._day != self.today():
            self._day, self._spent = self.today(), 0
        return self._spent

    @property
    def remaining(self) -> int:
        return self.budget - self.spent

    def require(self, units: int) -> None:
        if units > self.remaining:
            raise RuntimeError(f"{units} units needed, {self.remaining} left today")

    def charge(self, units: int) -> None:
        self._spent = self.spent + units


def content_key(channel_ref: str, fingerprints: DataFrame) -> str:
    """A job's identity by what it works on, so the same input resumes its own checkpoints."""
    row = fingerprints.agg(F.count("*"), F.bit_xor(F.xxhash64("fp")), F.sum(F.pmod(F.xxhash64("fp"), F.lit(1 << 31)))).first()
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{channel_ref}:{tuple(row)}").hex


def claim(folder: str, job_id: str) -> bool:
    """True for exactly one caller: an exclusive create in a folder that all drivers share."""
    os.makedirs(folder, exist_ok=True)
    try:
        os.close(os.open(f"{folder}/{job_id}.claim", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        return True
    except FileExistsError:
        return False


JOB_EVENT = _fields(("job_id", S, False), ("seq", L, False), ("at", T.TimestampType(), False), ("channel_ref", S, True), ("status", S, True), ("stage", S, True), ("total_units", L, True), ("completed_units", L, True), ("more_units", L, True), ("total_comment_count", L, True), ("heartbeat_at", T.TimestampType(), True), ("cancel_requested", B, True), ("error", S, True))
#: Statuses that nothing leaves again.
ENDED = ("completed", "failed", "cancelled")


def job_state(events: DataFrame) -> DataFrame:
    """A job's row as its events leave it: the last value of each field; completed_units is what was last set and what was added since.

    Insert, status, progress, counter, count, heartbeat and cancellation are all appended events; nothing is updated.
    """
    order = F.struct("at", "seq")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order))
    carried = [c for c in ("channel_ref", "status", "stage", "total_units", "completed_units", "total_comment_count", "heartbeat_at", "cancel_requested", "error") if c in events.columns]
    when_set = events.groupBy("job_id").agg(F.max(F.when(F.col("completed_units").isNotNull(), order)).alias("set_at"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), *(last(c).alias(c) for c in carried))
    more = events.filter("more_units is not null").select("job_id", order.alias("added_at"), "more_units").join(when_set.select("job_id", "set_at"), "job_id").filter(F.col("set_at").isNull() | (F.col("added_at") > F.col("set_at")))
    added = more.groupBy("job_id").agg(F.sum("more_units").alias("added"))
    done = F.coalesce("completed_units", F.lit(0)) + F.coalesce("added", F.lit(0))
    return when_set.join(added, "job_id", "left").withColumn("completed_units", done).withColumn("cancel_requested", F.coalesce("cancel_requested", F.lit(False))).drop("set_at", "added")


class JobLog:
    """Jobs as one appended table of events; its readers fold it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, job_id: str, **event) -> None:
        now = datetime.datetime.now(datetime.timezone.utc)
        row = {f.name: None for f in JOB_EVENT} | {"job_id": job_id, "seq": time.monotonic_ns(), "at": now} | event
        self.spark.createDataFrame([tuple(row.values())], JOB_EVENT).coalesce(1).write.parquet(f"{self.path}/{uuid.uuid4().hex}")  # a folder each: writers at once would share their temporary files

    def start(self, channel_ref: str) -> str:
        job_id = uuid.uuid4().hex
        self.write(job_id, channel_ref=channel_ref, status="pending")
        return job_id

    def heartbeat(self, job_id: str) -> None:
        self.write(job_id, heartbeat_at=datetime.datetime.now(datetime.timezone.utc))

    def cancel(self, job_id: str) -> None:
        self.write(job_id, cancel_requested=True)

    def states(self) -> DataFrame:
        return job_state(self.spark.read.schema(JOB_EVENT).parquet(f"{self.path}/*/*.parquet"))  # only files that were committed

    def read(self, job_id: str):
        return self.states().filter(F.col("job_id") == job_id).first()

    def reap(self, *, seconds: int = 300) -> list[str]:
        """Running jobs without a sign for so long are failed; their ids."""
        silent = stale(self.states().withColumn("claimed_at", F.lit(None).cast("timestamp")), F.current_timestamp(), seconds)
        found = [r["job_id"] for r in silent.select("job_id").collect()]  # of running jobs
        for job_id in found:
            self.write(job_id, status="failed", error="no heartbeat")
        return found

    def progress(self, job_id: str):
        """The job as it stands, once silent ones are failed."""
        self.reap()
        return self.read(job_id)


class Stopped(Exception):
    """A job was asked to end, or ran past its deadline."""


def run_job(log: JobLog, job_id: str, work, *, deadline: float = 900, beat: float = 30) -> str:
    """Runs work(check) and writes how it ended: completed, cancelled or failed; the status.

    A thread writes a heartbeat every `beat` seconds and looks for a cancellation; then, or past the deadline, it
    cancels the job's Spark work by tag, and check(), which stages call between their batches, raises Stopped.
    """
    began, over, why = time.monotonic(), threading.Event(), []
    spark = log.spark

    def check() -> None:
        if not why and time.monotonic() - began > deadline:
            why.append("failed")
        if why:
            raise Stopped(why[0])

    def watch() -> None:
        while not over.wait(beat):
            try:
                log.heartbeat(job_id)
                if log.read(job_id)["cancel_requested"]:
                    why.append("cancelled")
                elif time.monotonic() - began > deadline:
                    why.append("failed")
            except Exception:  # noqa: BLE001  a job that nobody can cancel any more is ended
                why.append("failed")
            if why:
                spark.sparkContext.cancelJobsWithTag(job_id)
                return

    log.write(job_id, status="running", heartbeat_at=datetime.datetime.now(datetime.timezone.utc))
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    spark.sparkContext.addJobTag(job_id)
    error = None
    try:
        work(check)
        status = "completed"
    except Exception as e:  # noqa: BLE001  whatever it was goes into the log
        status, error = (why[0] if why else "failed"), str(e)[:500]
    finally:
        spark.sparkContext.removeJobTag(job_id)
        over.set()
        watcher.join()
    log.write(job_id, status=status, error=error if status == "failed" else None)
    return status


def run_in_background(log: JobLog, job_id: str, work, **limits) -> threading.Thread:
    thread = threading.Thread(target=run_job, args=(log, job_id, work), kwargs=limits, daemon=True)
    thread.start()
    return thread


def stage_tables(spark: SparkSession, path: str, job_id: str, *, timings: dict[str, float] | None = None, check=lambda: None):
    """keep(df, name): the stage's rows, computed and written once for the job, and read from then on.

    df may be a function that makes the frame, so nothing of a stage that was written whole is planned or run again.
    keep.log(name) is the log of a stage's batches (checkpoints.StageLog): a stage that died within is taken up where it stood.
    timings gets the seconds that each stage took.
    """
    from .checkpoints import StageLog

    def keep(df, name: str) -> DataFrame:
        check()
        table, began = f"{path}/{job_id}/{name}", time.monotonic()
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
        if not file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file):
            (df() if callable(df) else df).write.mode("overwrite").parquet(table)
        if timings is not None:
            timings[name] = time.monotonic() - began
        return spark.read.parquet(table)

    keep.log = lambda stage: StageLog(spark, f"{path}/{job_id}/batches", job_id, stage)
    return keep


def run_stage(spark: SparkSession, *, path: str, job_id: str, stage: str, batches: DataFrame, work) -> DataFrame:
    """Checkpointed stage: skips completed batches, runs the rest through work(batches) -> checkpoint rows, returns all."""
    try:
        known = spark.read.parquet(path)
        done = completed(known, job_id, stage)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = None
    rest = pending(batches, done) if done is not None else batches
    write_checkpoints(work(rest), path)
    return completed(spark.read.parquet(path), job_id, stage)
