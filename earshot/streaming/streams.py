"""Streaming forms: deduplication with a time to live, and mood over time with late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dedup import fold
from ..schemas import score


def dedup_within(comments: DataFrame, *, fingerprint: str = "fp", at: str = "timestamp", ttl: str = "1 hour") -> DataFrame:
    """First sightings within a watermark of the time to live; a key that has expired is on record again with its next sighting."""
    return comments.withWatermark(at, ttl).dropDuplicatesWithinWatermark([fingerprint])


#: Keys share state by hash, in so many buckets; a call to Python is for a bucket of a micro-batch, not for a key.
BUCKETS = 4096
#: State of a bucket: its keys and the number on record for each.
RECORDS = "keys array<string>, recorded array<double>"


def _by_bucket(rows: DataFrame, key: str, run: Callable, timeout: str) -> DataFrame:
    buckets = rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")
    return buckets.applyInPandasWithState(run, f"{key} string, pos bigint, at double", RECORDS, "append", timeout)


def _records(state: GroupState) -> dict[str | None, float]:
    return dict(zip(*state.get)) if state.exists else {}


def _record(state: GroupState, held: dict[str | None, float]) -> None:
    if held:
        state.update((list(held), list(held.values())))
    elif state.exists:
        state.remove()


def _in_order(frames: Iterator[pd.DataFrame], key: str) -> pd.DataFrame:
    """(key, pos, at) of a bucket's rows of a micro-batch in order of time."""
    held = [f[[key, "pos", "at"]] for f in frames]
    return (pd.concat(held, ignore_index=True) if len(held) != 1 else held[0]).sort_values(["at", "pos"])


def dedup_exact(comments: DataFrame, *, key: str = "fp", at: str = "timestamp", seconds: float = 3600) -> DataFrame:
    """The engine's own rule (dedup.fold) on a stream: one number of state for each key.

    Its state stays: a sighting after the time to live clears a record, so the rule tells an expired record from none, for ever.
    """

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = _records(state)
        rows = _in_order(frames, key)
        fresh = np.zeros(len(rows), bool)
        for n, (k, t) in enumerate(zip(rows[key].tolist(), rows["at"].tolist())):
            recorded, fresh[n] = fold(held.get(k), t, seconds)
            if recorded is None:
                held.pop(k, None)
            else:
                held[k] = recorded
        _record(state, held)
        yield rows[fresh]

    timed = comments.select(key, "pos", F.col(at).cast("timestamp").cast("double").alias("at"))
    return _by_bucket(timed, key, run, GroupStateTimeout.NoTimeout)


def dedup_expiring(comments: DataFrame, *, key: str = "fp", at: str = "timestamp", seconds: float = 3600, late: str = "1 hour") -> DataFrame:
    """First sightings by the rule of a store whose keys expire: a sighting within the time to live of the one on record is
    a duplicate, a later one is fresh and goes on record itself.

    A record is one number of state. When the watermark, `late` behind the newest row, has passed the end of its time to live,
    a timer of its bucket removes it: what the stream holds is bounded by the keys of one time to live and the lateness. Rows behind the watermark are dropped.
    """

    def run(_, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, timed_out = _records(state), state.hasTimedOut
        if not timed_out:
            rows = _in_order(frames, key)
            fresh = np.zeros(len(rows), bool)
            for n, (k, t) in enumerate(zip(rows[key].tolist(), rows["at"].tolist())):
                recorded = held.get(k)
                if recorded is None or t - recorded >= seconds:
                    held[k], fresh[n] = t, True
        passed = state.getCurrentWatermarkMs()
        held = {k: t for k, t in held.items() if passed / 1000 - t < seconds}
        _record(state, held)
        if held:
            state.setTimeoutTimestamp(max(int((min(held.values()) + seconds) * 1000), passed + 1))
        if not timed_out:
            yield rows[fresh]

    timed = comments.withWatermark(at, late).select(key, "pos", at, F.col(at).cast("timestamp").cast("double").alias("at"))
    return _by_bucket(timed, key, run, GroupStateTimeout.EventTimeTimeout)


def labelled(comments: DataFrame, labels: DataFrame, *, id_col: str = "id", at: str = "timestamp", label_id: str = "comment_id", labelled_at: str = "labelled_at", within: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Comments with their labels, both as they come: a label counts if it was made within `within` of its comment.

    Either side is held until the watermarks of both, `late` behind their newest rows, say that no partner can come any more;
    rows behind the watermark of their own stream are dropped.
    """
    left = comments.withWatermark(at, late)
    right = labels.withWatermark(labelled_at, late)
    same = left[id_col] == right[label_id]
    timely = (F.col(labelled_at) >= F.col(at)) & (F.col(labelled_at) <= F.col(at) + F.expr(f"INTERVAL {within}"))
    return left.join(right, same & timely).drop(label_id)


def labelled_mood(comments: DataFrame, labels: DataFrame, *, width: str = "1 day", at: str = "timestamp", **how) -> DataFrame:
    """Mean score by window of the comments' time, of comments joined with labels as they come; a window is put out once it is closed."""
    joined = labelled(comments, labels, at=at, **how).withColumn("score", score(F.col("sentiment")))
    return joined.groupBy(F.window(at, width).alias("w")).agg(F.avg("score").alias("mood"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "mood", "n")


def mood(comments: DataFrame, *, late: str = "1 hour", width: str = "1 day", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Mean score by tumbling window, by one that slides, or by session (a gap without comments ends it)."""
    scored = comments.withColumn("score", score(F.col("sentiment"))).withWatermark("timestamp", late)
    if gap:  # a stream's sessions need a key beside them: here all have the same
        grouped = scored.groupBy(F.session_window("timestamp", gap).alias("w"), F.col("timestamp").isNotNull().alias("one"))
    else:
        grouped = scored.groupBy(F.window("timestamp", width, slide).alias("w"))
    return grouped.agg(F.avg("score").alias("mood"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "mood", "n")


def sink_batches(stream: DataFrame, write, checkpoint: str, mode: str = "append"):
    """Runs what is available now, handing each micro-batch to write(df, batch_id)."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
