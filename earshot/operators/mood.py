"""Sentiment aggregates by channel and video."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SENTIMENTS, score


def scored(comments: DataFrame) -> DataFrame:
    return comments.filter(F.col("sentiment").isNotNull()).withColumn("score", score(F.col("sentiment")))


def distribution(labels: DataFrame) -> DataFrame:
    """Counts over the whole label domain, zeros included."""
    domain = labels.sparkSession.createDataFrame([(s, i) for i, s in enumerate(SENTIMENTS)], "sentiment string, ord int")
    counts = labels.filter("sentiment <> ''").groupBy("sentiment").agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "sentiment", "left").select("ord", "sentiment", F.coalesce("n", F.lit(0)).alias("n"))


def channel_average(comments: DataFrame) -> DataFrame:
    """Mean score over distinct comment ids, whether or not they name a video."""
    return scored(comments).groupBy("id").agg(F.max_by("score", "pos").alias("score")).agg(F.avg("score").alias("channel_avg"), F.count("*").alias("n"))


def video_mood(comments: DataFrame) -> DataFrame:
    """Mean score of each named video, and its distance from the channel's."""
    by_video = scored(comments).filter("video_id <> ''").groupBy("video_id").agg(F.avg("score").alias("video_avg"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    return by_video.crossJoin(F.broadcast(channel_average(comments).select("channel_avg"))).withColumn("delta", F.col("video_avg") - F.col("channel_avg"))  # one row


def underperforming(comments: DataFrame, *, most: int = 2) -> DataFrame:
    return video_mood(comments).filter("delta < 0").orderBy("delta", "first_pos").limit(most)


def with_titles(stats: DataFrame, titles: DataFrame) -> DataFrame:
    """A video without a title goes by its id."""
    return stats.join(titles.select("video_id", "title"), "video_id", "left").withColumn("title", F.coalesce("title", "video_id"))


def driver_sample(comments: DataFrame, *, most: int = 20) -> DataFrame:
    """The lowest-scoring comments of each video, in comment order among equals."""
    order = Window.partitionBy("video_id").orderBy("score", "pos")
    return scored(comments).filter("video_id <> ''").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mood_windows(comments: DataFrame, width: str = "1 day") -> DataFrame:
    return scored(comments).groupBy(F.window("timestamp", width).alias("w")).agg(F.avg("score").alias("mood"), F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "mood", "n")
