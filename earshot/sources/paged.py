"""A batch data source over paged comment services: one partition for each video.

``client`` is a picklable factory of objects with ``page(video_id, token) ->
(threads, next_token)``; a refusal (``Forbidden``) of the first page means that
comments are off, later ones are errors. Transient failures are retried here,
with growing pauses: a task retry would spend the pages again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, video_id string, text string, author_handle string, published_at string, like_count int, is_reply boolean, pos bigint"


class Forbidden(Exception):
    pass


class Transient(Exception):
    pass


#: Statuses of an answer worth asking again for.
PASSING = (429, 500, 502, 503, 504)


def check_status(status: int, message: str = "") -> None:
    """Raises what an HTTP answer that isn't fine means to the reader; a client calls it on each answer."""
    if 200 <= status < 300:
        return
    if status in PASSING:
        raise Transient(f"{status}: {message}")
    if status == 403:
        raise Forbidden(message)
    raise RuntimeError(f"{status}: {message}")


def with_retry(call: Callable, *, attempts: int = 4, pause: float = 0.5, longest: float = 8.0):
    for attempt in range(attempts):
        try:
            return call()
        except Transient:
            if attempt + 1 == attempts:
                raise
            time.sleep(min(longest, pause * 2**attempt))


class _Video(InputPartition):
    def __init__(self, number: int, video_id: str):
        self.number, self.video_id = number, video_id


def rows_of(threads: list[dict], video_id: str) -> Iterator[tuple]:
    """The comments of a page of threads that have a text: all columns but pos."""
    for thread in threads:
        for k, c in enumerate([thread["top"], *thread.get("replies", [])]):
            text = c.get("textOriginal") or c.get("textDisplay")
            if text:
                yield c["id"], video_id, text, c.get("author"), c.get("publishedAt"), int(c.get("likeCount", 0)), k > 0


def read_video(client, video_id: str) -> Iterator[tuple]:
    token, first, pos = None, True, 0
    while first or token:
        try:
            threads, token = with_retry(lambda: client.page(video_id, token))  # noqa: B023
        except Forbidden:
            if first:
                return
            raise
        first = False
        for row in rows_of(threads, video_id):
            yield (*row, pos)
            pos += 1


def comments(spark: SparkSession, client: Callable[[], object], videos: list[tuple[str, int]]) -> DataFrame:
    """Comments of the videos (id, comment count), those without comments left out, in the order given."""
    wanted = [v for v, n in videos if n > 0]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "earshot_comments"

        def schema(self):
            return SCHEMA

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader()

    class Reader(DataSourceReader):
        def partitions(self):
            return [_Video(n, v) for n, v in enumerate(wanted)] or [_Video(-1, "")]

        def read(self, partition):
            if partition.number < 0:
                return
            for row in read_video(client(), partition.video_id):
                yield (*row[:-1], (partition.number << 32) + row[-1])

    spark.dataSource.register(Source)
    return spark.read.format("earshot_comments").load()
