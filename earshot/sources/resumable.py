"""Resumable ingestion: paged comment services as a stream whose offsets are videos and whose pages are paid for once.

An offset says how many videos of the list have been read; a micro-batch takes
the next ``videos_per_batch`` of them, dealt to ``partitions`` tasks, each with
several videos in flight. A page that came is written to the page store, a folder that driver and
executors share, with the token of the next one before its rows go on. A task
that is run again, after a lost executor or a killed query, finds the pages
it had, and asks from the first one on that isn't there: the token that the
store holds. When Spark has committed a batch, its pages are deleted.

Rows carry ``pos`` = (video's number << 32) + place, so the order of the channel
is that of ``pos``, whatever came first.

Defined results: videos without comments and those whose comments are off give
no row; a video that is listed twice is read twice; an empty list gives none; a list that isn't the one
which the store was begun with is an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.calls import Bucket, pooled
from ..operators.checkpoints import file_system, names, put
from .paged import SCHEMA, Forbidden, rows_of, with_retry


class PageStore:
    def __init__(self, folder: str):
        self.fs, self.root = file_system(folder)

    def page(self, video: int, number: int) -> tuple[list, str | None] | None:
        path = f"{self.root}/v-{video}/{number}.json"
        if not self.fs.get_file_info(path).is_file:
            return None
        with self.fs.open_input_stream(path) as f:
            held = json.loads(f.read())
        return held["rows"], held["next"]

    def keep(self, video: int, number: int, rows: list, token: str | None) -> None:
        put(self.fs, f"{self.root}/v-{video}/{number}.json", json.dumps({"rows": rows, "next": token}).encode())

    def forget(self, videos: range) -> None:
        for video in videos:
            if self.fs.get_file_info(f"{self.root}/v-{video}").type.name == "Directory":
                self.fs.delete_dir(f"{self.root}/v-{video}")

    def begin(self, digest: str) -> None:
        """Ties the store to a list of videos."""
        known = names(self.fs, f"{self.root}/list")
        if not known:
            put(self.fs, f"{self.root}/list/{digest}", b"")
        elif known != [digest]:
            raise ValueError("the page store was begun with another list of videos")

    def plan(self, upto: int) -> None:
        put(self.fs, f"{self.root}/planned/{upto}", b"")

    def planned(self) -> int:
        return max(map(int, names(self.fs, f"{self.root}/planned")), default=0)


def read_video(client, store: PageStore, number: int, video_id: str, before: Callable[[], None] = lambda: None) -> Iterator[list[tuple]]:
    """A video's rows, page by page: those in the store as they are, the others asked for and stored first."""
    token, page, pos = None, 0, 0
    while page == 0 or token:
        held = store.page(number, page)
        if held is None:
            try:
                before()
                threads, after = with_retry(lambda: client.page(video_id, token))  # noqa: B023
                rows = [list(r) for r in rows_of(threads, video_id)]
            except Forbidden:
                if page:
                    raise
                rows, after = [], None  # comments are off
            store.keep(number, page, rows, after)
            held = rows, after
        rows, token = held
        yield [(*r, (number << 32) + pos + k) for k, r in enumerate(rows)]
        pos, page = pos + len(rows), page + 1


class _Videos(InputPartition):
    def __init__(self, videos: list[tuple[int, str]]):
        self.videos = videos


def stream(spark: SparkSession, client: Callable[[], object], videos: list[tuple[str, int]], store: str, *, videos_per_batch: int = 1000, partitions: int = 64, at_once: int = 8, per_second: float | None = None) -> DataFrame:
    """The comments of the videos (id, comment count) as a streaming frame of the columns of paged.SCHEMA.

    client is a picklable factory of objects with page(video_id, token) -> (threads, next token).
    """
    digest = hashlib.sha256(json.dumps(videos).encode()).hexdigest()

    class Reader(DataSourceStreamReader):
        def __init__(self):
            self.pages = PageStore(store)
            self.pages.begin(digest)

        def initialOffset(self):
            return {"videos": 0}

        def latestOffset(self):
            return {"videos": min(len(videos), self.pages.planned() + videos_per_batch)}

        def partitions(self, start, end):
            own = [(k, v) for k, (v, n) in enumerate(videos[start["videos"] : end["videos"]], start["videos"]) if n > 0]
            self.pages.plan(end["videos"])
            return [_Videos(own[p::partitions]) for p in range(min(partitions, len(own)))]

        def read(self, partition):
            pages, service = PageStore(store), client()
            before = Bucket(per_second).take if per_second else lambda: None

            def whole(video: tuple[int, str]) -> tuple[int, str]:
                for _ in read_video(service, pages, *video, before):
                    pass
                return video

            for number, video_id in pooled(partition.videos, whole, at_once=at_once):
                for rows in read_video(service, pages, number, video_id):  # from the store, page by page
                    yield from rows

        def commit(self, end):
            before = int(end["videos"])
            self.pages.forget(range(max(0, before - videos_per_batch), before))

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "earshot_pages"

        def schema(self):
            return SCHEMA

        def streamReader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
    return spark.readStream.format("earshot_pages").load()


def ingest(spark: SparkSession, client: Callable[[], object], videos: list[tuple[str, int]], folder: str, *, ledger=None, page_size: int = 100, **how) -> DataFrame:
    """Reads all videos into a table under `folder`, and returns it; called again after a failure it goes on where that left off.

    With a ledger, a channel whose pages would cost more units than are left is refused before any page is asked for.
    """
    target = f"{folder}/comments"
    store = PageStore(f"{folder}/pages")
    size = how.get("videos_per_batch", 1000)
    if ledger is not None:
        ledger.require(sum(-(-n // page_size) for _, n in videos[max(0, store.planned() - size) :] if n > 0))
    for _ in range(-(-len(videos) // size) + 1):
        began = store.planned()
        query = stream(spark, client, videos, f"{folder}/pages", **how).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
        query.awaitTermination()
        if began >= len(videos):
            break
    return spark.read.schema(SCHEMA).parquet(target) if videos else spark.createDataFrame([], SCHEMA)
