"""Best-fit packing of tokenised documents into sequences of bounded length, in bulk-synchronous supersteps.

Pieces are range-sorted by length, descending, and ranked. They are placed by
classes of length, (1024, 2048], (512, 1024] and so on, and a superstep

* range-sorts the unplaced pieces of a class and the gaps that can hold one, by
  size, into tasks of about ``rows_per_task`` rows;
* lets every task sweep its range downwards: each piece takes the successor of
  its length, the smallest gap of the task that holds it, and the gap shrinks;
* resolves what is left across tasks by rank: the k-th piece that found no gap
  takes the k-th place in the gaps left over by tasks of larger sizes, nearest
  sizes first (a gap has as many places as pieces of its task's least size fit);
* writes placements and updated gaps, and repeats, until no gap holds a piece
  that is left; those open new sequences, filled in order of rank.

The driver sees counts by task, never rows. Over one task the result is that
of best-fit decreasing.

Defined results: a null text is an empty one, which is the end token alone; a
null doc_id keeps its row; repeated rows are packed once each; ties in length go
by doc_id and piece; a long text is cut into pieces, whatever their number; an
empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import drop_table, lean, materialize, shuffle_width, small_batches

SLICE = 512


def tokenize_pieces(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on request."""
    path = tokenizer or tokens.default_path()
    fields = [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    id_type = docs.schema[id_col].dataType
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.load(path).encode_to_numpy
        end = np.array([end_id], dtype="<u4")
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                part = whole.slice(at, SLICE)
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    own = np.concatenate([encode(text).astype("<u4", copy=False), end])
                    count = -(-len(own) // seq_len)
                    edges = [0, *(len(own) - seq_len * k for k in range(count - 1, -1, -1))]
                    for k in range(count):
                        span = own[edges[k] : edges[k + 1]]
                        owner.append(row)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(len(span))
                        crc.append(zlib.crc32(span.tobytes()))
                        if with_ids:
                            ids.append(span.astype(np.int32))
                columns = [part.column("doc_id").take(pa.array(owner, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f.name for f in fields)])

    return source.mapInArrow(lean(cut, tokens.load), T.StructType([T.StructField("doc_id", id_type), *fields]))


class Gaps:
    """Sequences by their free room."""

    def __init__(self) -> None:
        self.held: dict[int, list[int]] = {}  # gap -> sequences
        self.order: list[int] = []  # the gaps that have sequences, ascending

    def put(self, gap: int, sequence: int) -> None:
        if gap:
            if gap not in self.held:
                self.held[gap] = []
                bisect.insort(self.order, gap)
            self.held[gap].append(sequence)

    def take(self, length: int) -> tuple[int, int] | None:
        """The successor of length: (gap, a sequence of it)."""
        k = bisect.bisect_left(self.order, length)
        if k == len(self.order):
            return None
        gap = self.order[k]
        sequence = self.held[gap].pop()
        if not self.held[gap]:
            del self.held[gap], self.order[k]
        return gap, sequence


GAP, LEFT, PLACED = 0, 1, 2
#: id: sequence of a GAP, rank else; n: first place of a GAP, number in its task of a LEFT; places: of a GAP.
SWEPT = "part int, kind int, id long, size long, sequence_id long, offset long, n long, places long"


def sweep(pieces: DataFrame, gaps: DataFrame, *, parts: int, step: int, most: int, opens: bool, seq_len: int) -> DataFrame:
    """One sweep of (id, size) pieces over (id, size) gaps; most: the largest piece of the class. opens: a piece without a gap opens a sequence."""
    events = gaps.withColumn("kind", F.lit(GAP)).unionByName(pieces.withColumn("kind", F.lit(LEFT)))
    order = [F.col("size").desc(), F.col("kind"), F.col("id")]
    names = [f.split()[0] for f in SWEPT.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 6]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        state, opened, missed, least = Gaps(), step << 56 | part << 32, 0, most
        for batch in batches:
            rows = []
            for size, kind, key in zip(*(batch.column(c).to_pylist() for c in ("size", "kind", "id"))):
                least = min(least, size)
                if kind == GAP:
                    state.put(size, key)
                    continue
                found = state.take(size)
                if found is None and opens:
                    found = seq_len, opened
                    opened += 1
                if found is None:
                    rows.append((part, LEFT, key, size, None, None, missed, None))
                    missed += 1
                else:
                    gap, sequence = found
                    rows.append((part, PLACED, key, size, sequence, seq_len - gap, None, None))
                    state.put(gap - size, sequence)
            if rows:
                yield table(rows)
        first = 0
        for gap in state.order:
            at, rows = 0, state.held[gap]
            for at in range(0, len(rows), SLICE):
                some = []
                for sequence in rows[at : at + SLICE]:
                    some.append((part, GAP, sequence, gap, None, None, first, gap // least))
                    first += gap // least
                yield table(some)

    return events.select("size", "kind", "id").repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lean(run), SWEPT)


def pair_tasks(missed: dict[int, int], places: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Runs (part, first piece, end, other part, its first place): what a task missed goes to the places of tasks before it, the nearest first."""
    runs, free = [], []  # free: (part, next place, end), the nearest last
    for part in sorted(missed.keys() | places.keys()):
        done, wanted = 0, missed.get(part, 0)
        while done < wanted and free:
            other, at, end = free.pop()
            n = min(end - at, wanted - done)
            runs.append((part, done, done + n, other, at))
            done += n
            if at + n < end:
                free.append((other, at + n, end))
        if places.get(part):
            free.append((part, 0, places[part]))
    return runs


def hand_over(swept: DataFrame, runs: list[tuple[int, int, int, int, int]], *, seq_len: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolves the runs: (placements, gaps, pieces still left), the first two written."""
    spark = swept.sparkSession
    used: dict[int, int] = {}
    covered: dict[int, int] = {}
    for part, _, end, other, at in runs:
        covered[part] = max(covered.get(part, 0), end)
    for part, first, end, other, at in runs:
        used[other] = max(used.get(other, 0), at + end - first)
    # one to a few rows a task
    table = F.broadcast(spark.createDataFrame(runs, "part int, first long, end long, other int, at long"))
    taken = F.broadcast(spark.createDataFrame(list(used.items()), "part int, used long"))
    done = F.broadcast(spark.createDataFrame(list(covered.items()), "part int, covered long"))
    left = swept.filter(F.col("kind") == LEFT)
    wanted = left.join(table, "part").filter("n >= first AND n < end").select("id", "size", F.col("other").alias("part"), (F.col("at") + F.col("n") - F.col("first")).alias("place"))
    gaps = swept.filter(F.col("kind") == GAP)
    offered = gaps.filter("places > 0").join(taken, "part").filter("n < used").select("part", F.col("id").alias("sequence_id"), F.col("size").alias("gap"), F.explode(F.sequence("n", F.least(F.expr("n + places"), "used") - 1)).alias("place"))
    within = Window.partitionBy("sequence_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # seq_len rows at most
    placed = materialize(wanted.join(offered, ["part", "place"]).select("id", "size", "sequence_id", (F.lit(seq_len) - F.col("gap") + F.sum("size").over(within) - F.col("size")).alias("offset")), "pack-handed")
    filled = placed.groupBy(F.col("sequence_id").alias("id")).agg(F.sum("size").alias("filled"))
    rest = materialize(gaps.select("id", "size").join(filled, "id", "left").select("id", (F.col("size") - F.coalesce("filled", F.lit(0))).alias("size")).filter("size > 0"), "pack-gaps")
    return placed, rest, left.join(done, "part", "left").filter("covered IS NULL OR n >= covered").select("id", "size")


def classes(seq_len: int) -> list[tuple[int, int]]:
    """Length classes (above, up to), each half of the one before."""
    found, high = [], seq_len
    while high:
        found.append((high // 2, high))
        high //= 2
    return found


def pack(pieces: DataFrame, *, seq_len: int = 2048, rows_per_task: int = 200_000) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (frozen: a re-run must give the same rows)."""
    spark = pieces.sparkSession
    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece")]
    ranked = materialize(pieces.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).withColumn("rank", F.monotonically_increasing_id()), "pack-ranked")
    sizes = ranked.agg(*(F.count_if((F.col("length") > low) & (F.col("length") <= high)).alias(str(high)) for low, high in classes(seq_len))).first()
    none = spark.sql("SELECT 0L AS id, 0L AS size WHERE false")
    placements = [spark.sql("SELECT 0L AS id, 0L AS sequence_id, 0L AS offset WHERE false")]
    open_gaps: list[tuple[DataFrame, int]] = []  # written tables of (id, size), each with the largest gap that is still as it says
    step = 0
    for low, high in classes(seq_len):
        left, stuck = sizes[str(high)], False
        todo = ranked.filter((F.col("length") > low) & (F.col("length") <= high)).select(F.col("rank").alias("id"), F.col("length").alias("size"))
        while left:
            usable = none
            if not stuck:
                for table, largest in open_gaps:
                    if largest > low:
                        usable = usable.unionByName(table.filter((F.col("size") > low) & (F.col("size") <= largest)))
            parts = -(-(left + usable.count()) // rows_per_task)
            opens = stuck or parts == 1
            swept = materialize(sweep(todo, usable, parts=parts, step=step, most=high, opens=opens, seq_len=seq_len), "pack-swept")
            step += 1
            if not stuck:
                open_gaps = [(table, min(largest, low)) for table, largest in open_gaps]
            placements.append(swept.filter(F.col("kind") == PLACED).select("id", "sequence_id", "offset"))
            gaps = swept.filter(F.col("kind") == GAP).select("id", "size")
            if opens:
                open_gaps.append((gaps, seq_len))
                break
            counted = swept.filter(F.col("kind") != PLACED).groupBy("part", "kind").agg(F.count("*").alias("rows"), F.sum("places").alias("places")).collect()  # two rows a task
            missed = {r["part"]: r["rows"] for r in counted if r["kind"] == LEFT}
            runs = pair_tasks(missed, {r["part"]: r["places"] for r in counted if r["kind"] == GAP})
            left = sum(missed.values())
            todo, stuck = swept.filter(F.col("kind") == LEFT).select("id", "size"), not runs
            if runs:
                placed, gaps, todo = hand_over(swept, runs, seq_len=seq_len)
                placements.append(placed.select("id", "sequence_id", "offset"))
                left -= sum(end - first for _, first, end, _, _ in runs)
            open_gaps.append((gaps, seq_len))
    placed = functools.reduce(DataFrame.unionByName, placements)
    return ranked.join(placed, ranked["rank"] == placed["id"]).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, seq_len: int = 2048, **tokenizing) -> DataFrame:
    pieces = materialize(tokenize_pieces(docs, seq_len=seq_len, **tokenizing), "pack-pieces")
    packed = pack(pieces, seq_len=seq_len)
    drop_table(pieces)
    return packed


def assemble(packed: DataFrame) -> DataFrame:
    """Whole sequences (of seq_len ids at most) from pieces that carry their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))
