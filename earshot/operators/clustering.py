"""k-means in a worker or over the cluster, by one rule; nearest centroids for any number of points.

All restarts run side by side. A seed is the point of greatest log(u) / d, where
u is a uniform number from a hash of its id and d its squared distance from the
seeds before: a draw in proportion to d that comes out alike wherever the points
are. Then assignment and means alternate until the inertia of no restart moves
by more than 1e-6. A centroid without members takes the point that is farthest
from its own. The restart of least inertia counts.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch

#: Points whose distances are held at once.
BLOCK = 500
STILL = 1e-6
#: Points of a task of a pass, about.
PASS = 10_000


def draw(keys: np.ndarray, salt: int) -> np.ndarray:
    """Uniform numbers in (0, 1), one for each 64-bit key (the mixing steps of splitmix64)."""
    z = keys.astype(np.int64).view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / 2**53


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """restarts x points x centroids, squared; what rounding leaves of equal points is 0."""
    restarts, k, width = centroids.shape
    found = points @ centroids.reshape(-1, width).T
    found *= -2
    scale = (points**2).sum(1)[:, None] + (centroids**2).sum(2).reshape(1, -1)
    found += scale
    scale *= 1e-12
    found[~(found > scale)] = 0.0
    return found.reshape(len(points), restarts, k).transpose(1, 0, 2)


def _greatest(values: np.ndarray, keys: np.ndarray) -> int:
    """The place of the greatest value, of equals that of the greatest key."""
    at = np.flatnonzero(values == values.max())
    return int(at[keys[at].argmax()])


def seed_of(blocks: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], step: int, restarts: int, seed: int) -> list[tuple] | None:
    """The next seed of each restart among blocks of (points, keys, squared distances from the seeds before by restart): (rank, key, point)."""
    best = None
    for points, keys, far in blocks:
        far, found = np.maximum(far, 1e-300), []
        for r in range(restarts):
            rank = np.log(draw(keys, (seed * restarts + r) * 1_000_003 + step)) / far[r]
            at = _greatest(rank, keys)
            found.append((float(rank[at]), int(keys[at]), points[at]))
        best = found if best is None else [max(pair, key=lambda x: x[:2]) for pair in zip(best, found)]
    return best


def tally_of(blocks: Iterable[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray) -> tuple | None:
    """Of blocks of (points, keys): sums and sizes by centroid, inertia, and each restart's farthest point as (distance, key, point)."""
    total, k = None, centroids.shape[1]
    for points, keys in blocks:
        d = distances(points, centroids)
        label, least = d.argmin(2), d.min(2)
        sums, sizes, far = np.zeros(centroids.shape), np.zeros(centroids.shape[:2]), []
        for r, (own, row) in enumerate(zip(label, least)):
            order = own.argsort(kind="stable")
            sizes[r] = np.bincount(own, minlength=k)
            full = np.flatnonzero(sizes[r])
            sums[r, full] = np.add.reduceat(points[order], (np.cumsum(sizes[r]) - sizes[r])[full].astype(int))
            at = _greatest(row, keys)
            far.append((float(row[at]), int(keys[at]), points[at]))
        own = sums, sizes, least.sum(1)
        total = (*own, far) if total is None else (*(a + b for a, b in zip(total, own)), [max(pair, key=lambda x: x[:2]) for pair in zip(total[3], far)])
    return total


def settle(k: int, rounds: int) -> Generator[tuple[np.ndarray | None, int | None], object, np.ndarray]:
    """Asks for what it needs of the points and returns the centroids of the best restart.

    To (centroids, step) the answer is the seeds of that step, restarts x d; to (centroids, None) it is sums, sizes, inertia,
    farthest distances and points.
    """
    centroids = (yield None, 0)[:, None]
    for step in range(1, k):
        centroids = np.concatenate([centroids, (yield centroids, step)[:, None]], 1)
    before = np.inf
    for _ in range(rounds):
        sums, sizes, inertia, worst, farthest = yield centroids, None
        full = (sizes > 0).all(1) | (worst == 0)
        if full.all() and (np.abs(before - inertia) <= STILL + 1e-12 * inertia).all():
            break
        before = inertia
        centroids = np.where(sizes[:, :, None] > 0, sums / np.maximum(sizes, 1)[:, :, None], farthest[:, None])
    return centroids[np.argmax(inertia <= inertia.min() * (1 + 1e-9))]  # the first of equals, whatever the order of the sums


def _advance(run: Generator, answer: object) -> tuple[tuple | None, np.ndarray | None]:
    """(what it asks for next, None), or (None, its centroids)."""
    try:
        return run.send(answer), None
    except StopIteration as end:
        return None, end.value


def kmeans(points: np.ndarray, k: int, *, restarts: int = 10, seed: int = 0, rounds: int = 100, keys: np.ndarray | None = None) -> np.ndarray:
    points = np.asarray(points, float)
    if points.ndim != 2:
        raise ValueError(f"points must be rows of coordinates, not {points.shape}")
    if k < 1:
        raise ValueError(f"{k} clusters")
    n = len(points)
    k = min(k, n)
    if k <= 1:
        return np.zeros(n, int)
    keys = np.arange(n) if keys is None else np.asarray(keys)
    cuts = [slice(at, at + BLOCK) for at in range(0, n, BLOCK)]
    far = np.ones((restarts, n))  # from the seeds so far
    run = settle(k, rounds)
    asked, centroids = _advance(run, None)
    while asked:
        known, step = asked
        if step is None:
            sums, sizes, inertia, ends = tally_of(((points[c], keys[c]) for c in cuts), known)
            answer = sums, sizes, inertia, np.array([f[0] for f in ends]), np.array([f[2] for f in ends])
        else:
            for c in cuts if step else ():
                last = distances(points[c], known[:, -1:])[:, :, 0]
                far[:, c] = last if step == 1 else np.minimum(far[:, c], last)
            answer = np.array([p for _, _, p in seed_of(((points[c], keys[c], far[:, c]) for c in cuts), step, restarts, seed)])
        asked, centroids = _advance(run, answer)
    return np.concatenate([distances(points[c], centroids[None])[0].argmin(1) for c in cuts])


def cluster_scopes(points: DataFrame, *, scope: str, id_col: str, vector: str, clusters, one_worker: int = 100_000, restarts: int = 10, rounds: int = 100) -> DataFrame:
    """(scope, id, cluster_id) by k-means in each scope; clusters(n) says how many.

    Scopes of up to one_worker points take one worker each; larger ones are worked on side by side, in passes over the cluster, by the same rule.
    """
    held = points.select(scope, id_col, vector)
    large = held.groupBy(scope).count().filter(F.col("count") > one_worker).collect()  # one row for every one_worker points at most
    schema = f"`{scope}` {points.schema[scope].dataType.simpleString()}, `{id_col}` {points.schema[id_col].dataType.simpleString()}, cluster_id int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        return pd.DataFrame({scope: pdf[scope], id_col: pdf[id_col], "cluster_id": kmeans(np.stack(pdf[vector]), clusters(len(pdf)), keys=pdf["_key"].to_numpy(), restarts=restarts, rounds=rounds)})

    def whole(rows: DataFrame) -> DataFrame:
        return rows.select(scope, id_col, vector, F.xxhash64(id_col).alias("_key")).groupBy(scope).applyInPandas(run, schema)

    if not large:
        return whole(held)
    numbers = points.sparkSession.createDataFrame([(r[scope], n) for n, r in enumerate(large)], T.StructType([T.StructField("_scope", points.schema[scope].dataType), T.StructField("_n", T.IntegerType())]))
    numbered = held.join(F.broadcast(numbers), F.col(scope).eqNullSafe(F.col("_scope")), "left").drop("_scope")
    labelled = _in_passes(numbered.filter("_n IS NOT NULL"), sum(r["count"] for r in large), {n: min(clusters(r["count"]), r["count"]) for n, r in enumerate(large)}, id_col, vector, restarts, rounds)
    named = labelled.join(F.broadcast(numbers), "_n").select(F.col("_scope").alias(scope), id_col, "cluster_id")
    return whole(numbered.filter("_n IS NULL")).unionByName(named)


def cluster_all(points: DataFrame, *, id_col: str, vector: str, clusters, one_worker: int = 20_000, restarts: int = 10, rounds: int = 100) -> DataFrame:
    """(id, cluster_id) of all points as one scope: in one worker up to so many points, over the cluster beyond, by the same rule."""
    return cluster_scopes(points.withColumn("_all", F.lit(0)), scope="_all", id_col=id_col, vector=vector, clusters=clusters, one_worker=one_worker, restarts=restarts, rounds=rounds).drop("_all")


def _in_passes(points: DataFrame, total: int, counts: dict[int, int], id_col: str, vector: str, restarts: int, rounds: int) -> DataFrame:
    """(_n, id, cluster_id) of `total` points of scopes _n, counts[_n] clusters each.

    Each seed and each round is one pass over a written table of the points, for all scopes at once; the driver holds
    restarts x clusters centroids a scope, whatever the points.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = points.sparkSession
    written = points.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("key"), F.col(vector).cast("array<double>").alias("point"), "_n")
    path = scratch(spark, "points")
    written.repartitionByRange(-(-total // PASS), "_n", "key").write.parquet(path)  # a task meets few scopes
    table = spark.read.schema(written.schema).parquet(path)

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for batch in batches:
            scopes = batch.column("_n").to_numpy()
            for n in np.unique(scopes).tolist():
                own = batch.filter(pa.array(scopes == n)) if (scopes != n).any() else batch
                for at in range(0, own.num_rows, BLOCK):
                    part = own.slice(at, BLOCK)
                    yield n, part.column("point").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1), part.column("key").to_numpy(zero_copy_only=False)

    def one_pass(asked: dict[int, tuple[np.ndarray | None, int | None]]) -> dict[int, object]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, tuple | list] = {}
            for n, p, keys in blocks(batches):
                if n not in asked:
                    continue
                centroids, step = asked[n]
                if step is None:
                    own = tally_of([(p, keys)], centroids)
                    if n in found:
                        own = (*(a + b for a, b in zip(found[n], own[:3])), [max(pair, key=lambda x: x[:2]) for pair in zip(found[n][3], own[3])])
                else:
                    own = seed_of([(p, keys, np.ones((restarts, len(p))) if centroids is None else distances(p, centroids).min(2))], step, restarts, 0)
                    if n in found:
                        own = [max(pair, key=lambda x: x[:2]) for pair in zip(found[n], own)]
                found[n] = own
            rows = []
            for n, own in found.items():
                if asked[n][1] is None:
                    sums, sizes, inertia, far = own
                    rows += [(n, r, [*sums[r].ravel(), *sizes[r], inertia[r]], *far[r]) for r in range(restarts)]
                else:
                    rows += [(n, r, [0.0], *best) for r, best in enumerate(own)]
            if rows:
                types = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["_n", "restart", "total", "worst", "key", "point"])

        partial = table.select("key", "point", "_n").mapInArrow(run, "_n int, restart int, total array<double>, worst double, key long, point array<double>")
        merged = partial.groupBy("_n", "restart").agg(
            vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total"), F.max("worst").alias("worst"), F.max_by("point", F.struct("worst", "key")).alias("point"),
        )
        rows = sorted(merged.collect(), key=lambda r: (r["_n"], r["restart"]))  # scopes x restarts, with all their centroids
        answers: dict[int, object] = {}
        for n, (_, step) in asked.items():
            own = [r for r in rows if r["_n"] == n]
            point = np.array([r["point"] for r in own])
            if step is None:
                total = np.array([r["total"] for r in own])
                sums, sizes, inertia = np.split(total, [-counts[n] - 1, -1], 1)
                answers[n] = sums.reshape(restarts, counts[n], -1), sizes, inertia[:, 0], np.array([r["worst"] for r in own]), point
            else:
                answers[n] = point
        return answers

    runs = {n: settle(k, rounds) for n, k in counts.items() if k > 1}
    final: dict[int, np.ndarray] = {}  # one cluster needs no centroid
    answers: dict[int, object] = dict.fromkeys(runs)
    while answers:
        asked = {}
        for n, answer in answers.items():
            request, centroids = _advance(runs[n], answer)
            if request is None:
                final[n] = centroids
            else:
                asked[n] = request
        answers = one_pass(asked) if asked else {}

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int32)
            scopes = batch.column("_n").to_numpy()
            for n in np.unique(scopes).tolist():
                if n in final:
                    own = pa.array(scopes == n)
                    found[scopes == n] = np.concatenate([distances(p, final[n][None])[0].argmin(1) for _, p, _ in blocks([batch.filter(own)])])
            yield pa.RecordBatch.from_arrays([batch.column("_n"), batch.column("id"), pa.array(found)], names=["_n", id_col, "cluster_id"])

    return table.mapInArrow(label, f"_n int, `{id_col}` {written.schema['id'].dataType.simpleString()}, cluster_id int")


def nearest(points: DataFrame, centroids: DataFrame, *, id_col: str, vector: str, at_once: int = 1000) -> DataFrame:
    """(id, cluster_id): the nearest centroid of each point, the lowest number among equals.

    Centroids are counted and go to every point in blocks of about at_once, one array each; the least of the blocks holds.
    """
    squared = lambda c: F.aggregate(F.zip_with(vector, c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    parts = max(1, -(-centroids.count() // at_once))
    found, names = points.select(id_col, vector), []
    for part in range(parts):
        own = centroids.filter(F.pmod(F.xxhash64("cluster_id"), F.lit(parts)) == part) if parts > 1 else centroids
        few = own.agg(F.array_sort(F.collect_list(F.struct("cluster_id", F.col("centroid").alias("c")))).alias("_all"))
        names.append(f"_best{part}")
        best = F.array_min(F.transform("_all", lambda c: F.struct(squared(c).alias("d"), c["cluster_id"].alias("cluster_id"))))
        found = found.crossJoin(F.broadcast(few)).withColumn(names[-1], best).drop("_all")
    least = F.least(*names) if parts > 1 else F.col(names[0])
    return found.select(id_col, least["cluster_id"].alias("cluster_id"))


def sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster_id").agg(F.count("*").alias("mention_count"), F.min("pos").alias("first_pos"))


def biggest(labelled: DataFrame, *, most: int = 3, least_size: int = 2) -> DataFrame:
    return sizes(labelled).filter(F.col("mention_count") >= least_size).orderBy(F.desc("mention_count"), "first_pos").limit(most)
