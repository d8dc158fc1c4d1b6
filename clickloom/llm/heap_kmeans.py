"""Centroid clustering with heap-ordered bounds, in exact integers.

A vector stays with its centroid while the gap between its distance to the second nearest
centroid and that to its own is larger than all that centroids have moved since. A centroid's
moves shrink the gaps of its vectors by at most its own drift and the largest drift
of any other, so with the accumulated sum S of these as offset a vector's key is fixed when it
is assigned: gap + S. It expires when S passes the key, and only the vectors with the
smallest keys have to be looked at.

Each cluster's heap is a set of runs in files, sorted by (cluster, key). In each round all
expired keys lie in one range per cluster, from the last offset to the new one: the
filter on these ranges reaches the files, which skip all row groups beyond. Popped vectors are rescanned
exactly against all centroids and form the round's own run with new keys. A run is never
rewritten: what an earlier round popped from it lies below that round's offset. The sums of the
clusters change only by the vectors that moved. A lost executor costs one round at most.

Everything is exact: components are integers, distances are sums of squares in 64 bits,
and keys are only compared with a slack on the side of popping too much.

Defined cases: vectors that are null, do not have ``DIMENSIONS`` components, or hold
null or non-finite ones are left out, as are those with components whose integer form
reaches 2 ** 27 in size, whose distances may not fit 64 bits; equal rows are rows of the result; with
fewer vectors than clusters each begins a cluster; an empty table gives no rows; a null id counts
as an empty text in the order of the first centroids, where ties go by components; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import runtime
from clickloom.llm import text as T

DIMENSIONS = 64
CLUSTERS = 40
ROUNDS = 5
#: Vectors are multiplied by this and rounded down.
SCALE = 256
#: Added to the text of an id before it is hashed for the order of the first centroids.
SEED = "2:"
#: Components of this size and above are not representable in exact 64-bit distances.
LIMIT = 1 << 27
#: Up to this size products and sums of components are exact in double precision.
EXACT_IN_DOUBLE = 1 << 22
#: Slack of offsets against rounding, relative and absolute.
SLACK = 1e-9
#: Bytes of a row group, so that a range of keys can be read alone.
ROW_GROUP = 1 << 20
#: Distances computed at a time.
PRODUCT = 1 << 20


def integers(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id`` and the integer components ``v`` of all vectors that take part."""
    rows = T.pick(table, vec_id=vec_id, embedding=embedding)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"), "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LIMIT // SCALE))
    return rows.filter((F.size("embedding") == dimensions) & finite).select("vec_id", F.col("v").cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes."""
    key = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors to all centroids."""
    small = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLE
    if small and vectors.shape[1] <= 256:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return np.rint((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid, the first of equals, and the gap to the second in distance."""
    cluster, gap = np.zeros(len(vectors), dtype=np.int64), np.full(len(vectors), np.inf)
    step = max(1, PRODUCT // max(vectors.shape[1], len(centroids)))
    for at in range(0, len(vectors), step):
        found = squared(vectors[at:at + step], centroids)
        cluster[at:at + step] = found.argmin(axis=1)
        if len(centroids) > 1:
            two = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
            gap[at:at + step] = two[:, 1] - two[:, 0]
    return cluster, gap


class Heaps(NamedTuple):
    """Sorted runs in files. Of all but the newest, keys below ``low`` of their cluster are popped."""

    paths: list[str]
    low: np.ndarray


RUN = "vec_id long, v array<int>, cluster int, was int, key double, run int"


def push(heaps: Heaps, rows: DataFrame, centroids: np.ndarray, offsets: np.ndarray) -> Heaps:
    """Assign all rows exactly and write them as the newest run; ``was`` is the cluster they leave, -1 for none."""
    spark = rows.sparkSession

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            vectors = lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)
            cluster, gap = assign(vectors, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(cluster.astype(np.int32)), batch.column(2), pa.array(gap + offsets[cluster])],
                ["vec_id", "v", "cluster", "was", "key"])

    run = len(heaps.paths)
    path = T.scratch(spark, f"heap-{run}")
    scanned = rows.select("vec_id", "v", "was").mapInArrow(scan, RUN.removesuffix(", run int")).withColumn("run", F.lit(run))
    scanned.sortWithinPartitions("cluster", "key").write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return Heaps([*heaps.paths, path], heaps.low)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(RUN).parquet(*paths)


def held(heaps: Heaps, high: np.ndarray) -> Column:
    """Rows of the heaps with keys below ``high`` of their cluster, as ranges that the files can skip by."""
    newest, terms = len(heaps.paths) - 1, []
    for c, (low, top) in enumerate(zip(heaps.low, high)):
        term = f"cluster = {c}"
        if np.isfinite(top):
            term += f" AND key < double('{float(top)!r}')"
        if np.isfinite(low):
            term += f" AND (run = {newest} OR key >= double('{float(low)!r}'))"
        if top > -np.inf:
            terms.append(f"({term})")
    return F.expr(" OR ".join(terms) or "false")


def changes(moved: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """By how much the sums and counts of the clusters change: summed in each task, then over tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((clusters, dimensions + 1), dtype=np.int64)
        for batch in batches:
            lists, to, was = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            vectors = np.ones((len(lists), dimensions + 1), dtype=np.int64)
            vectors[:, :-1] = lists.flatten().to_numpy().reshape(len(lists), -1)
            np.add.at(total, to, vectors)
            np.subtract.at(total, was[was >= 0], vectors[was >= 0])
        held = np.flatnonzero(total.any(axis=1))
        places = np.arange(dimensions + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(held, dimensions + 1).astype(np.int32)), pa.array(np.tile(places, len(held))), pa.array(total[held].ravel())], ["c", "place", "x"])

    rows = moved.filter("cluster <> was").select("v", "cluster", "was").mapInArrow(partial, "c int, place int, x long")
    totals = np.zeros((clusters, dimensions + 1), dtype=np.int64)
    for r in rows.groupBy("c", "place").agg(F.sum("x").alias("x")).collect():
        totals[r["c"], r["place"]] = r["x"]
    return totals[:, :-1], totals[:, -1]


def drifts(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How much a gap of each cluster shrinks at most: its own drift and the largest other one."""
    own = np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64))
    if len(own) < 2:
        return np.zeros(len(own))
    top = np.sort(own)[-2:]
    return own + np.where(own == top[1], np.where((own == top[1]).sum() > 1, top[1], top[0]), top[1])


class Clustering(NamedTuple):
    """The heaps after the last round, the final centroids and the number of vectors that each round scanned."""

    heaps: Heaps
    centroids: np.ndarray
    scanned: list[int]


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED) -> Clustering:
    """Assign and move ``rounds`` times, then assign once more; ``vectors`` as ``integers`` gives them.

    Only centroids, and the sums and counts of clusters, are in the driver.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, clusters, seed)
    if not len(centroids):
        return Clustering(Heaps([], np.zeros(0)), centroids, [])
    k, dimensions = centroids.shape
    offsets = np.zeros(k)
    heaps = push(Heaps([], np.full(k, -np.inf)), vectors.withColumn("was", F.lit(-1)), centroids, offsets)
    sums, counts = changes(read_runs(spark, heaps.paths), k, dimensions)
    scanned = [int(counts.sum())]
    for _ in range(rounds):
        moved = centroids.copy()
        filled = counts > 0
        moved[filled] = np.floor_divide(sums[filled], counts[filled][:, None])
        shrink = drifts(centroids, moved)
        centroids, offsets = moved, offsets + shrink * (1 + SLACK)
        if not shrink.any():
            # nothing moved, so equal distances stay as they were decided
            scanned.append(0)
            continue
        until = offsets + SLACK * (1 + offsets)
        popped = read_runs(spark, heaps.paths).filter(held(heaps, until))
        heaps = push(heaps, popped.select("vec_id", "v", F.col("cluster").alias("was")), centroids, offsets)._replace(low=until)
        fresh = read_runs(spark, heaps.paths[-1:])
        more_sums, more_counts = changes(fresh, k, dimensions)
        sums, counts = sums + more_sums, counts + more_counts
        scanned.append(fresh.count())
    return Clustering(heaps, centroids, scanned)


def members(spark: SparkSession, found: Clustering) -> DataFrame:
    """All vectors with their ``cluster`` and exact squared ``distance`` to its centroid."""
    rows = read_runs(spark, found.heaps.paths).filter(held(found.heaps, np.full(len(found.centroids), np.inf)))
    centroids = found.centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            vectors = lists.flatten().to_numpy().astype(np.int64).reshape(len(lists), -1)
            cluster = batch.column(2).to_numpy()
            distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(measure, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            seed: str = SEED, dimensions: int = DIMENSIONS) -> DataFrame:
    """Every vector's cluster and distance, the sums of distances, and a digest of its final centroid."""
    spark = table.sparkSession
    found = fit(T.stored(integers(table, vec_id, embedding, dimensions), "integers"), clusters, rounds, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not found.heaps.paths:
        return spark.createDataFrame([], schema)
    measured = T.stored(members(spark, found), "members")
    for path in found.heaps.paths:
        runtime.remove(spark, path)
    sums = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    shown = [(c, sums.get(c), sum(sums.values()), ",".join(map(str, row.tolist()))) for c, row in enumerate(found.centroids)]
    of_cluster = spark.createDataFrame(shown, "c int, cluster_inertia long, inertia long, centroid string")
    # one row for each cluster
    joined = measured.join(F.broadcast(of_cluster), F.col("cluster") == F.col("c"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.col("centroid").cast("binary"), 256).alias("centroid_sha256"))
