"""Near-duplicate vectors by an exact metric range join inside each label.

The angle between two vectors is a metric, and a cosine of at least ``SIMILARITY`` is an
angle of at most r. The join is exact; the triangle inequality decides three times:

1. Pivots, found in a bounded sample where it is dense, partition the vectors: each goes
   home to its nearest pivot, and there to a ring of width r / 2 around it.
2. A vector is also sent as a guest to every ring that a linked vector may be at home in:
   its angle to the pivot must be within r of the ring's angles, and at most 2 r more than
   that to its own pivot.
3. All vectors of the innermost ring are within r of each other. They are linked without
   comparison and are one node of the graph, so a large group of near copies costs
   neither pairs nor edges.

Rings (and labels too small or too many for pivots) are cut into blocks of bounded size.
Each is joined alone: the block is held, its guests stream by, and a matrix product gives
the cosines. Pairs within ``DOUBT`` of the bound are decided by exactly rounded sums. Every pair of
vectors meets once in the home block of each, which counts its links there. A block gives
at most one edge per guest and member, which keep all connections; these edges go to the
connected components.

Where vectors have no clusters, as random ones of many dimensions, no triangle inequality
excludes anything: every block then sees all vectors of its label, and blocks grow with the
square root of a label's size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, nor do those with a null label, nor vectors of different lengths;
equal rows are different vectors that link with each other; a null id is the smallest id
of no component that has another, and is never kept; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import components
from clickloom.llm import text as T

SIMILARITY = 0.93
#: Vectors of a label for each of its pivots, and the least block.
CELL = 1024
#: The expected sample for all pivots together, in vectors and in components; the largest labels that get pivots.
SAMPLE, SAMPLE_COMPONENTS, PIVOT_LABELS = 4096, 1 << 21, 256
#: Components of the vectors of a block, and cosines computed at a time.
BLOCK_COMPONENTS, PRODUCT = 1 << 23, 1 << 21
#: Rows given to Spark at a time.
ROWS = 4096
#: Cosines so near the bound are computed again; angles are compared with the slack.
DOUBT, SLACK = 1e-9, 1e-6
#: Kinds of rows in a block, in this order.
MEMBER, GUEST = 0, 1


class Cells(NamedTuple):
    """The rings of one label that hold vectors: pivot, ring, least and greatest angle, members, node, blocks."""

    pivots: np.ndarray
    pivot: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    node: np.ndarray
    blocks: np.ndarray


def block_size(n: int, dim: int) -> int:
    """Members of a block: more for larger labels, bounded by memory."""
    return max(1, min(max(CELL, 8 * math.isqrt(n)), BLOCK_COMPONENTS // max(1, dim)))


def unit(lists: pa.Array) -> np.ndarray:
    """The vectors, all of one length, scaled to length 1 in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def choose_pivots(sample: np.ndarray, wanted: int, similarity: float = SIMILARITY) -> np.ndarray:
    """Means of the densest places of the sample first, none within the radius of an earlier place."""
    near = np.zeros(len(sample), dtype=np.int64)
    for at in range(0, len(sample), 512):
        near[at:at + 512] = (sample[at:at + 512] @ sample.T >= similarity).sum(axis=1)
    covered = np.zeros(len(sample), dtype=bool)
    pivots = []
    for i in np.argsort(-near, kind="stable"):
        if covered[i]:
            continue
        around = sample @ sample[i] >= similarity
        covered |= around
        mean = sample[around].mean(axis=0) if around.any() else sample[i]
        pivots.append(mean / np.sqrt(mean @ mean))
        if len(pivots) == wanted:
            break
    return np.array(pivots).reshape(len(pivots), sample.shape[1])


def _by_key(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """Rows of a batch by the values of some columns."""
    columns = [batch.column(n).to_pylist() for n in names]
    found: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*columns)):
        found.setdefault(key, []).append(i)
    for key, rows in found.items():
        yield key, np.array(rows)


def vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Every vector with a row number and the ``group`` it is compared in: null for those that link with nothing."""
    rows = T.pick(table, vec_id=vec_id, embedding=embedding, label=label)
    usable = (
        F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    dim = F.when(F.coalesce(usable, F.lit(False)), F.size("embedding"))
    return rows.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.when(dim.isNotNull(), F.col("label").cast("string")).alias("group"), dim.alias("dim"), "embedding")


def find_pivots(rows: DataFrame, groups: DataFrame, similarity: float = SIMILARITY) -> dict[tuple, np.ndarray]:
    """Pivots of the largest groups, from a sample of fixed expected size."""
    large = groups.filter(F.col("n") > CELL).orderBy(F.desc("n"), "group", "dim").limit(PIVOT_LABELS).collect()
    total = sum(r["n"] for r in large)
    if not total:
        return {}
    share = min(SAMPLE, SAMPLE_COMPONENTS // max(r["dim"] for r in large)) / total
    wanted = rows.sparkSession.createDataFrame([(r["group"], r["dim"]) for r in large], "g string, d int")
    # the high bits of a hash of the row number, as a number from 0 to 1
    draw = F.shiftrightunsigned(F.xxhash64("row"), 11) / float(1 << 53)
    chosen = rows.filter(draw < share).join(F.broadcast(wanted), (F.col("group") == F.col("g")) & (F.col("dim") == F.col("d")))
    sample = chosen.select("group", "dim", "row", "embedding").orderBy("row").toArrow().combine_chunks()
    found = {}
    sizes = {(r["group"], r["dim"]): r["n"] for r in large}
    for batch in sample.to_batches():
        for key, at in _by_key(batch, "group", "dim"):
            found[key] = choose_pivots(unit(batch.column("embedding").take(pa.array(at))), math.ceil(sizes[key] / CELL), similarity)
    return found


def count_cells(rows: DataFrame, pivots: dict[tuple, np.ndarray], radius: float) -> dict[tuple, Cells]:
    """Members, angles and least row of every ring; as many numbers as pivots times rings at most."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at in _by_key(batch, "group", "dim"):
                if key not in pivots:
                    continue
                angle = angles(unit(batch.column("embedding").take(pa.array(at))), pivots[key])
                home = angle.argmin(axis=1)
                own = angle[np.arange(len(at)), home]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(key[0], len(at)), pa.repeat(pa.scalar(key[1], pa.int32()), len(at)), pa.array(home.astype(np.int32)),
                     pa.array(ring_of(own, radius)), pa.array(own), batch.column("row").take(pa.array(at))],
                    ["group", "dim", "pivot", "ring", "angle", "row"])

    if not pivots:
        return {}
    homes = rows.select("row", "group", "dim", "embedding").mapInArrow(assign, "group string, dim int, pivot int, ring int, angle double, row long")
    counted = homes.groupBy("group", "dim", "pivot", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("row").alias("node")).collect()
    found = {}
    for key, centres in pivots.items():
        own = sorted((r for r in counted if (r["group"], r["dim"]) == key), key=lambda r: (r["pivot"], r["ring"]))
        total = sum(r["n"] for r in own)
        column = {c: np.array([r[c] for r in own]) for c in ("pivot", "ring", "low", "high", "n", "node")}
        blocks = np.array([math.ceil(r["n"] / block_size(total, key[1])) for r in own])
        found[key] = Cells(centres, column["pivot"], column["ring"], column["low"], column["high"], column["n"], column["node"], blocks)
    return found


def ring_of(angle: np.ndarray, radius: float) -> np.ndarray:
    """Rings of half the radius; the innermost is a little smaller, so that its links are beyond doubt."""
    return np.floor((angle + SLACK) / (radius / 2)).astype(np.int32)


#: Columns of what meets in a block: ``node`` stands for the vector in the graph, ``sure`` links are counted without comparison.
MEETING = "group string, dim int, pivot int, ring int, block int, kind int, row long, vec_id long, node long, sure long"


def meetings(rows: DataFrame, cells: dict[tuple, Cells], radius: float) -> DataFrame:
    """Every vector as member of its home block and as guest of all others that it may have links in."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, at in _by_key(batch, "group", "dim"):
                for begin in range(0, len(at), ROWS):
                    part = batch.take(pa.array(at[begin:begin + ROWS]))
                    where, columns = _sent(part, key, cells.get(key), radius)
                    for first in range(0, len(where), ROWS):
                        to = slice(first, first + ROWS)
                        own = pa.array(where[to])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("group").take(own), part.column("dim").take(own), *[pa.array(c[to], pa.int32()) for c in columns[:4]],
                             part.column("row").take(own), part.column("vec_id").take(own), *[pa.array(c[to]) for c in columns[4:]], part.column("embedding").take(own)],
                            [c.split()[0] for c in MEETING.split(", ")] + ["embedding"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(send, f"{MEETING}, embedding {kind}")


def _block_of(row: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The home block, by a multiplicative hash of the row number."""
    mixed = (row.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % blocks.astype(np.uint64)).astype(np.int64)


def _sent(part: pa.RecordBatch, key: tuple, cells: Cells | None, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows go out, and their pivot, ring, block, kind, node and sure links."""
    row = part.column("row").to_numpy()
    n = len(row)
    if cells is None:
        total = part.column("n")[0].as_py()
        blocks = np.full(n, math.ceil(total / block_size(total, key[1])))
        home, core = np.full(n, -1), np.zeros(n, dtype=bool)
        node, sure = row, np.zeros(n, dtype=np.int64)
        guest, cell = np.arange(n), np.zeros(n, dtype=np.int64)
        pivot, ring, cell_blocks = np.array([-1]), np.array([-1]), blocks[:1]
        home_cell = np.zeros(n, dtype=np.int64)
    else:
        angle = angles(unit(part.column("embedding")), cells.pivots)
        home = angle.argmin(axis=1)
        own = angle[np.arange(n), home]
        pivot, ring, cell_blocks = cells.pivot, cells.ring, cells.blocks
        places = {(int(p), int(r)): c for c, (p, r) in enumerate(zip(pivot, ring))}
        home_cell = np.array([places[int(p), int(r)] for p, r in zip(home, ring_of(own, radius))])
        core = ring[home_cell] == 0
        node = np.where(core, cells.node[home_cell], row)
        sure = np.where(core, cells.n[home_cell] - 1, 0)
        seen = angle[:, pivot]
        reach = radius + SLACK
        passes = (seen >= cells.low - reach) & (seen <= cells.high + reach) & (seen - own[:, None] <= 2 * reach)
        # the vectors of an innermost ring are linked already
        passes[np.flatnonzero(core), home_cell[core]] = False
        guest, cell = np.nonzero(passes)
    block = _block_of(row, cell_blocks[home_cell])
    copies = cell_blocks[cell]
    guest, cell = np.repeat(guest, copies), np.repeat(cell, copies)
    to = np.arange(len(guest)) - np.repeat(np.cumsum(copies) - copies, copies)
    other = (cell != home_cell[guest]) | (to != block[guest])
    guest, cell, to = guest[other], cell[other], to[other]
    where = np.concatenate([np.arange(n), guest])
    at = np.concatenate([home_cell, cell])
    kind = np.repeat([MEMBER, GUEST], [n, len(guest)])
    return where, [pivot[at], ring[at], np.concatenate([block, to]), kind, node[where], sure[where]]


class Block:
    """The members of one block, their links so far, and the sets that these join."""

    def __init__(self, similarity: float, core: bool):
        self.similarity, self.core, self.joined = similarity, core, False
        self.columns: list[list[np.ndarray]] = [[], [], [], []]
        self.held: list[np.ndarray] = []
        self.edges: set[tuple[int, int]] = set()

    def add(self, row, vec_id, node, sure, rows):
        for held, new in zip(self.columns, (row, vec_id, node, sure)):
            held.append(new)
        self.held.append(rows)

    def _close(self) -> None:
        """All members are here: link them among themselves, unless they are linked without comparison."""
        self.joined = True
        self.row, vec_id, self.node, self.n_links = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in self.columns]
        self.vec_id, self.n_links = vec_id, self.n_links.copy()
        self.rows = np.concatenate(self.held) if self.held else np.zeros((0, 1))
        self.parent = np.zeros(len(self.row), dtype=np.int64) if self.core else np.arange(len(self.row))
        if self.core:
            return
        step = max(1, PRODUCT // max(1, len(self.row)))
        for at in range(0, len(self.row), step):
            linked = self._linked(self.rows[at:at + step])
            linked[np.arange(at, at + linked.shape[1]), np.arange(linked.shape[1])] = False
            i, j = np.nonzero(linked)
            self.n_links += linked.sum(axis=1)
            self._join(i, j + at)

    def _linked(self, others: np.ndarray) -> np.ndarray:
        cosine = self.rows @ others.T
        linked = cosine >= self.similarity
        for i, j in zip(*np.nonzero(np.abs(cosine - self.similarity) < DOUBT)):
            a, b = self.rows[i], others[j]
            linked[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= self.similarity
        return linked

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Union of members; each set is named by its smallest."""
        while len(i):
            a, b = self.parent[i], self.parent[j]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while (self.parent[self.parent] != self.parent).any():
                self.parent = self.parent[self.parent]
            apart = self.parent[i] != self.parent[j]
            i, j = i[apart], j[apart]

    def meet(self, node: np.ndarray, rows: np.ndarray) -> None:
        if not self.joined:
            self._close()
        step = max(1, PRODUCT // max(1, len(self.row)))
        for at in range(0, len(node) if len(self.row) else 0, step):
            linked = self._linked(rows[at:at + step])
            self.n_links += linked.sum(axis=1)
            guests = np.flatnonzero(linked.any(axis=0))
            first = linked.argmax(axis=0)
            # members that share a guest are one set, to which the guest has one edge
            i, j = np.nonzero(linked)
            self._join(i, first[j])
            self.edges.update(zip(node[at + guests].tolist(), self.node[first[guests]].tolist()))

    def results(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.joined:
            self._close()
        inner = np.flatnonzero(self.node != self.node[self.parent]) if len(self.row) else np.zeros(0, dtype=np.int64)
        edges = [*self.edges, *zip(self.node[inner].tolist(), self.node[self.parent[inner]].tolist())]
        edges = [(a, b) for a, b in edges if a != b]
        return np.array([a for a, _ in edges], dtype=np.int64), np.array([b for _, b in edges], dtype=np.int64)


#: A block gives its members (row to n_links) and its edges (a, b) as rows of one table.
JOINED = "row long, vec_id long, node long, n_links long, a long, b long"


def join_blocks(met: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links of every member and edges of the graph; each block is joined by itself."""
    place = ["group", "dim", "pivot", "ring", "block"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, name = None, None
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            keys = list(zip(*[columns[c].to_pylist() for c in (*place, "kind")]))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin == end:
                    continue
                if keys[begin][:-1] != name:
                    if block is not None:
                        yield from _packed(block)
                    name = keys[begin][:-1]
                    block = Block(similarity, name[3] == 0)
                of = {c: v.slice(begin, end - begin) for c, v in columns.items()}
                rows, node = unit(of["embedding"]), of["node"].to_numpy()
                if keys[begin][-1] == MEMBER:
                    # null ids come back as they are: kept as an Arrow array beside the numbers
                    block.add(of["row"].to_numpy(), np.array(of["vec_id"].to_pylist(), dtype=object), node, of["sure"].to_numpy(), rows)
                else:
                    block.meet(node, rows)
        if block is not None:
            yield from _packed(block)

    ordered = met.repartition(*place).sortWithinPartitions(*place, "kind")
    return ordered.mapInArrow(join, JOINED)


def _packed(block: Block) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in JOINED.split(", ")]
    a, b = block.results()
    n, none = len(block.row), pa.scalar(None, pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array(block.row), pa.array(block.vec_id.tolist(), pa.int64()), pa.array(block.node), pa.array(block.n_links.astype(np.int64)),
         pa.repeat(none, n), pa.repeat(none, n)], names)
    if len(a):
        yield pa.RecordBatch.from_arrays([*[pa.repeat(none, len(a))] * 4, pa.array(a), pa.array(b)], names)


def near_duplicates(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    similarity: float = SIMILARITY) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    # at similarity 1 the radius is 0, which the slack widens
    radius = max(math.acos(similarity), 4 * SLACK)
    every = T.stored(vectors(table, vec_id, embedding, label), "vectors")
    alone = every.filter("group IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = every.filter("group IS NOT NULL")
    groups = T.stored(rows.groupBy("group", "dim").agg(F.count(F.lit(1)).alias("n")), "groups")
    cells = count_cells(rows, find_pivots(rows, groups, similarity), radius)
    sized = rows.join(groups.withColumnsRenamed({"group": "g", "dim": "d"}), (F.col("group") == F.col("g")) & (F.col("dim") == F.col("d"))).drop("g", "d")
    joined = T.stored(join_blocks(meetings(sized, cells, radius), similarity), "joined")

    edges = joined.filter("a IS NOT NULL").select("a", "b").distinct()
    roots = components.connected(edges)
    members = joined.filter("a IS NULL").select("vec_id", "node", "n_links")
    linked = members.filter("n_links > 0")
    # a node is one vector or all of an innermost ring
    nodes = linked.groupBy("node").agg(F.min("vec_id").alias("least")).join(roots.withColumnRenamed("node", "r_node"), F.col("node") == F.col("r_node"), "left")
    nodes = nodes.select("node", F.coalesce("root", "node").alias("root"), "least")
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "c_root")
    named = nodes.join(least, F.col("root") == F.col("c_root")).select(F.col("node").alias("n_node"), "component_id")
    linked = linked.join(named, F.col("node") == F.col("n_node")).select("vec_id", "n_links", "component_id")
    single = members.filter("n_links = 0").select("vec_id", "n_links", F.col("vec_id").alias("component_id"))
    out = alone.unionByName(single).unionByName(linked)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
