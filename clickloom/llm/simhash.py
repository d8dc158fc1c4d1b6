"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprints are cut into six blocks of bits. Two that differ in at most two bits agree
in four blocks at least, so every pair meets in one of the 15 tables whose keys are four
blocks (43 bits). Inside a table a run of equal keys is compared bit-sliced: bit planes
lie vertically, one machine word holds a bit of 64 fingerprints, and 64 distances are
updated by carry-save counters in a few bitwise steps. Comparison of a lag stops as soon
as all its distances exceed the radius.

Equal fingerprints are merged first, so a run holds distinct values that differ in 22
bits at most; runs of more than ``LONG_RUN`` are cut again by the same argument. Links
inside a run are given as a star, which keeps every connection without all pairs; the
links of all runs are joined to components.

Defined cases: texts without words (and null texts) have fingerprint 0 and are linked
like any other; null ids are the largest; repeated rows are rows of the result; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import components
from clickloom.llm import text as T

SHINGLE = 3
RADIUS = 2
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
LONG_RUN = 8192
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 17


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of all runs of ``n`` words; of the whole text if it has fewer words."""
    return F.transform(F.array(T.words(T.ascii_lower(F.coalesce(text, F.lit(""))))), lambda w: _hashes(w, n))[0]


def _hashes(words: Column, n: int) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - n)
    runs = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)])))
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= n, runs).otherwise(short)


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per group of hashes, the bits that are set in over half of them, as uint64."""
    counts = np.zeros((len(lengths), 64), dtype=np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(hashes), CHUNK):
        part, own = hashes[at:at + CHUNK], owner[at:at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    ones = (2 * counts > lengths[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_hash`` (of the whole row) and ``print`` of every document."""
    rows = documents.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_hash(documents).alias("row_hash"),
        shingle_hashes(F.col(f"`{text}`")).alias("hashes"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(lists.offsets.to_numpy())
            prints = majority(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "row_hash", "print"])

    return rows.mapInArrow(fold, "doc_id long, row_hash long, print long")


def row_hash(documents: DataFrame) -> Column:
    """Hash over all columns; a map counts by its sorted entries."""
    maps = T.map_columns(documents)
    return F.xxhash64(*[T.entries(c) if c in maps else F.col(f"`{c}`") for c in documents.columns])


def _masks() -> list[int]:
    """Masks of the bits that each table's keys keep."""
    starts = np.cumsum((0,) + BLOCK_BITS[:-1])
    blocks = [((1 << n) - 1) << int(s) for n, s in zip(BLOCK_BITS, starts)]
    return [sum(kept) for kept in combinations(blocks, len(blocks) - RADIUS)]


def near_links(prints: DataFrame) -> DataFrame:
    """Edges (``a``, ``b``) that connect all distinct ``print`` values within the radius."""
    masks = _masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(signed)])
    rows = prints.select("print", F.explode(keys).alias("k")).select("k.t", "k.key", "print")
    rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if not len(new):
                continue
            done = int(new[-1])  # the last run may go on in the next batch
            yield _packed(_run_links(*[h[:done] for h in held], masks))
            held = [h[done:] for h in held]
        yield _packed(_run_links(*held, masks))

    return rows.mapInArrow(compare, "a long, b long").distinct()


def _packed(edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(edges[:, 0].view(np.int64)), pa.array(edges[:, 1].view(np.int64))], ["a", "b"])


def _run_links(table: np.ndarray, key: np.ndarray, prints: np.ndarray, masks: list[int]) -> np.ndarray:
    """Star edges of all runs of equal (table, key)."""
    prints = prints.astype(np.int64).view(np.uint64)
    if not len(prints):
        return np.zeros((0, 2), dtype=np.uint64)
    starts = np.concatenate([[0], np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1])
    lengths = np.diff(np.append(starts, len(prints)))
    out = [np.zeros((0, 2), dtype=np.uint64)]
    for t in np.unique(table[starts[lengths > 1]]):
        free = [b for b in range(64) if not masks[t] >> b & 1]
        size = 2
        while size // 2 < lengths.max():
            # runs of similar length together, so that a lag serves all of them
            chosen = np.flatnonzero((table[starts] == t) & (lengths >= size // 2 + (size > 2)) & (lengths <= size) & (lengths > 1))
            if size > LONG_RUN:
                groups = [[c] for c in chosen]
            else:
                groups = [chosen[i:i + max(1, CHUNK // size)] for i in range(0, len(chosen), max(1, CHUNK // size))]
            for group in groups:
                rows = np.concatenate([np.arange(starts[c], starts[c] + lengths[c]) for c in group])
                run = np.repeat(np.arange(len(group)), lengths[group])
                parent = np.arange(len(rows))
                parent = link_runs(prints[rows], run, free, parent)
                child = np.flatnonzero(parent != np.arange(len(rows)))
                out.append(np.stack([prints[rows][child], prints[rows][parent[child]]], axis=1))
            size *= 2
    return np.concatenate(out)


def link_runs(prints: np.ndarray, run: np.ndarray, free: list[int], parent: np.ndarray) -> np.ndarray:
    """Merge in ``parent`` all members of a run (sorted by run) within the radius on the ``free`` bits."""
    longest = int(np.bincount(run).max()) if len(run) else 0
    if longest <= LONG_RUN or len(free) <= RADIUS + 1:
        return _link_lags(prints, run, free, parent, longest)
    # one part of the free bits at least is equal within a linked pair
    for part in np.array_split(np.array(free), RADIUS + 1):
        value = np.zeros(len(prints), dtype=np.uint64)
        for i, b in enumerate(part):
            value |= (prints >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
        order = np.lexsort([value, run])
        changed = (value[order][1:] != value[order][:-1]) | (run[order][1:] != run[order][:-1])
        inner_run = np.concatenate([[0], np.cumsum(changed)])
        inner = link_runs(prints[order], inner_run, [b for b in free if b not in part], np.arange(len(order)))
        parent = _merge(parent, order, order[inner])
    return parent


def _link_lags(prints, run, free, parent, longest):
    n = len(prints)
    planes = _planes(prints, free)
    for lag in range(1, longest):
        same = np.zeros(n, dtype=bool)
        same[:n - lag] = run[lag:] == run[:n - lag]
        alive = _words(same)
        counters = [np.zeros_like(alive) for _ in range((RADIUS + 1).bit_length())]
        for i, plane in enumerate(planes):
            carry = (plane ^ _shifted(plane, lag)) & alive
            for c, counter in enumerate(counters):
                counters[c], carry = counter ^ carry, counter & carry
            over = np.full_like(alive, ~np.uint64(0))
            for c, counter in enumerate(counters):
                over &= counter if (RADIUS + 1) >> c & 1 else ~counter
            alive = alive & ~over
            if i % 4 == 3 and not alive.any():
                break
        if alive.any():
            left = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:n])
            parent = _merge(parent, left, left + lag)
    return parent


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, dtype=np.uint8)]).view(np.uint64)


def _planes(prints: np.ndarray, free: list[int]) -> list[np.ndarray]:
    """Bit planes: word w of a plane has that bit of fingerprints 64 w to 64 w + 63."""
    return [_words((prints >> np.uint64(b) & np.uint64(1)).astype(bool)) for b in free]


def _shifted(plane: np.ndarray, lag: int) -> np.ndarray:
    """The plane with bit i + lag at place i."""
    skip, rest = divmod(lag, 64)
    out = np.zeros_like(plane)
    tail = plane[skip:]
    out[:len(tail)] = tail >> np.uint64(rest)
    if rest:
        out[:len(tail) - 1] |= tail[1:] << np.uint64(64 - rest)
    return out


def _merge(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Union of all (left, right); every entry of the result is the smallest member of its set."""
    while True:
        a, b = parent[left], parent[right]
        differ = a != b
        if not differ.any():
            return parent
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's ``doc_id``, ``row_hash``, ``print``, ``root`` (a print) and ``component_id``."""
    docs = T.stored(fingerprints(documents, doc_id, text), "prints")
    prints = docs.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components.connected(near_links(prints.select("print")))
    linked = prints.join(roots, F.col("print") == F.col("node"), "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # prints without links are their own component and need no second join
    named = linked.select(F.col("print").alias("p"), "root").join(smallest.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("p", "root", "component_id")
    return docs.join(named, F.col("print") == F.col("p")).select("doc_id", "row_hash", "print", "root", "component_id")


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of every group, that with the smallest id, with all its columns.

    Null ids come last; of rows with one id the one with the smallest row hash stays, and
    of rows that are equal in all columns one.
    """
    grouped = groups(documents, doc_id, text)
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    # the row is one column, so that no name of a user's column can clash
    rows = documents.select(F.struct("*").alias("row"), F.col(f"`{doc_id}`").cast("long").alias("id"), row_hash(documents).alias("hash"))
    kept = rows.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("hash") == F.col("first_hash")), "left_semi")
    return kept.dropDuplicates(["hash"]).select("row.*")
