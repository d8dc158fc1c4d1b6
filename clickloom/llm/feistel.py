"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 to N-1 in an order that depends only on their content. A Feistel
network over the next power of four, with cycle walking back into 0..N-1, permutes the
numbers; row ``p`` of the permutation is slot ``p // shards`` of shard ``p % shards``.
Shard sizes differ by one row at most, and either direction can be computed for any
single number.

Numbering needs the row counts of ``BUCKETS`` hash buckets on the driver, whatever the
number of rows. Rows that are equal in every column are counted before the shuffle and
take consecutive numbers, so they do not load one task.

Defined cases: nulls are ordinary values; an empty table gives no rows; equal rows each
get a slot of their own; columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import text as T

BUCKETS = 4096
SHARDS = 24
SEED = 20240229
ROUNDS = 6

#: Odd multipliers of a common 64-bit finaliser.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def _halves(n: int) -> tuple[np.uint64, np.uint64]:
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    return np.uint64(half), np.uint64((1 << half) - 1)


def _network(x: np.ndarray, n: int, seed: int, back: bool) -> np.ndarray:
    half, mask = _halves(n)
    left, right = x >> half, x & mask
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        key = seed * 0x9E3779B97F4A7C15 + r
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << half) | right


def permute(numbers, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """Images of ``numbers`` under the permutation of 0..n-1, or their preimages if ``back``."""
    start = np.asarray(numbers, dtype=np.uint64)
    if start.size and int(start.max()) >= n:
        raise ValueError("a number is outside the permutation")
    with np.errstate(over="ignore"):
        out = _network(start, n, seed, back)
        outside = np.flatnonzero(out >= n)
        while outside.size:
            out[outside] = _network(out[outside], n, seed, back)
            outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """All columns of ``rows`` with ``shard`` and ``slot``; columns of these names are replaced."""
    kept = [f"`{c}`" for c in rows.columns if c not in ("shard", "slot")]
    maps = [c for c in T.map_columns(rows) if f"`{c}`" in kept]
    whole = T.without_maps(rows).select(F.struct(*kept).alias("row"))
    whole = whole.withColumn("hash", F.xxhash64(F.lit(seed), "row"))
    whole = whole.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int"))
    counts = np.zeros(buckets, dtype=np.int64)
    for r in whole.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    total = int(counts.sum())
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])

    @F.pandas_udf("long")
    def place(bucket: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series(permute(first[bucket.to_numpy()] + within.to_numpy(), total, seed))

    copies = whole.groupBy("bucket", "hash", "row").agg(F.count(F.lit(1)).alias("copies"))
    # equal hashes of unequal rows are ordered by the rows themselves
    before = Window.partitionBy("bucket").orderBy("hash", "row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = copies.withColumn("before", F.coalesce(F.sum("copies").over(before), F.lit(0)))
    numbered = numbered.select("row", "bucket", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("within"))
    placed = numbered.select("row", place("bucket", "within").alias("at"))
    return T.with_maps(placed.select("row.*", (F.col("at") % shards).cast("int").alias("shard"), F.expr(f"at div {shards}").alias("slot")), maps)


def locate(number: int, total: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one global row number."""
    at = int(permute([number], total, seed)[0])
    return at % shards, at // shards


def number_at(shard: int, slot: int, total: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number at a slot."""
    return int(permute([slot * shards + shard], total, seed, back=True)[0])


def write_shards(rows: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write the shards as Parquet folders, each in slot order, by several tasks a shard."""
    placed = shard_rows(rows, shards, seed)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
