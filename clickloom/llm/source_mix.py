"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. A source's target is its weight's share of all words, but at most
``MOST`` times its own size; the excess goes to the other sources by weight. Each source
is put in a fixed random order and cut into blocks of words. Whole passes over a source
and the blocks of a last, partial pass make its block quota. The tree halves the output
shards again and again and draws how many blocks of each source go to either half, so
the quotas are exact and every shard is a fair draw of the mix. A shard then takes the
blocks of its own, disjoint range of a permutation of the source's blocks, and its rows
are shuffled inside it.

The driver holds one number for each source and order bucket, and for each source and
shard. A large source is spread over ``BUCKETS`` order buckets, and rows that are equal
in every column are counted before the shuffle.

Defined cases: a null text has 0 words; a null source is a source, the last; a source
without words has target 0 and its rows are not taken; a text without words is taken as
often as the whole passes over its source, and once more only inside a partial pass; an
empty table gives no rows; equal rows are separate documents; rows of equal id and text are
ordered by their other columns, of which maps count by their sorted entries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm import feistel
from clickloom.llm import text as T

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 65_536
SHARDS = 16
SEED = 17
BUCKETS = 256
#: Rows of the plan (one per source and bucket) up to this number are broadcast.
BROADCAST_PLAN = 500_000

PLACEMENT = "array<struct<pass:int,shard:int>>"


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, float]:
    """Target words of every source; weights repeat over the sources by code point, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total_weight = sum(sizes.values()), sum(weight.values())
    capped = {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        if most * sizes[s] * total_weight >= left * weight[s]:
            break
        capped[s] = most * sizes[s]
        left, total_weight = left - capped[s], total_weight - weight[s]
    return {s: float(capped[s]) if s in capped else left * weight[s] / total_weight for s in names}


def split_quotas(quotas, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns); every row sums to its quota."""
    quotas = np.asarray(quotas, dtype=np.int64)
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        middle = (low + high) // 2
        draw = round(int(have.sum()) * (middle - low) / (high - low))
        rng = np.random.default_rng([seed, low, high])
        ours = rng.multivariate_hypergeometric(have, draw, method="marginals")
        split(ours, low, middle)
        split(have - ours, middle, high)

    if len(quotas):
        split(quotas, 0, shards)
    return out


def word_count(text: Column) -> Column:
    return F.size(T.words(text)).cast("long")


def order_key(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """Fixed random order of documents: md5 of the seed, the id and the text's md5."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest).cast("binary"))


def place(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, weights=WEIGHTS, most: int = MOST,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """Where the mix takes each row.

    ``rows`` has columns ``row`` (a struct), ``source``, ``size`` and ``key`` (see
    ``order_key``). The result has one row per input row: ``row``, ``size``,
    ``source_size``, ``target``, ``placements`` (pass and shard of every take).
    """
    spark = rows.sparkSession
    rows = rows.withColumn("bucket", F.conv(F.substring("key", 1, 2), 16, 10).cast("int"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last(), "bucket").collect()
    sizes: dict[str | None, int] = {}
    for r in sums:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = targets(sizes, weights, most)

    names = list(goal)
    number = {s: i for i, s in enumerate(names)}
    passes = [int(goal[s] / sizes[s]) if sizes[s] else 0 for s in names]
    rest = [goal[s] - p * sizes[s] for s, p in zip(names, passes)]
    blocks = [-(-sizes[s] // block_words) for s in names]
    quotas = [p * b + (int(r // block_words) + 1 if r > 0 else 0) for p, b, r in zip(passes, blocks, rest)]
    bounds = np.cumsum(split_quotas(quotas, shards, seed), axis=1)

    plan, start = [], dict.fromkeys(names, 0)
    for r in sums:
        s = r["source"]
        i = number[s]
        plan.append((s, r["bucket"], start[s], sizes[s], goal[s], i, passes[i], float(rest[i]), blocks[i]))
        start[s] += r["size"]
    kind = "p_source string, p_bucket int, first long, source_size long, target double, number int, passes int, rest double, blocks long"
    plan_rows = spark.createDataFrame(plan, kind)
    if len(plan) <= BROADCAST_PLAN:
        plan_rows = F.broadcast(plan_rows)

    copies = rows.groupBy("source", "bucket", "key", "size", "row").agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("source", "bucket").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    copies = copies.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0)))
    one = copies.withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    one = one.join(plan_rows, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    at = F.col("first") + F.col("before") + F.col("n") * F.col("size")
    one = one.withColumn("at", at)
    takes = F.col("passes") + F.when((F.col("rest") > 0) & (F.col("at") + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0)

    @F.pandas_udf("int")
    def shard_of(source: pd.Series, block: pd.Series) -> pd.Series:
        source, block = source.to_numpy(), block.to_numpy()
        out = np.zeros(len(source), dtype=np.int32)
        for s in np.unique(source):
            mine = source == s
            drawn = feistel.permute(np.minimum(block[mine], quotas[s] - 1), quotas[s], seed + int(s)) if quotas[s] else block[mine]
            out[mine] = np.minimum(np.searchsorted(bounds[s], drawn, side="right"), shards - 1)
        return pd.Series(out)

    # a row is in one block per pass; up to ``most`` whole passes and one partial pass
    block = F.expr(f"least(at div {block_words}, greatest(blocks - 1, 0))")
    for p in range(most + 1):
        one = one.withColumn(f"shard_{p}", shard_of("number", block + p * F.col("blocks")))
    each = F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"shard_{p}").alias("shard")) for p in range(most + 1)])
    return one.select("row", "size", "source_size", "target", F.slice(each, F.lit(1), takes).cast(PLACEMENT).alias("placements"))


def mix(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text",
        source: str = "source", weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture: every take of a document as a row, with ``mix_pass``, ``mix_shard`` and ``mix_order``.

    ``mix_order`` is the random place inside the shard. Columns of these names are replaced.
    """
    kept = [c for c in documents.columns if c not in ("mix_pass", "mix_shard", "mix_order")]
    maps = [c for c in T.map_columns(documents) if c in kept]
    rows = T.without_maps(documents).select(
        F.struct(*[f"`{c}`" for c in kept]).alias("row"), F.col(f"`{source}`").alias("source"),
        word_count(F.col(f"`{text}`")).alias("size"), order_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed).alias("key"),
    )
    taken = place(rows, shards, seed, weights, most, block_words).select("row", F.explode("placements").alias("take"))
    return T.with_maps(taken.select(
        "row.*", F.col("take.pass").alias("mix_pass"), F.col("take.shard").alias("mix_shard"),
        F.xxhash64(F.lit(seed), "take", "row").alias("mix_order"),
    ), maps)


def write_mix(mixed: DataFrame, path: str) -> None:
    """Write the mixture by shard, every file in the shuffled order of its shard."""
    ordered = mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    ordered.write.partitionBy("mix_shard").parquet(path)
