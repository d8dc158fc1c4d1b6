"""Exact order statistics without gathering the values.

``percentile`` keeps a map of all distinct values in one task. Here the value range
is narrowed instead: a histogram over whole units, added up into steps, finds the step
and then the unit holding the wanted rank, and one over the remainder finds the value.
Each is an ordinary partial aggregation. What is ranked in one task is the steps, the
units of one step and the values of one unit: none of them grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

MICROS = 1_000_000
#: Units in a step: an hour of seconds.
STEP = 3600


def _pick(hist: DataFrame, value: str) -> DataFrame:
    """Per target: the histogram row whose cumulative count passes the rank.

    ``hist`` has columns target, rank, <value>, n; at most one row per value and target.
    """
    w = W.Window.partitionBy("target").orderBy(value)
    below = F.coalesce(F.sum("n").over(w.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    return hist.withColumn("_below", below).where(
        (F.col("_below") <= F.col("rank")) & (F.col("rank") < F.col("_below") + F.col("n"))
    ).select("target", (F.col("rank") - F.col("_below")).alias("rank"), value)


def exact_median(values: DataFrame, column: str, unit: int = MICROS) -> DataFrame:
    """One row, ``median``: exact middle of a whole-number column >= 0, else NULL.

    The middle is the mean of the two middle values for an even count.
    """
    v = values.select(F.col(column).alias("v")).where("v IS NOT NULL")
    coarse = v.groupBy(F.expr(f"v div {unit}").alias("hi")).agg(F.count("*").alias("n"))
    steps = coarse.groupBy(F.expr(f"hi div {STEP}").alias("top")).agg(F.sum("n").alias("n"))
    size = F.col("size")
    # two targets: the lower and the upper middle rank
    targets = F.array(
        F.struct(F.lit(0).alias("target"), F.floor((size - 1) / 2).cast("long").alias("rank")),
        F.struct(F.lit(1).alias("target"), F.floor(size / 2).cast("long").alias("rank")),
    )
    by_step = (
        steps.withColumn("size", F.sum("n").over(W.Window.partitionBy(F.lit(0))))
        .select("top", "n", F.explode(targets).alias("t"))
        .select("top", "n", "t.target", "t.rank")
    )
    # two rows at most, so the broadcast is bounded
    by_unit = coarse.withColumn("top", F.expr(f"hi div {STEP}")).join(F.broadcast(_pick(by_step, "top")), "top")
    units = _pick(by_unit, "hi")
    # two rows at most, so the broadcast is bounded
    inside = v.withColumn("hi", F.expr(f"v div {unit}")).join(F.broadcast(units), "hi")
    fine = inside.groupBy("target", "rank", "v").agg(F.count("*").alias("n"))
    return _pick(fine, "v").agg((F.sum("v") / F.count("*")).alias("median"))
