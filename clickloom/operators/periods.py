"""Time windows and period comparison. The clock is always an argument."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import scalars as sf

CURRENT, PREVIOUS = "current", "previous"
COMPARISONS = ("prior", "half", "half_compat")
DAY = 86400


def instant(as_of: datetime | str | Column) -> Column:
    """A clock reading as a timestamp; naive values are UTC."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc)
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(as_of).cast("timestamp")


def before(as_of: datetime | str | Column, seconds: float) -> Column:
    return instant(as_of) - F.make_dt_interval(secs=F.lit(float(seconds)))


def window_days(days: int | None, default: int = 7) -> int:
    """Days of a window, at least one; there is no upper limit."""
    days = default if days is None else days
    if days < 1:
        raise ValueError("the window has at least one day")
    return days


def events_in_window(
    events: DataFrame, seconds: float, as_of: datetime | str | Column, time_col: str = "received_at"
) -> DataFrame:
    """Events from ``as_of - seconds`` on, the bound included, with no upper bound."""
    return events.where(F.col(time_col) >= before(as_of, seconds))


def split_periods(
    events: DataFrame,
    seconds: float,
    as_of: datetime | str | Column,
    comparison: str = "prior",
    time_col: str = "received_at",
) -> DataFrame:
    """Add ``period``: ``current`` or ``previous``; other events are dropped.

    ``prior``        current window against the window before it
    ``half``         second half of the window against its first half
    ``half_compat``  whole window against its first half, whose events count twice
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"comparison must be one of {COMPARISONS}")
    t = F.col(time_col)
    start = before(as_of, seconds)
    if comparison == "prior":
        period = F.when(t >= start, CURRENT).otherwise(PREVIOUS)
        return events.where(t >= before(as_of, 2 * seconds)).withColumn("period", period)
    inside = events.where(t >= start)
    first_half = t < before(as_of, seconds / 2)
    if comparison == "half":
        return inside.withColumn("period", F.when(first_half, PREVIOUS).otherwise(CURRENT))
    both = F.when(first_half, F.array(F.lit(CURRENT), F.lit(PREVIOUS))).otherwise(F.array(F.lit(CURRENT)))
    return inside.withColumn("period", F.explode(both))


def compare_periods(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row with ``<name>``, ``<name>_previous`` and ``<name>_delta_pct`` per metric.

    ``metrics`` holds one row per period. Without a previous row the previous values
    and the changes are NULL.
    """
    at = lambda period, n: F.max(F.when(F.col("period") == period, F.col(n)))
    wide = metrics.groupBy().agg(
        *[F.coalesce(at(CURRENT, n), F.lit(0)).alias(n) for n in names],
        *[at(PREVIOUS, n).alias(f"{n}_previous") for n in names],
    )
    return wide.withColumns(
        {f"{n}_delta_pct": sf.delta_pct(F.col(n), F.col(f"{n}_previous")) for n in names}
    )
