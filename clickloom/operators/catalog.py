"""Catalog items: classification rules, dimension lookup, ordered picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom import taxonomy as tx
from clickloom.functions import scalars as sf


def classify_items(
    items: DataFrame,
    name: str,
    category_rules: Sequence[tuple[str, str]] = tx.CATEGORY_RULES,
    icon_rules: Sequence[tuple[str, str]] = tx.ICON_RULES,
    category_default: str = tx.CATEGORY_DEFAULT,
) -> DataFrame:
    """Add ``category`` and ``icon``; the icon falls back to two capital letters."""
    text = F.coalesce(F.col(name), F.lit(""))
    return items.withColumns(
        {
            "category": sf.rule_classify(text, category_rules, F.lit(category_default)),
            "icon": sf.rule_classify(text, icon_rules, F.upper(F.left(text, F.lit(2)))),
        }
    )


def lookup_dimension(
    items: DataFrame, dim: DataFrame, item_key: Column, dim_key: str, attributes: Mapping[str, Column]
) -> DataFrame:
    """Left join of a dimension by a derived key, attributes filled with defaults.

    ``attributes`` maps a dimension column to its default. No broadcast hint: Spark
    broadcasts a dimension below its size threshold and shuffles a larger one.
    """
    right = dim.select(F.col(dim_key).alias("_key"), *[F.col(a).alias(f"_{a}") for a in attributes])
    joined = items.withColumn("_item", item_key).join(right, F.col("_item") == F.col("_key"), "left")
    filled = joined.withColumns({a: F.coalesce(f"_{a}", default) for a, default in attributes.items()})
    return filled.drop("_item", "_key", *[f"_{a}" for a in attributes])


def lookup_item(items: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First item, in the given order, whose id or name equals the trimmed key."""
    wanted = F.lit(key.strip())
    hit = F.col(columns[0]) == wanted
    for c in columns[1:]:
        hit |= F.col(c) == wanted
    return items.where(hit).orderBy(*order).limit(1)


def by_title(title: str, tie: str) -> list[Column]:
    return [F.lower(F.col(title)), F.col(tie)]


def preferred_topk(items: DataFrame, preferred: Column, title: str, tie: str, k: int = 3) -> DataFrame:
    """Preferred items by title, filled up with the others by title."""
    flagged = items.withColumn("popular", F.coalesce(preferred, F.lit(False)))
    return flagged.orderBy(F.desc("popular"), *by_title(title, tie)).limit(k)


def first_by_title(items: DataFrame, title: str, tie: str, k: int = 3) -> DataFrame:
    return items.orderBy(*by_title(title, tie)).limit(k)


def newest_created(items: DataFrame, created: str, tie: str) -> DataFrame:
    return items.orderBy(F.desc(created), tie)
