"""Words, row keys and scratch folders shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom import runtime

#: The contract's word patterns.
WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: For bytes.translate: A-Z to a-z, all else as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are.

    ``lower`` is the fast form for a text of ASCII only, whose lengths in bytes and in
    characters agree.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def map_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]


def entries(name: str) -> Column:
    """A map column as its sorted entries, which unlike a map can be hashed, grouped and ordered."""
    return F.sort_array(F.map_entries(F.col(f"`{name}`")))


def without_maps(df: DataFrame) -> DataFrame:
    return df.withColumns({name: entries(name) for name in map_columns(df)})


def with_maps(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of these names as maps again."""
    return df.withColumns({name: F.map_from_entries(F.col(f"`{name}`")) for name in names})


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """Mark for broadcast if it has at most ``rows`` rows; otherwise leave the join to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver's Python ends."""
    return runtime.passing_dir(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read back, which cuts its lineage."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, and the folder, for a caller that deletes it when nothing reads it any more."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
