"""Compaction of the table that ``append_batch`` writes: few files for a day that is over.

Every micro-batch leaves a directory per day, so a day of a steady stream is thousands of
small files. ``compact_days`` rewrites a day's batches as files of the advisory size
and swaps them in with one marker file, which names the batches that the files hold.
``read_batches`` is the reader that honours the markers:

* before the marker is there, it reads the batch directories;
* after it, it reads the compacted files and the directories of other batches only, so a
  directory that is left, or that comes back with a repeated batch, is not read twice.

The marker is put in place by a rename, so a reader sees a day before or after the swap.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom import runtime, schema

#: Hidden from plain readers of the table by its underscore.
COMPACTED = "_compacted"
DAY = schema.PARTITION_COLUMN


def committed_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The last batch that a stream has committed; it and those before are never run again."""
    done = [int(name) for name in runtime.children(spark, f"{checkpoint}/commits") if name.isdigit()]
    return max(done, default=None)


def _days(spark: SparkSession, path: str) -> list[str]:
    return sorted(n.partition("=")[2] for n in runtime.children(spark, path) if n.startswith(f"{DAY}="))


def _batches(spark: SparkSession, path: str, day: str) -> set[int]:
    names = runtime.children(spark, f"{path}/{DAY}={day}")
    return {int(n.partition("=")[2]) for n in names if n.startswith("batch_id=")}


def _marker(spark: SparkSession, path: str, day: str) -> dict | None:
    """The newest marker of a day: its generation and the batches it holds."""
    folder = f"{path}/{COMPACTED}/{DAY}={day}"
    found = [int(n.removesuffix(".json")) for n in runtime.children(spark, folder) if n.endswith(".json")]
    return json.loads(runtime.read_text(spark, f"{folder}/{max(found)}.json")) if found else None


def compact_days(spark: SparkSession, path: str, before: str, upto: int, least: int = 2) -> list[str]:
    """Compact all days before ``before`` that have ``least`` new batches; returns these days.

    Only batches up to ``upto`` are taken, which must be committed (``committed_batch``).
    Batches that come later for a compacted day join its next generation.
    """
    limit, done = datetime.date.fromisoformat(before).isoformat(), []
    for day in sorted({*_days(spark, path), *_days(spark, f"{path}/{COMPACTED}")}):
        if day < limit and _compact(spark, path, day, upto, least):
            done.append(day)
    return done


def _compact(spark: SparkSession, path: str, day: str, upto: int, least: int) -> bool:
    marker = _marker(spark, path, day) or {"generation": -1, "batches": []}
    held = set(marker["batches"])
    fresh = {b for b in _batches(spark, path, day) if b <= upto}
    new = fresh - held
    folder = f"{path}/{COMPACTED}/{DAY}={day}"
    if len(new) < least:
        _drop(spark, path, day, fresh & held)
        return False
    rows = _raw(spark, path, day, new)
    if held:
        rows = rows.unionByName(_generation(spark, path, day, marker["generation"]))
    generation = marker["generation"] + 1
    rows.drop(DAY).hint("rebalance").write.mode("overwrite").parquet(f"{folder}/{generation}")
    text = json.dumps({"generation": generation, "batches": sorted(held | new)})
    runtime.write_text(spark, f"{folder}/{generation}.json", text)
    # the day is swapped; what follows only frees space, and may be repeated
    _drop(spark, path, day, fresh)
    for name in runtime.children(spark, folder):
        # the generation before stays for readers that have begun
        if int(name.removesuffix(".json")) < generation - 1:
            runtime.delete(spark, f"{folder}/{name}")
    return True


def _drop(spark: SparkSession, path: str, day: str, batches: set[int]) -> None:
    for b in batches:
        runtime.delete(spark, f"{path}/{DAY}={day}/batch_id={b}")


def _raw(spark: SparkSession, path: str, day: str, batches: set[int]) -> DataFrame:
    folders = [f"{path}/{DAY}={day}/batch_id={b}" for b in sorted(batches)]
    return spark.read.option("basePath", path).parquet(*folders).withColumn("batch_id", F.col("batch_id").cast("long"))


def _generation(spark: SparkSession, path: str, day: str, generation: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{COMPACTED}/{DAY}={day}/{generation}")
    return rows.withColumn(DAY, F.lit(day).cast("date"))


def read_batches(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """All rows of the table, each once, from compacted files and batch directories; from the day ``since`` on."""
    raw, merged = [], []
    for day in sorted({*_days(spark, path), *_days(spark, f"{path}/{COMPACTED}")}):
        if since is not None and day < datetime.date.fromisoformat(since).isoformat():
            continue
        marker = _marker(spark, path, day)
        if marker:
            merged.append(f"{path}/{COMPACTED}/{DAY}={day}/{marker['generation']}")
        raw += [f"{path}/{DAY}={day}/batch_id={b}" for b in sorted(_batches(spark, path, day) - set(marker["batches"] if marker else ()))]
    parts = []
    if raw:
        parts.append(spark.read.option("basePath", path).parquet(*raw).withColumn("batch_id", F.col("batch_id").cast("long")))
    if merged:
        # the generation is the last directory, below the day
        parts.append(spark.read.option("basePath", f"{path}/{COMPACTED}").parquet(*merged))
    if not parts:
        raise FileNotFoundError(f"no batches below {path}")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def count_files(spark: SparkSession, path: str) -> DataFrame:
    """Data files per day as ``read_batches`` sees them."""
    rows = read_batches(spark, path)
    return rows.select(DAY, F.input_file_name().alias("f")).distinct().groupBy(DAY).agg(F.count("*").alias("files"))
