"""Connected components of a graph given by its edges, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom import runtime
from clickloom.llm import text as T


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node ``root`` of its component, for every node that is not its own root.

    ``edges`` has columns ``a`` and ``b``. A large star links every larger neighbour of a
    node to the node's smallest neighbour, a small star every smaller one; both keep the
    components and end in stars. Each round is written to the shared folder, so it can be
    read again after a loss, and the round before is deleted. An empty table gives none.
    """
    spark = edges.sparkSession
    path, mark = _write(edges.select("a", "b").filter("a <> b"))
    while True:
        stars = _small_star(_large_star(spark.read.schema("a long, b long").parquet(path)))
        new_path, new_mark = _write(stars)
        runtime.remove(spark, path)
        path = new_path
        if new_mark == mark or not new_mark[0]:
            break
        mark = new_mark
    return spark.read.schema("a long, b long").parquet(path).select(F.col("a").alias("node"), F.col("b").alias("root"))


def _write(edges: DataFrame) -> tuple[str, tuple]:
    spark = edges.sparkSession
    path = T.scratch(spark, "edges")
    edges.write.parquet(path)
    stored = spark.read.schema("a long, b long").parquet(path)
    found = stored.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return path, (found["n"], found["x"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct()
