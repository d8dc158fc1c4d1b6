"""Catalog documents and metric exposition text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.operators import periods

RELAY_MAX_AGE = 30


def _texts(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))


CATALOG = T.StructType(
    [
        T.StructField("synced_at", T.StringType()),
        T.StructField("console_url", T.StringType()),
        T.StructField(
            "experiences",
            _texts("id", "name", "appName", "status", "clusterName", "clusterId", "version",
                   "cloudCredentialProvider", "cloudCredentialName", "createdOn"),
        ),
        T.StructField("engines", _texts("engineId", "name", "displayName", "description", "latestVersion")),
        T.StructField("blueprints", _texts("blueprintId", "name", "displayName", "description", "owner", "latestVersion")),
    ]
)
SECTIONS = ("experiences", "engines", "blueprints")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The catalog document as one row; an empty one when there is no file."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)
    if not exists:
        return spark.createDataFrame([(None, None, [], [], [])], CATALOG)
    return spark.read.schema(CATALOG).json(path, multiLine=True)


def catalog_items(catalog: DataFrame, section: str) -> DataFrame:
    """One row per entry of a section, in document order."""
    return catalog.select(F.posexplode(section).alias("position", "item")).select("position", "item.*")


def catalog_meta(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "synced_at", "console_url",
        *[F.coalesce(F.size(s), F.lit(0)).alias(f"{s.removesuffix('s')}_count") for s in SECTIONS],
    )


def metric_lines(spark: SparkSession, path: str, as_of, max_age: int = RELAY_MAX_AGE) -> DataFrame:
    """Text lines of relay files that were written within ``max_age`` seconds."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_modification_time")
    fresh = lines.where(F.col("file_modification_time") >= periods.before(as_of, max_age))
    return fresh.withColumn("line_no", F.monotonically_increasing_id())


def parse_samples(lines: DataFrame, prefix: str, exclude_prefix: str | None = None, text: str = "value") -> DataFrame:
    """``name{label="v",...} number`` lines as metric, labels and value.

    Comments, other prefixes and unreadable numbers are left out.
    """
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+-?\d+)?\s*$"
    label = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    line = F.col(text)
    body = F.regexp_extract(line, pattern, 2)
    names, values = (F.regexp_extract_all(body, F.lit(label), F.lit(i)) for i in (1, 2))
    plain = F.transform(values, _unescape)
    keep = [c for c in lines.columns if c != text]
    rows = lines.where(F.rlike(line, F.lit(pattern))).select(
        *keep,
        F.regexp_extract(line, pattern, 1).alias("metric"),
        F.map_from_arrays(names, plain).alias("labels"),
        F.regexp_extract(line, pattern, 3).try_cast("double").alias("value"),
    )
    rows = rows.where(F.startswith("metric", F.lit(prefix)) & F.col("value").isNotNull())
    return rows.where(~F.startswith("metric", F.lit(exclude_prefix))) if exclude_prefix else rows


def _unescape(c):
    """Escapes of the exposition format: ``\\\\``, ``\\"`` and ``\\n``."""
    mark = F.lit("\x00")
    kept = F.replace(c, F.lit("\\\\"), mark)
    return F.replace(F.replace(F.replace(kept, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), mark, F.lit("\\"))
