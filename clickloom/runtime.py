"""Session settings and the shared folder for checkpoints and written results."""

from __future__ import annotations

import atexit
import functools
import math
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Runtime settings the operators rely on.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # sessions of a busy key are merged before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # batch numbers of the idempotent sink replace their own directory only
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def size_shuffles(spark: SparkSession, *paths: str, partition_bytes: int = 128 * 1024**2) -> int:
    """Set the shuffle partitions for inputs of this size and return their number.

    Adaptive execution merges partitions that turn out small but does not add any, so
    a large run has to start with enough of them to fit executor memory.
    """
    conf = spark._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += location.getFileSystem(conf).getContentSummary(location).getLength()
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / partition_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
    return wanted


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors see, named by ``spark.checkpoint.dir``.

    A machine-local folder is used only where the session names none and runs in
    local mode, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir(context.applicationId)


@functools.cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"clickloom-{application}-")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def passing_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one that is deleted when the driver's Python ends."""
    path = run_dir(spark, name)
    atexit.register(_discard, spark, path)
    return path


def _discard(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext._jsc
    if context is not None and not context.sc().isStopped():
        remove(spark, path)


def is_folder(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(location).isDirectory()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder, none if it is not there."""
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(location)] if system.exists(location) else []


def delete(spark: SparkSession, path: str) -> None:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    location.getFileSystem(spark._jsc.hadoopConfiguration()).delete(location, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made with ``run_dir``, on whatever file system it is."""
    if not path.startswith(shared_dir(spark)):
        raise ValueError(f"{path} is not below the shared folder")
    delete(spark, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file and put it in place by a rename, over one that is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    passing = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = system.create(passing, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(passing, target):
        system.delete(target, False)
        if not system.rename(passing, target):
            raise OSError(f"cannot write {path}")


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
