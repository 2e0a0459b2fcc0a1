"""Files by way of Spark's own file systems, so that a path may be on any of them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import GranaryError


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file as a whole under a name that no file has yet. False if another writer was first."""
    fs, final = _path(spark, path)
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(temp, final):
        fs.delete(temp, False)
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which goes with the JVM. Only where all is one machine
    may it be a folder of that machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise GranaryError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)
    return path
