"""Small files in whatever store Spark reads: existence, text, and creation that only one writer can win."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _located(spark, path)
    return system.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no such folder."""
    system, where = _located(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []


def age_seconds(spark: SparkSession, path: str) -> float:
    """Seconds since a file was written, by the driver's clock."""
    import time

    system, where = _located(spark, path)
    return time.time() - system.getFileStatus(where).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _located(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, *, replace: bool = False) -> bool:
    """Create a small file; whether this call created it. Without ``replace`` a file that is there is left alone.

    The store decides which of several writers creates a file, as HDFS and local disks do in one step.
    """
    system, where = _located(spark, path)
    try:
        stream = system.create(where, replace)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    system, where = _located(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give a file or folder another name; false if the store refuses."""
    system, where = _located(spark, source)
    return system.rename(where, _located(spark, target)[1])
