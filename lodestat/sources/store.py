"""Small files beside tables, through the file system that Spark itself uses for a path."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return bool(system.exists(where))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none of a folder that is not there."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A file that is whole as soon as it can be seen; an existing one is never replaced."""
    system, where = _at(spark, path)
    folder, name = path.rsplit("/", 1)
    _, draft = _at(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(where) or not system.rename(draft, where):
        system.delete(draft, False)
        raise FileExistsError(path)
