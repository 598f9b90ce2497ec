"""The few file-system calls Spark has no DataFrame for, on whatever storage the path names."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

DELETES_AT_ONCE = 16


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark prints it, with scheme."""
    return _fs(spark, path).makeQualified(_path(spark, path)).toString()


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a directory; none if it does not exist."""
    if not exists(spark, path):
        return []
    return [s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path))]


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a file, or a directory with all it holds."""
    return _fs(spark, path).delete(_path(spark, path), True)


def delete_all(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete many files or directories, some at a time."""
    with ThreadPoolExecutor(DELETES_AT_ONCE) as pool:
        for _ in pool.map(lambda path: delete(spark, path), paths):
            pass


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file, or a directory with all it holds."""
    util, conf = spark._jvm.org.apache.hadoop.fs.FileUtil, spark._jsc.hadoopConfiguration()
    util.copy(_fs(spark, source), _path(spark, source), _fs(spark, target), _path(spark, target), False, conf)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any path fits a pattern with ``*``."""
    return bool(_fs(spark, pattern).globStatus(_path(spark, pattern)))


def write_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that appears whole or not at all, and never replaces another.

    The file is written under another name and renamed without overwriting, which on HDFS is
    one atomic step: of two writers of the same path, one gets an error.
    """
    folder, _, _ = path.rpartition("/")
    storage = _fs(spark, path)
    hidden = storage.makeQualified(_path(spark, f"{folder}/.{uuid.uuid4().hex}"))
    stream = storage.create(hidden, False)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(hidden.toUri(), spark._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
    try:
        context.rename(hidden, storage.makeQualified(_path(spark, path)), no_options)
    except Exception:
        storage.delete(hidden, False)
        raise
