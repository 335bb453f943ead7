"""File housekeeping through Hadoop's file system, so that it works on local paths and shared stores alike."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a file exists and has no bytes."""
    fs, p = _place(spark, path)
    return bool(fs.exists(p)) and not fs.getFileStatus(p).isDirectory() and fs.getFileStatus(p).getLen() == 0


def create_directory(spark: SparkSession, path: str) -> str:
    """Make a directory and its parents; nothing happens if it is there."""
    fs, p = _place(spark, path)
    fs.mkdirs(p)
    return path


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or directory, in place of what is there."""
    a, p = _place(spark, source)
    b, q = _place(spark, target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, spark._jsc.hadoopConfiguration())


@contextmanager
def temporary(spark: SparkSession, directory: str, suffix: str = "") -> Iterator[str]:
    """A fresh path below a directory; what was put there is removed on leaving."""
    path = f"{directory.rstrip('/')}/tmp_{uuid.uuid4().hex}{suffix}"
    try:
        yield path
    finally:
        fs, p = _place(spark, path)
        fs.delete(p, True)
