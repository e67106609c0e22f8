"""Single small files in whichever store a path names, by Hadoop's file systems."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, for readers and writers that don't go through Spark."""
    fs, p = _at(spark, path)
    full = fs.makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def literal(path: str) -> str:
    """A path that means itself where patterns are understood."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _at(spark, pattern)
    return [x.getPath().toString() for x in fs.globStatus(p) or []]


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; whether there was none yet."""
    fs, p = _at(spark, path)
    if not fs.createNewFile(p):
        return False
    _write(fs, p, text)
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file beside and moves it into its place."""
    fs, p = _at(spark, path)
    _, beside = _at(spark, f"{path}.new")
    _write(fs, beside, text)
    fs.delete(p, True)
    if not fs.rename(beside, p):
        raise OSError(f"{beside} can't be renamed")


def _write(fs, p, text: str) -> None:
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
