"""Shared-folder tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files when it ends; those behind a written table are of no further use.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one is made only for local masters that name none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found and "://" not in found:
        # A bare path means the cluster's default store; writers that don't go through Spark need its name, too.
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found)
        found = re.sub("^file:/+", "file:///", p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="constella-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Bytes of a row group of tables between steps.
ROW_GROUP = 16 << 20
#: Folders made by this process and not deleted yet, and those of the scopes that are open.
_made: list[str] = []
_scopes: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/constella/{name}-{uuid.uuid4().hex}"
    for known in (_made, *_scopes):
        known.append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """Within it, the list that it gives gets every folder that is made."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield own
    finally:
        _scopes[:] = [s for s in _scopes if s is not own]  # scopes of equal content are not the same


def discard(spark: SparkSession, paths: list[str], *keep: DataFrame) -> None:
    """Delete folders, but for those of the tables to keep."""
    kept = {f.rsplit("/", 1)[0].replace("file:///", "file:/") for t in keep for f in t.inputFiles()}
    for path in list(paths):
        if path.replace("file:///", "file:/") not in kept:
            delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table that this process has made and not deleted: for when the results that read them have been used."""
    discard(spark, _made)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are deleted when the query ends."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


#: Seconds between two times that the driver gives memory back, and when it last did.
PAUSE = 5
_given_back = 0.0


def give_back(spark: SparkSession) -> None:
    """The driver's JVM collects its garbage, shrinks its heap and gives what its threads have freed back to the system.

    Many short queries leave plans on the heap, and buffers of compilers and threads in malloc's arenas, which would
    otherwise grow to their limits.
    """
    global _given_back
    if time.monotonic() - _given_back < PAUSE:
        return
    jvm = spark.sparkContext._jvm
    jvm.java.lang.System.gc()
    with suppress(Exception):  # other virtual machines and C libraries do so by themselves
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class isn't exported; its interface is.
        next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke").invoke(server, args)
    _given_back = time.monotonic()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    with tidy(spark):
        # A writer holds a row group in memory; these are read once or twice, and soon deleted.
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder with Hadoop's file system, whichever store holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def make_dir(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def drop(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` made and that no later plan reads."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete(t.sparkSession, re.sub("^file:/+", "file:///", folder))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` doesn't have, compared without case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
