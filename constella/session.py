"""Sessions and command-line settings."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def session(name: str = "constella", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session with adaptive plans; on a cluster all else comes from its own settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if master or cores:
        builder = builder.master(master or f"local[{cores}]")
    return builder.getOrCreate()


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description="Match particle constellations in directories of microscopy images")
    p.add_argument("root")
    p.add_argument("--out")
    p.add_argument("--master")
    p.add_argument("--process-only", action="store_true", help="process images, don't match")
    p.add_argument("--always-process", action="store_true", help="process images that have a valid cached result, too")
    p.add_argument("--opening", choices=["flat_disk", "nonflat_compat"], default="flat_disk")
    p.add_argument("--annotate", action="store_true", help="write pictures: annotated fields, particles, review sheets")
    p.add_argument("--decisions", metavar="FILE", help="apply review decisions to the results of an earlier run")
    p.add_argument("--verbose", action="store_true", help="log warnings and errors of images")
    p.add_argument("--retry-failed", action="store_true")
    resume = p.add_mutually_exclusive_group()
    resume.add_argument("--resume", metavar="RUN_ID")
    resume.add_argument("--resume-latest", action="store_true")
    return p.parse_args(argv)
