"""Review decisions applied to result tables: overrides in each directory's table, then the master tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from constella import schemas
from constella.functions import naming as N
from constella.operators import rollups
from constella.sources import results

DECISION = "sample_dir string, red_square string, green_square string, index int"


def candidates(rows: DataFrame, best_only: bool = True) -> DataFrame:
    """What a reviewer is shown: each pair's best row, or all of its rows, numbered from 0 as decisions name them."""
    ranked = rollups.top_k(rows, ["sample_dir", "red_square", "green_square"], [F.col("percentage").cast("double").desc(), "ord"], 1 if best_only else 1 << 30)
    return ranked.withColumn("index", F.col("rank") - 1).drop("rank")


def apply(spark: SparkSession, root: str, decisions: DataFrame) -> tuple[str, str]:
    """Marks the chosen rows of every directory that a decision names, rewrites their tables in one job, and writes the master tables.

    Decisions name directories by their keys below ``root``, or by their paths.
    """
    named = decisions.withColumn("sample_dir", N.directory_key("sample_dir", F.lit(root)))
    rows = results.read_all(spark, root)
    rows = rows.withColumn("sample_dir", N.directory_key("sample_dir", F.lit(root)))
    marked = rollups.apply_overrides(rows.join(named.select("sample_dir").distinct(), "sample_dir", "left_semi"), named)
    columns = [c.split(" ")[0] for c in schemas.PERCENTAGE_CSV.split(", ")]
    text = marked.select("sample_dir", *[results.six_places(c).alias(c) if c == "percentage" else c for c in columns], "ord")
    results.write_each(text, [F.col("ord")], columns, root, "percentage_data.csv")
    return results.write_master(spark, root)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION).option("header", "true").csv(path)
