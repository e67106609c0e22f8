"""Views of the given tables as the engine's own: embeddings as particles, events as a run log, orders as result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One particle per embedding: the label is the image, the first elements are its place and size. All images lie in one directory."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("samples").alias("sample_dir"), F.col("label").alias("image_key"), F.col("vec_id").alias("particle_id"),
        F.floor(e(0) * 1000).cast("int").alias("center_row"), F.floor(e(1) * 1000).cast("int").alias("center_col"), (F.abs(F.floor(e(2) * 1000)) + 1).cast("int").alias("bbox_size"),
    )


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(spark, sf_dir).filter("image_key % 5 = 0")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return particles(spark, sf_dir).filter("image_key % 5 <> 0")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log: users are directories, the number in ``props`` is the attempt."""
    kinds = F.create_map(*[F.lit(x) for k, v in enumerate(("completed", "failed", "started", "queued")) for x in (k, f"directory_{v}")])
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sample_dir"), F.col("event_id").alias("ord"), kinds[(F.col("event_id") % 5).cast("int")].alias("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("attempt"),
    )


def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as result rows: priority and status are the squares, the price is the percentage."""
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("/root/set"), F.col("o_custkey") % 7).alias("sample_dir"), F.col("o_orderpriority").alias("red_square"), F.col("o_orderstatus").alias("green_square"),
        F.round(F.col("o_totalprice") / 1000, 6).alias("percentage"), (F.col("o_orderkey") % 100).cast("double").alias("distance"), F.col("o_custkey").cast("string").alias("particle_details"), F.col("o_orderkey").alias("ord"),
    )
