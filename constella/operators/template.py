"""Templates: a primary particle, and the offsets of the particles around it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from constella.functions import geometry as G
from constella.operators import neighbours as N


def primaries(particles: DataFrame) -> DataFrame:
    """The largest particle of each image by ``bbox_size``; of equal ones the first."""
    w = Window.partitionBy("image_key").orderBy(F.desc("bbox_size"), "particle_id")
    return particles.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank")


def relations(particles: DataFrame, radius: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """One row per relation: the offset from the primary, and how far from it a match may lie.

    Relations are the primary's neighbours, numbered in particle order; without a radius all other particles
    are. With ``limit`` only the nearest ones count, numbered by distance.
    """
    keys = ["image_key", "particle_id", "center_row", "center_col"]
    p = primaries(particles).select(*keys, *[c for c in ("sample_dir",) if c in particles.columns]).alias("p")
    r = particles.select(*keys).alias("r")
    on = (F.col("p.image_key") == F.col("r.image_key")) & (F.col("p.particle_id") != F.col("r.particle_id"))
    d = G.distance("p.center_row", "p.center_col", "r.center_row", "r.center_col")
    met = p.join(r, on)
    if radius is not None:
        met = met.join(radius.alias("q"), F.col("p.image_key") == F.col("q.image_key")).filter(d < F.col("q.radius"))
    dr, dc = F.col("r.center_row") - F.col("p.center_row"), F.col("r.center_col") - F.col("p.center_col")
    columns = [F.col("p.sample_dir")] if "sample_dir" in particles.columns else []
    out = met.select(*columns, F.col("p.image_key").alias("red_image"), F.col("p.particle_id").alias("primary_id"), F.col("r.particle_id").alias("relation_id"), dr.alias("dr"), dc.alias("dc"), G.search_distance(d).alias("search_distance"))
    by = [(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")), F.col("relation_id")] if limit else [F.col("relation_id")]
    out = out.withColumn("relation_no", F.row_number().over(Window.partitionBy("red_image").orderBy(*by)))
    return out.filter(F.col("relation_no") <= limit) if limit else out


def add_relation(relations_: DataFrame, more: DataFrame) -> DataFrame:
    """Relations with further ones appended; the primary itself and repeated ones are left out."""
    both = relations_.unionByName(more).filter("relation_id <> primary_id")
    w = Window.partitionBy("red_image", "relation_id").orderBy("relation_no")
    return both.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")
