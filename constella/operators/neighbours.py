"""Neighbour searches within images: k-th nearest distances, radii, and grid-bucketed distance joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from constella import constants as K
from constella.functions import geometry as G

POINT = ["image_key", "particle_id", "center_row", "center_col"]


#: Particles to a grid cell on the average, and how much wider the second grid's cells are.
PER_CELL, WIDER = 4, 8


def _grid(particles: DataFrame) -> DataFrame:
    """(image_key, size): cells that hold ``PER_CELL`` particles on the average."""
    extent = lambda c: (F.max(c) - F.min(c) + 1).cast("double")
    return particles.groupBy("image_key").agg(F.greatest(F.lit(1.0), F.ceil(F.sqrt(extent("center_row") * extent("center_col") * PER_CELL / F.count(F.lit(1))))).alias("size"))


def _kth_in_reach(points: DataFrame, others: DataFrame, k: int, size=None) -> DataFrame:
    """The k-th nearest of ``others`` in the nine cells around each point; without a size, in its whole image."""
    a, b = points, others.select(*[F.col(c).alias(f"_{c}") for c in POINT], *(["size"] if size is not None else []))
    on = (F.col("image_key") == F.col("_image_key")) & (F.col("particle_id") != F.col("_particle_id"))
    if size is not None:
        a = a.withColumn("_cell", cells(F.col("center_row"), F.col("center_col"), size, 0)[0])
        b = b.withColumn("_at", F.explode(cells(F.col("_center_row"), F.col("_center_col"), size, 1))).drop("size")
        on = on & (F.col("_cell") == F.col("_at"))
    pairs = a.join(b, on).withColumn("distance", G.distance("center_row", "center_col", "_center_row", "_center_col"))
    w = Window.partitionBy("image_key", "particle_id").orderBy("distance")
    # The bound on the row number lets every task drop farther neighbours before the shuffle.
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).filter(F.col("rank") == k).select(*points.columns, "distance")


def kth_distance(particles: DataFrame, k: int = K.NEIGHBOUR_RANK) -> DataFrame:
    """(image_key, particle_id, distance) of each particle's k-th nearest other particle of its image, if there is one.

    Particles meet on grid cells. What lies nearer than a cell's width lies in the nine cells around a particle, so
    a k-th distance up to that width is certain. The few others look into a grid of wider cells, and only those that
    this leaves open, which are remote or in images of hardly more than k particles, meet their whole image.
    """
    points = particles.select(*POINT).join(_grid(particles), "image_key")
    key, kept = ["image_key", "particle_id"], [*POINT, "size"]
    near = _kth_in_reach(points, points, k, F.col("size")).filter(F.col("distance") <= F.col("size")).select(*key, "distance")
    rest = points.join(near, key, "left_anti").select(*kept)
    wide = _kth_in_reach(rest, points, k, F.col("size") * WIDER).filter(F.col("distance") <= F.col("size") * WIDER).select(*key, "distance")
    far = _kth_in_reach(rest.join(wide, key, "left_anti").select(*kept), points, k).select(*key, "distance")
    return near.unionByName(wide).unionByName(far)


def search_radius(particles: DataFrame, k: int = K.NEIGHBOUR_RANK) -> DataFrame:
    """(image_key, radius): the median k-th distance of an image, widened; a fixed one for images of k particles or fewer."""
    medians = kth_distance(particles, k).groupBy("image_key").agg(F.median("distance").alias("m"))
    images = particles.select("image_key").distinct()
    return images.join(medians, "image_key", "left").select("image_key", F.when(F.col("m").isNull(), F.lit(K.FALLBACK_RADIUS)).otherwise(G.neighbour_radius("m")).alias("radius"))


def cells(row, col, size, reach: int):
    """The grid cells within ``reach`` cells of a point, as an array of (r, c)."""
    r, c = F.floor(row / size).cast("long"), F.floor(col / size).cast("long")
    return F.array(*[F.struct((r + dr).alias("r"), (c + dc).alias("c")) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1)])


def within_radius(particles: DataFrame, radius: DataFrame) -> DataFrame:
    """Pairs (particle, neighbour) of one image nearer than the image's radius, itself excluded.

    Points meet on grid cells as wide as the radius, so a dense image costs its neighbours, not its square.
    """
    points = particles.select(*POINT).join(radius, "image_key")
    a = points.withColumn("cell", F.explode(cells(F.col("center_row"), F.col("center_col"), F.col("radius"), 1))).alias("a")
    b = points.withColumn("cell", cells(F.col("center_row"), F.col("center_col"), F.col("radius"), 0)[0]).alias("b")
    d = G.distance("a.center_row", "a.center_col", "b.center_row", "b.center_col")
    met = a.join(b, (F.col("a.image_key") == F.col("b.image_key")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.particle_id") != F.col("b.particle_id")) & (d < F.col("a.radius")))
    return met.select("a.image_key", "a.particle_id", F.col("b.particle_id").alias("neighbour_id"), d.alias("distance"))


def neighbour_lists(particles: DataFrame, radius: DataFrame) -> DataFrame:
    """Particles with ``nearby_particle_ids``, in particle order."""
    lists = within_radius(particles, radius).groupBy("image_key", "particle_id").agg(F.sort_array(F.collect_list("neighbour_id")).alias("nearby_particle_ids"))
    out = particles.join(lists, ["image_key", "particle_id"], "left")
    return out.withColumn("nearby_particle_ids", F.coalesce("nearby_particle_ids", F.array().cast("array<int>")))


def neighbour_distance_sum(particles: DataFrame, radius: DataFrame) -> DataFrame:
    return within_radius(particles, radius).groupBy("image_key", "particle_id").agg(F.sum("distance").alias("total"))
