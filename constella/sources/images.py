"""Directories of source images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.functions import naming as N
from constella.sources import store

_FILES = "*.{tif,tiff,TIF,TIFF,Tif,Tiff}"


def sample_dirs(spark: SparkSession, root: str) -> DataFrame:
    """The directories below ``root``, at any depth, that hold a file named GB*.tif, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "GB*.tif").load(root)
    return files.select(N.parent("path").alias("sample_dir")).distinct().orderBy("sample_dir")


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(sample_dir, path, name, role, ord) of templates and fields; 'ord' takes .tif files before .tiff files. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _FILES).load(root).select("path")
    return _named(files.withColumn("ord", F.struct(F.lower(N.base_name("path")).endswith(".tiff").alias("long"), N.base_name("path").alias("name"))))


def _named(files: DataFrame) -> DataFrame:
    # Sources write the scheme of local files with one slash or three.
    named = files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).withColumn("name", N.base_name("path")).withColumn("role", N.role("name")).withColumn("sample_dir", N.parent("path"))
    return named.filter("role is not null")


def read_images(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Templates and fields with their RGB rasters, decoded by Spark; the raster of an unreadable file is null.

    Of one root all directories below it are read, of a list of directories just the files that lie in them.
    """
    files = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", _FILES)
    files = files.option("recursiveFileLookup", "true").load(root) if isinstance(root, str) else files.load([store.literal(d) for d in root])
    # The image source names files by their escaped URI, other sources by their path.
    path = F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B")))
    flat = files.select(path.alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    raster = F.when(F.col("height") > 0, F.struct("height", "width", "channels", "data"))
    return _named(flat.select("path", raster.alias("raster")))


def unprocessed(images: DataFrame, cached: DataFrame) -> DataFrame:
    """Images of which no valid processed table row is there; of a template all squares must be valid."""
    good = cached.groupBy("path").agg(F.bool_and(F.col("error").isNull()).alias("valid")).filter("valid")
    return images.join(good, "path", "left_anti")


def processed(images: DataFrame, cached: DataFrame) -> DataFrame:
    good = cached.groupBy("path").agg(F.bool_and(F.col("error").isNull()).alias("valid")).filter("valid")
    return images.join(good, "path", "left_semi")


def first_template(images: DataFrame) -> DataFrame:
    """The first template image of each directory, .tif before .tiff."""
    return images.filter("role = 'red'").groupBy("sample_dir").agg(F.min_by("path", "ord").alias("path"))


def square_stems(images: DataFrame) -> DataFrame:
    """(sample_dir, green_square, stem): the field's file stem of each ordinal; of several the last one."""
    mm = F.nullif(F.regexp_extract("name", r"\.(\d+)mm", 1), F.lit(""))
    fields = images.filter("role = 'green'").withColumn("green_square", mm).filter("green_square is not null")
    return fields.groupBy("sample_dir", "green_square").agg(F.max_by(N.stem("name"), "ord").alias("stem"))


def latest_pictures(files: DataFrame) -> DataFrame:
    """(sample_dir, stem, path): of the pictures (path) of each field's particles and best matches the last one by name."""
    named = files.withColumn("sample_dir", N.parent(N.parent("path"))).withColumn("stem", F.regexp_extract(N.base_name("path"), "^(.*)_particles[.]png$", 1))
    return named.filter("stem <> ''").groupBy("sample_dir", F.regexp_replace("stem", r"^\d{4}-\d\d-\d\d[^_]*_", "").alias("stem")).agg(F.max("path").alias("path"))
