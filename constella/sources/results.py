"""Result files: the CSV dialect of percentages and distances, master tables, and caches of processed images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from constella import constants as K, schemas
from constella.functions import naming as N
from constella.operators import rollups
from constella.sources import store

NUMBERS = ["percentage", "distance", "base_score", "completeness_ratio", "geometry_consistency"]


def six_places(column: str):
    return F.format_string("%.6f", F.col(column).cast("double"))


def scores_json(column: str):
    """Scores rounded to six places as a JSON array with a blank after each comma."""
    return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: F.regexp_replace(F.round(x, 6).cast("string"), "^-0.0$", "0.0")), ", "), F.lit("]"))


def percentage_text(rows: DataFrame) -> DataFrame:
    """Typed result rows as the texts of their CSV, in order of field and template."""
    ordered = rows.orderBy(rollups.number("green_square"), rollups.number("red_square"), "ord")
    return ordered.select("red_square", "green_square", *[six_places(c).alias(c) for c in NUMBERS], scores_json("individual_scores").alias("individual_scores"), "particle_details")


def _csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option("lineSep", "\n").option("emptyValue", "").csv(path)


def write_percentages(rows: DataFrame, path: str) -> None:
    """One directory's result rows; quotes within a field are doubled."""
    _csv(percentage_text(rows), path)


def write_distances(rows: DataFrame, path: str) -> None:
    _csv(rows.orderBy(rollups.number("green_square"), rollups.number("red_square"), "ord").select("red_square", "green_square", six_places("horizontal_distance").alias("horizontal_distance")), path)


def read_csv(spark: SparkSession, path: str | list[str], schema: str = schemas.PERCENTAGE_CSV) -> DataFrame:
    """Texts of a result CSV with their file and place in it; fields may hold doubled quotes and line breaks."""
    rows = spark.read.schema(schema).option("header", "true").option("multiLine", "true").option("escape", '"').option("quote", '"').csv(path)
    return rows.withColumn("file", F.input_file_name()).withColumn("ord", F.monotonically_increasing_id())


def read_all(spark: SparkSession, root: str, name: str = "percentage_data.csv") -> DataFrame:
    """The result rows of all directories below ``root``: <sample_dir>/data/<name>, a file or a folder of parts. None there gives no rows."""
    rows = spark.read.schema(schemas.PERCENTAGE_CSV).option("header", "true").option("multiLine", "true").option("escape", '"').option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(root)
    # Files are named by their escaped URIs here.
    rows = rows.withColumn("file", F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))).withColumn("ord", F.monotonically_increasing_id())
    found = F.regexp_extract("file", rf"^(.*)/data/{name.replace('.', '[.]')}(?:/[^/]*)?$", 1)
    return rows.withColumn("sample_dir", found).filter("sample_dir <> ''")


def rewrite(rows: DataFrame, path: str) -> None:
    """Replaces a table that ``rows`` may be read from: written beside it first."""
    spark = rows.sparkSession
    _csv(rows, f"{path}.tmp")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp"), jvm.org.apache.hadoop.fs.Path(path)
    fs = new.getFileSystem(conf)
    fs.delete(old, True)
    fs.rename(new, old)


def write_master(spark: SparkSession, root: str) -> tuple[str, str]:
    """All directories' rows, and the best row of each key, as tables at the root."""
    rows = read_all(spark, root).withColumn("percentage", F.col("percentage").cast("double")).drop("file").cache()
    columns = ["sample_dir", *[c.split(" ")[0] for c in schemas.PERCENTAGE_CSV.split(", ")]]
    for name, table in (("master_percentage_data.csv", rollups.master(rows)), ("master_percentage_data_best.csv", rollups.master_best(rows))):
        _csv(table.orderBy("sample_dir", "ord").select(*[six_places(c).alias(c) if c == "percentage" else c for c in columns]), f"{root}/{name}")
    rows.unpersist()
    return f"{root}/master_percentage_data.csv", f"{root}/master_percentage_data_best.csv"


def read_legacy_caches(spark: SparkSession, path: str) -> DataFrame:
    """JSON caches of processed images, versions 1 and 2, with ``valid`` saying whether all that is needed is there."""
    rows = spark.read.schema(schemas.CACHE_JSON).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_processed_data.json").json(path)
    rows = rows.withColumn("file", F.input_file_name()).withColumn("version", F.coalesce("schema_version", F.lit(1)))
    shape = F.col("image_shape")
    pixels = (F.size(shape).isin(2, 3)) & F.forall(shape, lambda x: x > 0) & F.col("image_dtype").isNotNull() & (F.col("image_dtype") != "object") & F.col("image_cache_file").isNotNull()
    image = F.when(F.col("version") == 1, F.size("image_data") > 0).otherwise(pixels)
    templates = F.when(N.base_name("file").rlike("redsquare|(?i)locations fixed"), F.col("relations.primary_particle_id").isNotNull() & F.col("relations.relation_ids").isNotNull()).otherwise(F.lit(True))
    valid = F.col("_corrupt_record").isNull() & (F.col("version") <= 2) & F.col("particles").isNotNull() & image & templates
    return rows.withColumn("valid", F.coalesce(valid, F.lit(False)))


def legacy_images(caches: DataFrame) -> DataFrame:
    """(image_key, raster) of valid caches: version 1 from its nested list, version 2 from the array file beside it. A file that doesn't fit gives null."""
    import numpy as np
    import pyarrow as pa

    from constella.functions import codecs

    spark = caches.sparkSession
    valid = caches.filter("valid").select(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("image_key"), "version", "image_cache_file", "image_shape", "image_dtype", "image_data")
    valid = valid.withColumn("path", F.concat(N.parent("image_key"), F.lit("/"), "image_cache_file"))
    folders = [r[0] for r in valid.select(N.parent("image_key")).distinct().collect()]  # one row per directory of caches
    if folders:
        arrays = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folders).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        valid = valid.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).join(arrays, "path", "left")
    else:
        valid = valid.withColumn("content", F.lit(None).cast("binary"))
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())])

    def decode(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                image = np.array(row["image_data"], np.uint8) if row["version"] == 1 else codecs.npy(row["content"], row["image_shape"], row["image_dtype"]) if row["content"] else None
                image = image[..., None] if image is not None and image.ndim == 2 else image
                out.append(None if image is None else {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": np.ascontiguousarray(image, np.uint8).tobytes()})
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["image_key", "raster"])

    return valid.select("image_key", "version", "image_shape", "image_dtype", "image_data", "content").mapInArrow(decode, f"image_key string, raster {schemas.RASTER}")


def legacy_particles(caches: DataFrame) -> DataFrame:
    """One row per cached particle; neighbours stay identifiers."""
    p = caches.filter("valid").select("file", F.explode("particles").alias("p"))
    corner = lambda k, j: F.col("p.corner_coordinates")[k][j]
    return p.select(
        F.col("file").alias("image_key"), F.col("p.id").alias("particle_id"), corner(0, 0).alias("min_row"), corner(0, 1).alias("min_col"), corner(1, 0).alias("max_row"), corner(1, 1).alias("max_col"),
        F.col("p.center_position")[0].alias("center_row"), F.col("p.center_position")[1].alias("center_col"), F.col("p.color").alias("color"),
        F.transform("p.nearby_particle_ids", lambda x: F.nullif(x, F.lit(-1))).alias("nearby_particle_ids"),
    )


def legacy_relations(caches: DataFrame) -> DataFrame:
    """(red_image, primary_id, relation_no, relation_id), offsets and constants of cached templates; a relation without its particle has no offsets."""
    r = caches.filter("valid and relations is not null").select(F.col("file").alias("red_image"), F.col("relations.primary_particle_id").alias("primary_id"), F.col("relations").alias("_own"), F.posexplode("relations.relation_ids").alias("pos", "relation_id"))
    places = legacy_particles(caches).select(F.col("image_key").alias("red_image"), "particle_id", "center_row", "center_col")
    first = places.toDF("red_image", "primary_id", "_r", "_c")
    other = places.toDF("red_image", "relation_id", "_rr", "_cc")
    joined = r.join(first, ["red_image", "primary_id"], "left").join(other, ["red_image", "relation_id"], "left")
    return joined.select("red_image", "primary_id", (F.col("pos") + 1).alias("relation_no"), "relation_id", (F.col("_rr") - F.col("_r")).alias("dr"), (F.col("_cc") - F.col("_c")).alias("dc"), *[F.coalesce(F.col("_own")[k], F.lit(float(v))).alias(k) for k, v in (("offset_angle", K.OFFSET_ANGLE), ("search_distance_modifier", K.SEARCH_FACTOR), ("max_search_distance", K.MAX_SEARCH_DISTANCE))])


def particle_json(particles: DataFrame):
    """A particle as the one-line JSON document of the reports."""
    return F.to_json(F.struct(
        F.col("particle_id").alias("id"), F.array(F.array("min_row", "min_col"), F.array("max_row", "max_col")).alias("corner_coordinates"), F.array("center_row", "center_col").alias("center_position"),
        "color", *(["nearby_particle_ids"] if "nearby_particle_ids" in particles.columns else []),
    ))


def relations_json(relations: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Templates as JSON documents: identifiers, constants, and with ``matches`` (red_image, relation_id, candidate_id) the equivalent particles."""
    whole = relations.groupBy("red_image", "primary_id").agg(F.sort_array(F.collect_list(F.struct("relation_no", "relation_id"))).alias("r"))
    if matches is None:
        whole = whole.withColumn("e", F.array().cast("array<array<bigint>>"))
    else:
        pairs = matches.groupBy("red_image").agg(F.sort_array(F.collect_set(F.array(F.col("relation_id").cast("long"), F.col("candidate_id").cast("long")))).alias("e"))
        whole = whole.join(pairs, "red_image", "left").withColumn("e", F.coalesce("e", F.array().cast("array<array<bigint>>")))
    constants = [F.lit(float(v)).alias(k) for k, v in (("offset_angle", K.OFFSET_ANGLE), ("search_distance_modifier", K.SEARCH_FACTOR), ("max_search_distance", K.MAX_SEARCH_DISTANCE))]
    return whole.select("red_image", F.to_json(F.struct(F.col("primary_id").alias("primary_particle_id"), F.transform("r", lambda x: x["relation_id"]).alias("relation_ids"), F.col("e").alias("equivalent_particles"), *constants)).alias("relations"))


def write_particles(particles: DataFrame, path: str) -> None:
    """Particles of all fields as a table partitioned by directory; other directories' rows stay."""
    write_directories(particles, path)


def write_directories(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample_dir").parquet(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files below a folder, from the executors; names are the rows' own, so a repeated task writes the same."""
    from collections.abc import Iterator

    import pyarrow as pa

    folder = store.qualified(files.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        n, made = 0, set()
        for batch in batches:
            for name, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = f"{root}/{name}"
                if (parent := place.rpartition("/")[0]) not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                with system.open_output_stream(place) as out:
                    out.write(raw)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    return files.select("name", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def _csv_line(columns: list[str]):
    """A CSV line of text columns: fields with quotes, commas or line breaks are quoted, quotes in them doubled."""
    one = lambda c: F.when(F.col(c).rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *map(one, columns))


def write_each(rows: DataFrame, order: list, columns: list[str], root: str, file: str) -> int:
    """One CSV file for each ``sample_dir`` of ``rows``, ``root``/<sample_dir>/data/<file>, all in one job; returns their number.

    A directory's rows stream through one task, as they make one file. Files are written beside their places and
    moved there when all are, so ``rows`` may come from the files that they replace.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    spark = rows.sparkSession
    uri, header = store.qualified(spark, root), ",".join(columns) + "\n"
    lines = rows.select("sample_dir", _csv_line(columns).alias("line"), *[o.alias(f"_o{k}") for k, o in enumerate(order)]).repartition("sample_dir").sortWithinPartitions("sample_dir", *[f"_o{k}" for k in range(len(order))]).select("sample_dir", "line")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(uri)
        now, out, made = None, None, []
        for batch in batches:
            for key, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    if out:
                        out.close()
                    folder = f"{base}/{key}/data"
                    system.create_dir(folder, recursive=True)
                    made.append((f"{folder}/{file}.{TaskContext.get().taskAttemptId()}", f"{folder}/{file}"))
                    now, out = key, system.open_output_stream(made[-1][0])
                    out.write(header.encode())
                out.write(f"{line}\n".encode())
        if out:
            out.close()
        yield pa.record_batch([pa.array([m[k] for m in made], pa.string()) for k in (0, 1)], ["written", "place"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(uri)
        n = 0
        for batch in batches:
            for written, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A repeated task finds what it moved before in its place.
                if system.get_file_info(written).type != fs.FileType.NotFound:
                    if system.get_file_info(place).type == fs.FileType.Directory:
                        system.delete_dir(place)
                    system.move(written, place)
                n += 1
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    made = lines.mapInArrow(write, "written string, place string").collect()  # one row per directory
    return spark.createDataFrame(made, "written string, place string").mapInArrow(move, "n long").agg(F.sum("n")).first()[0] or 0


def write_all_percentages(rows: DataFrame, root: str) -> int:
    """The result table of each directory."""
    order = [rollups.number("green_square"), rollups.number("red_square"), F.col("ord")]
    text = rows.select("sample_dir", "red_square", "green_square", *[six_places(c).alias(c) for c in NUMBERS], scores_json("individual_scores").alias("individual_scores"), "particle_details", "ord")
    return write_each(text, order, [c.split(" ")[0] for c in schemas.PERCENTAGE_CSV.split(", ")], root, "percentage_data.csv")


def write_all_distances(rows: DataFrame, root: str) -> int:
    order = [rollups.number("green_square"), rollups.number("red_square"), F.col("ord")]
    text = rows.select("sample_dir", "red_square", "green_square", six_places("horizontal_distance").alias("horizontal_distance"), "ord")
    return write_each(text, order, ["red_square", "green_square", "horizontal_distance"], root, "horizontal_distance.csv")
