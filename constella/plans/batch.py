"""The whole method: images to particles, particles to ranked matches, matches to tables and pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from constella import constants as K, schemas
from constella.functions import codecs, geometry as G, naming as N, raster as R
from constella.operators import matching, neighbours, template
from constella.sources import images as sources, results, store


def _raster(image: np.ndarray) -> dict:
    return {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": np.ascontiguousarray(image, np.uint8).tobytes()}


def pixels(raster: dict, bgr: bool = False) -> np.ndarray:
    """A raster row's pixels; Spark's image source orders them blue first, and alpha is dropped."""
    out = np.frombuffer(raster["data"], np.uint8).reshape(raster["height"], raster["width"], raster["channels"])
    return out[..., 2::-1] if bgr and raster["channels"] >= 3 else out


def particle_rows(image: np.ndarray) -> list[dict]:
    """The particles of a cleaned image, numbered in scan order."""
    out = []
    for number, (r0, c0, r1, c1, n) in enumerate(R.detect(image).tolist(), 1):
        own = R.crop(image, (r0, c0, r1, c1))
        colour = R.colour(own)
        dr, dc = r1 - r0, c1 - c0
        out.append({
            "particle_id": number, "min_row": r0, "min_col": c0, "max_row": r1, "max_col": c1, "pixel_count": n, "center_row": (r0 + r1) // 2, "center_col": (c0 + c1) // 2,
            "bbox_size": dr * dc if dr and dc else dr + dc, "color": None if colour is None else colour.tolist(), "crop": _raster(own),
        })
    return out


def _process_one(role: str, image: np.ndarray, opening_mode: str) -> list[tuple[str, np.ndarray]]:
    """(suffix, cleaned crop) of an image: one of a field, one for each box of a template."""
    if role == "green":
        crop = R.green_square(image)
        if crop is None:
            raise ValueError("no green border")
        return [("", R.remove_colour_aggregates(R.process(crop, opening_mode)))]
    squares = R.red_squares(image)
    if not squares:
        raise ValueError("no red square")
    return [(f"_redsquare{k}" if len(squares) > 1 else "", R.process(s, opening_mode)) for k, s in enumerate(squares)]


def _doubts(role: str, image: np.ndarray) -> str | None:
    """Edges of a field's border that are green for too small a part."""
    weak = {k: v for k, v in R.edge_coverage(image).items() if v < K.EDGE_COVERAGE} if role == "green" else {}
    return "border: " + ", ".join(f"{k} {v:.2f}" for k, v in weak.items()) if weak else None


def process_images(images: DataFrame, opening_mode: str = "flat_disk") -> DataFrame:
    """Crops, cleans and searches every image, one at a time in memory; a failed one gives a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kind)
        for batch in batches:
            for row in batch.to_pylist():
                base = {k: row[k] for k in ("sample_dir", "role", "path")} | {"warning": None}
                out = []
                try:
                    if row["raster"] is None or row["raster"]["channels"] < 3:
                        raise ValueError("not a colour image")
                    base["warning"] = _doubts(row["role"], pixels(row["raster"], True))
                    for suffix, cleaned in _process_one(row["role"], pixels(row["raster"], True), opening_mode):
                        key = row["path"] if not suffix else f"{row['path'].rpartition('.')[0]}{suffix}.{row['path'].rpartition('.')[2]}"
                        out.append(base | {"image_key": key, "error": None, "raster": _raster(cleaned), "particles": particle_rows(cleaned)})
                except (ValueError, IndexError) as e:
                    out = [base | {"image_key": row["path"], "error": str(e), "raster": None, "particles": None}]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    spark = images.sparkSession
    kind = spark.createDataFrame([], schemas.PROCESSED).schema
    return images.select("sample_dir", "role", "path", "raster").mapInArrow(run, schemas.PROCESSED)


def particles(processed: DataFrame) -> DataFrame:
    """One row per particle of the images that went well."""
    return processed.filter("error is null").select("sample_dir", "image_key", "role", F.explode("particles").alias("p")).select("sample_dir", "image_key", "role", "p.*")


def failures(processed: DataFrame) -> DataFrame:
    return processed.filter("error is not null").select("sample_dir", "path", "error")


def match_images(found: DataFrame, top: int | None = None) -> DataFrame:
    """Ranked result rows of all templates and fields of a directory, with the legacy keys and the particle's document."""
    red, green = found.filter("role = 'red'"), found.filter("role = 'green'")
    relations = template.relations(red, neighbours.search_radius(red))
    matches = matching.matched(matching.candidates(relations, green))
    scored = matching.percentages(relations, green, matches)
    best = matching.top(scored, top) if top else matching.top(scored)
    listed = neighbours.neighbour_lists(green.drop("crop"), neighbours.search_radius(green))
    details = listed.select("sample_dir", F.col("image_key").alias("green_image"), F.col("particle_id").alias("anchor_id"), results.particle_json(listed).alias("particle_details"))
    out = best.join(details, ["green_image", "anchor_id"]).join(_drawings(best, relations, green, matches), ["red_image", "green_image", "anchor_id"], "left")
    red_name, green_name = N.base_name("red_image"), N.base_name("green_image")
    return out.select("sample_dir", N.red_square(red_name).alias("red_square"), N.green_square(green_name).alias("green_square"), "red_image", "green_image", "anchor_id", "percentage", F.col("horizontal_distance").alias("distance"), "base_score", "completeness_ratio", "geometry_consistency", "individual_scores", "particle_details", F.col("rank").alias("ord"), "matched_ids", "drawing")


def _drawings(best: DataFrame, relations: DataFrame, green: DataFrame, matches: DataFrame) -> DataFrame:
    """For the best anchor of each pair: every relation's wanted point, reach, and matched point if any."""
    anchors = best.filter("rank = 1").select("red_image", "green_image", "anchor_id")
    at = green.select(F.col("image_key").alias("green_image"), F.col("particle_id").alias("anchor_id"), F.col("center_row").alias("_r"), F.col("center_col").alias("_c"))
    wanted = anchors.join(at, ["green_image", "anchor_id"]).join(relations.select("red_image", "relation_no", "dr", "dc", F.col("search_distance").alias("reach")), "red_image")
    found = matches.select("red_image", "green_image", "anchor_id", "relation_no", F.col("center_row").alias("row"), F.col("center_col").alias("col"))
    every = wanted.join(found, ["red_image", "green_image", "anchor_id", "relation_no"], "left")
    own = F.struct("relation_no", (F.col("_r") + F.col("dr")).alias("want_row"), (F.col("_c") + F.col("dc")).alias("want_col"), "reach", "row", "col")
    return every.groupBy("red_image", "green_image", "anchor_id").agg(F.sort_array(F.collect_list(own)).alias("drawing"))


def horizontal_rows(ranked: DataFrame) -> DataFrame:
    """The best match's horizontal distance of each template and field."""
    return ranked.filter("ord = 1").select("sample_dir", "red_square", "green_square", F.col("distance").alias("horizontal_distance"), "ord")


def _file(key, suffix: str):
    return F.concat(N.stem(N.base_name(key)), F.lit(suffix))


def annotated(processed: DataFrame, ranked: DataFrame) -> DataFrame:
    """(sample_dir, name, content): each field as PNG with its particles boxed in red and, on one picture for all templates, the best match of each drawn.

    Annotation works on copies; the stored rasters stay as they were processed.
    """
    best = ranked.filter("ord = 1").groupBy(F.col("green_image").alias("image_key")).agg(F.sort_array(F.collect_list(F.struct("red_image", "anchor_id", "drawing"))).alias("best"))
    boxes = F.transform("particles", lambda p: F.struct(p["particle_id"].alias("id"), F.array(p["min_row"], p["min_col"], p["max_row"], p["max_col"]).alias("box")))
    rows = processed.filter("error is null").join(best, "image_key", "left").select("sample_dir", _file("image_key", "_particles.png").alias("name"), "raster", boxes.alias("boxes"), "best")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = plain = pixels(row["raster"])
                found = {b["id"]: b["box"] for b in row["boxes"]}
                anchors = {m["anchor_id"] for m in row["best"] or ()}
                for key, box in found.items():
                    image = R.draw_box(image, box, (0, 255, 0) if key in anchors else (255, 0, 0))
                for number, m in enumerate(row["best"] or ()):
                    box = found[m["anchor_id"]]
                    wanted = [(d["want_row"], d["want_col"]) for d in m["drawing"] or ()]
                    hits = [None if d["row"] is None else (d["row"], d["col"]) for d in m["drawing"] or ()]
                    image = R.draw_match(image, ((box[0] + box[2]) // 2, (box[1] + box[3]) // 2), wanted, hits, [d["reach"] for d in m["drawing"] or ()], [(box, R.crop(plain, box))], number)
                yield pa.record_batch([pa.array([row["sample_dir"]]), pa.array([row["name"]]), pa.array([codecs.png(image, 2400)], pa.binary())], ["sample_dir", "name", "content"])

    return rows.mapInArrow(draw, "sample_dir string, name string, content binary")


def particle_pictures(found: DataFrame) -> DataFrame:
    """(sample_dir, name, content): each particle's crop as PNG, on black of the largest particle's size in its directory, numbered within it."""
    sizes = found.groupBy("sample_dir").agg(F.max(F.col("max_row") - F.col("min_row") + 1).alias("_height"), F.max(F.col("max_col") - F.col("min_col") + 1).alias("_width"))
    w = Window.partitionBy("sample_dir").orderBy("image_key", "particle_id")
    rows = found.withColumn("_n", F.row_number().over(w)).join(sizes, "sample_dir")
    name = F.concat(_file("image_key", "_num"), F.col("_n").cast("string"), F.lit(".png"))
    rows = rows.select("sample_dir", "image_key", "particle_id", name.alias("name"), "crop", "_height", "_width")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codecs.png(R.padded(pixels(r["crop"]), r["_height"], r["_width"]), 2400) for r in batch.to_pylist()]
            yield pa.record_batch([*batch.columns[:4], pa.array(made, pa.binary())], ["sample_dir", "image_key", "particle_id", "name", "content"])

    return rows.mapInArrow(draw, "sample_dir string, image_key string, particle_id int, name string, content binary")


def review_sheets(ranked: DataFrame, found: DataFrame, page: int = K.PAGE_SIZE) -> DataFrame:
    """(sample_dir, name, content): the anchors of each pair's best rows, ``page`` to a sheet, numbered from 0 as decisions name them."""
    crops = found.filter("role = 'green'").select(F.col("image_key").alias("green_image"), F.col("particle_id").alias("anchor_id"), "crop")
    rows = ranked.join(crops, ["green_image", "anchor_id"]).withColumn("index", F.col("ord") - 1)
    rows = rows.withColumn("sheet", F.floor(F.col("index") / page))
    name = F.concat(_file("green_image", "_redsquare"), "red_square", F.lit("_sheet"), F.col("sheet").cast("string"), F.lit(".png"))
    sheets = rows.groupBy("sample_dir", name.alias("name")).agg(F.sort_array(F.collect_list(F.struct("index", "crop"))).alias("items"))  # a page of crops

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [codecs.png(R.sheet([pixels(i["crop"]) for i in items], [i["index"] for i in items])) for items in batch.column(2).to_pylist()]
            yield pa.record_batch([*batch.columns[:2], pa.array(made, pa.binary())], ["sample_dir", "name", "content"])

    return sheets.mapInArrow(draw, "sample_dir string, name string, content binary")


def template_documents(found: DataFrame) -> DataFrame:
    """(sample_dir, red_image, relations): each template as a JSON document."""
    red = found.filter("role = 'red'")
    made = template.relations(red, neighbours.search_radius(red))
    return results.relations_json(made).join(made.select("sample_dir", "red_image").distinct(), "red_image")


def in_directories(pictures: DataFrame, root: str, folder: str = "pictures") -> DataFrame:
    """Pictures named by their directory's key below ``root``."""
    return pictures.withColumn("name", F.concat_ws("/", N.directory_key("sample_dir", F.lit(root)), F.lit(folder), "name"))


def current(spark: SparkSession, out: str, listed: DataFrame | None = None) -> DataFrame | None:
    """The rows of each image's latest processing, or nothing if there is none yet; with ``listed`` only of images still there."""
    if not store.exists(spark, f"{out}/processed"):
        return None
    rows = spark.read.schema(f"{schemas.PROCESSED}, run string").parquet(f"{out}/processed")
    # Run ids sort by time, then by the number that a clash added.
    order = F.struct(F.substring("run", 1, 20), F.coalesce(F.expr("try_cast(substring(run, 22) as int)"), F.lit(0)))
    last = rows.groupBy("path").agg(F.max_by("run", order).alias("run"))
    rows = rows.join(last, ["path", "run"], "left_semi")
    return rows if listed is None else rows.join(listed.select("path"), "path", "left_semi")


def run_batch(spark: SparkSession, root: str, out: str, run: str = "0", *, opening_mode: str = "flat_disk", directories: DataFrame | None = None, everything: bool = False, match: bool = True, pictures: bool = False) -> DataFrame:
    """Processes images, and writes processed images, particles, and the result tables of all directories below ``out``; returns the ranked rows.

    ``directories`` (path) names those to look at, all below ``root`` else; only files that lie in them count, not those
    of directories within. Images with a valid row of an earlier run are taken from there unless ``everything`` is wanted;
    the others' rows are added under ``run``. All directories are worked on at once.
    """
    listed = sources.list_images(spark, root)
    if directories is not None:
        listed = listed.join(directories.select(F.col("path").alias("sample_dir")), "sample_dir", "left_semi")
    kept = None if everything else current(spark, out)
    todo = listed if kept is None else sources.unprocessed(listed, kept)
    folders = [r.sample_dir for r in todo.select("sample_dir").distinct().collect()]  # at most one row per directory
    if folders:
        images = sources.read_images(spark, folders).join(todo.select("path"), "path", "left_semi")
        process_images(images, opening_mode).write.mode("append").parquet(f"{out}/processed/run={run}")
    done = current(spark, out, listed)
    if done is None or not match:
        return done
    found = particles(done)
    results.write_particles(found, f"{out}/particles")
    results.write_directories(match_images(found), f"{out}/matches")
    ranked = spark.read.parquet(f"{out}/matches").join(listed.select("sample_dir").distinct(), "sample_dir", "left_semi")
    results.write_directories(template_documents(found), f"{out}/templates")
    keyed = ranked.withColumn("sample_dir", N.directory_key("sample_dir", F.lit(root)))
    results.write_all_percentages(keyed, out)
    results.write_all_distances(horizontal_rows(keyed), out)
    if pictures:
        crops = in_directories(particle_pictures(found), root)
        for made in (in_directories(annotated(done.filter("role = 'green'"), ranked), root), crops, in_directories(review_sheets(ranked, found), root)):
            results.write_files(made, out)
        index = crops.select(N.directory_key("sample_dir", F.lit(root)).alias("sample_dir"), N.base_name("image_key").alias("image"), F.col("particle_id").cast("string").alias("particle"), F.col("name").alias("picture"))
        results.write_each(index, [F.col("image"), F.col("particle").cast("int")], ["image", "particle", "picture"], out, "particle_pictures.csv")
    return ranked
