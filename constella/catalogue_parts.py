"""Registered queries of single parts of the engine, raster kernels and column functions, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from constella import constants as K
from constella.catalogue import _NAMES, _ROWS, _names, _query
from constella.functions import geometry as G, naming as N, raster as R
from constella.operators import rollups
from constella.plans import rasters, views
from constella.sources import images as sources, results

_I = "CAST(floor(abs(CAST(embedding[{0} % 64 + 1] AS DOUBLE)) * 2000) AS INTEGER)"
_PIXELS = f"""
WITH RECURSIVE px AS (SELECT vec_id, i, i // 8 AS r, i % 8 AS c, dark, CASE WHEN dark THEN 0 ELSE a % 256 END AS p0, CASE WHEN dark THEN 0 ELSE b % 256 END AS p1, CASE WHEN dark THEN 0 ELSE d % 256 END AS p2 FROM (
  SELECT vec_id, i, {_I.format('i')} AS a, {_I.format('(i * 7 + 1)')} AS b, {_I.format('(i * 13 + 2)')} AS d, {_I.format('i')} % 7 < 4 AS dark FROM embeddings, (SELECT unnest(range(64)) AS i)))"""
_MEDIAN = (
    _PIXELS
    + """, md AS (SELECT a.vec_id, a.i, a.r, a.c, CAST(median(b.p0) AS INTEGER) AS m0, CAST(median(b.p1) AS INTEGER) AS m1, CAST(median(b.p2) AS INTEGER) AS m2 FROM px a, (SELECT unnest(range(9)) AS k) s, px b
  WHERE b.vec_id = a.vec_id AND b.r = least(greatest(a.r + k // 3 - 1, 0), 7) AND b.c = least(greatest(a.c + k % 3 - 1, 0), 7) GROUP BY ALL)"""
)


def _regions(source: str, same: str, columns: str) -> str:
    """Pixels of a source with the first pixel of their 4-connected component of equal class."""
    return f""", cl AS (SELECT vec_id, i, r, c, {same} AS k, {columns} FROM {source}),
edge AS (SELECT a.vec_id, a.i, b.i AS j FROM cl a JOIN cl b ON a.vec_id = b.vec_id AND a.k = b.k AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach AS (SELECT vec_id, i, i AS j FROM cl UNION SELECT reach.vec_id, reach.i, edge.j FROM reach JOIN edge ON reach.vec_id = edge.vec_id AND reach.j = edge.i),
lab AS (SELECT vec_id, i, min(j) AS root, count(*) AS size FROM reach GROUP BY ALL)"""


_BLACK = "p0 < 10 AND p1 < 10 AND p2 < 10"


def _cells(image: np.ndarray) -> list[list[int]]:
    """(pixel, values) of every pixel."""
    flat = image.reshape(rasters.SIDE**2, -1)
    return [[i, *row] for i, row in enumerate(flat.tolist())]


@_query("raster_grey", _PIXELS + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CAST(floor(0.299::DOUBLE * p0 + 0.587::DOUBLE * p1 + 0.114::DOUBLE * p2) AS INTEGER) AS grey FROM px")
def raster_grey(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.grey(x)), ["pixel", "grey"])


@_query("raster_median", _MEDIAN + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, m0, m1, m2 FROM md")
def raster_median(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.median3(x)), ["pixel", "m0", "m1", "m2"])


@_query("raster_masks", _PIXELS + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CAST(p0 >= 240 AND p1 <= 5 AND p2 <= 5 AS INTEGER) AS red, CAST(p0 <= 5 AND p1 >= 240 AND p2 <= 5 AS INTEGER) AS green, CAST(p0 < 10 AND p1 < 10 AND p2 < 10 AS INTEGER) AS black FROM px")
def raster_masks(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(np.stack([R.red_mask(x), R.green_mask(x), R.black_mask(x)], axis=-1).astype(int)), ["pixel", "red", "green", "black"])


@_query("particle_boxes", _PIXELS + _regions("px", _BLACK, "r AS rr") + """ SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS number, min_row, min_col, max_row, max_col, pixel_count, min_row + (max_row - min_row) // 2 AS center_row, min_col + (max_col - min_col) // 2 AS center_col FROM (
  SELECT vec_id, root, CAST(min(r) AS INTEGER) AS min_row, CAST(min(c) AS INTEGER) AS min_col, CAST(max(r) AS INTEGER) AS max_row, CAST(max(c) AS INTEGER) AS max_col, CAST(count(*) AS INTEGER) AS pixel_count, max(CASE WHEN r < 7 AND c < 7 THEN 1 ELSE 0 END) AS seeded FROM cl JOIN lab USING (vec_id, i) WHERE NOT k GROUP BY ALL) WHERE seeded = 1 AND pixel_count > 1""")
def particle_boxes(spark, sf):
    """Components of more than one pixel, in scan order."""

    def kernel(image):
        found = R.boxes(image)
        found = found[found[:, 4] > K.MIN_PARTICLE_SIZE].tolist()
        return [[n, *b, (b[0] + b[2]) // 2, (b[1] + b[3]) // 2] for n, b in enumerate(found, 1)]

    return rasters.apply(rasters.images(spark, sf), kernel, ["number", "min_row", "min_col", "max_row", "max_col", "pixel_count", "center_row", "center_col"])


@_query("colour_aggregates", _PIXELS + _regions("px", _BLACK, "p0, p1, p2") + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CASE WHEN size > 6 THEN 0 ELSE p0 END AS p0, CASE WHEN size > 6 THEN 0 ELSE p1 END AS p1, CASE WHEN size > 6 THEN 0 ELSE p2 END AS p2 FROM cl JOIN lab USING (vec_id, i)")
def colour_aggregates(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.remove_colour_aggregates(x, 6)), ["pixel", "p0", "p1", "p2"])


@_query("grey_aggregates", _PIXELS + ", gr AS (SELECT vec_id, i, r, c, CAST(floor(0.299::DOUBLE * p0 + 0.587::DOUBLE * p1 + 0.114::DOUBLE * p2) AS INTEGER) AS g FROM px), mean AS (SELECT vec_id, avg(g) AS m FROM gr GROUP BY 1), gm AS (SELECT * FROM gr JOIN mean USING (vec_id))" + _regions("gm", "g > m * 1.5", "g") + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CASE WHEN k AND size > 3 THEN 0 ELSE g END AS grey FROM cl JOIN lab USING (vec_id, i)")
def grey_aggregates(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.remove_grey_aggregates(R.grey(x), 3)), ["pixel", "grey"])


@_query("outer_frame", _PIXELS + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 THEN p0 ELSE 0 END AS p0, CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 THEN p1 ELSE 0 END AS p1, CASE WHEN r BETWEEN 2 AND 5 AND c BETWEEN 2 AND 5 THEN p2 ELSE 0 END AS p2 FROM px")
def outer_frame(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.remove_frame(x, 2)), ["pixel", "p0", "p1", "p2"])


@_query("halo_mask", _PIXELS + " SELECT a.vec_id, CAST(a.i AS INTEGER) AS pixel, CAST(bool_or(NOT b.dark AND b.i % 11 = 0) AS INTEGER) AS halo FROM px a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) + abs(a.c - b.c) <= 2 GROUP BY ALL")
def halo_mask(spark, sf):
    """Two dilations by a cross of some of the pixels: all within two steps of one."""
    some = (np.arange(rasters.SIDE**2) % 11 == 0).reshape(rasters.SIDE, rasters.SIDE)
    # A pixel is dark by its making, so a bright one of value 0 can't be told; the mask comes from the columns.
    dark = views.table(spark, sf, "embeddings").select("vec_id", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[F.when(F.pmod(F.floor(F.abs(F.col("embedding")[i].cast("double")) * 2000), F.lit(7)) < 4, 0).otherwise(1)] * 3))).alias("px"))
    return rasters.apply(dark, lambda x: _cells(R.dilate((x[..., 0] > 0) & some, 2).astype(int)), ["pixel", "halo"])


@_query("flat_opening", _PIXELS + """, e AS (SELECT a.vec_id, a.i, a.r, a.c, min(b.p0) AS v FROM px a, (SELECT unnest(range(9)) AS k) s, px b WHERE abs(k // 3 - 1) + abs(k % 3 - 1) <= 1 AND b.vec_id = a.vec_id AND b.r = least(greatest(a.r + k // 3 - 1, 0), 7) AND b.c = least(greatest(a.c + k % 3 - 1, 0), 7) GROUP BY ALL)
 SELECT a.vec_id, CAST(a.i AS INTEGER) AS pixel, CAST(max(b.v) AS INTEGER) AS opened FROM e a, (SELECT unnest(range(9)) AS k) s, e b WHERE abs(k // 3 - 1) + abs(k % 3 - 1) <= 1 AND b.vec_id = a.vec_id AND b.r = least(greatest(a.r + k // 3 - 1, 0), 7) AND b.c = least(greatest(a.c + k % 3 - 1, 0), 7) GROUP BY ALL""")
def flat_opening(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.opening(x[..., 0], "flat_disk", 3)), ["pixel", "opened"])


@_query("particle_colours", _PIXELS + """, lit AS (SELECT vec_id, list({'a': p0, 'b': p1, 'd': p2, 'r': r} ORDER BY i) AS l FROM px WHERE NOT (p0 < 10 AND p1 < 10 AND p2 < 10) GROUP BY 1),
 s AS (SELECT vec_id, l, list_filter(l, lambda x: x.r = l[len(l)].r)[1] AS seed FROM lit)
 SELECT vec_id, CAST(list_reduce(list_prepend(seed.a, list_transform(l, lambda x: x.a)), lambda p, q: CAST(round_even((p + q) / 2.0, 0) AS INTEGER)) AS INTEGER) AS red,
  CAST(list_reduce(list_prepend(seed.b, list_transform(l, lambda x: x.b)), lambda p, q: CAST(round_even((p + q) / 2.0, 0) AS INTEGER)) AS INTEGER) AS green,
  CAST(list_reduce(list_prepend(seed.d, list_transform(l, lambda x: x.d)), lambda p, q: CAST(round_even((p + q) / 2.0, 0) AS INTEGER)) AS INTEGER) AS blue FROM s""")
def particle_colours(spark, sf):
    """The running average of an image's lit pixels, from the first one of the last row that has any."""
    return rasters.apply(rasters.images(spark, sf), lambda x: [] if (c := R.colour(x)) is None else [c.tolist()], ["red", "green", "blue"])


@_query("foreground_weight", _PIXELS + " SELECT vec_id, CAST(i AS INTEGER) AS pixel, CAST(floor(CAST(p0 AS FLOAT) * CAST(CAST(p1 AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT)) AS INTEGER) AS weighed FROM px")
def foreground_weight(spark, sf):
    return rasters.apply(rasters.images(spark, sf), lambda x: _cells(R.weigh_foreground(x[..., 0], x[..., 1])), ["pixel", "weighed"])


@_query("pixel_predicates", "SELECT p_partkey, p_size * 5 >= 240 AND p_partkey % 9 <= 5 AND p_partkey % 11 <= 5 AS red, p_partkey % 9 <= 5 AND p_size * 5 >= 240 AND p_partkey % 11 <= 5 AS green, p_size < 10 AND p_partkey % 256 < 10 AS black, p_partkey % 40 < 30 AND p_size < 40 AS inside, p_partkey % 40 * 30 + p_size AS identifier, CAST(floor((p_size + p_partkey % 40) / 2.0) AS INTEGER) AS centre FROM part")
def pixel_predicates(spark, sf):
    x, y, z = F.col("p_size") * 5, F.col("p_partkey") % 9, F.col("p_partkey") % 11
    row, col = F.col("p_partkey") % 40, F.col("p_size")
    return views.table(spark, sf, "part").select("p_partkey", G.is_red(x, y, z).alias("red"), G.is_green(y, x, z).alias("green"), G.is_black(col, F.col("p_partkey") % 256).alias("black"), G.in_bounds(row, col, F.lit(30), F.lit(40)).alias("inside"), G.identifier(row, F.col("p_size"), F.lit(30)).alias("identifier"), G.centre(col, row).alias("centre"))


@_query("run_labels", "SELECT event_id, strftime(ts, '%Y-%m-%d--%H-%M-%S') AS run_id, printf('%02d:%02d:%02d', CAST(event_id * 37 // 3600 AS BIGINT), CAST(event_id * 37 % 3600 // 60 AS BIGINT), CAST(event_id * 37 % 60 AS BIGINT)) AS elapsed, CAST(event_id % 50 * 7 AS DOUBLE) AS seconds, CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(greatest(0, least(100, floor((event_id % 9 + (event_id % 11) / 11.0::DOUBLE) * 100 / (event_id % 4)))) AS INTEGER) END AS percent FROM events")
def run_labels(spark, sf):
    e = F.col("event_id")
    ended = F.timestamp_micros(F.unix_micros("ts") + e % 50 * 7_000_000)
    percent = N.progress_percent(e % 9, e % 11, F.lit(11), e % 4)
    return views.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", N.run_id("ts").alias("run_id"), N.elapsed(e * 37).alias("elapsed"), N.duration_seconds(F.col("ts"), ended).alias("seconds"), percent.alias("percent"))


@_query("cache_names", f"SELECT page_id, concat(regexp_replace(p, '/[^/]*$', ''), '/data/', s, '_processed_data.json') AS document, concat(regexp_replace(p, '/[^/]*$', ''), '/data/', s, '_processed_image.npy') AS pixels, coalesce(nullif(regexp_extract(n, '(\\d+mm)', 1), ''), s) AS millimetres, CASE WHEN starts_with(p, '/root/s1/') THEN substr(p, 10) ELSE p END AS key FROM (SELECT *, regexp_replace(n, '\\.[^.]*$', '') AS s FROM (SELECT page_id, {_NAMES} AS p, regexp_extract({_NAMES}, '[^/]*$') AS n FROM pages))")
def cache_names(spark, sf):
    rows = _names(spark, sf).withColumn("document", N.cache_path("path"))
    return rows.select("page_id", "document", N.image_cache_path("document").alias("pixels"), N.millimetres("name").alias("millimetres"), N.directory_key("path", F.lit("/root/s1/")).alias("key"))


_LISTED = f"WITH li AS (SELECT page_id, p AS path, n AS name, regexp_replace(p, '/[^/]*$', '') AS sample_dir, CASE WHEN n ILIKE 'GB.%locations fixed%.tif' OR n ILIKE 'GB.%locations fixed%.tiff' THEN 'red' WHEN (n ILIKE 'GB.%.tif' OR n ILIKE 'GB.%.tiff') AND n NOT ILIKE '%locations fixed%' THEN 'green' END AS role, n ILIKE '%.tiff' AS long FROM (SELECT page_id, {_NAMES} AS p, regexp_extract({_NAMES}, '[^/]*$') AS n FROM pages))"


def _listed(spark, sf):
    rows = _names(spark, sf).withColumn("sample_dir", N.parent("path")).withColumn("role", N.role("name"))
    return rows.filter("role is not null").withColumn("ord", F.struct(F.lower("name").endswith(".tiff").alias("long"), F.col("name").alias("name")))


@_query("first_templates", _LISTED + " SELECT sample_dir, arg_min(path, {'long': long, 'name': name}) AS path FROM li WHERE role = 'red' GROUP BY 1")
def first_templates(spark, sf):
    return sources.first_template(_listed(spark, sf))


@_query("square_stems", _LISTED + " SELECT sample_dir, green_square, arg_max(regexp_replace(name, '\\.[^.]*$', ''), {'long': long, 'name': name}) AS stem FROM (SELECT *, nullif(regexp_extract(name, '\\.(\\d+)mm', 1), '') AS green_square FROM li WHERE role = 'green') WHERE green_square IS NOT NULL GROUP BY ALL")
def square_stems(spark, sf):
    return sources.square_stems(_listed(spark, sf))


_CACHED = ", cached AS (SELECT path, CASE WHEN page_id % 3 = 0 THEN 'error' END AS error FROM li WHERE page_id % 2 = 0), good AS (SELECT path FROM cached GROUP BY 1 HAVING bool_and(error IS NULL))"


def _cached(spark, sf):
    return _listed(spark, sf).filter("page_id % 2 = 0").select("path", F.when(F.col("page_id") % 3 == 0, F.lit("error")).alias("error"))


@_query("images_to_process", _LISTED + _CACHED + " SELECT page_id, path FROM li WHERE role IS NOT NULL AND path NOT IN (SELECT path FROM good)")
def images_to_process(spark, sf):
    return sources.unprocessed(_listed(spark, sf), _cached(spark, sf)).select("page_id", "path")


@_query("images_done", _LISTED + _CACHED + " SELECT page_id, path FROM li WHERE role IS NOT NULL AND path IN (SELECT path FROM good)")
def images_done(spark, sf):
    return sources.processed(_listed(spark, sf), _cached(spark, sf)).select("page_id", "path")


@_query("result_lines", _ROWS + " SELECT ord, printf('%.6f', percentage) AS percentage, printf('%.6f', distance) AS distance, concat('[', printf('%.1f', distance), ', ', CAST(round(percentage, 6) AS VARCHAR), ']') AS scores FROM rows")
def result_lines(spark, sf):
    rows = views.result_rows(spark, sf).withColumn("s", F.array("distance", "percentage"))
    return rows.select("ord", results.six_places("percentage").alias("percentage"), results.six_places("distance").alias("distance"), results.scores_json("s").alias("scores"))


@_query("rows_of_a_pair", _ROWS + " SELECT ord, percentage FROM rows WHERE red_square = '1-URGENT' AND green_square = 'O' ORDER BY percentage DESC, ord")
def rows_of_a_pair(spark, sf):
    return rollups.ranked_rows(views.result_rows(spark, sf), "1-URGENT", "O").select("ord", "percentage")


@_query("page_of_rows", _ROWS + f" SELECT ord, percentage FROM rows WHERE red_square = '1-URGENT' AND green_square = 'O' ORDER BY percentage DESC, ord LIMIT {K.PAGE_SIZE} OFFSET {2 * K.PAGE_SIZE}")
def page_of_rows(spark, sf):
    """The third page of a pair's rows; the limit is the page's."""
    return rollups.page(rollups.ranked_rows(views.result_rows(spark, sf), "1-URGENT", "O"), 2).select("ord", "percentage")
