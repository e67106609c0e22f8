import json
import re

import pytest
from pyspark.sql import functions as F

from constella import catalogue, catalogue_parts
from constella.functions import geometry as G, naming as N
from constella.sources import images as sources, results
from tests.test_matching import _values


def test_names_of_files_and_runs(spark):
    row = spark.range(1).select(
        N.cache_path(F.lit("/r/s/GB.a.12mm.tif")).alias("a"), N.image_cache_path(F.lit("/r/s/data/x_processed_data.json")).alias("b"), N.image_cache_path(F.lit("/r/x.json")).alias("c"),
        N.millimetres(F.lit("GB.a.12mm.tif")).alias("d"), N.millimetres(F.lit("GB.a.tif")).alias("e"), N.directory_key(F.lit("file:/r/s"), F.lit("file:///r/")).alias("f"), N.directory_key(F.lit("/q/s"), F.lit("/r")).alias("g"),
        N.progress_percent(F.lit(1), F.lit(1), F.lit(2), F.lit(3)).alias("h"), N.progress_percent(F.lit(1), F.lit(1), F.lit(0), F.lit(0)).alias("i"), N.elapsed(F.lit(3725)).alias("j"),
    ).first()
    assert tuple(row) == ("/r/s/data/GB.a.12mm_processed_data.json", "/r/s/data/x_processed_image.npy", None, "12mm", "GB.a", "s", "/q/s", 50, 0, "01:02:05")


def test_random_colours_keep_their_range(spark):
    rows = spark.range(200).select(G.random_colour(3).alias("c")).collect()
    assert all(100 <= x <= 255 for r in rows for x in r.c) and len({tuple(r.c) for r in rows}) > 150


@pytest.mark.parametrize("name", [n for n, f in catalogue.QUERIES.items() if f.__module__ == catalogue_parts.__name__])
def test_parts_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in set(re.findall(r"\b(?:embeddings|events|orders|pages|part)\b", catalogue.ORACLE_SQL[name])):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert _values(df.collect(), columns) == _values([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns)


def test_latest_pictures(spark):
    files = spark.createDataFrame([(f"/r/a/pictures/{n}",) for n in ("x_particles.png", "2026-01-02_x_particles.png", "2026-01-01_x_particles.png", "y_particles.png", "x_num1.png")], "path string")
    assert {(r.sample_dir, r.stem, r.path.rpartition("/")[2]) for r in sources.latest_pictures(files).collect()} == {("/r/a", "x", "x_particles.png"), ("/r/a", "y", "y_particles.png")}


def test_template_documents(spark):
    relations = spark.createDataFrame([("t", 1, 1, 4), ("t", 1, 2, 2)], "red_image string, primary_id int, relation_no int, relation_id int")
    matches = spark.createDataFrame([("t", 4, 9), ("t", 2, 7)], "red_image string, relation_id int, candidate_id int")
    got = json.loads(results.relations_json(relations, matches).first().relations)
    assert got == {"primary_particle_id": 1, "relation_ids": [4, 2], "equivalent_particles": [[2, 7], [4, 9]], "offset_angle": 30.0, "search_distance_modifier": 0.75, "max_search_distance": 50.0}
