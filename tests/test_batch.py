import json

import numpy as np
import pytest

from constella import __main__ as cli
from constella.functions import codecs
from constella.operators import rollups
from constella.plans import approval, batch
from constella.sources import images as sources, results, store

DOTS = [(30, 30, 4), (44, 30, 3), (30, 52, 3), (60, 64, 3)]


def picture(colour, dots, h=110, w=120):
    image = np.full((h, w, 3), 60, np.uint8)
    image[4 : h - 4, 4 : w - 4] = colour
    image[7 : h - 7, 7 : w - 7] = 60
    for r, c, s in dots:
        image[r : r + s, c : c + s] = 240
    return image


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("samples")
    for k, name in enumerate(("a", "b/c")):
        d = top / name
        d.mkdir(parents=True)
        (d / "GB.s.m.10x.1mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), [(r + 2, c + 3, s) for r, c, s in DOTS])))
        (d / "GB.s.m.10x.2mm.tiff").write_bytes(codecs.tiff(picture((0, 255, 0), [(70, 20, 4), (30, 80, 3)])))
        (d / "GB.s.m.10x.1mm.1.locations fixed.tif").write_bytes(codecs.tiff(picture((255, 0, 0), DOTS)))
        (d / "notes.tif").write_bytes(b"no")
    (top / "a" / "GB.s.m.10x.3mm.tif").write_bytes(codecs.tiff(np.zeros((30, 30, 3), np.uint8)))
    (top / "a" / "GB.s.m.10x.4mm.tif").write_bytes(b"broken")
    return top


def test_discovery(spark, root):
    dirs = [r.sample_dir for r in sources.sample_dirs(spark, f"file://{root}").collect()]
    assert [d.rpartition("/")[2] for d in dirs] == ["a", "c"]
    listed = sources.list_images(spark, f"file://{root}")
    assert sorted((r.role, r.name) for r in listed.collect() if r.sample_dir.endswith("/c")) == [("green", "GB.s.m.10x.1mm.tif"), ("green", "GB.s.m.10x.2mm.tiff"), ("red", "GB.s.m.10x.1mm.1.locations fixed.tif")]
    assert sources.first_template(listed).count() == 2
    stems = {(r.green_square, r.stem) for r in sources.square_stems(listed).collect()}
    assert ("1", "GB.s.m.10x.1mm") in stems


def test_images_become_ranked_tables(spark, root, tmp_path):
    ranked = batch.run_batch(spark, f"file://{root}", f"file://{tmp_path}")
    done = spark.read.parquet(f"file://{tmp_path}/processed")
    errors = {r.path.rpartition(".")[0].rpartition(".")[2]: r.error for r in batch.failures(done).collect()}
    assert errors["3mm"] == "no green border" and "4mm" in errors
    rows = ranked.filter("sample_dir like '%/c'").collect()
    best = next(r for r in rows if r.ord == 1 and r.green_square == "1")
    assert best.red_square == "0" and json.loads(best.particle_details)["id"] == best.anchor_id
    assert best.percentage > 90
    text = results.read_csv(spark, f"file://{tmp_path}/b/c/data/percentage_data.csv").collect()
    assert [r.green_square for r in text] == sorted(r.green_square for r in text) and json.loads(text[0].particle_details)["corner_coordinates"]
    assert all(len(r.percentage.partition(".")[2]) == 6 for r in text)
    paths = results.write_master(spark, f"file://{tmp_path}")
    whole, top = (results.read_csv(spark, p, "sample_dir string, " + results.schemas.PERCENTAGE_CSV).collect() for p in paths)
    assert len(whole) == ranked.count() and len(top) == len({(r.sample_dir, r.red_square, r.green_square) for r in whole})
    # A second run takes what is valid from the first.
    images = sources.read_images(spark, f"file://{root}")
    assert {r.name.rpartition(".")[0].rpartition(".")[2] for r in sources.unprocessed(images, done).collect()} == {"3mm", "4mm"}
    assert sources.processed(images, done).count() == 6
    sheets = {r.name: codecs.read_png(bytes(r.content)) for r in batch.review_sheets(ranked, batch.particles(done)).filter("sample_dir like '%/c'").collect()}
    assert "GB.s.m.10x.1mm_redsquare0_sheet0.png" in sheets and all(x.shape[2] == 3 for x in sheets.values())
    crops = batch.particle_pictures(batch.particles(done)).filter("sample_dir like '%/c'").collect()
    assert len({r.name for r in crops}) == len(crops) == batch.particles(done).filter("sample_dir like '%/c'").count()
    assert len({codecs.read_png(bytes(r.content)).shape for r in crops}) == 1
    best_row = ranked.filter("ord = 1 and sample_dir like '%/c' and green_square = '1'").first()
    assert len(best_row.drawing) == 3 and [d.row is not None for d in best_row.drawing].count(True) == len(best_row.matched_ids)
    n = results.write_files(batch.annotated(done.filter("role = 'green'"), ranked), f"file://{tmp_path}/pictures")
    made = sorted((tmp_path / "pictures").glob("*.png"))
    assert n == 4 and (codecs.read_png(made[0].read_bytes()) == (255, 0, 0)).all(-1).any()


def test_command_line_resumes(spark, root, tmp_path):
    args = [f"file://{root}", "--out", str(tmp_path)]
    assert cli.main(args) == 0
    assert cli.main([*args, "--resume-latest"]) == 0
    runs = sorted((tmp_path / "runs").iterdir())
    summary = json.loads((runs[-1] / "summary.json").read_text())
    assert summary["counts"] == {"skipped": 2} and summary["run_status"] == "completed"


def test_command_line_looks_at_every_image_again(spark, tmp_path):
    top, out = tmp_path / "in", tmp_path / "out"
    d = top / "a"
    d.mkdir(parents=True)
    (d / "GB.s.m.10x.1mm.1.locations fixed.tif").write_bytes(codecs.tiff(picture((255, 0, 0), DOTS)))
    (d / "GB.s.m.10x.1mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), DOTS)))
    (d / "GB.s.m.10x.4mm.tif").write_bytes(b"broken")
    args = [f"file://{top}", "--out", str(out)]
    squares = lambda: {r.green_square for r in results.read_csv(spark, f"file://{next(out.glob('**/percentage_data.csv'))}").collect()}
    assert cli.main(args) == 0 and squares() == {"1"}
    # One image is mended, one is new, and one goes.
    (d / "GB.s.m.10x.4mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), DOTS)))
    (d / "GB.s.m.10x.2mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), DOTS)))
    assert cli.main(args) == 0 and squares() == {"1", "2", "4"}
    (d / "GB.s.m.10x.1mm.tif").unlink()
    assert cli.main(args) == 0 and squares() == {"2", "4"}
    before = sorted(out.glob("**/processed/*"))
    assert cli.main(args) == 0 and sorted(out.glob("**/processed/*")) == before and before


def test_nested_directories_keep_their_own_images(spark, tmp_path):
    top, out = tmp_path / "in", tmp_path / "out"
    for k, name in enumerate(("a", "a/b [1]", "a/b [1]/c")):
        d = top / name
        d.mkdir(parents=True)
        (d / "GB.s.m.10x.1mm.1.locations fixed.tif").write_bytes(codecs.tiff(picture((255, 0, 0), DOTS)))
        (d / f"GB.s.m.10x.{k + 1}mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), DOTS)))
    (top / "bad").mkdir()
    (top / "bad" / "GB.x.1mm.tif").write_bytes(b"broken")
    assert cli.main([f"file://{top}", "--out", str(out), "--annotate"]) == 1
    squares = {str(p.relative_to(out).parent.parent): {r.green_square for r in results.read_csv(spark, store.literal(f"file://{p}")).collect()} for p in out.glob("**/data/percentage_data.csv")}
    assert squares == {"a": {"1"}, "a/b [1]": {"2"}, "a/b [1]/c": {"3"}}
    assert sorted(p.name for p in (out / "a/b [1]/pictures").glob("*.png") if "num" not in p.name) == ["GB.s.m.10x.2mm_particles.png", "GB.s.m.10x.2mm_redsquare0_sheet0.png"]
    listed = results.read_csv(spark, store.literal(f"file://{out}/a/b [1]/data/particle_pictures.csv"), "image string, particle string, picture string").collect()
    assert all((out / r.picture).exists() for r in listed) and len(listed) == len(list((out / "a/b [1]/pictures").glob("*num*.png"))) > 5
    assert all(json.loads(r.relations)["relation_ids"] for r in spark.read.parquet(f"file://{out}/templates").collect())
    run = next((out / "runs").iterdir())
    assert json.loads((run / "summary.json").read_text())["directory_states"] == {"a": "completed", "a/b [1]": "completed", "a/b [1]/c": "completed", "bad": "failed"}
    # A failed directory is tried again only if that is wanted, and others' tables stay.
    (top / "bad" / "GB.x.1mm.tif").write_bytes(codecs.tiff(picture((0, 255, 0), DOTS)))
    (top / "bad" / "GB.x.1mm.1.locations fixed.tif").write_bytes(codecs.tiff(picture((255, 0, 0), DOTS)))
    assert cli.main([f"file://{top}", "--out", str(out), "--resume-latest"]) == 0 and not (out / "bad/data").exists()
    assert cli.main([f"file://{top}", "--out", str(out), "--resume", run.name, "--retry-failed"]) == 0 and (out / "bad/data/percentage_data.csv").exists()
    assert len(list(out.glob("**/data/percentage_data.csv"))) == 4 and len(list((out / "matches").glob("sample_dir=*"))) == 4
    # Decisions by the command line.
    (tmp_path / "d.csv").write_text("sample_dir,red_square,green_square,index\na/b [1],0,2,1\n")
    assert cli.main([f"file://{top}", "--out", str(out), "--decisions", f"file://{tmp_path}/d.csv"]) == 0
    rows = results.read_csv(spark, store.literal(f"file://{out}/a/b [1]/data/percentage_data.csv")).collect()
    assert [r.percentage for r in rows].count("999.000000") == 1


def test_csv_dialect_and_rewrite(spark, tmp_path):
    rows = spark.createDataFrame([("d", "1", "10", 5.0, 1.0, 2.0, 1.0, 1.0, [0.12345678, 2.0], '{"a": "x, \\"y\\""}', 1), ("d", "2", "9", 7.25, 1.0, 2.0, 1.0, 1.0, [], "line\nbreak", 2)], "sample_dir string, red_square string, green_square string, percentage double, distance double, base_score double, completeness_ratio double, geometry_consistency double, individual_scores array<double>, particle_details string, ord long")
    path = f"file://{tmp_path}/percentage_data.csv"
    results.write_percentages(rows, path)
    got = results.read_csv(spark, path).collect()
    assert [(r.green_square, r.percentage, r.individual_scores, r.particle_details) for r in got] == [("9", "7.250000", "[]", "line\nbreak"), ("10", "5.000000", "[0.123457, 2.0]", '{"a": "x, \\"y\\""}')]
    results.rewrite(results.read_csv(spark, path).drop("file", "ord").filter("green_square = '9'"), path)
    assert results.read_csv(spark, path).count() == 1


def test_legacy_caches(spark, tmp_path):
    particle = {"id": 1, "corner_coordinates": [[1, 2], [3, 4]], "center_position": [2, 3], "color": [9, 9, 9], "nearby_particle_ids": [2, -1, None]}
    good = {"particles": [particle], "schema_version": 2, "image_cache_file": "x.npy", "image_shape": [5, 6, 3], "image_dtype": "uint8"}
    cases = {"ok": good, "old": {"particles": [particle], "image_data": [[[1, 2, 3]]]}, "shape": good | {"image_shape": [5, 0, 3]}, "type": good | {"image_dtype": "object"}, "file": {k: v for k, v in good.items() if k != "image_cache_file"}, "t_redsquare0": good, "u_redsquare0": good | {"relations": {"primary_particle_id": 1, "relation_ids": [1, 7]}}}
    for k, v in cases.items():
        (tmp_path / f"{k}_processed_data.json").write_text(json.dumps(v))
    (tmp_path / "bad_processed_data.json").write_text("{")
    np.save(tmp_path / "x.npy", np.ones((5, 6, 3), np.uint8))
    caches = results.read_legacy_caches(spark, f"file://{tmp_path}")
    images = {r.image_key.rpartition("/")[2].removesuffix("_processed_data.json"): r.raster for r in results.legacy_images(caches).collect()}
    assert images.keys() == {"ok", "old", "u_redsquare0"} and (images["ok"].height, images["old"].channels) == (5, 3)
    assert codecs.npy(b"broken", [1, 1], "uint8") is None and codecs.npy((tmp_path / "x.npy").read_bytes(), [5, 6, 4], "uint8") is None
    valid = {r.file.rpartition("/")[2].removesuffix("_processed_data.json") for r in caches.filter("valid").collect()}
    assert valid == {"ok", "old", "u_redsquare0"}
    p = results.legacy_particles(caches).first()
    assert (p.min_row, p.max_col, p.center_row, p.nearby_particle_ids) == (1, 4, 2, [2, None, None])
    assert [(r.relation_id, r.dr) for r in results.legacy_relations(caches).orderBy("relation_no").collect()] == [(1, 0), (7, None)]


def test_overrides_and_paging(spark):
    rows = spark.createDataFrame([("d", "1", "1", p, 1.0, f"x{k % 3}", k) for k, p in enumerate([5.0, 9.0, 7.0, 9.0])], "sample_dir string, red_square string, green_square string, percentage double, distance double, particle_details string, ord int")
    out = {r.ord: (r.percentage, r.original_percentage) for r in rollups.apply_overrides(rows, spark.createDataFrame([("d", "1", "1", 1)], "sample_dir string, red_square string, green_square string, index int")).collect()}
    assert out == {0: (999.0, 5.0), 1: (9.0, 9.0), 2: (7.0, 7.0), 3: (999.0, 9.0)}
    ordered = rollups.ranked_rows(rows, "1", "1")
    assert [r.ord for r in ordered.collect()] == [1, 3, 2, 0] and [r.ord for r in rollups.page(ordered, 5, 3).collect()] == [0]


def test_decisions(spark, tmp_path):
    kind = "red_square string, green_square string, percentage double, distance double, base_score double, completeness_ratio double, geometry_consistency double, individual_scores array<double>, particle_details string, ord long"
    for d in "ab":
        rows = spark.createDataFrame([("1", "2", p, float(k), 1.0, 1.0, 1.0, [], f'{{"id": {k}}}', k) for k, p in enumerate([5.0, 9.0])], kind)
        results.write_percentages(rows, f"file://{tmp_path}/{d}/data/percentage_data.csv")
    shown = approval.candidates(results.read_all(spark, f"file://{tmp_path}")).collect()
    assert sorted((r.percentage, r["index"]) for r in shown) == [("9.000000", 0)] * 2
    best = approval.apply(spark, f"file://{tmp_path}", spark.createDataFrame([("a", "1", "2", 1)], approval.DECISION))[1]
    got = {r.sample_dir: r.percentage for r in results.read_csv(spark, best, "sample_dir string, " + results.schemas.PERCENTAGE_CSV).collect()}
    assert got == {"a": "999.000000", "b": "9.000000"}
