import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from constella import catalogue
from constella.operators import assignment as A, matching as M, neighbours, template


def brute(options, skip=50.0):
    """All choices in order, the first of the cheapest."""
    best = None
    for pick in itertools.product(*[[*range(len(o)), None] if o else [None] for o in options]):
        used = [options[k][j][0] for k, j in enumerate(pick) if j is not None]
        if len(set(used)) < len(used):
            continue
        cost = sum((options[k][j][1] if j is not None else skip) for k, j in enumerate(pick) if options[k])
        if best is None or cost < best[0] - 1e-12:
            best = cost, [None if j is None else options[k][j][0] for k, j in enumerate(pick)]
    return best[1]


@pytest.mark.parametrize("seed", range(5))
def test_assignment_agrees_with_brute_force(seed):
    r = np.random.default_rng(seed)
    for _ in range(150):
        options = [sorted((int(c), float(r.integers(0, 49))) for c in r.choice(6, int(r.integers(0, 4)), replace=False)) for _ in range(int(r.integers(1, 5)))]
        got = A.assign(options)
        assert got == brute(options)
        used = [g for g in got if g is not None]
        assert len(set(used)) == len(used)


def test_crowded_anchors_take_no_time():
    began = time.time()
    r = np.random.default_rng(2)
    for options in (
        [[(1, 5.0)]] * 1200, [[((k + c) % 1200, 7.0) for c in range(6)] for k in range(1200)], [[((k + c) % 1200, float(r.integers(1, 49))) for c in range(6)] for k in range(1200)],
        [[(c, 10.0) for c in range(8)] for _ in range(20)], [[(c, float(r.integers(1, 49))) for c in range(8)] for _ in range(20)],
    ):
        got = [g for g in A.assign(options) if g is not None]
        assert len(set(got)) == len(got)
    assert A.assign([[(1, 5.0)]] * 1200) == [1] + [None] * 1199
    assert A.assign([[(c, 10.0) for c in range(8)] for _ in range(20)]) == [*range(8), *[None] * 12]
    assert time.time() - began < 3


@pytest.mark.parametrize("seed", range(3))
def test_kth_distances_agree_with_all_pairs(spark, seed):
    r = np.random.default_rng(seed)
    rows = []
    for image, n in (("dense", 300), ("few", 3), ("four", 4), ("one", 1), ("pairs", 40)):
        at = r.integers(0, 40 if image == "dense" else 3000, (n, 2))
        at = np.repeat(at[: n // 2], 2, axis=0) if image == "pairs" else at
        at = np.concatenate([at, [[10**6, 10**6 + k] for k in range(2)]]) if image == "dense" else at  # remote ones
        rows += [("d", image, k, int(a), int(b), 1) for k, (a, b) in enumerate(at)]
    table = spark.createDataFrame(rows, "sample_dir string, image_key string, particle_id int, center_row int, center_col int, bbox_size int")
    for k in (1, 3):
        want = {}
        for _, image, p, a, b, _ in rows:
            d = sorted(np.hypot(a - y, b - x) for _, i, q, y, x, _ in rows if i == image and q != p)
            if len(d) >= k:
                want[image, p] = d[k - 1]
        assert {(x.image_key, x.particle_id): x.distance for x in neighbours.kth_distance(table, k).collect()} == pytest.approx(want)


def points(spark, image, role_points, first=1):
    return spark.createDataFrame([("d", image, first + k, r, c, s) for k, (r, c, s) in enumerate(role_points)], "sample_dir string, image_key string, particle_id int, center_row int, center_col int, bbox_size int")


def match(spark, red, green):
    relations, fields = template.relations(points(spark, "red", red)), points(spark, "green", green)
    matches = M.matched(M.candidates(relations, fields))
    return {r.anchor_id: r for r in M.percentages(relations, fields, matches).collect()}


SHAPE = [(100, 100, 900), (140, 100, 5), (100, 160, 5), (60, 70, 5)]


def test_exact_copy_scores_full(spark):
    got = match(spark, SHAPE, [(r + 500, c + 300, s) for r, c, s in SHAPE])
    assert got[1].percentage == pytest.approx(100) and got[1].completeness_ratio == 1 and got[1].geometry_consistency == 1
    assert got[1].matched_ids == [2, 3, 4] and got[1].horizontal_distance == 0 and len(got[1].individual_scores) == 3


def test_conflict_tie_and_isolated(spark):
    red = [(0, 0, 900), (0, 60, 5), (0, 62, 5)]
    got = match(spark, red, [(0, 0, 9), (0, 61, 9), (5000, 5000, 9)])
    assert got[1].completeness_ratio == 0.5 and got[1].matched_ids == [2]
    assert got[3].percentage == 0 and got[3].individual_scores == [] and got[3].matched_ids == []
    tied = template.relations(points(spark, "red", [(0, 0, 900), (0, 60, 5)]))
    found = A.assignment(M.candidates(tied, points(spark, "green", [(0, 0, 1), (3, 60, 1), (-3, 60, 1)]))).filter("anchor_id = 1").collect()
    assert [r.candidate_id for r in found] == [2]


def test_radius_of_few_points_and_lists(spark):
    few = points(spark, "a", [(0, 0, 1), (3, 4, 1), (30, 40, 2)])
    assert neighbours.search_radius(few).first().radius == 200
    lists = {r.particle_id: r.nearby_particle_ids for r in neighbours.neighbour_lists(few, neighbours.search_radius(few).withColumn("radius", F.lit(6))).collect()}
    assert lists == {1: [2], 2: [1], 3: []}
    more = template.add_relation(template.relations(few), template.relations(few))
    assert more.count() == 2


def test_top_keeps_zero_rows_and_orders_ties(spark):
    rows = spark.createDataFrame([("r", "g", k, float(p)) for k, p in enumerate([0, 5, 5, -1, 9])], "red_image string, green_image string, anchor_id int, percentage double")
    assert [(r.anchor_id, r["rank"]) for r in M.top(rows, 3).orderBy("rank").collect()] == [(4, 1), (1, 2), (2, 3)]
    assert M.top(rows).count() == 4


def _values(rows, columns):
    def plain(x):
        return round(x, 9) if isinstance(x, float) else x

    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)


def test_queries_agree_with_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for t in "customer orders events embeddings pages part".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("nn_search_radius", "match_candidates", "full_assignment", "geometry_consistency", "match_percentage", "top16_matches", "avg_horizontal_distance", "full_match_percentage", "resume_plan", "override_rows", "regex_role", "master_best", "running_average_color"):
        df, want = catalogue.QUERIES[name](spark, sf), con.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        columns = sorted(df.columns)
        assert _values(df.collect(), columns) == _values([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], columns), name


def test_queries_take_all_relations(spark, tmp_path):
    # A primary with five neighbours within the radius, and one far beyond it; the field is a moved, disturbed copy.
    red = [(500, 500, 900), (540, 500, 5), (460, 505, 5), (500, 544, 5), (503, 455, 5), (545, 545, 5), (900, 900, 5)]
    green = [(r + 9 + k % 3, c - 7 + 2 * (k % 2), 5) for k, (r, c, _) in enumerate(red)] + [(552, 498, 5), (512, 540, 5)]
    rows = [(k + 1, [(x + 0.5) / 1000 for x in (r, c, s)], label) for label, pts, first in ((5, red, 0), (1, green, 100)) for k, (r, c, s) in enumerate(pts, first)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    near = [p for p in red[1:6]]
    want = {}
    for anchor, (ar, ac, _) in enumerate(green, 101):
        options, places = [], []
        for r, c, _ in near:
            wr, wc, reach = ar + r - 500, ac + c - 500, min(round(0.75 * np.hypot(r - 500, c - 500)), 50)
            found = [(k, float(np.hypot(wr - q, wc - u))) for k, (q, u, _) in enumerate(green, 101) if np.hypot(wr - q, wc - u) < reach]
            options.append(sorted(found, key=lambda x: x[1]))
            places.append((wr, wc))
        chosen = brute(options)
        m = [(places[i], green[c - 101][:2], o, c) for i, (c, o) in enumerate(zip(chosen, options, strict=True)) if c is not None]
        if not m:
            want[anchor] = (0.0, None, None)
            continue
        scores = []
        for _, _, o, c in m:
            d, rivals = dict(o)[c], [x for k, x in o if k != c]
            scores.append(100 * np.exp(-d / 20) * (np.exp(-(d / min(rivals)) / 0.5) if rivals and min(rivals) >= 1e-6 else 1))
        pairs = [np.exp(-abs(np.hypot(*np.subtract(a[1], b[1])) / np.hypot(*np.subtract(a[0], b[0])) - 1)) for a, b in itertools.combinations(m, 2)]
        geometry = np.mean(pairs) if pairs else 1.0
        want[anchor] = (np.mean(scores) * len(m) / len(near) * geometry, geometry, np.mean([abs(g[1] - w[1]) for w, g, _, _ in m]))
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.anchor_id: r.percentage for r in run("top16_matches")} == pytest.approx({k: v[0] for k, v in want.items()}, abs=2e-6)
    assert {r.anchor_id: r.geometry_consistency for r in run("geometry_consistency")} == pytest.approx({k: v[1] for k, v in want.items() if v[1] is not None}, abs=2e-6)
    assert {r.anchor_id: r.horizontal_distance for r in run("avg_horizontal_distance")} == pytest.approx({k: v[2] for k, v in want.items() if v[1] is not None}, abs=2e-6)
    assert max(r.relation_no for r in run("full_assignment")) == 5


def test_the_entry_ranks_over_all_relations(spark):
    import __spark_entry__

    columns = ["red_image", "green_image", "anchor_id", "percentage", "rank"]
    got, whole = __spark_entry__.entry(spark), catalogue.QUERIES["full_match_percentage"](spark, "/root/testdata/sf0.001")
    assert [x[:3] for x in _values(got.filter("rank = 1").collect(), columns)] == [x[:3] for x in _values(whole.filter("rank = 1").collect(), columns)]
