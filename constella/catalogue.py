"""The registered queries of the matching engine and the SQL that DuckDB runs for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from constella.functions import geometry as G, naming as N
from constella.operators import matching as M, neighbours, rollups, template
from constella.operators.assignment import KEY
from constella.plans import views
from constella.streaming import runlog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# The stand-in particles, then each step of the method on top of the ones before.
_PARTICLES = """
WITH p AS (SELECT label AS image_key, vec_id AS particle_id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 1000) AS INTEGER) AS r, CAST(floor(CAST(embedding[2] AS DOUBLE) * 1000) AS INTEGER) AS c,
  CAST(abs(floor(CAST(embedding[3] AS DOUBLE) * 1000)) + 1 AS INTEGER) AS size FROM embeddings),
kth AS (SELECT image_key, particle_id, d FROM (SELECT a.image_key, a.particle_id, sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) AS d,
  row_number() OVER (PARTITION BY a.image_key, a.particle_id ORDER BY d) AS k FROM p a JOIN p b ON a.image_key = b.image_key AND a.particle_id <> b.particle_id) WHERE k = 3),
radius AS (SELECT image_key, CAST(CASE WHEN m IS NULL THEN 200 ELSE greatest(1, round_even(m * 1.5, 0)) END AS INTEGER) AS radius
  FROM (SELECT DISTINCT image_key FROM p) LEFT JOIN (SELECT image_key, median(d) AS m FROM kth GROUP BY 1) USING (image_key))"""
_RELATIONS = (
    _PARTICLES
    + """,
prim AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_key ORDER BY size DESC, particle_id) AS k FROM p WHERE image_key % 5 = 0) WHERE k = 1),
rel AS (SELECT red_image, primary_id, relation_id, dr, dc, CAST(least(round_even(0.75 * d, 0), 50) AS INTEGER) AS sd, row_number() OVER (PARTITION BY red_image ORDER BY relation_id) AS no,
  row_number() OVER (PARTITION BY red_image ORDER BY dr * dr + dc * dc, relation_id) AS near FROM (
  SELECT a.image_key AS red_image, a.particle_id AS primary_id, b.particle_id AS relation_id, b.r - a.r AS dr, b.c - a.c AS dc, sqrt(CAST((b.r - a.r) * (b.r - a.r) + (b.c - a.c) * (b.c - a.c) AS DOUBLE)) AS d
  FROM prim a JOIN p b ON a.image_key = b.image_key AND a.particle_id <> b.particle_id))"""
)
_NEAR = ", near_rel AS (SELECT rel.* FROM rel JOIN radius ON red_image = image_key WHERE sqrt(CAST(dr * dr + dc * dc AS DOUBLE)) < radius)"


def _candidates(relations: str, number: str) -> str:
    return f""",
cand AS (SELECT red_image, green_image, anchor_id, relation_no, candidate_id, d, wr, wc, r, c FROM (
  SELECT t.red_image, f.image_key AS green_image, f.particle_id AS anchor_id, t.{number} AS relation_no, q.particle_id AS candidate_id, f.r + t.dr AS wr, f.c + t.dc AS wc, q.r, q.c, t.sd,
    sqrt(CAST((f.r + t.dr - q.r) * (f.r + t.dr - q.r) + (f.c + t.dc - q.c) * (f.c + t.dc - q.c) AS DOUBLE)) AS d
  FROM {relations} t JOIN p f ON f.image_key % 5 <> 0 JOIN p q ON q.image_key = f.image_key) WHERE d < sd)"""


#: Relations in order of their particles; per anchor a step for each relation that has candidates, with all its options and what later
#: steps may still take; then the cheapest way to each set of taken candidates that matters later, the first of equally cheap ones.
_FULL = (
    _RELATIONS
    + _NEAR
    + ", nrel AS (SELECT *, row_number() OVER (PARTITION BY red_image ORDER BY relation_id) AS rno FROM near_rel)"
    + _candidates("nrel", "rno")
    + """,
step AS (SELECT *, row_number() OVER (PARTITION BY red_image, green_image, anchor_id ORDER BY relation_no) AS k FROM (
  SELECT red_image, green_image, anchor_id, relation_no, list({'c': candidate_id, 'd': d} ORDER BY candidate_id) || [{'c': 9000000000000, 'd': 50.0}] AS options FROM cand GROUP BY ALL)),
later AS (SELECT a.red_image, a.green_image, a.anchor_id, a.k, list_distinct(flatten(list(list_transform(b.options, lambda o: o.c)))) AS live FROM step a JOIN step b USING (red_image, green_image, anchor_id) WHERE b.k > a.k GROUP BY ALL),
steps AS MATERIALIZED (SELECT step.*, coalesce(live, []) AS live FROM step LEFT JOIN later USING (red_image, green_image, anchor_id, k)),
way AS (
  SELECT DISTINCT red_image, green_image, anchor_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, {'cost': CAST(0 AS DOUBLE), 'picks': CAST([] AS BIGINT[])} AS best FROM steps
  UNION ALL
  SELECT red_image, green_image, anchor_id, k, used, min(best) FROM (
    SELECT w.red_image, w.green_image, w.anchor_id, s.k, list_sort(list_filter(list_append(w.used, o.c), lambda x: x < 9000000000000 AND list_contains(s.live, x))) AS used,
      {'cost': round(w.best.cost + o.d, 9), 'picks': list_append(w.best.picks, CAST(o.c AS BIGINT))} AS best
    FROM way w JOIN (SELECT *, unnest(options) AS o FROM steps) s ON w.red_image = s.red_image AND w.green_image = s.green_image AND w.anchor_id = s.anchor_id AND s.k = w.k + 1 WHERE NOT list_contains(w.used, o.c))
  GROUP BY red_image, green_image, anchor_id, k, used),
pick AS (SELECT red_image, green_image, anchor_id, unnest(range(1, len(picks) + 1)) AS k, unnest(picks) AS candidate_id FROM (
  SELECT red_image, green_image, anchor_id, best.picks AS picks FROM way w WHERE k = (SELECT max(k) FROM steps s WHERE s.red_image = w.red_image AND s.green_image = w.green_image AND s.anchor_id = w.anchor_id))),
asg AS (SELECT x.*,
  (SELECT min(y.d) FROM cand y WHERE y.red_image = x.red_image AND y.green_image = x.green_image AND y.anchor_id = x.anchor_id AND y.relation_no = x.relation_no AND y.candidate_id <> x.candidate_id) AS second
  FROM pick JOIN steps USING (red_image, green_image, anchor_id, k) JOIN cand x ON x.red_image = pick.red_image AND x.green_image = pick.green_image AND x.anchor_id = pick.anchor_id AND x.relation_no = steps.relation_no AND x.candidate_id = pick.candidate_id),
sc AS (SELECT *, 100 * exp(-d / 20) * CASE WHEN second IS NULL OR second < 1e-6 THEN 1.0 ELSE exp(-(d / second) / 0.5) END AS score FROM asg),
geo AS (SELECT k.red_image, k.green_image, k.anchor_id, coalesce(avg(g), 1.0) AS geometry FROM (SELECT DISTINCT red_image, green_image, anchor_id FROM asg) k LEFT JOIN (
  SELECT a.red_image, a.green_image, a.anchor_id, CASE WHEN s >= 1e-6 THEN exp(-abs(sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) / s - 1)) END AS g FROM asg a JOIN asg b USING (red_image, green_image, anchor_id)
  JOIN nrel t ON t.red_image = a.red_image AND t.rno = a.relation_no JOIN nrel u ON u.red_image = b.red_image AND u.rno = b.relation_no, LATERAL (SELECT sqrt(CAST((t.dr - u.dr) * (t.dr - u.dr) + (t.dc - u.dc) * (t.dc - u.dc) AS DOUBLE)) AS s)
  WHERE a.relation_no < b.relation_no) USING (red_image, green_image, anchor_id) GROUP BY ALL),
pct AS (SELECT t.red_image, f.image_key AS green_image, f.particle_id AS anchor_id, coalesce(base, 0) AS base, coalesce(n / t.e, 0) AS complete, coalesce(geometry, 0) AS geometry, coalesce(hd, 0) AS hd, coalesce(n, 0) AS n, t.e, coalesce(scores, MAP {}) AS scores, coalesce(ids, []) AS ids
  FROM (SELECT red_image, count(*) AS e FROM nrel GROUP BY 1) t JOIN p f ON f.image_key % 5 <> 0
  LEFT JOIN (SELECT red_image, green_image, anchor_id, avg(score) AS base, count(*) AS n, avg(abs(c - wc)) AS hd, map(list(relation_no), list(score)) AS scores, list(candidate_id ORDER BY candidate_id) AS ids FROM sc GROUP BY ALL) m ON m.red_image = t.red_image AND m.green_image = f.image_key AND m.anchor_id = f.particle_id
  LEFT JOIN geo ON geo.red_image = t.red_image AND geo.green_image = f.image_key AND geo.anchor_id = f.particle_id)"""
).replace("WITH p AS", "WITH RECURSIVE p AS", 1)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Exponentials may differ in the last bit between engines; six places are what reports keep."""
    return df.withColumns({n: F.round(n, 6) for n in names})


def _near_relations(spark, sf: str) -> DataFrame:
    return template.relations(views.templates(spark, sf), neighbours.search_radius(views.templates(spark, sf)))


def _full(spark, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations, fields, and the matches over all relations."""
    relations, fields = _near_relations(spark, sf), views.fields(spark, sf)
    return relations, fields, M.matched(M.candidates(relations, fields))


@_query("nn_search_radius", _PARTICLES + " SELECT image_key, radius FROM radius")
def nn_search_radius(spark, sf):
    return neighbours.search_radius(views.particles(spark, sf))


@_query("nearby_particles", _PARTICLES + " SELECT a.image_key, a.particle_id, b.particle_id AS neighbour_id, sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) AS distance FROM p a JOIN p b ON a.image_key = b.image_key AND a.particle_id <> b.particle_id JOIN radius q ON q.image_key = a.image_key WHERE distance < q.radius")
def nearby_particles(spark, sf):
    p = views.particles(spark, sf)
    return neighbours.within_radius(p, neighbours.search_radius(p))


@_query("neighbour_distance_sum", _PARTICLES + " SELECT a.image_key, a.particle_id, round(sum(sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE))), 6) AS total FROM p a JOIN p b ON a.image_key = b.image_key AND a.particle_id <> b.particle_id JOIN radius q ON q.image_key = a.image_key WHERE sqrt(CAST((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS DOUBLE)) < q.radius GROUP BY ALL")
def neighbour_distance_sum(spark, sf):
    p = views.particles(spark, sf)
    return _rounded(neighbours.neighbour_distance_sum(p, neighbours.search_radius(p)), "total")


@_query("template_relations", _RELATIONS + _NEAR + " SELECT red_image, primary_id, relation_id, dr, dc, sd AS search_distance FROM near_rel")
def template_relations(spark, sf):
    return _near_relations(spark, sf).drop("sample_dir", "relation_no")


@_query("match_candidates", _RELATIONS + _NEAR + _candidates("near_rel", "relation_id") + " SELECT red_image, green_image, anchor_id, relation_no AS relation_id, candidate_id, d AS distance FROM cand")
def match_candidates(spark, sf):
    relations = _near_relations(spark, sf)
    found = M.candidates(relations, views.fields(spark, sf))
    return found.join(relations.select("red_image", "relation_no", "relation_id"), ["red_image", "relation_no"]).select(*KEY, "relation_id", "candidate_id", "distance")


@_query("nearest_candidate_score", _RELATIONS + _NEAR + _candidates("near_rel", "relation_id") + """ SELECT red_image, green_image, anchor_id, relation_no AS relation_id, candidate_id, d AS distance,
 round(100 * exp(-d / 20) * CASE WHEN s IS NULL OR s < 1e-6 THEN 1.0 ELSE exp(-(d / s) / 0.5) END, 6) AS score FROM (SELECT *, lead(d) OVER w AS s, row_number() OVER w AS k FROM cand WINDOW w AS (PARTITION BY red_image, green_image, anchor_id, relation_no ORDER BY d, candidate_id)) WHERE k = 1""")
def nearest_candidate_score(spark, sf):
    relations = _near_relations(spark, sf)
    scored = M.nearest_scores(M.candidates(relations, views.fields(spark, sf)))
    named = scored.join(relations.select("red_image", "relation_no", "relation_id"), ["red_image", "relation_no"])
    return _rounded(named.select(*KEY, "relation_id", "candidate_id", "distance", "score"), "score")


@_query("full_assignment", _FULL + " SELECT red_image, green_image, anchor_id, CAST(relation_no AS INTEGER) AS relation_no, candidate_id, d AS distance FROM asg")
def full_assignment(spark, sf):
    return _full(spark, sf)[2].select(*KEY, "relation_no", "candidate_id", "distance")


@_query("geometry_consistency", _FULL + " SELECT red_image, green_image, anchor_id, round(geometry, 6) AS geometry_consistency FROM geo")
def geometry_consistency(spark, sf):
    return _rounded(M.geometry_consistency(_full(spark, sf)[2]), "geometry_consistency")


@_query("match_percentage", _FULL + " SELECT red_image, green_image, anchor_id, round(base * complete * geometry, 6) AS percentage, round(base, 6) AS base_score, round(complete, 6) AS completeness_ratio, round(geometry, 6) AS geometry_consistency FROM pct")
def match_percentage(spark, sf):
    out = M.percentages(*_full(spark, sf))
    return _rounded(out.select(*KEY, "percentage", "base_score", "completeness_ratio", "geometry_consistency"), "percentage", "base_score", "completeness_ratio", "geometry_consistency")


@_query("top16_matches", _FULL + " SELECT red_image, green_image, anchor_id, percentage, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY red_image, green_image ORDER BY percentage DESC, anchor_id) AS k FROM (SELECT *, round(base * complete * geometry, 6) AS percentage FROM pct)) WHERE k <= 16")
def top16_matches(spark, sf):
    return M.top(_rounded(M.percentages(*_full(spark, sf)).select(*KEY, "percentage"), "percentage"))


@_query("avg_horizontal_distance", _FULL + " SELECT red_image, green_image, anchor_id, round(hd, 6) AS horizontal_distance FROM pct WHERE n > 0")
def avg_horizontal_distance(spark, sf):
    return _rounded(M.horizontal_distance(_full(spark, sf)[2]), "horizontal_distance")


@_query("full_match_percentage", _FULL + """ SELECT red_image, green_image, anchor_id, percentage, base_score, completeness_ratio, geometry_consistency, horizontal_distance, individual_scores, matched_ids, CAST(k AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY red_image, green_image ORDER BY percentage DESC, anchor_id) AS k FROM (
    SELECT red_image, green_image, anchor_id, round(base * complete * geometry, 6) AS percentage, round(base, 6) AS base_score, round(complete, 6) AS completeness_ratio, round(geometry, 6) AS geometry_consistency, round(hd, 6) AS horizontal_distance,
      CASE WHEN n = 0 THEN '' ELSE array_to_string(list_transform(range(1, e + 1), lambda i: printf('%.6f', coalesce(scores[i], 0.0))), ',') END AS individual_scores, array_to_string(ids, ',') AS matched_ids FROM pct)) WHERE k <= 16""")
def full_match_percentage(spark, sf):
    """The whole result rows of the best anchors; lists are written as text, as in the reports."""
    names = ("percentage", "base_score", "completeness_ratio", "geometry_consistency", "horizontal_distance")
    scored = _rounded(M.percentages(*_full(spark, sf)), *names)
    listed = F.array_join(F.transform("individual_scores", lambda x: F.format_string("%.6f", x)), ",")
    return M.top(scored).select(*KEY, *names, listed.alias("individual_scores"), F.array_join("matched_ids", ",").alias("matched_ids"), "rank")


_RUN = """WITH ev AS (SELECT user_id AS sample_dir, event_id, CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN 'queued' END AS state, CAST(json_extract_string(props, '$.k') AS INTEGER) AS attempt FROM events),
st AS (SELECT sample_dir, max_by(state, event_id) AS state, max(attempt) AS attempts FROM ev WHERE state IS NOT NULL AND sample_dir IS NOT NULL GROUP BY 1)"""


@_query("latest_state_fold", "SELECT user_id, max_by(event_type, event_id) AS latest FROM events GROUP BY 1")
def latest_state_fold(spark, sf):
    return runlog.latest(views.table(spark, sf, "events"), "user_id", "event_type", "event_id")


@_query("directory_states", _RUN + " SELECT * FROM st")
def directory_states(spark, sf):
    return runlog.fold(views.run_events(spark, sf))


@_query("state_counts", _RUN + " SELECT state, count(*) AS n FROM st GROUP BY 1")
def state_counts(spark, sf):
    return runlog.state_counts(runlog.fold(views.run_events(spark, sf)))


@_query("resume_plan", _RUN + """, dirs AS (SELECT c_custkey AS sample_dir FROM customer) SELECT dirs.sample_dir, CASE WHEN state = 'completed' THEN 'completed_in_previous_run' WHEN state = 'failed' THEN 'failed_in_previous_run' END AS skip_reason,
 CASE WHEN coalesce(state, '') IN ('completed', 'failed') THEN 'skip' ELSE 'process' END AS action, CAST(coalesce(attempts, 0) + CASE WHEN coalesce(state, '') IN ('completed', 'failed') THEN 0 ELSE 1 END AS INTEGER) AS attempt FROM dirs LEFT JOIN st USING (sample_dir)""")
def resume_plan(spark, sf):
    directories = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("sample_dir"))
    return runlog.resume_plan(directories, runlog.fold(views.run_events(spark, sf)))


@_query("json_field_counts", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_field_counts(spark, sf):
    return views.table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@_query("topk_per_group", "SELECT event_type, event_id, value, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS k FROM events) WHERE k <= 16")
def topk_per_group(spark, sf):
    rows = views.table(spark, sf, "events").select("event_type", "event_id", "value")
    return rollups.top_k(rows, ["event_type"], [F.desc_nulls_last("value"), "event_id"], 16)


@_query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return runlog.windowed_counts(views.table(spark, sf, "events"), "ts", "1 hour")


_ROWS = "WITH rows AS (SELECT concat('/root/set', o_custkey % 7) AS sample_dir, o_orderpriority AS red_square, o_orderstatus AS green_square, round(o_totalprice / 1000, 6) AS percentage, CAST(o_orderkey % 100 AS DOUBLE) AS distance, CAST(o_custkey AS VARCHAR) AS particle_details, o_orderkey AS ord FROM orders)"


@_query("best_row_per_key", _ROWS + " SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY sample_dir, red_square, green_square ORDER BY percentage DESC NULLS LAST, ord) AS k FROM rows) WHERE k = 1")
def best_row_per_key(spark, sf):
    return rollups.best_rows(views.result_rows(spark, sf), ["sample_dir", "red_square", "green_square"], "percentage", "ord")


@_query("override_rows", _ROWS + """, pick AS (SELECT DISTINCT sample_dir, red_square, green_square, particle_details, distance FROM (SELECT *, row_number() OVER (PARTITION BY sample_dir, red_square, green_square ORDER BY percentage DESC, ord) - 1 AS i FROM rows) WHERE i = 1 AND green_square = 'O')
 SELECT rows.* REPLACE (CASE WHEN p.sample_dir IS NOT NULL THEN 999.0 ELSE percentage END AS percentage), percentage AS original_percentage FROM rows LEFT JOIN pick p ON p.sample_dir = rows.sample_dir AND p.red_square = rows.red_square AND p.green_square = rows.green_square AND p.particle_details IS NOT DISTINCT FROM rows.particle_details AND p.distance IS NOT DISTINCT FROM rows.distance""")
def override_rows(spark, sf):
    rows = views.result_rows(spark, sf)
    chosen = rows.filter("green_square = 'O'").select("sample_dir", "red_square", "green_square").distinct().withColumn("index", F.lit(1))
    return rollups.apply_overrides(rows, chosen)


@_query("master_union", _ROWS + " SELECT * REPLACE (regexp_extract(sample_dir, '[^/]*$') AS sample_dir) FROM rows WHERE green_square <> 'P' UNION ALL SELECT * REPLACE (regexp_extract(sample_dir, '[^/]*$') AS sample_dir) FROM rows WHERE green_square = 'P'")
def master_union(spark, sf):
    rows = views.result_rows(spark, sf)
    return rollups.master(rollups.union_all([rows.filter("green_square <> 'P'"), rows.filter("green_square = 'P'")]))


@_query("master_best", _ROWS + " SELECT * EXCLUDE k FROM (SELECT * REPLACE (regexp_extract(sample_dir, '[^/]*$') AS sample_dir), row_number() OVER (PARTITION BY regexp_extract(sample_dir, '[^/]*$'), red_square, green_square ORDER BY percentage DESC NULLS LAST, ord) AS k FROM rows) WHERE k = 1")
def master_best(spark, sf):
    return rollups.master_best(views.result_rows(spark, sf))


@_query("distinct_squares", _ROWS + " SELECT DISTINCT red_square FROM rows")
def distinct_squares(spark, sf):
    return rollups.distinct_squares(views.result_rows(spark, sf), "red_square")


@_query("bbox_size", "SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 OR p_partkey % 4 = 0 THEN p_size % 5 + p_partkey % 4 ELSE (p_size % 5) * (p_partkey % 4) END AS BIGINT) AS size FROM part")
def bbox_size(spark, sf):
    part = views.table(spark, sf, "part").withColumn("zero", F.lit(0))
    part = part.withColumn("high_row", F.col("p_size") % 5).withColumn("high_col", F.col("p_partkey") % 4)
    return part.select("p_partkey", G.box_size("zero", "zero", "high_row", "high_col").cast("long").alias("size"))


@_query("running_average_color", "SELECT vec_id, CAST(list_reduce(list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 255) AS INTEGER)), lambda a, x: CAST(round_even((a + x) / 2.0, 0) AS INTEGER)) AS INTEGER) AS color FROM embeddings")
def running_average_color(spark, sf):
    channel = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int"))
    rows = views.table(spark, sf, "embeddings").select("vec_id", channel.alias("x"))
    return rows.select("vec_id", G.running_colour(F.slice("x", F.lit(2), F.size("x") - 1), F.col("x")[0]).alias("color"))


_NAMES = "concat('/root/s', page_id % 3, '/GB.', substr(url, 9, 6), '.10x.', page_id % 40, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'mm' END, CASE WHEN page_id % 4 = 0 THEN '.Locations fixed' ELSE '' END, CASE WHEN page_id % 5 = 0 THEN '.TIF' WHEN page_id % 11 = 0 THEN '.png' ELSE '.tiff' END)"


def _names(spark, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", F.expr(_NAMES).alias("path")).withColumn("name", N.base_name("path"))


@_query("regex_role", f"SELECT page_id, CASE WHEN n ILIKE 'GB.%locations fixed%.tif' OR n ILIKE 'GB.%locations fixed%.tiff' THEN 'red' WHEN (n ILIKE 'GB.%.tif' OR n ILIKE 'GB.%.tiff') AND n NOT ILIKE '%locations fixed%' THEN 'green' END AS role FROM (SELECT page_id, regexp_extract({_NAMES}, '[^/]*$') AS n FROM pages)")
def regex_role(spark, sf):
    return _names(spark, sf).select("page_id", N.role("name").alias("role"))


@_query("regex_mm", f"SELECT page_id, coalesce(nullif(regexp_extract(n, '(\\d+)mm', 1), ''), regexp_replace(n, '\\.[^.]*$', '')) AS green_square, coalesce(nullif(regexp_extract(n, 'redsquare(\\d+)', 1), ''), '0') AS red_square, right(split_part(n, '.', 1), 12) AS label FROM (SELECT page_id, regexp_extract({_NAMES}, '[^/]*$') AS n FROM pages)")
def regex_mm(spark, sf):
    return _names(spark, sf).select("page_id", N.green_square("name").alias("green_square"), N.red_square("name").alias("red_square"), N.short_label("name").alias("label"))


@_query("sample_directories", f"SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS sample_dir FROM (SELECT {_NAMES} AS p FROM pages) WHERE regexp_matches(regexp_extract(p, '[^/]*$'), '^GB.*\\.TIF$')")
def sample_directories(spark, sf):
    return _names(spark, sf).filter(F.col("name").rlike(r"^GB.*\.TIF$")).select(N.parent("path").alias("sample_dir")).distinct()
