"""Matching templates to fields: candidates, scores, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from constella import constants as K
from constella.functions import geometry as G
from constella.operators.assignment import KEY, assignment
from constella.operators.neighbours import cells


#: Parts into which the particles of one directory are dealt where they meet the directory's templates.
DEALT = 16


def _with_templates(fields: DataFrame, small: DataFrame) -> DataFrame:
    """Field particles with the rows of their directory's templates; a directory's particles are dealt to several tasks."""
    salted = fields.withColumn("_salt", F.pmod(F.xxhash64("green_image", "anchor_id"), F.lit(DEALT)).cast("int"))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["sample_dir", "_salt"]).drop("_salt")


def anchors(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Every particle of every field against every relation of the templates of its directory, with the point looked for."""
    f = fields.select("sample_dir", F.col("image_key").alias("green_image"), F.col("particle_id").alias("anchor_id"), "center_row", "center_col")
    met = _with_templates(f, relations.select("sample_dir", "red_image", "relation_no", "search_distance", "dr", "dc"))
    return met.select(*KEY, "relation_no", "search_distance", (F.col("center_row") + F.col("dr")).alias("want_row"), (F.col("center_col") + F.col("dc")).alias("want_col"))


def candidates(relations: DataFrame, fields: DataFrame) -> DataFrame:
    """Field particles nearer to the point looked for than the relation's search distance.

    No search distance exceeds the cell width, so a point's candidates lie in the cells around its own. The
    particles are listed in all nine of theirs, as they are fewer than the points by the number of relations.
    """
    size = F.lit(K.MAX_SEARCH_DISTANCE)
    a = anchors(relations, fields).withColumn("cell", cells(F.col("want_row"), F.col("want_col"), size, 0)[0]).alias("a")
    p = fields.select("image_key", "particle_id", "center_row", "center_col", F.explode(cells(F.col("center_row"), F.col("center_col"), size, 1)).alias("cell")).alias("p")
    d = G.distance("a.want_row", "a.want_col", "p.center_row", "p.center_col")
    met = a.join(p, (F.col("a.green_image") == F.col("p.image_key")) & (F.col("a.cell") == F.col("p.cell")) & (d < F.col("a.search_distance")))
    return met.select(*[f"a.{c}" for c in KEY], "a.relation_no", F.col("p.particle_id").cast("long").alias("candidate_id"), d.alias("distance"), "a.want_row", "a.want_col", "p.center_row", "p.center_col")


def nearest_scores(found: DataFrame) -> DataFrame:
    """Each relation's nearest candidate on its own, without the one-to-one rule: score times selectivity."""
    w = Window.partitionBy(*KEY, "relation_no").orderBy("distance", "candidate_id")
    ranked = found.withColumn("second", F.lead("distance").over(w)).withColumn("rank", F.row_number().over(w)).filter("rank = 1")
    return ranked.select(*KEY, "relation_no", "candidate_id", "distance", (G.deviation_score("distance") * G.selectivity("distance", "second")).alias("score"))


def matched(found: DataFrame) -> DataFrame:
    """The assignment with each chosen candidate's score."""
    return assignment(found).withColumn("score", G.deviation_score("distance") * G.selectivity("distance", "second"))


def _by_anchor(matches: DataFrame) -> DataFrame:
    """One row per template and anchor with its matches in relation order."""
    columns = ["relation_no", "candidate_id", "score", "want_row", "want_col", "center_row", "center_col"]
    return matches.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("m"))


def _mean(values):
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _geometry(m):
    """Mean agreement over pairs; points looked for lie apart as the template's particles do."""

    def with_later(x, i):
        later = F.slice(m, i + 2, F.size(m))
        return F.transform(later, lambda y: G.stretch_score(G.distance(x["want_row"], x["want_col"], y["want_row"], y["want_col"]), G.distance(x["center_row"], x["center_col"], y["center_row"], y["center_col"])))

    return F.coalesce(_mean(F.filter(F.flatten(F.transform(m, with_later)), lambda v: v.isNotNull())), F.lit(1.0))


def _offset(m):
    return _mean(F.transform(m, lambda x: F.abs(x["center_col"] - x["want_col"]).cast("double")))


def geometry_consistency(matches: DataFrame) -> DataFrame:
    """Mean agreement of pairwise distances of matched particles in template and field; 1 without a pair."""
    return _by_anchor(matches).select(*KEY, _geometry(F.col("m")).alias("geometry_consistency"))


def horizontal_distance(matches: DataFrame) -> DataFrame:
    """Mean absolute column offset of matched particles from where they were looked for."""
    return _by_anchor(matches).select(*KEY, _offset(F.col("m")).alias("horizontal_distance"))


def percentages(relations: DataFrame, fields: DataFrame, matches: DataFrame) -> DataFrame:
    """One row per template and anchor: mean score times completeness times geometry; 0 where nothing matched."""
    expected = relations.groupBy("red_image").agg(F.count(F.lit(1)).alias("expected"), F.first("sample_dir").alias("sample_dir"))
    every = _with_templates(fields.select("sample_dir", F.col("image_key").alias("green_image"), F.col("particle_id").alias("anchor_id")), expected).drop("sample_dir")
    m = F.col("m")
    measured = _by_anchor(matches).select(
        *KEY, _mean(F.transform(m, lambda x: x["score"])).alias("base"), F.size(m).alias("n"), _geometry(m).alias("geometry"), _offset(m).alias("offset"),
        F.map_from_entries(F.transform(m, lambda x: F.struct(x["relation_no"], x["score"]))).alias("by"), F.array_sort(F.transform(m, lambda x: x["candidate_id"])).alias("matched_ids"),
    )
    out = every.join(measured, KEY, "left")
    base, geometry = F.coalesce("base", F.lit(0.0)), F.coalesce("geometry", F.lit(0.0))
    complete = F.coalesce(F.col("n") / F.col("expected"), F.lit(0.0))
    # Unmatched relations stand as 0 in the list of scores, in relation order.
    scores = F.when(F.col("n").isNull(), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(1), F.col("expected").cast("int")), lambda k: F.coalesce(F.col("by")[k], F.lit(0.0))))
    return out.select(
        *KEY, (base * complete * geometry).alias("percentage"), base.alias("base_score"), complete.alias("completeness_ratio"), geometry.alias("geometry_consistency"),
        F.coalesce("offset", F.lit(0.0)).alias("horizontal_distance"), scores.alias("individual_scores"), F.coalesce("matched_ids", F.array().cast("array<bigint>")).alias("matched_ids"),
    )


def valid_scores(scored: DataFrame) -> DataFrame:
    """Drops missing and -1 scores; 0 stays."""
    return scored.filter("percentage is not null and percentage <> -1")


def top(scored: DataFrame, n: int = K.TOP_MATCHES) -> DataFrame:
    """The best ``n`` anchors of each template and field; equal ones in particle order."""
    w = Window.partitionBy("red_image", "green_image").orderBy(F.desc("percentage"), "anchor_id")
    return valid_scores(scored).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
