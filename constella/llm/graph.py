"""Connected components of distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from constella.llm import _skew, _store


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); a component is its smallest node.

    Alternates large-star and small-star steps, each one aggregate and one join on the node, until the
    edges no longer change: a number of rounds that grows with the logarithm of the longest path. Every
    round is written to the shared folder; a node of very many edges is broadcast, so that its edges stay
    where they are. Self-links and null ends are ignored; no edges give no rows.
    """
    now = _store.materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("rows"))
        large = _skew.spread_join(both, least, "a", 2 * before[0], ["b"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("rows"))
        small = _skew.spread_join(large, least, "a", 2 * before[0], ["b"])
        small = small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        done = _store.materialise(small, "edges")
        after = _digest(done)
        _store.drop(now)
        now = done
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
