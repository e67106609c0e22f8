"""Best rows, overrides, paging and unions of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from constella import constants as K

NUMERIC = "^[0-9]+$"


def best_rows(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The row of the highest ``value`` per key; of equal ones the first by ``order``.

    One aggregate with a partial step: a key with any number of rows sends one per task. Rows without a value lose.
    """
    rest = [c for c in rows.columns if c not in keys]
    packed = F.struct(F.col(value).isNotNull().alias("_has"), F.col(value).cast("double").alias("_v"), (-F.col(order).cast("decimal(38,0)")).alias("_o"))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), packed).alias("_best"))
    return best.select(*keys, "_best.*").select(*rows.columns)


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked_rows(rows: DataFrame, red: str, green: str) -> DataFrame:
    """All rows of one pair, best first, equal ones in file order."""
    return rows.filter((F.col("red_square") == red) & (F.col("green_square") == green)).orderBy(F.col("percentage").cast("double").desc(), "ord")


def page(rows: DataFrame, number: int, size: int = K.PAGE_SIZE) -> DataFrame:
    """One page of ordered rows, numbered from 0; a number beyond the ends gives the nearest page."""
    pages = max(1, -(-rows.count() // size))
    return rows.offset(min(max(number, 0), pages - 1) * size).limit(size)


def apply_overrides(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Marks chosen rows, and rows of the pair with equal details and distance, as overridden.

    ``chosen`` has (sample_dir, red_square, green_square, index), the index counting a pair's rows from 0, best
    first. The replaced value is kept in ``original_percentage``. Earlier overrides stay.
    """
    pair = ["sample_dir", "red_square", "green_square"]
    w = Window.partitionBy(*pair).orderBy(F.col("percentage").cast("double").desc(), "ord")
    numbered = rows.withColumn("_index", F.row_number().over(w) - 1)
    picks = numbered.join(chosen.select(*pair, F.col("index").alias("_index")), [*pair, "_index"], "left_semi").select(*pair, F.col("particle_details").alias("_details"), F.col("distance").alias("_distance")).distinct()
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}") == F.col(f"p.{c}") for c in pair]) & F.col("particle_details").eqNullSafe(F.col("_details")) & F.col("distance").eqNullSafe(F.col("_distance"))
    hit = rows.alias("r").join(picks.alias("p"), on, "left")
    value = F.when(F.col("p.sample_dir").isNotNull(), F.lit(K.OVERRIDE_PERCENTAGE)).otherwise(F.col("r.percentage").cast("double"))
    return hit.select(*[value.alias(c) if c == "percentage" else F.col(f"r.{c}") for c in rows.columns], F.col("r.percentage").cast("double").alias("original_percentage"))


def number(column: str):
    """A text of digits as its number, anything else as 0."""
    return F.coalesce(F.when(F.col(column).rlike(NUMERIC), F.expr(f"try_cast(`{column}` as bigint)")), F.lit(0).cast("bigint"))


def distinct_squares(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(column).distinct().orderBy(number(column), column)


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def master(rows: DataFrame) -> DataFrame:
    """Rows of all directories under the directories' base names."""
    return rows.withColumn("sample_dir", F.element_at(F.split("sample_dir", "/"), -1))


def master_best(rows: DataFrame) -> DataFrame:
    """The best row per directory name, template and field; directories of one name share their keys."""
    return best_rows(master(rows), ["sample_dir", "red_square", "green_square"], "percentage", "ord")

