"""Joins that keep even tasks when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is heavy beyond this share of all rows (and beyond ``LEAST`` rows), so fewer than ``PARTS`` keys ever are.
PARTS, LEAST = 10_000, 64
#: Rows in all up to which any key's rows are one small task, so that a plain join does; and pairs, whose values are wide.
FEW, FEW_PAIRS = 100_000, 4_000


def limit(total: int) -> int:
    return max(total // PARTS, LEAST)


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, other: list[str], how: str = "inner", few: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key`` and says in ``rows`` how many rows hold it.

    ``total`` is the number of rows or more. Heavy keys, fewer than ``PARTS`` or ``total / LEAST``, are broadcast; their rows are dealt by ``other``.
    A total of ``few`` (``FEW``) rows is joined as it is.
    """
    if total <= (FEW if few is None else few):
        return rows.join(table.drop("rows"), key, how).select(*rows.columns, *[c for c in table.columns if c not in (key, "rows")])
    values = [c for c in table.columns if c not in (key, "rows")]
    of = lambda mark, own: own.select(F.col(key).alias(f"_{mark}k"), F.struct(*values).alias(f"_{mark}v"))
    heavy, light = of("h", table.filter(F.col("rows") > limit(total))), of("l", table.filter(F.col("rows") <= limit(total)))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    marked = marked.withColumn("_sk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(F.xxhash64(*other)))
    out = marked.join(light, F.col("_sk") == F.col("_lk"), "left").withColumn("_v", F.when(F.col("_hk").isNull(), F.col("_lv")).otherwise(F.col("_hv")))
    if how == "inner":
        out = out.filter("_v is not null")
    return out.select(*rows.columns, *[F.col("_v")[c].alias(c) for c in values])


def salted_join(pairs: DataFrame, wide: DataFrame, ends: list[str], key: str, value: str, total: int) -> DataFrame:
    """``pairs`` with the ``value`` of ``wide`` (one row per ``key``) for each of the columns ``ends``.

    A key of very many pairs has its value sent to several tasks, as many as its pairs fill; ``total`` is the number of pairs.
    """
    if total <= FEW_PAIRS:
        out = pairs
        for end in ends:
            out = out.join(wide.select(F.col(key).alias(end), F.col(value).alias(f"{value}_{end}")), end)
        return out
    both = pairs.select(F.col(ends[0]).alias("_k"))
    for end in ends[1:]:
        both = both.unionByName(pairs.select(F.col(end).alias("_k")))
    often = both.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit(total))
    heavy = often.select("_k", F.ceil(F.col("_n") / limit(total)).cast("int").alias("_parts"))  # fewer than len(ends) * PARTS rows
    spread = wide.join(F.broadcast(heavy), F.col(key) == F.col("_k"), "left").select(key, value, F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_salt"))
    out = pairs
    for end in ends:
        salt: Column = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*ends), F.col("_parts")).cast("int"))
        marked = out.join(F.broadcast(heavy), F.col(end) == F.col("_k"), "left").withColumn("_s", salt).drop("_k", "_parts")
        own = spread.select(F.col(key).alias("_w"), F.col(value).alias(f"{value}_{end}"), "_salt")
        out = marked.join(own, (F.col(end) == F.col("_w")) & (F.col("_s") == F.col("_salt"))).drop("_w", "_s", "_salt")
    return out
