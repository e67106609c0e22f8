"""Secret scanning with multipart credential linking, in DataFrame expressions.

Base kinds are reported wherever they stand. Two weak kinds, a bare 40-character key and an endpoint, are
reported only when a part that completes them lies within the same scope: a key next to an access
identifier, an endpoint next to an access identifier, an assignment, a hex token or such a key. Parts meet
in an equi-join on (document, scope cell); a cell is as wide as a scope, so a part looks into three cells,
and a cell holds a bounded number of parts however long the text is.

Positions are code points. Null or empty text has no spans. Documents are told apart by row, so repeated rows and
null identifiers are each reported; other columns are ignored, whatever their names; an empty table gives no rows. Spans
of one start are listed in order of their kinds. Patterns take whole runs, so very long texts cost time in proportion
to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from constella.llm import _store

# The patterns of the kinds, in the order in which kinds are listed, and their least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Matches of fewer characters are dropped; as both take whole runs, the bound may stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KEY = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^\x00-\x20\"'<>]+|arn:aws[a-z-]*:[a-z0-9-]*:[a-z0-9-]*:[0-9]*:[^\x00-\x20\"'<>]+"
KINDS = ["assign", "access", "hex", "key", "endpoint"]

#: Code points that linked parts lie apart at most, from the end of one to the start of the other.
SCOPE = 400


def _lengths(strings) -> Column:
    return F.transform(strings, lambda x: F.char_length(x))


def _found(text, pattern: str, valid) -> Column:
    """Array of (gap before, length, ok) of the matches of a pattern; null without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(text.rlike(pattern), F.arrays_zip(_lengths(F.slice(gaps, 1, F.size(whole))).alias("gap"), _lengths(whole).alias("len"), valid(whole).alias("ok")))


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(rows, parts): the documents by row number, and the reported spans (row, kind number, start, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    yes = lambda m: F.transform(m, lambda _: F.lit(True))
    mixed = lambda m: F.transform(m, lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]"))
    found = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).withColumn("row", F.monotonically_increasing_id())
    text = F.col("_t")
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    found = found.withColumn("k0", _found(text, ASSIGN, lambda _: F.transform(value, lambda v: F.char_length(v) >= ASSIGN_LEAST)))
    found = found.withColumn("k1", F.when(F.contains(text, F.lit("AKIA")), _found(text, ACCESS, yes))).withColumn("k2", _found(text, HEX, yes))
    # A weak part is never reported without a base part, so other texts need not be searched for any.
    some = F.coalesce("k0", "k1", "k2").isNotNull()
    found = found.withColumn("k3", F.when(some, _found(text, KEY, mixed))).withColumn("k4", F.when(some, _found(text, ENDPOINT, yes)))
    found = _store.materialise(found.drop("_t"), "secrets")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("m")) for k in range(len(KINDS))]))
    rows = found.filter(F.coalesce("k0", "k1", "k2").isNotNull()).select("row", each.alias("x")).select("row", "x.kind", F.posexplode("x.m").alias("no", "m"))
    w = Window.partitionBy("row", "kind").orderBy("no")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(w)
    parts = rows.select("row", "kind", (end - F.col("m.len")).alias("start"), end.alias("end"), F.col("m.ok").alias("ok")).filter("ok").drop("ok")
    parts = _store.materialise(parts, "parts")
    base = parts.filter("kind < 3")
    return found.select("row", "doc_id"), base.unionByName(_linked(parts, scope))


def _near(weak: DataFrame, strong: DataFrame, scope: int) -> DataFrame:
    """The weak parts that have a strong one of their document within the scope; overlapping ones don't count."""
    cell = lambda c: F.floor(F.col(c) / scope).cast("long")
    # A part reaches into the cells from one before its start to one after its end; a long part has few rivals in them.
    a = weak.withColumn("cell", F.explode(F.sequence(cell("start") - 1, cell("end") + 1))).alias("a")
    b = strong.select("row", "start", "end", F.explode(F.sequence(cell("start"), cell("end"))).alias("cell")).alias("b")
    apart = (F.col("b.end") <= F.col("a.start")) & (F.col("a.start") - F.col("b.end") <= scope) | (F.col("a.end") <= F.col("b.start")) & (F.col("b.start") - F.col("a.end") <= scope)
    return a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.cell") == F.col("b.cell")) & apart, "left_semi").drop("cell").distinct()


def _free(weak: DataFrame, taken: DataFrame, scope: int) -> DataFrame:
    """The weak parts that overlap no base span of their document."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / scope).cast("long"), F.floor(F.col("end") / scope).cast("long")))
    a, b = weak.withColumn("cell", cells).alias("a"), taken.withColumn("cell", cells).alias("b")
    met = a.join(b, (F.col("a.row") == F.col("b.row")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_semi").select(*weak.columns).distinct()
    return weak.join(met, weak.columns, "left_anti")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    base = parts.filter("kind < 3")
    keys = _near(_free(parts.filter("kind = 3"), base, scope), parts.filter("kind = 1"), scope)
    keys = _store.materialise(keys, "keys")
    ends = _near(_free(parts.filter("kind = 4"), base.filter("kind > 0"), scope), base.unionByName(keys), scope)
    return keys.unionByName(ends)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_linked, and the spans in order of start and kind."""
    rows, parts = spans(docs, id_col=id_col, text_col=text_col, scope=scope)
    n = lambda k: F.count(F.when(k, 1))
    listed = F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans")
    by_row = parts.groupBy("row").agg(n(F.col("kind") == 0).alias("n_assign"), n(F.col("kind") == 1).alias("n_access"), n(F.col("kind") == 2).alias("n_hex"), n(F.col("kind") > 2).alias("n_linked"), listed)
    out = rows.join(by_row, "row", "left").fillna(0, ["n_assign", "n_access", "n_hex", "n_linked"])
    names = F.array(*[F.lit(k) for k in KINDS])
    span = lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_linked", F.coalesce(F.transform("spans", span), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")).alias("spans"))


def _joined(spans_):
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_store.table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), "n_linked")


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: A bare key is a whole run of its characters and of those that may not stand beside it; DuckDB's patterns look neither way.
_SQL_RUN = "[A-Za-z0-9+/=_-]{40,}"
_SQL_PARTS = " UNION ALL ".join(
    f"SELECT r, {k} AS kind, regexp_extract_all(t, {_sql_text(p)}) AS m, regexp_extract_all(t, {_sql_text(p)}, {2 if k == 0 else 0}) AS v, regexp_split_to_array(t, {_sql_text(p)}) AS g FROM d WHERE regexp_matches(t, {_sql_text(p)})"
    for k, p in enumerate([ASSIGN, ACCESS, HEX, _SQL_RUN, ENDPOINT])
)
_SQL_NEAR = f"(0 <= a.s - b.e AND a.s - b.e <= {SCOPE} OR 0 <= b.s - a.e AND b.s - a.e <= {SCOPE})"
_SQL_LIST = "string_agg(concat(CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' WHEN 3 THEN 'key' ELSE 'endpoint' END, ':', s, ':', e), ',' ORDER BY s, kind)"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({_SQL_PARTS}),
y AS (SELECT r, kind, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM x),
z AS (SELECT r, kind, sum(length(g[i]) + length(m[i])) OVER (PARTITION BY r, kind ORDER BY i) AS e, length(m[i]) AS n, v[i] AS v FROM y),
p AS (SELECT r, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM z WHERE CASE kind WHEN 0 THEN length(v) >= {ASSIGN_LEAST} WHEN 3 THEN regexp_full_match(v, '[A-Za-z0-9+/]{{40}}') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END),
base AS (SELECT * FROM p WHERE kind < 3),
keys AS (SELECT * FROM p a WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND a.s < b.e AND b.s < a.e) AND EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.kind = 1 AND {_SQL_NEAR})),
strong AS (SELECT * FROM base UNION ALL SELECT * FROM keys),
ends AS (SELECT * FROM p a WHERE kind = 4 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.kind > 0 AND a.s < b.e AND b.s < a.e) AND EXISTS (SELECT 1 FROM strong b WHERE b.r = a.r AND {_SQL_NEAR})),
f AS (SELECT * FROM strong UNION ALL SELECT * FROM ends),
a AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind > 2) AS n_linked, coalesce({_SQL_LIST} FILTER (kind < 3), '') AS base, {_SQL_LIST} AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN a USING (r)
"""
