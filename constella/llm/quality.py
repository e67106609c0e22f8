"""Quality rules with thresholds that mergeable quantile sketches set for each language and source.

Base measures are exact for every text. On top of them, rates in whole per mille (marks and capitals among
characters, word lengths, repeated lines and words) are summarised for each (language, source) by sketches:
counts of values in buckets of ever wider integer ranges, nine bits of precision each. A sketch is a set of
(bucket, count) rows, so sketches of any parts of the corpus merge by adding counts, in any order, with the
same result. A rule names two quantiles; a group's fence lies ``reach`` times their distance beyond the
upper one, and no cutoff is fixed: what is usual in one source is rejected in another. Fences of groups
shrink to their language's, and those of languages to the corpus', by ``PRIOR`` documents' weight, so a
small group has no other rule than a large one. A document is rejected when its count lies further above what
the fence allows a text of its size than chance explains (three standard deviations), so short texts aren't
rejected for a single event. Everything is DataFrame expressions.

Null text has no words and fails the base rules. Null language or source is a group like any other, and
identifiers may repeat or be null: every row is judged by its own text. Equal texts of one group get one
verdict. Very long texts, and runs of blanks of any length, cost time in proportion to their length. Columns
of any further name are carried along; an empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from constella.llm import _store

# The base rules' characters, window and limits.
SYMBOLS = r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED_PERCENT = 8, 20, 30
#: The marks of the ASCII block.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Rule(NamedTuple):
    """A rate ``count`` per ``size``, the quantiles (per mille) whose distance sets the fence, and how far beyond it lies."""

    count: str
    size: str
    low: int
    high: int
    reach: int
    #: The least fence in per mille, below which events are noise, and the counted units that one event brings.
    noise: int
    event: int


RULES = {
    "marks_pm": Rule("_marks", "word_chars", 250, 750, 6, 20, 1),
    "upper_pm": Rule("_upper", "word_chars", 250, 750, 6, 20, 1),
    "word_len_pm": Rule("word_chars", "n_words", 250, 750, 6, 0, 5),
    # Most texts repeat nothing, so the tail of the sketch says what a source's own repetition is.
    "dup_lines_pm": Rule("n_dup_lines", "_lines", 500, 980, 1, 50, 1),
    "repeats_pm": Rule("n_repeat_words", "n_words", 500, 980, 1, 50, 2 * WINDOW),
}
#: Documents of the language, or of the corpus, that a group's own fence is weighed against.
PRIOR = 10
#: A quantile distance counts for a sixteenth of the upper quantile at least, and an excess for three deviations.
LEAST_SPREAD, DEVIATIONS = 16, 3
#: Bits of a sketch bucket.
PRECISION = 9

_FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the base measures, ``base_failed`` and the rates of the rules; names begin with ``prefix``."""
    p = f"_{prefix}m_"
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Blanks at either end leave an empty string there, which isn't a word.
    out = docs.withColumn(f"{p}w", F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    out = out.withColumn(f"{p}n", F.size(f"{p}w"))
    # Hashes of all windows; only a text that repeats one goes on to positions.
    window = F.expr(f"case when `{p}n` >= {WINDOW} then transform(sequence(1, `{p}n` - {WINDOW - 1}), i -> xxhash64(slice(`{p}w`, i, {WINDOW}))) else array() end").cast("array<bigint>")
    out = out.withColumn(f"{p}h", window)
    # Sorted by hash, then place: places whose neighbour has the same hash belong to repeated windows.
    sorted_ = F.expr(f"array_sort(transform(`{p}h`, (h, i) -> struct(h, i)))")
    out = out.withColumn(f"{p}s", F.when(F.size(F.array_distinct(f"{p}h")) < F.size(f"{p}h"), sorted_))
    same = f"filter(`{p}s`, (x, k) -> (k > 0 and x.h = `{p}s`[greatest(k - 1, 0)].h) or (k < size(`{p}s`) - 1 and x.h = `{p}s`[least(k + 1, size(`{p}s`) - 1)].h))"
    out = out.withColumn(f"{p}at", F.expr(f"case when `{p}s` is not null then array_sort(transform({same}, x -> x.i)) end"))
    # Each place covers the words up to the next place, WINDOW at most.
    covered = f"aggregate(`{p}at`, named_struct('n', 0L, 'end', 0), (a, i) -> named_struct('n', a.n + i + {WINDOW} - greatest(a.end, i), 'end', i + {WINDOW}), a -> a.n)"
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn(f"{p}l", lines).withColumn(f"{p}j", F.array_join(f"{p}w", ""))
    measures = {
        "n_words": F.col(f"{p}n").cast("long"),
        "word_chars": F.char_length(f"{p}j").cast("long"),
        "n_symbols": F.regexp_count(F.col(f"{p}j"), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0).cast("long")),
        "_lines": F.size(f"{p}l").cast("long"),
        "_upper": F.when(F.col(f"{p}j") != F.lower(f"{p}j"), F.regexp_count(F.col(f"{p}j"), F.lit(r"\p{Lu}")).cast("long")).otherwise(F.lit(0).cast("long")),
        "_marks": F.regexp_count(F.col(f"{p}j"), F.lit(r"[!-/:-@\[-`{-~]")).cast("long"),
    }
    for name, value in measures.items():
        out = out.withColumn(f"{prefix}{name}", value)
    c = lambda name: F.col(f"{prefix}{name}")
    out = out.withColumn(f"{prefix}base_failed", (c("n_words") < MIN_WORDS) | (100 * c("n_repeat_words") > MAX_REPEATED_PERCENT * c("n_words")))
    for name, rule in RULES.items():
        out = out.withColumn(f"{prefix}{name}", F.expr(f"coalesce(1000 * `{prefix}{rule.count}` div nullif(`{prefix}{rule.size}`, 0), 0)"))
    # Filters on what a generator gives are not pushed below it, where they would work out the measures again and again.
    made = [f"{prefix}{k}" for k in (*measures, "base_failed", *RULES)]
    return out.select(*docs.columns, F.explode(F.array(F.struct(*made))).alias(f"{p}all")).select(*docs.columns, f"{p}all.*")


def bucket(value: str) -> Column:
    """The lowest value of a value's sketch bucket: the first ``PRECISION`` bits of it."""
    shift = f"greatest(length(bin({value})) - {PRECISION}, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {shift}), {shift})").cast("long")


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rule, bucket, n): the sketches of all documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value")) for r in RULES])).alias("r")
    rows = measured.filter("not base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), rates)
    return rows.groupBy("lang", "source", "r.rule", bucket("r.value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, rule, fence) from merged sketches; each fence is weighed with its language's, and that with the corpus'."""
    from pyspark.sql import Window

    of_rule = lambda field: F.create_map(*[F.lit(x) for r, rule in RULES.items() for x in (r, getattr(rule, field))])[F.col("rule")]

    def own(by: list[str], name: str) -> DataFrame:
        merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*by, "rule")
        ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
        at = lambda q: F.min(F.when(F.col("upto") * 1000 >= F.col("all") * of_rule(q), F.col("bucket")))
        ends = ranked.groupBy(*by, "rule").agg(F.max("all").alias(f"{name}_n"), at("low").alias("low"), at("high").alias("high"))
        spread = F.greatest(F.col("high") - F.col("low"), F.floor(F.col("high") / LEAST_SPREAD))
        return ends.select(*by, "rule", f"{name}_n", F.greatest(F.col("high") + of_rule("reach") * spread, of_rule("noise")).cast("long").alias(f"{name}_fence"))

    a, b, c = own(["lang", "source"], "own").alias("a"), own(["lang"], "lang").alias("b"), own([], "all").alias("c")
    joined = a.join(b, (F.col("a.rule") == F.col("b.rule")) & F.col("a.lang").eqNullSafe(F.col("b.lang"))).join(c, F.col("a.rule") == F.col("c.rule"))
    weighed = lambda n, fence, prior: f"(({n} * {fence} + {PRIOR} * {prior}) div ({n} + {PRIOR}))"
    return joined.select("a.lang", "a.source", "a.rule", F.expr(weighed("own_n", "own_fence", weighed("lang_n", "lang_fence", "all_fence"))).alias("fence"))


def _beyond(count: str, size: str, fence: str, event: int) -> str:
    """SQL for both engines: a count further above what a fence allows a size than chance and one event explain."""
    return f"(({count} - {event}) * 1e3 - {fence} * {size} * 1e0 > {DEVIATIONS} * sqrt({event} * 1e3 * {fence} * {size}))"


def judge(measured: DataFrame, fence: DataFrame, kept: str = "kept", lang: str = "lang", source: str = "source") -> DataFrame:
    """``measured`` joined with its groups' fences: the documents that pass the base rules and lie beyond no fence."""
    wide = fence.groupBy(F.col("lang").alias("_f_lang"), F.col("source").alias("_f_source")).agg(*[F.max(F.when(F.col("rule") == r, F.col("fence"))).alias(f"_f_{r}") for r in RULES])
    joined = measured.join(wide, F.col(lang).eqNullSafe(F.col("_f_lang")) & F.col(source).eqNullSafe(F.col("_f_source")), "left")
    passes = ~F.col("base_failed")
    for r, rule in RULES.items():
        passes = passes & ~F.coalesce(F.expr(_beyond(rule.count, rule.size, f"_f_{r}", rule.event)), F.lit(False))
    return joined.withColumn(kept, passes).drop("_f_lang", "_f_source", *[f"_f_{r}" for r in RULES])


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: base measures, base_failed, kept and the rates that the rules judge."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_t"))
    measured = _store.materialise(with_measures(narrow, "_t").drop("_t"), "measures")
    judged = judge(measured, fences(sketches(measured)))
    return judged.select("doc_id", *_FEATURES, "base_failed", "kept", *RULES)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept. They are written once with their measures, of which the sketches read the narrow columns."""
    own = [c for c in docs.columns]
    renamed = docs.toDF(*[f"_d_{k}" for k in range(len(own))])
    at = lambda c: f"_d_{own.index(c)}"
    measured = with_measures(renamed.withColumn("lang", F.col(at(lang_col))).withColumn("source", F.col(at(source_col))), at(text_col))
    measured = _store.materialise(measured, "measures")
    fence = _store.materialise(fences(sketches(measured)), "fences")
    return judge(measured, fence).filter("kept").select(*[F.col(f"_d_{k}").alias(c) for k, c in enumerate(own)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_store.table(spark, sf_dir, "documents"))


_SQL_MARKS = "'" + MARKS.replace("'", "''") + "'"


def _sql_fence() -> str:
    """The fence of a group of values ``b`` of one rule."""
    cases = []
    for k, x in RULES.items():
        low, high = (f"quantile_disc(b, {q / 1000})" for q in (x.low, x.high))
        cases.append(f"WHEN '{k}' THEN greatest({high} + {x.reach} * greatest({high} - {low}, {high} // {LEAST_SPREAD}), {x.noise})")
    return f"CASE rule {' '.join(cases)} END"


_SQL_FENCE = _sql_fence()

#: The measures, then the fences, then the verdict, for DuckDB.
ORACLE_CTES = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
x AS (SELECT r, unnest(list_transform(range(1, greatest(len(words) - {WINDOW - 2}, 1)), lambda i: {{'i': i, 's': array_to_string(words[i:i + {WINDOW - 1}], ' ')}})) AS u FROM w),
d AS (SELECT r, u.i AS i FROM (SELECT r, u, count(*) OVER (PARTITION BY r, u.s) AS c FROM x) WHERE c > 1),
g AS (SELECT r, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, {WINDOW})) AS own FROM d),
rep AS (SELECT r, sum(own) AS n FROM g GROUP BY r),
m AS (
  SELECT w.r, doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS _lines, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS _upper, length(t) - length(translate(t, {_SQL_MARKS}, '')) AS _marks
  FROM w LEFT JOIN rep USING (r)),
f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed,
    {", ".join(f"coalesce(1000 * {x.count} // nullif({x.size}, 0), 0) AS {k}" for k, x in RULES.items())}
  FROM m),
v AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, {k} AS value FROM f WHERE NOT base_failed" for k in RULES)}),
s AS (SELECT lang, source, rule, (value >> greatest(length(bin(value)) - {PRECISION}, 0)) << greatest(length(bin(value)) - {PRECISION}, 0) AS b FROM v),
q AS (SELECT lang, source, rule, count(*) AS n, {_SQL_FENCE} AS fence FROM s GROUP BY lang, source, rule),
ql AS (SELECT lang, rule, count(*) AS n, {_SQL_FENCE} AS fence FROM s GROUP BY lang, rule),
qa AS (SELECT rule, {_SQL_FENCE} AS fence FROM s GROUP BY rule),
fence AS (SELECT q.lang, q.source, q.rule, (q.n * q.fence + {PRIOR} * ((ql.n * ql.fence + {PRIOR} * qa.fence) // (ql.n + {PRIOR}))) // (q.n + {PRIOR}) AS fence
  FROM q JOIN ql ON ql.rule = q.rule AND ql.lang IS NOT DISTINCT FROM q.lang JOIN qa ON qa.rule = q.rule),
bad AS (SELECT DISTINCT f.r FROM f JOIN fence e ON f.lang IS NOT DISTINCT FROM e.lang AND f.source IS NOT DISTINCT FROM e.source WHERE {" OR ".join(f"(e.rule = '{k}' AND {_beyond('f.' + x.count, 'f.' + x.size, 'e.fence', x.event)})" for k, x in RULES.items())}),
judged AS (SELECT f.*, NOT base_failed AND bad.r IS NULL AS kept FROM f LEFT JOIN bad USING (r))
"""
ORACLE_SQL = f"{ORACLE_CTES} SELECT doc_id, {', '.join(_FEATURES)}, base_failed, kept, {', '.join(RULES)} FROM judged"
