import re
import time
from collections import Counter

import numpy as np
import pytest

from constella.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, inside = Counter(runs), set()
    for k, run in enumerate(runs):
        if often[run] > 1:
            inside |= set(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n


def texts(seed):
    r = np.random.default_rng(seed)
    out = [None, "", " \t\r\n", "\x0bé\x0c😀 x\x00y", "a\n\na\na \n", "\n".join(["same line here"] * 9), "w " * 4000]
    for _ in range(60):
        n = int(r.integers(0, 80))
        out.append("".join(w + s for w, s in zip(r.choice(["a", "b", "é*", "C|", " "], n), r.choice([" ", "\n", "  ", "\t"], n), strict=True)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_measures_agree_with_brute_force(spark, seed):
    data = [(k, t, "en" if k % 3 else None, f"s{k % 2}", 0) for k, t in enumerate(texts(seed))]
    got = {r.doc_id: r for r in Q.report(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words int")).collect()}
    assert len(got) == len(data)
    for k, t, *_ in data:
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def said(k, marks, n=100):
    return " ".join(f"word{j}{k}" + "*" * (j < marks) for j in range(n))


def test_no_fixed_cutoff_gives_the_verdicts(spark):
    # Sources of plain prose, and of code that is full of marks: 50 to 60 marks are usual in one, 60 an outlier in the other.
    rows = [(k, said(k, 2 + k % 5), "en", "plain") for k in range(300)] + [(1000 + k, said(k, 50 + k % 11), "en", "code") for k in range(200)]
    rows += [(5000, said(1, 60), "en", "plain"), (5001, said(2, 100), "en", "plain"), (5002, said(3, 61), "en", "code"), (5003, "**** ".join(said(4, 100).split()) + " *", "en", "code")]
    got = {r.doc_id: r for r in Q.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sorted(k for k, r in got.items() if not r.kept) == [5000, 5001, 5003]
    # Documents with more marks are kept than some that are rejected: no cutoff on the rate does this.
    assert max(r.marks_pm for r in got.values() if r.kept) > min(r.marks_pm for r in got.values() if not r.kept)


def test_fences_of_the_given_documents_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = Q.with_measures(docs.select("lang", "source", "text")).drop("text").cache()
    found = Q.fences(Q.sketches(measured)).collect()
    for rule in ("marks_pm", "upper_pm", "word_len_pm"):
        own = Counter(r.fence for r in found if r.rule == rule)
        assert len(own) > 4 and max(own.values()) < 0.5 * sum(own.values()), (rule, own)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rejected = [labels.get(r.doc_id) for r in Q.report(docs).filter("not base_failed and not kept").collect()]
    assert rejected.count(0) > 10 and rejected.count(1) <= 1


def test_small_groups_lean_on_their_language(spark):
    rows = [(k, said(k, 2 + k % 5), "en", "plain") for k in range(200)] + [(900, said(7, 90), "en", "tiny"), (902, said(9, 3), None, None)] + [(910 + k, said(8, 3 + k), "en", "tiny") for k in range(4)]
    kept = {r.doc_id: r.kept for r in Q.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, v in kept.items() if not v] == [900]


def test_short_texts_arent_rejected_for_one_event(spark):
    line = lambda k, j: " ".join(f"w{k}x{j}y{i}" for i in range(12))
    rows = [(k, "\n".join(line(k, j) for j in range(6)), "en", "s") for k in range(100)] + [(500, "\n".join([line(500, 0), line(500, 1), "Les.", "Les."]), "en", "s")]
    assert all(r.kept for r in Q.report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect())


def test_long_blanks_and_other_white_space(spark):
    big = " \t" * 500_000
    rows = [(1, "a \u0085", "en", "s"), (2, f"a{big}b", "en", "s"), (3, big, "en", "s"), (4, f"x{big}", "en", "s"), (5, "a\u2028b \u00a0", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    Q.report(docs.limit(1)).collect()
    began = time.time()
    got = {r.doc_id: r.n_words for r in Q.report(docs).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 1, 5: 2} and time.time() - began < 20


def test_sketches_merge_to_the_sketch_of_all(spark):
    values = spark.range(5000).selectExpr("id * id % 79190 as v").select("v", Q.bucket("v").alias("b"))
    for r in values.collect():
        assert r.b <= r.v and (r.v < 512 and r.b == r.v or r.v - r.b < r.v / 256)


def test_sql_agrees(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(Q.ORACLE_SQL)
    got = Q.query(spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())


def test_filter_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)), "en", "s", 7, True), (2, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_words int, kept boolean")
    assert [tuple(r) for r in Q.keep_good(docs).drop("text").collect()] == [(1, "en", "s", 7, True)]
    assert Q.keep_good(docs).columns == docs.columns
    assert Q.keep_good(docs.limit(0)).count() == 0 and Q.report(docs.limit(0)).count() == 0
