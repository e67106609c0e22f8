import re

import numpy as np
import pytest

from constella.llm import graph, ngram_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, min(len(words), 1)))}


def brute(docs, width, percent=75):
    sets = [shingles(t, width) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (i, _), g in zip(docs, group, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    return [(i, len(s), least[g]) for (i, _), s, g in zip(docs, sets, group, strict=True)]


def check(spark, docs, width, parts=3):
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = J.link_classes(table, width=width).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(docs, width), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_random_copies_agree_with_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    docs = []
    for _ in range(14):
        words = r.choice([f"w{k}" for k in range(30)], int(r.integers(3, 60))).tolist()
        for _ in range(int(r.integers(1, 7))):
            own = [w if r.random() > 0.03 else "New" for w in words]
            docs.append((len(docs), " \n".join(own[: len(own) - int(r.integers(0, 4))])))
    docs += [(500, None), (501, ""), (502, " \t"), (503, "é b"), (504, "É b"), (505, "é B"), (506, docs[0][1].upper()), (None, docs[1][1]), (None, "alone and without a name"), (7, docs[9][1])]
    check(spark, docs, int(r.integers(2, 6)))


def test_chain_of_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[4 * k : 4 * k + 80])) for k in range(31)]
    check(spark, docs, 2)


def test_large_group_needs_few_pairs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(J, "_verified", lambda pairs, *a, f=J._verified: (seen.append(pairs.count()), f(pairs, *a))[1])
    r = np.random.default_rng(0)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(300):
        own = base.copy()
        for at in r.integers(0, 120, 2):
            own[at] = f"x{k}-{at}"
        docs.append((k, " ".join(own)))
    check(spark, docs, 3)
    assert sum(seen) < 1200


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (2, None, "z"), (None, "a b c d e f", "n"), (4, "other words are here now", None)], "doc_id long, text string, _row string")
    got = J.keep_one(docs).collect()
    assert sorted((r.doc_id or 0, r._row or "") for r in got) == [(0, "n"), (1, "y"), (2, "z"), (4, "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.link_classes(docs).count() == 0 and J.keep_one(docs).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(90, 100), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 100: 90}


def test_filters_refute_only_what_counting_refutes():
    r = np.random.default_rng(1)
    refuted = 0
    for size in (50, 3000):
        for _ in range(150):
            pool = r.integers(0, 2**63, size + size // 5).astype(np.uint64) * np.uint64(2)
            x, y = (np.unique(r.choice(pool, int(r.integers(1, size)))) for _ in range(2))
            same = len(np.intersect1d(x, y))
            for percent in (20, 50, 75, 100):
                linked = 100 * same >= percent * (len(x) + len(y) - same)
                may = J.may_reach(J._signature(x), J._signature(y), len(x), len(y), percent)
                assert J.overlap_reaches(x, y, percent) == linked and (may or not linked)
                refuted += not may
    assert refuted > 300
    many = np.arange(2**14, dtype=np.uint64)  # all in one range, whose count overflows
    assert J.may_reach(J._signature(many), J._signature(many[:-9]), len(many), len(many) - 9, 75)


def test_sets_of_one_half_digest_are_told_apart(spark, monkeypatch):
    few = lambda h, rows: ((np.diff(rows) % 3).astype(np.uint64), J._text.mix(np.add.reduceat(np.append(h, np.uint64(0)), rows[:-1]) + np.diff(rows).astype(np.uint64)))
    monkeypatch.setattr(J, "_digests", few)
    docs = [(k, " ".join(f"w{k // 3}x{j}" for j in range(9 + k % 3))) for k in range(24)] + [(50, None), (51, "")]
    check(spark, docs, 2)


def test_hot_grams_and_classes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(J._skew, "LEAST", 3)
    monkeypatch.setattr(J._skew, "FEW", 0)
    monkeypatch.setattr(J._skew, "FEW_PAIRS", 0)
    monkeypatch.setattr(J, "HOT", 0)
    r, docs = np.random.default_rng(5), []
    base = [f"w{k}" for k in range(60)]
    for k in range(120):
        own = base.copy()
        for at in r.integers(0, 60, 3):
            own[at] = f"x{k}-{at}"
        docs.append((k, " ".join(own)))
    docs += [(200 + k, " ".join(base)) for k in range(40)] + [(300 + k, " ".join([f"o{k}", *base[:4]])) for k in range(30)] + [(400 + k, None) for k in range(30)]
    check(spark, docs, 3)


def test_other_columns_and_long_texts(spark):
    long = " ".join(f"v{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, long, 1, "a"), (2, long + " end", 2, "b"), (3, "short", 3, None)], "doc_id long, text string, node int, component string")
    assert sorted(tuple(r) for r in J.link_classes(docs).collect()) == [(1, 59_996, 1), (2, 59_997, 1), (3, 1, 3)]
    assert sorted((r.doc_id, r.node, r.component) for r in J.keep_one(docs).collect()) == [(1, 1, "a"), (3, 3, None)]
