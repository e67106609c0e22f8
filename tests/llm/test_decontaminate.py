import re

import numpy as np
import pytest

from constella.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    words, hit, found = lowered(text), set(), set()
    for name, t in items:
        w = lowered(t)
        for k in range(max(len(w) - window + 1, min(len(w), 1))):
            p = w[k : k + window]
            for a in range(len(words) - len(p) + 1):
                if words[a : a + len(p)] == p:
                    hit |= set(range(a, a + len(p)))
                    found.add(name)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts_agree_with_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    say = lambda n: " ".join(r.choice(["ab", "b", "É", "x1"], n))
    items = [(str(k), say(int(r.integers(0, 7)))) for k in range(12)] + [("n", None)]
    docs = [(k, say(int(r.integers(0, 60)))) for k in range(40)] + [(100, None), (101, ""), (102, "?? --"), (None, items[0][1])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, window=4).collect()
    assert len(got) == len(docs)
    want = sorted((brute(t, items, 4) for _, t in docs), key=str)
    assert sorted(((x.n_words, x.n_hit, x["items"]) for x in got), key=str) == want


@pytest.mark.parametrize("part_bytes", [7, 40])
def test_a_benchmark_in_parts_finds_the_same(spark, monkeypatch, part_bytes):
    r = np.random.default_rng(9)
    say = lambda n: " ".join(r.choice(["ab", "b", "c", "x1"], n))
    items = [(str(k % 20), say(int(r.integers(0, 9)))) for k in range(30)] + [(None, "ab b c x1 ab")]
    docs = spark.createDataFrame([(k, say(int(r.integers(0, 50))), "s", 1) for k in range(40)], "doc_id long, text string, spans string, n_hit int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(str, D.contamination(docs, bench, window=4).collect()))
    cut = sorted(map(str, D.remove_passages(docs, bench, window=4).collect()))
    monkeypatch.setattr(D, "PART_BYTES", part_bytes)
    assert D._known(bench, "item_id", "text", 4).broadcast is None
    assert sorted(map(str, D.contamination(docs, bench, window=4).collect())) == whole
    assert sorted(map(str, D.remove_passages(docs, bench, window=4).collect())) == cut


def test_phrases_are_looked_up_in_batches(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(300))
    docs, bench = spark.createDataFrame([(1, text), (1, text), (2, "w1 w2")], "doc_id long, text string"), spark.createDataFrame([(7, text), (7, text)], "item_id long, text string")
    known = D.phrases([("7", text), ("7", text), ("8", "w1 w2")])
    monkeypatch.setattr(D, "AT_ONCE", 13)
    assert sum(len(w) for w, _ in known.batches()) == 292 and max(len(w) for w, _ in known.batches()) == 13
    assert sorted((x.doc_id, x.n_hit, x["items"]) for x in D.contamination(docs, bench).collect()) == [(1, 300, ["7"]), (1, 300, ["7"]), (2, 0, [])]


def test_very_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(10))
    text = "w " * 300_000 + passage + " v" * 300_000 + " " + passage
    docs = spark.createDataFrame([(1, text), (2, "w " * 500_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in D.contamination(docs, spark.createDataFrame([("a", passage), ("b", "w " * 12)], "item_id string, text string")).collect()}
    assert (got[1].n_hit, got[1]["items"], len(got[1].spans)) == (300_020, ["a", "b"], 2) and got[2].n_hit == 500_000


def test_spans_are_cut_and_clean_rows_stay(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"Before, {passage.upper()} after", 5, "z"), (2, passage, 6, "z"), (3, None, None, "z"), (4, "clean w1 w2", 11, None)]
    got = D.remove_passages(spark.createDataFrame(docs, "doc_id long, text string, n_chars long, spans string"), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()
    assert {x.doc_id: (x.text, x.n_chars) for x in got} == {1: ("Before,  after", 14), 3: (None, None), 4: ("clean w1 w2", 11)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, none).first().n_hit == 0
    assert D.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_index_of_long_repeats():
    symbols = np.array([1, 2] * 500 + [1, 2, 3])
    index = D.FMIndex(symbols, np.array([1000, 1003]), 4)
    low, high = index.search(np.array([[1, 2, 1], [2, 3, 3], [2, 1, 2]]))
    assert (high - low).tolist() == [499, 0, 499]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == list(range(0, 998, 2))
