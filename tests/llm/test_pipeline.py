import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline as C
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from constella.llm import _store

from tests.llm import test_decontaminate as bench, test_ngram_join as near, test_quality as quality

SF = "/root/testdata/sf0.001"
PII = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])|(?<!\w)\d{16}(?!\w)")


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).cache()
    columns = docs.columns
    made = [docs]
    for name, stage in C.STAGES[:-1]:
        out = _store.materialise(stage(spark, made[-1], SF), name)
        assert out.columns == columns and out.count() > 0
        made.append(out)
    rows = [{r.doc_id: r for r in t.collect()} for t in made]
    # Quality: base failures go, and what stays is as it was.
    failed = {k for k, r in rows[0].items() if quality.brute(r.text)[-1]}
    assert not failed & rows[1].keys() and len(rows[1]) > 0.7 * (len(rows[0]) - len(failed))
    assert all(rows[0][k] == r for k, r in rows[1].items())
    # Near duplicates: the smallest identifier of each class.
    classes = near.brute([(k, r.text) for k, r in rows[1].items()], 5)
    assert set(rows[2]) == {k for k, _, c in classes if k == c}
    # Benchmark: no window is left, and clean documents stay as they were.
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [bench.lowered(t)] for k in range(max(len(w) - 9, 1))}
    hit = lambda t: any(tuple(w[k : k + 10]) in windows for w in [bench.lowered(t)] for k in range(len(w) - 9))
    spoilt = {k for k, r in rows[2].items() if hit(r.text)}
    assert spoilt and not any(hit(r.text) for r in rows[3].values())
    assert all(rows[3][k] == r for k, r in rows[2].items() if k not in spoilt)
    # Personal data: none of the values found before is left.
    old = {m for r in rows[3].values() for m in PII.findall(r.text)}
    assert old and rows[4].keys() == rows[3].keys()
    for k, r in rows[4].items():
        assert not old & set(PII.findall(r.text)) and r.n_chars == (len(r.text) if r.text != rows[3][k].text else rows[3][k].n_chars)
        assert PII.search(rows[3][k].text) or r == rows[3][k]
    packed = C.STAGES[-1][1](spark, made[-1], SF).collect()
    assert {r.doc_id for r in packed} == set(rows[4])


def test_stages_take_nulls_and_empty_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    some = spark.createDataFrame([(None, None, None, None, None), (1, " ".join(f"w{k}" for k in range(40)), None, "s", 5), (2, "", "en", None, 0)], kind)
    docs = some
    for name, stage in C.STAGES:
        docs = _store.materialise(stage(spark, docs, SF), name)
    assert {r.doc_id for r in docs.collect()} == {1}
    for name, stage in C.STAGES[::2]:  # the others are tried on empty tables in their own tests
        assert stage(spark, some.limit(0), SF).count() == 0


def test_sequences_can_be_built_from_the_last_stage(spark):
    texts = {1: "word " * 3000, 2: "a b", 3: "don't"}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    rows = sorted(C.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: (r.doc_id, r.piece))
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for k, t in texts.items():
        ids = b"".join(r.ids for r in rows if r.doc_id == k)
        assert np.frombuffer(ids, "<u4").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_run_from_end_to_end(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    extra = spark.createDataFrame([(9001, None, None, None, None), (9001, "", "en", "s", 0), (None, " ".join(f"w{k}" for k in range(40)), "en", "s", 5)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    _store.release(spark)
    folder = Path(_store.shared_dir(spark).removeprefix("file://")) / "constella"
    before = set(folder.iterdir()) if folder.exists() else set()
    got = C.run(spark, str(tmp_path)).collect()
    assert len(set(folder.iterdir()) - before) == 1  # nothing but the result is left
    by_hand = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in C.STAGES:
        by_hand = _store.materialise(stage(spark, by_hand, str(tmp_path)), name)
    key = lambda r: (r.doc_id or -1, r.piece, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, by_hand.collect())) and len(got) > 50
    # Sequences are gapless and no longer than they may be.
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    _store.release(spark)
    assert not set(folder.iterdir()) - before


def test_columns_that_clash_with_the_stages_own(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, node string, _e string, spans string, _t string"
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "en", "s", 5, *"abcdef"), (1, text, "en", "s", 5, *"abcdef")], kind)
    for name, stage in C.STAGES[:-1]:
        docs = _store.materialise(stage(spark, docs, SF), name)
    assert [tuple(r) for r in docs.collect()] == [(1, text, "en", "s", 5, *"abcdef")]


def test_the_driver_gives_memory_back_between_tables(spark, monkeypatch):
    long_ago = -_store.PAUSE
    monkeypatch.setattr(_store, "_given_back", long_ago)
    out = _store.materialise(spark.range(10).toDF("id"), "own")
    assert _store._given_back > long_ago and sorted(r.id for r in out.collect()) == list(range(10))
    _store.drop(out)
    # Nothing else on the JVM's heap refers to this key.
    seen = spark.sparkContext._jvm.java.util.WeakHashMap()
    seen.put(123_456, "garbage")
    _store._given_back = long_ago
    _store.give_back(spark)
    assert seen.size() == 0
