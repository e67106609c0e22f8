import zlib

import numpy as np
import pytest

from constella.llm import language as L


def test_held_out_accuracy(spark):
    rows = L.query(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def direct(text, names, table):
    """The mixture of one text, word by word."""
    words = []
    for w in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        raw = b" " + w.encode() + b" "
        codes = [((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 0x9E3779B1 & 0xFFFFFFFF) >> 16 for k in range(len(raw) - 2)]
        logs = sum(table[c].astype(float) for c in codes)
        words.append(np.exp(np.maximum(logs - logs.max(), -L.SPREAD)))
    words = np.array(words)

    def fit(allowed):
        p = np.array(allowed, float) / sum(allowed)
        for _ in range(500):
            r = words * p
            p = (r / r.sum(1, keepdims=True)).mean(0)
        return p, np.log((words * p).sum(1)).sum()

    p, _ = fit([1] * len(names))
    order, best = np.argsort(-p, kind="stable"), None
    for k in range(1, min(L.CANDIDATES, len(names)) + 1):
        q, ll = fit([int(j in order[:k]) for j in range(len(names))])
        value = ll - (k - 1) * (0.5 * np.log(len(words)) + 1)
        if best is None or value > best[0]:
            best = value, names[int(q.argmax())], q.max(), k
    return best[1:]


def test_mixture_agrees_with_a_direct_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = L.learn(docs)
    by = {r.lang: r.text for r in docs.orderBy("doc_id").collect() if "|" not in r.text}
    texts = [*by.values(), by["en"][:400] + " " + by["de"][:900], "der", by["fr"][:200] + " " + by["es"][:200]]
    got = L.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (names, table)).collect()
    for r in sorted(got, key=lambda r: r.doc_id):
        lang, score, size = direct(texts[r.doc_id], names, table)
        assert (r.lang_pred, r.n_langs) == (lang, size)
        assert r.score == pytest.approx(score, abs=0.01)
    mixed = next(r for r in got if r.doc_id == len(by))
    assert mixed.lang_pred == "de" and mixed.n_langs == 2


def test_odd_texts_and_no_teacher(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "123 !?", "de"), (None, "", None), (5, "€€ …", None), (6, "日本", None)], "doc_id long, text string, lang string")
    model = L.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(docs, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[None] == got[5] == ("und", 0.0) and got[6][0] in ("en", "de")
    none = L.learn(docs.limit(0))
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
    assert L.predict(docs.limit(0), model).count() == 0


def test_sets_grow_beyond_the_first_candidates(spark):
    r, parts, teach = np.random.default_rng(3), [], []
    for k, letters in enumerate(("abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx")):
        words = ["".join(r.choice(list(letters), 6)) for _ in range(60)]
        teach.append((k, " ".join(words * 5), f"l{k}"))
        parts.append(" ".join(words[: 20 + 4 * k]))
    kind = "doc_id long, text string, lang string"
    model = L.learn(spark.createDataFrame(teach, kind))
    texts = [" ".join(parts), " ".join(parts[:5]), parts[2], "1"]
    got = sorted(L.predict(spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], kind), model).collect(), key=lambda x: x.doc_id)
    assert [x.n_langs for x in got] == [6, 5, 1, 0] and [x.lang_pred for x in got] == ["l5", "l4", "l2", "und"]
    assert [m.lang for m in got[0].mixture] == ["l5", "l4", "l3", "l2", "l1", "l0"] and got[3].mixture == []
    assert [m.share for m in got[0].mixture] == pytest.approx([(20 + 4 * k) / 180 for k in reversed(range(6))], abs=0.01)
    assert got[0].score == pytest.approx(40 / 180, abs=0.01) and got[2].mixture[0].share == pytest.approx(1)


def test_letters_are_letters_only(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, "½ ²", None), (4, "٣ ⅷ ①", None), (5, "ª", None), (6, "_ ª½", None), (7, "\u0301", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, L.learn(docs)).collect()}
    assert got[3] == got[4] == got[7] == "und" and got[5] != "und" and got[6] != "und"


def test_very_long_texts_are_judged_as_their_words_say(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, table = L.learn(docs)
    by = {r.lang: r.text for r in docs.orderBy("doc_id").collect() if "|" not in r.text}
    text = (by["en"] + " " + by["de"] + " ") * 20
    data, offsets = L._text.text_bytes(L.pa.array([text]))
    whole, short = (L.infer(*L._features(data, offsets, distinct), table) for distinct in (False, True))
    assert whole[0].tolist() == short[0].tolist() and whole[2].tolist() == short[2].tolist() == [2] and whole[3] == pytest.approx(short[3], abs=1e-6)
    monkeypatch.setattr(L, "TOGETHER", 1000)
    assert L.infer(*L._features(data, offsets, True), table)[1] == pytest.approx(short[1], abs=1e-6)
    big = spark.createDataFrame([(1, text * 40, "x"), (1, text * 40, "x"), (2, "a" * 3_000_000, None)], "doc_id long, text string, lang_pred string")
    got = L.predict(big, (names, table)).collect()
    assert len(got) == 3 and all(r.n_langs == 2 for r in got if r.doc_id == 1)


def test_more_languages_than_the_bound(spark):
    docs = spark.createDataFrame([(k, f"word{k}", f"l{k}") for k in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(Exception, match="more than 3 languages"):
        L.learn(docs, max_languages=3)
    assert len(L.learn(docs, max_languages=5)[0]) == 5
