import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from constella.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def slow(lengths, capacity):
    """Tries every move and sums the squares anew."""
    bins, where = [], [None] * len(lengths)
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        s, best = lengths[item], None
        gaps = sorted({capacity - sum(b) for b in bins if capacity - sum(b) >= s})
        for gap in gaps or [capacity]:
            after = [capacity - sum(b) for b in bins]
            if gap < capacity:
                after.remove(gap)
            after.append(gap - s)
            total = sum(after.count(g) ** 2 for g in set(after) if g)
            if best is None or total < best[0]:
                best = total, gap
        if best[1] == capacity:
            bins.append([s])
        else:
            next(b for b in reversed(bins) if capacity - sum(b) == best[1]).append(s)
    return sorted(capacity - sum(b) for b in bins)


@pytest.mark.parametrize("seed", range(5))
def test_placement_agrees_with_brute_force(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(1, 20, 60)
    bins, offsets = P.sum_of_squares(lengths, 20)
    held = defaultdict(list)
    for b, o, n in zip(bins, offsets, lengths, strict=True):
        held[b].append((o, n))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 20
    assert sorted(20 - sum(n for _, n in x) for x in held.values()) == slow(lengths.tolist(), 20)


def test_ids_are_the_tokenizers_own():
    plain = Tokenizer.from_file(PATH)
    texts = ["Hello world's   end\n\n x", "", None, "  lead \t tab\r\n", "été 12½ ٣ x²", "中文 text", "a<|endoftext|>b", "don't I'LL ' s", "x y  z​", "“q” – …€5", "ª º µ ×÷", "\x1c\x1d a\x85b \x00\x7f", "a  \n", "ſ ǅ ʰ"]
    got = P.Tokens(PATH, 2)(texts)
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 2], t


def test_documents_are_whole_and_sequences_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(900001, None), (900002, ""), (None, "a b"), (900003, "word " * 5000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    got = P.pack_documents(docs, PATH, shard=50).collect()
    plain, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4096
    assert pieces.keys() == texts.keys()
    for doc, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        ids = [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) * 1.05 + 5


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query_places_ids_and_takes_the_digest_of_them(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "word " * 3000), (2, "a b"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, pack = [], P.pack
    monkeypatch.setattr(P, "pack", lambda pieces, *a, **k: seen.append(pack(pieces, *a, **k)) or seen[-1])
    got = P.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    placed = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in seen[0].collect()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in got.collect()} == placed and len(placed) > 3


def test_long_texts_and_other_columns(spark):
    text = "some words of it " * 60_000
    docs = spark.createDataFrame([(1, text, 5, "x"), (1, text, 5, "x"), (None, None, 6, "y")], "doc_id long, text string, piece int, ids string")
    rows = P.pack_documents(docs).collect()
    assert sorted({r.doc_id or 0 for r in rows}) == [0, 1] and [r.length for r in rows if r.doc_id is None] == [1]
    n = sum(r.length for r in rows if r.doc_id == 1)
    assert n % 2 == 0 and n > 2 * 200_000 and max(r.length for r in rows) == 1024
    assert all(len(r.ids) == 4 * r.length for r in rows)
