"""Sum-of-squares packing of tokenised documents into sequences.

Documents are tokenised by the public byte-level BPE and end in one separator id. A document longer than
a sequence is cut into full pieces and one shorter first piece. Full pieces are sequences of their own.
The others are dealt to shards by a hash; in its shard each is put, longest first, where the sum of the
squared counts of open sequences per residual gap becomes smallest. A shard holds about ``SHARD`` pieces
whatever the corpus' size, and a shard leaves a few sequences open at most, so the waste stays a
vanishing share.

Null text is empty: one piece that holds the separator alone. Repeated documents and null identifiers are
packed as they come; columns other than the identifier and the text are ignored, whatever their names; an empty
table gives no rows. Of equally good places the smallest gap wins, and of sequences with one gap the latest. A very long
text is tokenised whole, in memory in proportion to its length, and cut into as many pieces as it takes.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.llm import _store, _text

LENGTH = 1024
#: Documents whose short pieces are packed together.
SHARD = 32_768
#: Distinct words whose ids a worker keeps at most, in two generations.
CACHE_WORDS = 1_000_000

# The pre-tokenisation pattern of the vocabulary, for texts whose letters and digits are all ASCII or Latin.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_SIMPLE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
#: Characters for which that pattern is the vocabulary's own: neither other letters and numbers nor separators that white space classes dispute.
_COVERED = re.compile(rf"[\t\n\v\f\r\x20-\x7e{_LATIN}¡-©«¬®-±´¶-¸»¿×÷‐-‧‰-⁞₠-₿]*+\Z")



def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in plain else 256 + sum(c not in plain for c in range(b)) for b in range(256)}


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, with the ids of words kept between texts."""

    def __init__(self, path: str, separator: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.end = separator.to_bytes(4, "little")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        self.words[word] = found
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            # A special token's string is told apart by the tokenizer itself, and so is what the pattern doesn't cover.
            if text and ("<|" in text or not _COVERED.match(text)):
                ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                if len(self.words) > CACHE_WORDS // 2:
                    self.words, self.older = {}, self.words
                known, learn = self.words.get, self._word
                ids = b"".join([known(w) or learn(w) for w in _SIMPLE.findall(text or "")])
            out.append(ids + self.end)
        return out


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones, and a shorter first one."""
    first = n % length
    return ([(0, first)] if first else []) + [(k, length) for k in range(first, n, length)]


def sum_of_squares(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, placed longest first where the sum of N(g)**2 grows least.

    N(g) counts the open bins with gap g > 0. Moving a bin from gap g to g - s changes the sum by
    2 * (N(g - s) - N(g)) + 2, closing it by 1 - 2 * N(g). A bin is opened where none has room: on
    document lengths that leaves 0.2 % over the lower bound, against 1.5 % where an opening competes.
    Ties go to the smallest gap; of bins with one gap the latest is used.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    counts, opened, n = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)], 0
    for item in np.argsort(-lengths, kind="stable"):
        s = int(lengths[item])
        if s <= 0 or s > capacity:
            raise ValueError(f"a piece of {s} tokens")
        gaps = counts[s:capacity]
        there = np.flatnonzero(gaps)
        best = capacity
        if len(there):
            deltas = 2 * (counts[there] - gaps[there]) + 2
            if there[0] == 0:
                deltas[0] = 1 - 2 * gaps[0]
            best = s + int(there[np.argmin(deltas)])
        if best == capacity:
            bins[item], offsets[item], n = n, 0, n + 1
        else:
            bins[item], offsets[item] = opened[best].pop(), capacity - best
            counts[best] -= 1
        if best - s:
            opened[best - s].append(bins[item])
            counts[best - s] += 1
    return bins, offsets


def tokenise(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", separator: int = 2, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32, and the ids themselves if wanted.

    ``tokenizer`` is the path of a file that every executor has; ``name:`` before it asks the installed
    package of public tokenizers for the place.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path.startswith("name:"):
            import public_tokenizers

            path = public_tokenizers.path(path[5:])
        tokens = Tokens(path, separator)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                docs_, numbers, starts, lengths, sums, ids = [], [], [], [], [], []
                for k, raw in enumerate(tokens(part.column(1).to_pylist())):
                    for number, (start, n) in enumerate(cut(len(raw) // 4, length)):
                        own = raw[4 * start : 4 * (start + n)]
                        docs_.append(k)
                        numbers.append(number)
                        starts.append(start)
                        lengths.append(n)
                        sums.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(own)
                columns = [part.column(0).take(pa.array(docs_, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_text.give_back(pieces), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def pack(pieces: DataFrame, n_docs: int, *, length: int = LENGTH, shard: int = SHARD) -> DataFrame:
    """Adds ``sequence_id`` and ``offset``. ``pieces`` should be a written table: it is read twice."""
    shards = max(1, -(-n_docs // shard))
    full = pieces.filter(F.col("length") == length)
    # Even numbers for full pieces, odd ones for the shards' sequences.
    full = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.filter(F.col("length") < length).withColumn("_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    names = pieces.columns

    def place(batch: pa.Table) -> pa.Table:
        batch = batch.combine_chunks()
        number = batch.column("_shard")[0].as_py()
        bins, offsets = sum_of_squares(batch.column("length").to_numpy(), length)
        return pa.table([*(batch.column(c) for c in names), pa.array(((number << 32) + bins) * 2 + 1), pa.array(offsets)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    placed = short.groupBy("_shard").applyInArrow(place, f"{kinds}, sequence_id long, offset long")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, tokenizer: str = "name:byte_bpe_50k.json", *, id_col: str = "doc_id", text_col: str = "text", separator: int = 2, length: int = LENGTH, shard: int = SHARD, with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack ``docs``; the pieces are written to the shared folder in between."""
    made = tokenise(docs, tokenizer, id_col=id_col, text_col=text_col, separator=separator, length=length, with_ids=with_ids)
    made = _store.materialise(made, "pieces")
    return pack(made, made.filter("piece = 0").count(), length=length, shard=shard)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The digest is taken of the ids that were placed; they go only now.
    return pack_documents(_store.table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
