"""Benchmark decontamination with one FM-index per training shard.

A shard is one Arrow batch of documents. Its words are numbered by the vocabulary of the benchmark's
phrases; any other word cannot occur in a phrase, so the index covers every maximal run of vocabulary
words that is long enough to hold a phrase, and nothing that could match is left out. All phrases are
searched together, backward, by ranks in a wavelet matrix over the Burrows-Wheeler transform;
occurrences are located by sampled suffix positions and merged into removal spans.

A benchmark of any size is taken in parts of about ``PART_BYTES`` of text. One part is broadcast; several lie in the
shared folder, of which a task holds one at a time; what the parts find is merged, so their number changes nothing.

Null or empty text has no words and is never contaminated; null items are named by the empty string; repeated
documents and identifiers are each reported, and rows of one item are one item; an empty benchmark or an empty
table marks nothing. Where phrases overlap or tie, all of them count. Very long texts are indexed whole: memory is in
proportion to the words of a batch. Other columns, whatever their names, are ignored by :func:`contamination` and passed
through by :func:`remove_passages`.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from constella.llm import _store, _text

#: Bytes of benchmark text that are searched together, which bounds what is broadcast, and phrases that are looked up at once.
PART_BYTES, AT_ONCE = 8 << 20, 1 << 16
SAMPLE_EVERY = 8


@dataclass
class Phrases:
    """Distinct phrases as places in rows of vocabulary numbers, and the items that hold each."""

    vocabulary: np.ndarray
    words: np.ndarray
    by_length: list[tuple[int, np.ndarray, np.ndarray]]  # (length, places in words, first phrase number)
    items: np.ndarray  # of phrase k: items[bounds[k]:bounds[k + 1]]
    bounds: np.ndarray
    names: list[str]

    @property
    def shortest(self) -> int:
        return min((n for n, _, _ in self.by_length), default=0)

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, numbers) of phrases of one length, some at a time."""
        for length, places, number in self.by_length:
            for lo in range(0, len(places), AT_ONCE):
                own = places[lo : lo + AT_ONCE]
                yield self.words[own[:, None] + np.arange(length)].astype(np.int64), number + lo + np.arange(len(own))


def phrases(items: list[tuple[str, str | None]], window: int = 10) -> Phrases:
    """Windows of ``window`` consecutive words of each item; an item of fewer words is one window."""
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    data, offsets = _text.text_bytes(pa.array([t for _, t in items], pa.large_string()))
    starts, ends, rows = _text.word_bounds(data, offsets, _text.ALNUM)
    vocabulary, ids = np.unique(_text.word_hashes(data, starts, ends), return_inverse=True)
    ids, item = ids.astype(np.int32), np.array([number[i] for i, _ in items], np.int64)
    have = np.diff(rows)
    by_length, holders, bounds, first = [], [], [0], 0
    for length in sorted({int(min(n, window)) for n in have if n}):
        # Items of just so many words, and all windows of longer ones.
        rows_of = np.flatnonzero(have == length) if length < window else np.flatnonzero(have >= window)
        count = have[rows_of] - length + 1
        row = np.repeat(rows_of, count)
        place = rows[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        _, one, same = np.unique(ids[place[:, None] + np.arange(length)], axis=0, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([same.ravel(), item[row]]), axis=1)
        by_length.append((length, place[one], first))
        holders.append(pairs[1])
        bounds.append(np.cumsum(np.bincount(pairs[0], minlength=len(one))) + sum(map(len, holders[:-1])))
        first += len(one)
    return Phrases(vocabulary, ids, by_length, np.concatenate(holders) if holders else np.zeros(0, np.int64), np.concatenate([[0], *bounds[1:]]).astype(np.int64), names)


class FMIndex:
    """An index of runs of symbols 0..sigma-1; runs end in separators that no phrase matches."""

    def __init__(self, symbols: np.ndarray, run_ends: np.ndarray, sigma: int, every: int = SAMPLE_EVERY):
        # Separators are told apart by position, so that all suffixes differ; in the transform they are one symbol, 0.
        n_runs = len(run_ends)
        total = len(symbols) + n_runs
        at_end = np.zeros(total, bool)
        at_end[run_ends + np.arange(n_runs)] = True
        text = np.empty(total, np.int64)
        text[at_end] = np.arange(n_runs)
        text[~at_end] = symbols + n_runs
        order = self._suffixes(text)
        flat = np.where(at_end, 0, text - n_runs + 1)
        before = flat[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=sigma + 1))])
        self.levels = max(1, int(sigma).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = before
        for bit in range(self.levels - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(int(len(b) - self.ones[-1][-1]))
            level = np.concatenate([level[b == 0], level[b == 1]])
        head = np.zeros(total, bool)
        head[0] = True
        head[1:] = at_end[:-1]
        self.sampled = (head | at_end | (np.arange(total) % every == 0))[order]
        self.sample_rank = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling."""
        n, width = len(text), 1
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        while True:
            key = rank * (n + 1)
            key[:-width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            same = np.diff(key[order]) != 0
            rank[order] = np.concatenate([[0], np.cumsum(same)])
            if same.all() or width >= n:
                return order
            width *= 2

    def _rank(self, symbol: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
        base, out = np.zeros(len(symbol), np.int64), list(places)
        for k, bit in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            base, *out = [np.where(one, zeros + ones[p], p - ones[p]) for p in (base, *out)]
        return [p - base for p in out]

    def _back(self, place: np.ndarray) -> np.ndarray:
        """From a suffix's place to that of the suffix one symbol longer."""
        symbol, base, p = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), place
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            one = (ones[p + 1] - ones[p]).astype(bool)
            symbol = symbol * 2 + one
            base, p = (np.where(one, zeros + ones[x], x - ones[x]) for x in (base, p))
        return self.first[symbol] + p - base

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, the rows of ``words``, all of one length."""
        low, high = np.zeros(len(words), np.int64), np.full(len(words), len(self.sampled), np.int64)
        alive = np.arange(len(words))
        for k in range(words.shape[1] - 1, -1, -1):
            symbol = words[alive, k] + 1
            a, b = self._rank(symbol, low[alive], high[alive])
            low[alive], high[alive] = self.first[symbol] + a, self.first[symbol] + b
            empty = low[alive] >= high[alive]
            high[alive[empty]] = low[alive[empty]]
            alive = alive[~empty]
        return low, high

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Positions of suffixes in the text with separators."""
        out, steps, left, at = np.empty(len(place), np.int64), 0, np.arange(len(place)), place
        while len(left):
            done = self.sampled[at]
            out[left[done]] = self.samples[self.sample_rank[at[done]]] + steps
            left, at, steps = left[~done], self._back(at[~done]), steps + 1
        return out


@dataclass
class Shard:
    """The words of a batch of documents, which of them are hit, and the items found in each document."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    base: np.ndarray  # byte offsets of the documents
    hit: np.ndarray
    items: list[set[str]]


def _shard(column: pa.Array, known: Iterator[tuple[Phrases, np.ndarray]]) -> Shard:
    """One shard searched for all parts of the benchmark in turn."""
    data, offsets = _text.text_bytes(column)
    parts = []
    for lo, hi in _text.chunks(offsets):
        own = data[offsets[lo] : offsets[hi]]
        s, e, r = _text.word_bounds(own, offsets[lo : hi + 1] - offsets[lo], _text.ALNUM)
        parts.append((s + offsets[lo], e + offsets[lo], r[1:] - r[:-1], _text.word_hashes(own, s, e)))
    starts, ends, counts, hashes = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*parts, strict=True)) or [[]] * 4)]
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = Shard(starts, ends, rows, offsets, np.zeros(len(starts), bool), [set() for _ in counts])
    if len(hashes):
        for part, table in known:
            if part.shortest:
                _search(out, hashes, part, table)
    return out


def _search(shard: Shard, hashes: np.ndarray, known: Phrases, table: np.ndarray) -> None:
    """Marks in ``shard`` what an index of it gives for the phrases."""
    number, rows = np.full(len(hashes), -1, np.int32), shard.rows
    maybe = np.flatnonzero(table[hashes >> np.uint64(44)])
    if len(maybe):
        at = np.minimum(np.searchsorted(known.vocabulary, hashes[maybe]), len(known.vocabulary) - 1)
        number[maybe] = np.where(known.vocabulary[at] == hashes[maybe], at, -1)
    inside = number >= 0
    edge = np.zeros(len(inside) + 1, bool)
    edge[rows] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    run_lo = np.flatnonzero(inside & (~before | edge[:-1]))
    run_hi = np.flatnonzero(inside & (~after | edge[1:])) + 1
    long = run_hi - run_lo >= known.shortest
    run_lo, run_hi = run_lo[long], run_hi[long]
    if not len(run_lo):
        return
    lengths = run_hi - run_lo
    run_ends = np.cumsum(lengths)
    origin = np.arange(run_ends[-1]) + np.repeat(run_lo - (run_ends - lengths), lengths)
    index = FMIndex(number[origin].astype(np.int64), run_ends, len(known.vocabulary))
    marks = np.zeros(len(number) + 1, np.int64)
    doc_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for words, names in known.batches():
        low, high = index.search(words)
        n = high - low
        which = np.repeat(np.arange(len(words)), n)
        if not len(which):
            continue
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]
        at = index.locate(place)
        at = origin[at - np.searchsorted(run_ends + np.arange(len(run_ends)), at, "left")]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + words.shape[1], -1)
        for doc, phrase in np.unique(np.stack([doc_of[at], names[which]]), axis=1).T.tolist():
            shard.items[doc].update(known.names[k] for k in known.items[known.bounds[phrase] : known.bounds[phrase + 1]].tolist())
    shard.hit |= np.cumsum(marks[:-1]) > 0


def _prefilter(known: Phrases) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[known.vocabulary >> np.uint64(44)] = True
    return table


class _Known:
    """A benchmark's parts, for the executors: broadcast if there is one, else files in the shared folder."""

    def __init__(self, broadcast, paths: list[str]):
        self.broadcast, self.paths = broadcast, paths

    def __iter__(self) -> Iterator[tuple[Phrases, np.ndarray]]:
        if self.broadcast is not None:
            yield self.broadcast.value, _prefilter(self.broadcast.value)
        for path in self.paths:
            from pyarrow import fs

            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_stream(place) as file:
                part = pickle.loads(file.read())
            yield part, _prefilter(part)


def _known(benchmark: DataFrame, item_col: str, text_col: str, window: int, part_bytes: int = 0) -> _Known:
    """The phrases of a benchmark; its size is looked at before any of it comes to the driver, which holds one part at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = -(-size // (part_bytes or PART_BYTES)) or 1
    if parts == 1:
        return _Known(spark.sparkContext.broadcast(phrases([tuple(r) for r in rows.collect()], window)), [])
    from pyarrow import fs

    dealt = _store.materialise(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("int")), "benchmark")
    folder, paths = _store.new_path(spark, "phrases"), []
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    for k in range(parts):
        own = phrases([tuple(r) for r in dealt.filter(F.col("part") == k).select("i", "t").collect()], window)
        with store.open_output_stream(f"{place}/{k}") as out:
            out.write(pickle.dumps(own))
        paths.append(f"{folder}/{k}")
    _store.drop(dealt)
    return _Known(None, paths)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per document: words, hit words, item ids found, and the merged spans in UTF-8 bytes."""
    known = _known(benchmark, item_col, item_text_col, window)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _shard(batch.column(1), known)
            totals = np.concatenate([[0], np.cumsum(found.hit)])
            n_hit = totals[found.rows[1:]] - totals[found.rows[:-1]]
            spans = [_spans(found, k) if n_hit[k] else [] for k in range(batch.num_rows)]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(found.rows), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in found.items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_text.give_back(shard), f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>")


def _spans(shard: Shard, doc: int) -> list[dict]:
    lo, hi, base = shard.rows[doc], shard.rows[doc + 1], shard.base[doc]
    step = np.diff(np.concatenate([[0], shard.hit[lo:hi].astype(np.int8), [0]]))
    first, last = np.flatnonzero(step == 1) + lo, np.flatnonzero(step == -1) + lo - 1
    return [{"start": int(shard.starts[a] - base), "end": int(shard.ends[b] - base)} for a, b in zip(first, last, strict=True)]


def remove_passages(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs`` with every hit span cut from the text; a document of which no word is left goes.

    Documents without hits keep their text as it is, null included.
    """
    known = _known(benchmark, item_col, item_text_col, window)
    text_at = docs.columns.index(text_col)
    chars_at = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _shard(batch.column(text_at), known)
            touched = [k for k, x in enumerate(found.items) if x]
            if touched:
                texts = batch.column(text_at).to_pylist()
                chars = batch.column(chars_at).to_pylist() if chars_at is not None else None
                stay = np.ones(batch.num_rows, bool)
                for k in touched:
                    raw, kept, at = texts[k].encode(), [], 0
                    for span in _spans(found, k):
                        kept.append(raw[at : span["start"]])
                        at = span["end"]
                    texts[k] = b"".join([*kept, raw[at:]]).decode()
                    stay[k] = not found.hit[found.rows[k] : found.rows[k + 1]].all()
                    if chars is not None and chars[k] is not None:
                        chars[k] = len(texts[k])
                columns = list(batch.columns)
                columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
                if chars is not None:
                    columns[chars_at] = pa.array(chars, batch.schema.field(chars_at).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(stay))
            yield batch

    return docs.mapInArrow(_text.give_back(shard), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(_store.table(spark, sf_dir, "documents"), _store.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: w[i:i + 9])) AS phrase FROM b WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
n AS (SELECT DISTINCT len(phrase) AS n FROM p),
o AS (SELECT r, i, n, item FROM (SELECT r, n, i, w[i:i + n - 1] AS phrase FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)) JOIN p USING (phrase)),
h AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM o) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
