"""Language identification by mixture inference over n-gram likelihoods.

Counts of hashed byte trigrams, within words and with their ends, give every language a distribution.
A document is a mixture: each of its words was written in one language, and expectation-maximisation
estimates the languages' proportions from the words' likelihoods, to convergence. Nested sets of languages, in
order of their proportions, are fitted again, and the set whose likelihood less half the logarithm of the number
of words per further language is largest gives the answer: its first language, with its proportion, and
the whole mixture. Sets grow until none is better. Of languages of equal proportions the first by name leads.

Null text, and text without a letter (any Unicode letter counts, and no digit or number sign does), is ``und`` with
score 0. Rows without a language, and held-out rows, teach nothing; without any teaching row every document is
``und``. Repeated and null identifiers, and repeated rows, are kept as they come, other columns are ignored whatever
their names, and an empty table gives no rows. Of a very long text each distinct word is judged once, with its number,
which changes nothing; memory is in proportion to its distinct words times the languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from constella.llm import _store, _text

#: Cells of a language's trigram table, and of the blocks in which counts travel.
CELLS, BLOCK = 1 << 16, 1 << 13
#: Languages that a model has at most unless the caller says otherwise; more are an error, as the model is sent to every executor.
MAX_LANGUAGES = 512
#: The change of any proportion below which a mixture has converged, and steps between looks at it.
TOLERANCE, STRIDE = 1e-3, 3
#: Languages, by their proportions, of which nested sets are fitted again in any case; larger sets while they improve.
CANDIDATES = 4
#: Bytes of texts whose words are taken together, and cells whose likelihoods are.
TOGETHER = 1 << 23
#: Nats that a word's likelihoods lie apart at most, so that no single word outweighs a document.
SPREAD = 30.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Upper-case letters of the Latin-1 block, by their second byte after 0xC3.
_LOWER_C3 = np.arange(256, dtype=np.uint8)
_LOWER_C3[0x80:0x97] += 32
_LOWER_C3[0x98:0x9F] += 32
#: Bytes that aren't letters: all ASCII but a-z and A-Z.
_LETTERS = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def _features(data: np.ndarray, offsets: np.ndarray, distinct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cells, word of each cell's start, words of each text, number of each word): trigrams of bytes with one blank around each word.

    With ``distinct``, which is for a single text, each word comes once.
    """
    low = _LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        low[second] = _LOWER_C3[data[second]]
    starts, ends, rows = _text.word_bounds(low, offsets, _LETTERS)
    times = np.ones(len(starts))
    if distinct and len(starts):
        _, first, times = np.unique(_text.word_hashes(low, starts, ends, lower=False), return_index=True, return_counts=True)
        starts, ends, rows, times = starts[first], ends[first], np.array([0, len(first)]), times.astype(float)
    # A word of n bytes has n trigrams, centred on each byte.
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - starts, lengths)
    padded = np.concatenate([[0], low, [0]]).astype(np.uint32)
    left, right = padded[at], padded[at + 2]
    left[first[:-1][lengths > 0]] = 32
    right[first[1:][lengths > 0] - 1] = 32
    code = (left << 16) | (padded[at + 1] << 8) | right
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), first, rows, times


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and the logarithms of their cells' probabilities [cell, language]."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            data, offsets = _text.text_bytes(batch.column(0))
            for lo, hi in _text.chunks(offsets):
                cells, first, rows, _ = _features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                per_text = first[rows[1:]] - first[rows[:-1]]
                got = np.bincount(np.repeat(code[lo:hi].astype(np.int64) * CELLS, per_text) + cells, minlength=len(names) * CELLS).reshape(-1, CELLS)
                for name, own in zip(names, got, strict=True):
                    totals[name] = totals.get(name, 0) + own
        for name, own in totals.items():
            blocks = [own[k : k + BLOCK].astype("<i8").tobytes() for k in range(0, CELLS, BLOCK)]
            yield pa.record_batch([pa.array([name] * len(blocks)), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["lang", "block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Holds one block of each language and block number at most, however many tasks counted.
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for name, block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[name, block] = sums.get((name, block), 0) + np.frombuffer(raw, "<i8")
        keys = list(sums)
        yield pa.record_batch([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["lang", "block", "counts"])

    kind = "lang string, block int, counts binary"
    teachers = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string"))
    if teachers.select(lang_col).distinct().limit(max_languages + 1).count() > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    parts = teachers.mapInArrow(_text.give_back(count), kind)
    rows = parts.repartition(F.col("lang"), F.col("block")).mapInArrow(add, kind).collect()  # one table per language: bounded by max_languages
    names = sorted({r.lang for r in rows})
    table = np.zeros((CELLS, len(names)))
    for r in rows:
        table[r.block * BLOCK : (r.block + 1) * BLOCK, names.index(r.lang)] = np.frombuffer(r.counts, "<i8")
    if names:
        # Each cell is smoothed by its share in all languages.
        share = (table.sum(1) + 0.5) / (table.sum() + 0.5 * CELLS)
        prior = 1e-3 * max(table.sum() / len(names), 1e3)
        table = np.log((table + prior * share[:, None]) / (table.sum(0) + prior))
    return names, table.astype(np.float32)


def _fit(words: np.ndarray, times: np.ndarray, text: np.ndarray, first: np.ndarray, n: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions [text, language], log likelihood) by expectation-maximisation from ``begin``, until no proportion changes any more.

    The likelihood has one maximum within the languages that ``begin`` holds, so it doesn't matter where it begins.
    """
    p = begin / begin.sum(1, keepdims=True)
    going, step = np.flatnonzero((begin > 0).sum(1) > 1), 0
    own, weight, at, starts = words, times, text, first
    if len(going) < len(n):
        own, weight, at, starts = _only(words, times, n, first, going)
    while len(going):
        joint = own * p[going][at]
        joint *= (weight / np.maximum(joint.sum(1), 1e-300))[:, None]
        q = np.add.reduceat(joint, starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        moved = np.abs(q - p[going]).max(1)
        p[going] = q
        step += 1
        if step % STRIDE == 0 and (moved < TOLERANCE).any():
            going = going[moved >= TOLERANCE]
            own, weight, at, starts = _only(words, times, n, first, going)
    mixed = np.log(np.maximum((words * p[text]).sum(1), 1e-300)) * times
    return p, np.add.reduceat(mixed, first)


def _only(words: np.ndarray, times: np.ndarray, n: np.ndarray, first: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts: their likelihoods, numbers, texts, and first places."""
    own = n[texts]
    starts = np.cumsum(own) - own
    at = np.repeat(np.arange(len(texts)), own)
    place = np.arange(own.sum()) - starts[at] + first[texts][at]
    return words[place], times[place], at, starts


def infer(cells: np.ndarray, starts: np.ndarray, rows: np.ndarray, times: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, size of the chosen set, proportions) of each text; language -1 where it has no words, proportion -1 outside the set."""
    n_texts, n_langs = len(rows) - 1, table.shape[1]
    shares = np.full((n_texts, n_langs), -1.0)
    best, score, size = np.full(n_texts, -1), np.zeros(n_texts), np.zeros(n_texts, np.int64)
    n = np.diff(rows)
    have = np.flatnonzero(n)
    if not len(have) or not n_langs:
        return best, score, size, shares
    logs, word, step = np.empty((len(starts) - 1, n_langs)), 0, max(1, TOGETHER // n_langs)
    while word < len(starts) - 1:
        # Words of about so many cells at a time; one longer word stands alone.
        to = max(word + 1, int(np.searchsorted(starts, starts[word] + step, "right")) - 1)
        logs[word:to] = np.add.reduceat(table[cells[starts[word] : starts[to]]], starts[word:to] - starts[word], axis=0)
        word = to
    words = np.exp(np.maximum(logs - logs.max(1, keepdims=True), -SPREAD))
    n, first = n[have], rows[:-1][have]
    total = np.add.reduceat(times, first)
    text = np.repeat(np.arange(len(have)), n)
    full, _ = _fit(words, times, text, first, n, np.ones((len(have), n_langs)))
    order = np.argsort(-full, axis=1, kind="stable")
    top, value = full[np.arange(len(have)), order[:, 0]], np.full(len(have), -np.inf)
    lang, count = order[:, 0].copy(), np.ones(len(have), np.int64)
    mixture = np.full((len(have), n_langs), -1.0)
    at = np.arange(len(have))
    for k in range(1, n_langs + 1):
        if k > CANDIDATES:
            # Only texts that the last language made better go on.
            go = count[at] == k - 1
            if not go.any():
                break
            words, times, text, first = _only(words, times, n, first, np.flatnonzero(go))
            at, n = at[go], n[go]
        allowed = np.zeros((len(at), n_langs))
        np.put_along_axis(allowed, order[at, :k], 1.0, axis=1)
        # The whole mixture's proportions are near those of the set.
        q, likelihood = _fit(words, times, text, first, n, allowed * np.maximum(full[at], 1e-6))
        penalised = likelihood - (k - 1) * (0.5 * np.log(total[at]) + 1)
        better = penalised > value[at]
        to = at[better]
        value[to], lang[to], count[to] = penalised[better], q.argmax(1)[better], k
        top[to] = q.max(1)[better]
        mixture[to] = np.where(allowed > 0, q, -1.0)[better]
    best[have], score[have], size[have], shares[have] = lang, np.clip(top, 0, 1), count, mixture
    return best, score, size, shares


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, n_langs (size of the chosen set) and mixture (the set's languages and proportions, largest first) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for batch in batches:
            data, offsets = _text.text_bytes(batch.column(1))
            langs, scores, sizes, mixtures = [], [], [], []
            limit = max(1 << 14, TOGETHER // max(8, len(names)))
            for lo, hi in _text.chunks(offsets, limit):
                long = hi - lo == 1 and offsets[hi] - offsets[lo] > limit
                b, s, z, q = infer(*_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], long), table)
                langs += b.tolist()
                scores += s.tolist()
                sizes += z.tolist()
                for own in q:
                    chosen = np.flatnonzero(own >= 0)
                    mixtures.append([{"lang": names[j], "share": float(own[j])} for j in chosen[np.argsort(-own[chosen], kind="stable")]])
            # A word here is a run of letters or of other scripts' bytes; whether one is a letter is asked of the odd texts only.
            odd = _no_ascii_letter(data, offsets)
            for k in odd.tolist():
                if not any(map(str.isalpha, batch.column(1)[k].as_py() or "")):
                    langs[k], scores[k], sizes[k], mixtures[k] = -1, 0.0, 0, []
            yield pa.record_batch([batch.column(0), pa.array([names[k] if k >= 0 else "und" for k in langs], pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), pa.array(mixtures, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))], ["doc_id", "lang_pred", "score", "n_langs", "mixture"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_text.give_back(texts), f"doc_id {kind}, lang_pred string, score double, n_langs int, mixture array<struct<lang: string, share: double>>")


def _no_ascii_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts without an ASCII letter."""
    sums = np.concatenate([[0], np.cumsum(_LETTERS[data] & (data < 128), dtype=np.int64)])
    return np.flatnonzero(sums[offsets[1:]] == sums[offsets[:-1]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_langs")
