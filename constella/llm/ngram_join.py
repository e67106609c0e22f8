"""Jaccard self-join of word-shingle sets by rare-first prefix filtering, and the classes it links.

Every text is the set of its distinct word n-grams, known by 64-bit hashes. Equal sets, known by a 128-bit
digest, are one node from the start. Grams are ordered rare first, by a fixed-size sketch of counts over the
whole corpus; two sets that reach the threshold share a gram within the prefixes that the order gives them.
Nodes meet on prefix grams; pairs that the length or the positional filter refutes are dropped there, those
that the suffix filter refutes (it bounds the overlap by counts in ranges of the gram space, a quarter as many
as the set has grams) before any set is fetched; the others are verified exactly, once.

Classes need connections, not all pairs. First each node is verified against one leader of the buckets it
shares: the node with the least rare grams before the shared one, which in a group of altered copies is
the one closest to their origin. What is connected is not compared again. While very many candidate pairs
remain and their number falls, further rounds with other leaders follow. The last round verifies every pair of
nodes that still share a bucket in different classes, so no link between classes is lost. Nothing is capped: a
large group of copies is joined by as many verifications as it has nodes, not by their square.

No key keeps its rows together: grams, nodes and classes with more than a thousandth of all rows are aggregated
first and joined by broadcasting what is known of these few; a leader's set goes to as many tasks as its pairs fill.

Null text, and text without a word, has an empty set, which is linked with nothing; rows of one identifier
are each reported; null identifiers take part, and name a class only if it has no other identifier (null). Of
equally good leaders a hash decides, which changes no class. A very long text is one row of grams at a time; memory
is in proportion to the longest text. Other columns than the two named ones are ignored by :func:`link_classes`
and carried along, whatever their names, by :func:`keep_one`; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from constella.llm import _skew, _store, _text, graph

#: Counters of the frequency sketch, and of the blocks in which they travel.
SKETCH_BITS, BLOCK = 20, 1 << 14
#: Candidate pairs per bucket row up to which the last round begins, and the fall of their number that makes another round of leaders worth while.
PAIRS_PER_ROW, FALL = 20, 0.7
#: Nodes whose grams a worker remembers at a time, so that equal sets needn't list them again.
REMEMBERED = 1_000_000
#: Counters of this many times the average hold grams that are aggregated rather than sorted by gram.
HOT = 16

def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, rows): the sorted distinct shingle hashes of each text."""
    starts, ends, words = _text.word_bounds(data, offsets, _text.SPACED)
    h, rows = _text.shingle_hashes(_text.word_hashes(data, starts, ends), words, width)
    n = len(rows) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint16 if n < 65536 else np.int64), np.diff(rows))
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))]).astype(np.int64)


def _digests(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of a 128-bit digest of each set."""
    n = np.diff(rows)
    have = np.flatnonzero(n)
    halves = []
    for own in (h, _text.mix(h ^ np.uint64(0xA0761D6478BD642F))):
        sums = np.zeros(len(n), np.uint64)
        if len(have):
            sums[have] = np.add.reduceat(own, rows[:-1][have])
        halves.append(_text.mix(sums + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return halves[0], halves[1]


def _nodes(h: np.ndarray, rows: np.ndarray, clashing: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """(node, check) of each set: the first half of its digest, moved on by the second where sets of several digests share it."""
    first, check = _digests(h, rows)
    node = first.astype(np.int64)
    if clashing:
        while len(moved := np.flatnonzero(np.isin(node, list(clashing)))):
            node[moved] = _text.mix(node[moved].astype(np.uint64) + _text.mix(check[moved])).astype(np.int64)
    return node, check.astype(np.int64)


def _signature(h: np.ndarray) -> bytes:
    """Counts of a sorted set in equal ranges of the gram space, four to eight grams to a range on the average."""
    bits = max(4, (len(h) // 4).bit_length() - 1)
    return np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_reach(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """The suffix filter: whether sets of these signatures and sizes may reach the threshold. A range that overflows counts for any number."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if (a == 255).any() or (b == 255).any():
        return True
    if len(a) > len(b):
        a = a.reshape(len(b), -1).sum(1)
    elif len(b) > len(a):
        b = b.reshape(len(a), -1).sum(1)
    return int(np.minimum(a, b).sum()) * (100 + percent) >= (nx + ny) * percent


def sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Counts of all grams of the corpus in ``2 ** SKETCH_BITS`` counters, a size that the corpus doesn't change."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            data, offsets = _text.text_bytes(batch.column(0))
            for lo, hi in _text.chunks(offsets):
                own = data[offsets[lo] : offsets[hi]]
                starts, ends, words = _text.word_bounds(own, offsets[lo : hi + 1] - offsets[lo], _text.SPACED)
                h, _ = _text.shingle_hashes(_text.word_hashes(own, starts, ends), words, width)
                total += np.bincount(h >> np.uint64(64 - SKETCH_BITS), minlength=1 << SKETCH_BITS)
        if total.any():
            yield blocks({k: total[k * BLOCK : (k + 1) * BLOCK] for k in range(len(total) // BLOCK)})

    def blocks(own: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(own.keys(), pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes() for x in own.values()], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        yield blocks(sums)

    kind = "block int, counts binary"
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in docs.select(text_col).mapInArrow(_text.give_back(count), kind).repartition(F.col("block")).mapInArrow(add, kind).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, "<u4")
    return out


def _least(n, percent: int):
    """The least overlap of equal-sized sets: ceil(percent / 100 * n)."""
    return -(-(n * percent) // 100)


def prefixes(docs: DataFrame, counts: np.ndarray, *, id_col: str, text_col: str, width: int, percent: int, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """doc_id, node, check, n (set size), the prefix grams, rare first, how many of them aren't hot, and the set's signature.

    Of equal sets that follow one another in a partition one lists its grams and signature.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 0x7FFFFFFF).astype(np.uint32))
    hot = max(int(counts.sum()) * HOT // len(counts), _skew.LEAST)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, seen = shared.value, set()
        for batch in batches:
            data, offsets = _text.text_bytes(batch.column(1))
            for lo, hi in _text.chunks(offsets):
                h, rows = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                (nodes, check), n = _nodes(h, rows, clashing), np.diff(rows)
                doc = np.repeat(np.arange(len(n)), n)
                often = frequency[h >> np.uint64(64 - SKETCH_BITS)]
                order = np.argsort(doc.astype(np.int64) << 32 | often, kind="stable")
                take = np.where(n > 0, n - _least(n, percent) + 1, 0)
                marks = []
                for k, node in enumerate(nodes.tolist()):
                    if node in seen:
                        take[k] = 0
                    seen.add(node)
                    marks.append(_signature(h[rows[k] : rows[k + 1]]) if take[k] else None)
                if len(seen) > REMEMBERED:
                    seen.clear()
                out = np.concatenate([[0], np.cumsum(take)])
                at = np.arange(out[-1]) - np.repeat(out[:-1] - rows[:-1], take)
                cold = np.concatenate([[0], np.cumsum(often[order][at] < hot)])
                grams = pa.ListArray.from_arrays(pa.array(out, pa.int32()), pa.array(h[order][at].astype(np.int64)))
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array(nodes), pa.array(check), pa.array(n, pa.int64()), grams, pa.array(cold[out[1:]] - cold[out[:-1]], pa.int32()), pa.array(marks, pa.binary())],
                    ["doc_id", "node", "check", "n", "grams", "n_cold", "signature"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(_text.give_back(rank), f"doc_id {kind}, node long, check long, n long, grams array<long>, n_cold int, signature binary")


def _buckets(ranked: DataFrame, total: int) -> DataFrame:
    """(gram, node, n, pos, hot) of the grams that at least two nodes have in their prefixes; pos counts from 1. ``total`` bounds the prefix grams."""
    rows = ranked.select("node", "n", "n_cold", F.posexplode("grams").alias("pos", "gram"))
    rows = rows.select("gram", "node", F.shiftleft("n", 31).bitwiseOR(F.col("pos") + 1).alias("at"), (F.col("pos") >= F.col("n_cold")).alias("hot"))
    w = Window.partitionBy("gram").orderBy("node")
    cold = rows.filter("not hot").withColumn("prev", F.lag("node").over(w)).withColumn("next", F.lead("node").over(w)).filter("prev <> node or next <> node").select(*rows.columns)
    hot = rows.filter("hot").distinct()
    several = hot.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("gram", "rows", F.lit(True).alias("shared"))
    both = cold.unionByName(_skew.spread_join(hot, several, "gram", total, ["node"]).select(*rows.columns))
    return both.select("gram", "node", F.shiftright("at", 31).alias("n"), F.col("at").bitwiseAND((1 << 31) - 1).alias("pos"), "hot")


def _possible(percent: int):
    """Length and positional filters of a pair of rows x, y."""
    xn, yn = F.col("x.n"), F.col("y.n")
    length = F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent
    # overlap >= percent / (100 + percent) * (xn + yn), at most 1 + what follows in the shorter rest
    return length & ((F.least(xn - F.col("x.pos"), yn - F.col("y.pos")) + 1) * (100 + percent) >= (xn + yn) * percent)


def _labelled(buckets: DataFrame, labels: DataFrame | None, total: int) -> DataFrame:
    """Buckets with each node's class and the class that most rows of the bucket are in, without those that one class fills."""
    found = buckets.withColumn("class", F.col("node")) if labels is None else buckets.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
    per = found.groupBy("gram", "class").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("gram").agg(F.sum("c").alias("rows"), F.max_by("class", F.struct("c", "class")).alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").drop("classes")
    return _skew.spread_join(found, mixed, "gram", total, ["node"])


def _short(percent: int):
    """Whether a row may stand for the smaller set of a pair: the positional filter for a partner of its own size."""
    return (F.col("n") - F.col("pos") + 1) * (100 + percent) >= 2 * F.col("n") * percent


def _open_pairs(rows: DataFrame, percent: int) -> int:
    """Pairs of different classes within buckets whose rows both may stand for a smaller set."""
    per = rows.filter(_short(percent)).groupBy("gram", "class").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("gram").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return int(per.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2)).first()[0] or 0)


def _leader_pairs(rows: DataFrame, round_: int, percent: int, total: int) -> DataFrame:
    """Each node with the leader, of another class, that it shares most buckets with."""
    order = [F.col("pos") / F.col("n")] if round_ == 0 else []
    order += [F.xxhash64("class", F.lit(round_)), F.xxhash64("node", F.lit(round_))]
    own = F.struct("node", "class", "n", "pos")
    cold = rows.filter("not hot").withColumn("x", F.first(own).over(Window.partitionBy("gram").orderBy(*order)))
    hot = rows.filter("hot")
    first = hot.groupBy("gram").agg(F.min_by(own, F.struct(*order)).alias("x"), F.count(F.lit(1)).alias("rows"))
    led = cold.unionByName(_skew.spread_join(hot, first, "gram", total, ["node"])).withColumn("y", own)
    led = led.filter((F.col("x.class") != F.col("y.class")) & _possible(percent))
    shared = led.groupBy(F.col("y.node").alias("member"), F.col("x.node").alias("leader")).count()
    best = shared.groupBy("member").agg(F.max(F.struct("count", "leader")).alias("b")).select("member", F.col("b.leader").alias("leader"))
    return best.select(F.greatest("member", "leader").alias("a"), F.least("member", "leader").alias("b")).distinct()


def _all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs of nodes of different classes that share a bucket and that the filters let pass.

    A pair has an end outside its bucket's main class: only such rows look for partners, so that a bucket costs
    no more than its open pairs.
    """
    x, y = rows.filter("class <> main").alias("x"), rows.alias("y")
    ordered = (F.col("y.class") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    met = x.join(y, (F.col("x.gram") == F.col("y.gram")) & ordered & (F.col("x.class") != F.col("y.class")) & _possible(percent))
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _merged(labels: DataFrame | None, links: DataFrame, total: int) -> DataFrame:
    """(node, component) after new links between nodes: classes are joined, and their nodes follow."""
    if labels is None:
        return graph.components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    of = lambda end: labels.join(degree, "node").select(F.col("node").alias(end), F.col("component").alias(f"_{end}"), "rows")
    between = _skew.spread_join(links, of("a"), "a", total, ["b"], "left")
    between = _skew.spread_join(between, of("b"), "b", total, ["a"], "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    joined = _store.materialise(graph.components(between), "joined")
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("_to")).join(sizes, "component")
    moved = _skew.spread_join(labels, to, "component", total, ["node"], "left").select("node", F.coalesce("_to", "component").alias("component"))
    return moved.unionByName(joined.join(labels.select("node"), "node", "left_anti"))


def _survivors(pairs: DataFrame, signatures: DataFrame, total: int, percent: int) -> DataFrame:
    """The pairs that the suffix filter doesn't refute."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (nx, x), (ny, y) = batch.column(2).flatten(), batch.column(3).flatten()
            keep = [may_reach(a.as_buffer(), b.as_buffer(), m, n, percent) for a, b, m, n in zip(x, y, nx.to_pylist(), ny.to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    marked = signatures.join(wanted, "node", "left_semi").dropDuplicates(["node"]).select("node", F.struct("n", "signature").alias("s"))
    return _skew.salted_join(pairs, marked, ["a", "b"], "node", "s", total).select("a", "b", "s_a", "s_b").mapInArrow(_text.give_back(judge), "a long, b long")


def _node_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, *, id_col: str, text_col: str, width: int, clashing: frozenset[int]) -> DataFrame:
    """(node, grams): the whole sets of the nodes of pairs, taken from one document each."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ids = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("_id")).join(wanted, "node").select("_id").distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids.withColumnRenamed("_id", "_wanted").hint("merge"), F.col("_id").eqNullSafe(F.col("_wanted")), "left_semi").select("_text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.text_bytes(batch.column(0))
            for lo, hi in _text.chunks(offsets):
                h, rows = _sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                blobs = [h[rows[k] : rows[k + 1]].tobytes() for k in range(len(rows) - 1)]
                yield pa.record_batch([pa.array(_nodes(h, rows, clashing)[0]), pa.array(blobs, pa.binary())], ["node", "grams"])

    return texts.mapInArrow(_text.give_back(sets), "node long, grams binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def overlap_reaches(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs (a, b) with what exact counting says of them."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [overlap_reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return _skew.salted_join(pairs, sets, ["a", "b"], "node", "grams", total).select("a", "b", "grams_a", "grams_b").mapInArrow(_text.give_back(judge), "a long, b long, linked boolean")


def _ranked(docs: DataFrame, counts: np.ndarray, **more) -> tuple[DataFrame, frozenset[int]]:
    """The written prefixes, and the nodes that sets of different digests would share; these are told apart and the prefixes made again."""
    clashing: frozenset[int] = frozenset()
    while True:
        ranked = _store.materialise(prefixes(docs, counts, clashing=clashing, **more), "prefixes")
        found = ranked.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("node").collect()  # by chance, one in 2**63 pairs of sets
        if not found:
            return ranked, clashing
        clashing |= {r.node for r in found}
        _store.drop(ranked)


def _classes(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, node, n) of all documents, and (node, component) of the linked nodes."""
    counts = sketch(docs, text_col, width)
    ranked, clashing = _ranked(docs, counts, id_col=id_col, text_col=text_col, width=width, percent=percent)
    buckets = _store.materialise(_buckets(ranked, int(counts.sum()) * (100 - percent) // 100), "buckets")
    nodes = _store.materialise(ranked.select("doc_id", "node", "n"), "nodes")
    n_rows, n_docs = buckets.count(), nodes.count()
    labels: DataFrame | None = None
    before: int | None = None
    judged: list[DataFrame] = []
    signatures = ranked.filter("signature is not null").select("node", "n", "signature")
    round_ = 0
    while n_rows:
        if round_ == 0:
            # No class is known yet: all nodes that share a bucket are open.
            rows, last = buckets.withColumn("class", F.col("node")), False
        else:
            rows = _store.materialise(_labelled(buckets, labels, n_rows), "open")
            open_ = _open_pairs(rows, percent)
            last = open_ <= PAIRS_PER_ROW * n_rows or before is not None and open_ > FALL * before
            before = open_
        pairs = _all_pairs(rows, percent) if last else _leader_pairs(rows, round_, percent, n_rows)
        for done in judged:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = _store.materialise(pairs, "pairs")
        if total := pairs.count():
            # Most nodes of buckets are in no pair that the filters let pass; their texts stay where they are.
            rest = _store.materialise(_survivors(pairs, signatures, total, percent), "survivors")
            sets = _store.materialise(_node_sets(docs, nodes, rest, id_col=id_col, text_col=text_col, width=width, clashing=clashing), "sets")
            found = _store.materialise(_verified(rest, sets, percent, total), "verified")
            later = _store.materialise(_merged(labels, found.filter("linked").select("a", "b"), n_docs), "labels")
            _store.drop(sets, rest, found, *([labels] if labels is not None else []))
            labels = later
        judged.append(pairs)
        if round_:
            _store.drop(rows)
        if last:
            break
        round_ += 1
    _store.drop(buckets, ranked, *judged)
    return nodes, labels


def link_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest identifier that links reach, of every document.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets.
    """
    with _store.tidy(docs.sparkSession):
        nodes, labels = _classes(docs, id_col, text_col, width, percent)
        total = nodes.count()
        by_node = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("docs"))
        by_node = by_node.withColumn("class", F.col("node")) if labels is None else by_node.join(labels, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component")
        by_node = _store.materialise(by_node, "by-node")
        if labels is not None:
            _store.drop(labels)
    by_class = by_node.groupBy("class").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = _skew.spread_join(by_node.select("class", "node", "docs"), by_class, "class", total, ["node"], few=0).select("node", "component_id", F.col("docs").alias("rows"))
    full = _skew.spread_join(nodes.filter("n > 0"), named, "node", total, ["doc_id"], few=0).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(nodes.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each class: that of the smallest identifier. Of repeated rows of it one stays; rows without an identifier stay."""
    classes = link_classes(docs, id_col=id_col, text_col=text_col, width=width, percent=percent)
    mine, number = _store.free_name(docs, "_kept_id"), _store.free_name(docs, "_row")
    kept = classes.filter("doc_id = component_id").select(F.col("doc_id").alias(mine)).distinct()
    # Identifiers grow with the corpus: they are sorted and merged at every size, not broadcast while they are few.
    one = docs.join(kept.hint("merge"), F.col(id_col) == F.col(mine), "left_semi")
    one = one.withColumn(number, F.row_number().over(Window.partitionBy(id_col).orderBy(id_col))).filter(F.col(number) == 1).drop(number)
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(_store.table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, their overlaps, and what links reach, for DuckDB on small tables.
ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, hash(shingle) AS sh FROM (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - 3, 2)), lambda i: ws[i:i + 4])) AS shingle FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT r, r AS t FROM w UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.t = e.x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.r, min(o.doc_id) AS component_id FROM reach JOIN w o ON o.r = reach.t GROUP BY reach.r) m USING (r)
"""
