"""Minimum-cost assignment of candidates to relations, one to one, where a relation may be skipped at a cost.

Of equally cheap assignments that one wins which comes first when relations are taken in order, their
candidates in order, and skipping last. Where the nearest candidates of all relations differ they are the
answer, which one aggregate finds out; other anchors go to an exact solver, an Arrow batch at a time, that
treats groups of relations that share candidates separately: shortest augmenting paths, then changes along edges
without reduced cost towards the first of the cheapest assignments. Its time is polynomial in a group's size.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from constella import constants as K

KEY = ["red_image", "green_image", "anchor_id"]
#: Costs that differ by less are equal.
EQUAL = 1e-9


def _groups(options: list[list[tuple[int, float]]]) -> list[list[int]]:
    """Relations that compete, directly or through others, in ascending order."""
    owner: dict[int, int] = {}
    parent = list(range(len(options)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k, choices in enumerate(options):
        for cand, _ in choices:
            a, b = root(owner.setdefault(cand, k)), root(k)
            parent[max(a, b)] = min(a, b)
    out: dict[int, list[int]] = {}
    for k in range(len(options)):
        out.setdefault(root(k), []).append(k)
    return list(out.values())


def _cheapest(edges: list[list[tuple[int, float]]], n_columns: int) -> tuple[list[int], list[int], list[float], list[float]]:
    """(column of each row, row of each column or -1, row prices, column prices) of a cheapest assignment of all rows.

    Each row is joined by a shortest augmenting path; prices leave no edge a negative reduced cost, and a column without a row is free of price.
    """
    column, row = [-1] * len(edges), [-1] * n_columns
    u, v = [0.0] * len(edges), [0.0] * n_columns
    for start in range(len(edges)):
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: list[int] = []
        closed: set[int] = set()
        heap: list[tuple[float, int]] = []
        at, so_far = start, 0.0
        while True:
            for c, cost in edges[at]:
                d = so_far + cost - u[at] - v[c]
                if c not in closed and d < best.get(c, float("inf")):
                    best[c], came[c] = d, at
                    heapq.heappush(heap, (d, c))
            so_far, end = heapq.heappop(heap)
            while end in closed:
                so_far, end = heapq.heappop(heap)
            if row[end] < 0:
                break
            closed.add(end)
            done.append(end)
            at = row[end]
        u[start] += so_far
        for c in done:
            u[row[c]] += so_far - best[c]
            v[c] -= so_far - best[c]
        while True:
            at = came[end]
            row[end], column[at], end = at, end, column[at]
            if at == start:
                break
    return column, row, u, v


def _first_cheapest(options: list[list[tuple[int, float]]], skip: float) -> list[int | None]:
    """The first of the cheapest choices for one group."""
    number: dict[int, int] = {}
    edges = [[(number.setdefault(cand, len(number)), d) for cand, d in choices] for choices in options]
    names, n = list(number), len(options)
    for k, own in enumerate(edges):
        own.append((len(names) + k, skip))  # each relation's own way to be skipped
    column, row, u, v = _cheapest(edges, len(names) + n)
    # All cheapest assignments use edges without reduced cost only, and every column that has a price.
    tight = [[c for c, cost in own if cost - u[k] - v[c] < EQUAL] for k, own in enumerate(edges)]
    priceless = [c for c in range(len(v)) if v[c] > -EQUAL]
    for k in range(n):
        for c in tight[k]:
            if c == column[k]:
                break
            if row[c] >= 0 and row[c] < k:
                continue
            path = _exchange(c, column[k], k, tight, row, priceless)
            if path is not None:
                moves = [(row[a], b) for a, b in path] + [(k, c)]
                for r, _ in moves:
                    row[column[r]] = -1
                for r, to in moves:
                    column[r], row[to] = to, r
                break
    return [names[c] if c < len(names) else None for c in column]


def _exchange(start: int, goal: int, first: int, tight: list[list[int]], row: list[int], priceless: list[int]) -> list[tuple[int, int]] | None:
    """Moves (from column, to column) of rows after ``first`` that clear ``start`` when its row gives up ``goal``; none if there are none.

    A row that leaves a column goes to another one, and so on until ``goal`` is taken; or until a column without a row is,
    and then any column without a price may be left, and on from there.
    """
    came: dict[int, int] = {start: start}
    queue, hub, hub_mark = deque([start]), None, -1
    while queue:
        a = queue.popleft()
        if a == goal:
            break
        if row[a] < 0:
            if hub is None:
                hub = a
                for b in priceless:
                    if b not in came and (b == goal or row[b] > first):
                        came[b] = hub_mark
                        queue.append(b)
            continue
        if a != start and row[a] <= first:
            continue
        for b in tight[row[a]]:
            if b not in came and (b == goal or row[b] < 0 or row[b] > first):
                came[b] = a
                queue.append(b)
    else:
        return None
    moves, at = [], goal
    while at != start:
        if came[at] == hub_mark:
            at = hub
        else:
            moves.append((came[at], at))
            at = came[at]
    return moves


def assign(options: list[list[tuple[int, float]]], skip: float = K.SKIP_COST) -> list[int | None]:
    """The candidate of each relation, or None; ``options`` has (candidate, distance) by relation, both in order."""
    out: list[int | None] = [None] * len(options)
    for group in _groups(options):
        for k, cand in zip(group, _first_cheapest([options[k] for k in group], skip), strict=True):
            out[k] = cand
    return out


def assignment(candidates: DataFrame) -> DataFrame:
    """The candidate rows that are chosen, with ``second``, the distance of the nearest other candidate of their relation.

    ``candidates`` has a row per (red_image, green_image, anchor_id, relation_no, candidate_id) with its distance;
    further columns are carried along. The candidates are read once: an anchor's options travel together.
    """
    carried = [c for c in candidates.columns if c not in (*KEY, "relation_no", "candidate_id", "distance")]
    option = F.struct("candidate_id", "distance", *carried)
    by_relation = candidates.groupBy(*KEY, "relation_no").agg(F.min(F.struct("distance", "candidate_id")).alias("best"), F.sort_array(F.collect_list(option)).alias("options"))
    anchors = by_relation.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("relation_no", "best", "options"))).alias("rel"))
    distinct = F.size(F.array_distinct(F.transform("rel", lambda x: x["best"]["candidate_id"]))) == F.size("rel")
    simple = anchors.filter(distinct).withColumn("chosen", F.transform("rel", lambda x: x["best"]["candidate_id"].cast("long")))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [assign([[(o["candidate_id"], o["distance"]) for o in r["options"]] for r in rel]) for rel in batch.column(len(KEY)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int64()))], [*KEY, "rel", "chosen"])

    hard = anchors.filter(~distinct).mapInArrow(solve, T.StructType([*anchors.schema.fields, T.StructField("chosen", T.ArrayType(T.LongType()))]))
    rows = simple.unionByName(hard).select(*KEY, F.explode(F.arrays_zip("rel", "chosen")).alias("x")).filter("x.chosen is not null")
    rows = rows.select(*KEY, F.col("x.rel.relation_no").alias("relation_no"), F.col("x.rel.options").alias("options"), F.col("x.chosen").alias("chosen"))
    pick = F.filter("options", lambda o: o["candidate_id"] == F.col("chosen"))[0]
    second = F.array_min(F.transform(F.filter("options", lambda o: o["candidate_id"] != F.col("chosen")), lambda o: o["distance"]))
    return rows.select(*KEY, "relation_no", pick.alias("p"), second.alias("second")).select(*KEY, "relation_no", "p.*", "second")
