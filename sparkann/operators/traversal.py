"""Graph traversals: best-first, multi-candidate and delayed-synchronization search, layered and pooled variants.

Per-query form: each task holds the graph as arrays (broadcast, behind a check of its size) and works through its queries. Superstep form, in
superstep.py: all state is in DataFrames, for graphs that don't fit a task.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1e20
#: Bytes of a graph and its vectors that every task may hold; beyond, use the superstep form.
MAX_GRAPH_BYTES = 512 << 20


class Graph(NamedTuple):
    """A graph in compressed rows: ids sorted; neighbours of ids[i] are links[starts[i]:starts[i + 1]], as positions."""

    ids: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    links: np.ndarray

    def at(self, node: int) -> int:
        return int(np.searchsorted(self.ids, node))

    def of(self, i: int) -> np.ndarray:
        return self.links[self.starts[i] : self.starts[i + 1]]


def distances(g: Graph, nodes: list[int] | np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared L2 of nodes to q, added from left to right as the column functions do."""
    return np.cumsum((g.vectors[nodes] - q) ** 2, 1)[:, -1]


def load(vectors: DataFrame, edges: DataFrame) -> Graph:
    """Gathers a graph for the per-query form; ValueError if it is larger than MAX_GRAPH_BYTES. Links to unknown nodes are left out."""
    return load_layers(vectors, edges.withColumn("level", F.lit(0)), 0)[0]


def load_layers(vectors: DataFrame, edges: DataFrame, top: int) -> dict[int, Graph]:
    """As load(), a graph for each level of edges up to top. The vectors are gathered once, and all levels hold the same ones."""
    edges = edges.where(F.col("level").between(0, top))
    n, dim = vectors.agg(F.count("*"), F.max(F.size("embedding"))).first()
    links = edges.count()
    if n * (dim or 0) * 8 + links * 8 > MAX_GRAPH_BYTES:
        raise ValueError("the graph is too large for each task to hold; use the superstep form")
    v = vectors.select(F.col("node_id").cast("long"), "embedding").orderBy("node_id").toArrow()
    ids = v.column(0).to_numpy()
    matrix = v.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
    e = edges.select(F.col("level").cast("int"), F.col("src").cast("long"), F.col("dst").cast("long"), "pos").orderBy("level", "src", "pos", "dst").toArrow()
    level, all_src, all_dst = (e.column(k).to_numpy() for k in range(3))

    def one(lv: int) -> Graph:
        some = slice(*np.searchsorted(level, [lv, lv + 1]))
        src, dst = np.searchsorted(ids, all_src[some]), np.searchsorted(ids, all_dst[some])
        known = (dst < n) & (ids[np.minimum(dst, n - 1)] == all_dst[some]) if n else np.zeros(0, bool)
        src, dst = src[known], dst[known]
        return Graph(ids, matrix, np.searchsorted(src, np.arange(n + 1)), dst)

    return {lv: one(lv) for lv in range(top + 1)}


class Found(NamedTuple):
    result: list[tuple[float, int]]
    hops: int
    visited: int
    trace: list[tuple[int, int, int, float]]


def dst_search(g: Graph, q: np.ndarray, entry: int, ef: int, cq: int = 32, mc: int = 1, mg: int = 1, traced: bool = False) -> Found:
    """Up to mg groups of up to mc candidates are in flight; only the oldest one is waited for.

    (1, 1) is best-first search, (mc, 1) multi-candidate search. The entry is neither scored nor returned unless a neighbour leads
    back to it. Admission to the result is strict (nearer than the worst of ef), expansion is not; equal distances go by id. trace has
    (step, candidate, node, distance) of all that was scored.
    """
    result: list[tuple[float, int]] = []
    pool: list[tuple[float, int]] = []
    seen, steps, hops, visited = set(), [], 1, 0
    flight: deque[tuple[list[int], list[tuple[float, int]], float]] = deque()

    def evaluate(group: list[int]) -> tuple[list[int], list[tuple[float, int]], float]:
        nonlocal visited
        admitted = []
        for c in group:
            fresh = [x for x in g.of(c).tolist() if x not in seen]
            fresh = list(dict.fromkeys(fresh))
            seen.update(fresh)
            visited += len(fresh)
            if not fresh:
                continue
            d = distances(g, fresh, q)
            for x, dist in zip(fresh, d.tolist(), strict=True):
                if traced:
                    steps.append((len(steps), int(g.ids[c]), int(g.ids[x]), dist))
                worst = result[-1][0] if len(result) == ef else NONE
                if dist < worst:
                    _insert(result, (dist, x), ef)
                    admitted.append((dist, x))
        return group, admitted, result[-1][0] if len(result) == ef else NONE

    flight.append(evaluate([g.at(entry)]))
    while flight:
        _, admitted, threshold = flight.popleft()
        for item in admitted:
            _insert(pool, item, cq)
        while len(flight) < mg:
            group = []
            while pool and len(group) < mc and pool[0][0] <= threshold and pool[0][0] < NONE:
                group.append(pool.pop(0)[1])
            if not group:
                break
            hops += len(group)
            flight.append(evaluate(group))
    return Found([(d, int(g.ids[x])) for d, x in result], hops, visited, steps)


class Whole:
    """dst_search() with queues as large as the graph, which nothing is refused by or dropped from: every node that is reached is scored, admitted and expanded, in the same
    order. So a query's distances are taken at once, the waiting candidates are a heap of ranks by (distance, id), and the result is what was reached."""

    def __init__(self, g: Graph) -> None:
        self.g, self.columns = g, np.ascontiguousarray(g.vectors.T)
        links, starts = g.links.tolist(), g.starts.tolist()
        self.near = [links[a:b] for a, b in pairwise(starts)]

    def search(self, q: np.ndarray, entry: int, mc: int = 1, mg: int = 1, top: int | None = None) -> Found:
        """top: how many of the result are told; all are looked at."""
        n, near = len(self.near), self.near
        dist = np.zeros(n)
        for column, x in zip(self.columns, q, strict=True):
            dist += (column - x) ** 2
        order = np.argsort(dist, kind="stable")
        ranks = np.empty(n, np.int64)
        ranks[order] = np.arange(n)
        rank, node, finite = ranks.tolist(), order.tolist(), int(np.searchsorted(dist[order], NONE))
        seen, hops, heap, push, pop = bytearray(n), 1, [], heapq.heappush, heapq.heappop
        flight: deque[list[int]] = deque()

        def evaluate(group: list[int]) -> list[int]:
            met = []
            for c in group:
                for x in near[c]:
                    if not seen[x]:
                        seen[x] = 1
                        met.append(rank[x])
            return met if finite == n else [r for r in met if r < finite]

        flight.append(evaluate([self.g.at(entry)]))
        while flight:
            for r in flight.popleft():
                push(heap, r)
            while heap and len(flight) < mg:
                group = [node[pop(heap)] for _ in range(min(mc, len(heap)))]
                hops += len(group)
                flight.append(evaluate(group))
        reached = np.frombuffer(seen, np.uint8)
        found = order[:finite][reached[order[:finite]] > 0][:top]
        return Found(list(zip(dist[found].tolist(), self.g.ids[found].tolist(), strict=True)), hops, int(reached.sum()), [])


def _insert(queue: list[tuple[float, int]], item: tuple[float, int], cap: int) -> None:
    """Into a sorted bounded queue; a full one drops its worst for a strictly nearer item."""
    if len(queue) == cap:
        if not item[0] < queue[-1][0]:
            return
        queue.pop()
    lo, hi = 0, len(queue)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if queue[mid] < item else (lo, mid)
    queue.insert(lo, item)


def layer_search(g: Graph, q: np.ndarray, entry: int, ef: int, allowed: set[int] | None = None) -> Found:
    """HNSW's base-layer search: the entry is scored and returned, candidates are unbounded. Nodes outside allowed (ids) are walked through, never returned."""
    first = g.at(entry)
    d0 = float(distances(g, [first], q)[0])
    ok = (lambda x: allowed is None or int(g.ids[x]) in allowed)
    result = [(-d0, -first)] if ok(first) else []
    heap, seen, hops = [(d0, first)], {first}, 0
    while heap:
        d, c = heapq.heappop(heap)
        if len(result) == ef and d > -result[0][0]:
            break
        hops += 1
        fresh = [x for x in dict.fromkeys(g.of(c).tolist()) if x not in seen]
        seen.update(fresh)
        if not fresh:
            continue
        for x, dist in zip(fresh, distances(g, fresh, q).tolist(), strict=True):
            if len(result) < ef or dist < -result[0][0]:
                heapq.heappush(heap, (dist, x))
                if ok(x):
                    heapq.heappush(result, (-dist, -x))
                    if len(result) > ef:
                        heapq.heappop(result)
    return Found(sorted((-d, int(g.ids[-x])) for d, x in result), hops, len(seen), [])


def greedy_descent(layers: dict[int, Graph], q: np.ndarray, entry: int) -> int:
    """The node where moving to a strictly nearer neighbour ends, from the top layer down to layer 1."""
    here = entry
    for level in sorted(layers, reverse=True):
        g = layers[level]
        at = g.at(here)
        best = float(distances(g, [at], q)[0])
        while True:
            near = g.of(at)
            if not len(near):
                break
            d = distances(g, near, q)
            k = int(d.argmin())
            if not d[k] < best:
                break
            at, best = int(near[k]), float(d[k])
        here = int(g.ids[at])
    return here


def pool_search(g: Graph, q: np.ndarray, entry: int, ef: int) -> Found:
    """NSG's search: one pool of the ef nearest with flags; the first one not expanded is next, going back to wherever something new was put."""
    first = g.at(entry)
    pool = [(float(distances(g, [first], q)[0]), first)]
    done, seen, k, hops = set(), {first}, 0, 0
    while k < len(pool):
        back = k + 1
        if pool[k][1] not in done:
            node = pool[k][1]
            done.add(node)
            hops += 1
            fresh = [x for x in dict.fromkeys(g.of(node).tolist()) if x not in seen]
            seen.update(fresh)
            if fresh:
                for x, dist in zip(fresh, distances(g, fresh, q).tolist(), strict=True):
                    if len(pool) == ef and not dist < pool[-1][0]:
                        continue
                    _insert(pool, (dist, x), ef)
                    back = min(back, pool.index((dist, x)))
        k = back
    return Found([(d, int(g.ids[x])) for d, x in pool], hops, len(seen), [])


def run_queries(queries: DataFrame, search: Callable[[np.ndarray], Found], output: str = "results", tasks: int | None = None) -> DataFrame:
    """Applies a search to each of queries (qid, embedding). output: results (qid, rank, node_id, dist), stats (qid, hops, visited), or trace
    (qid, step, cand_id, node_id, dist). Queries are dealt out to tasks by hashed id."""
    schema = {"results": "qid long, rank int, node_id long, dist double", "stats": "qid long, hops int, visited int", "trace": "qid long, step int, cand_id long, node_id long, dist double"}[output]
    names = [x.split()[0] for x in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for qid, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                f = search(np.array(v.as_py(), float))
                if output == "stats":
                    rows.append((qid, f.hops, f.visited))
                elif output == "trace":
                    rows += [(qid, *t) for t in f.trace]
                else:
                    rows += [(qid, r + 1, node, d) for r, (d, node) in enumerate(f.result)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = tasks or queries.sparkSession.sparkContext.defaultParallelism
    dealt = queries.select(F.col("qid").cast("long"), "embedding").repartition(n, "qid")
    return dealt.mapInArrow(run, schema)


def search(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entry: int, ef: int = 64, cq: int = 32, mc: int = 1, mg: int = 1, output: str = "results", top: int | None = None) -> DataFrame:
    """dst_search() for every query; the graph is gathered once and broadcast. top: how many of each result are returned (all)."""
    g = queries.sparkSession.sparkContext.broadcast(load(vectors, edges))
    own: list[Whole] = []  # a task's

    def one(q: np.ndarray) -> Found:
        if output == "trace" or min(ef, cq) < len(g.value.ids):
            f = dst_search(g.value, q, entry, ef, cq, mc, mg, output == "trace")
            return f._replace(result=f.result[:top])
        if not own:
            own.append(Whole(g.value))
        return own[0].search(q, entry, mc, mg, top)

    return run_queries(queries, one, output)


def sweep(queries: DataFrame, vectors: DataFrame, edges: DataFrame, entry: int, settings: list[tuple[int, int, int, int]], truth: DataFrame) -> DataFrame:
    """ef, cq, mc, mg, recall_1, recall_10, avg_hops, avg_visited of each setting (ef, cq, mc, mg) over all queries; truth: qid, rank, node_id to rank 10.

    A task runs all settings for its queries and tells of each how many of its first ten are true, so a row a query and setting is shuffled."""
    held = queries.sparkSession.sparkContext.broadcast((load(vectors, edges), settings))
    true = truth.where("rank <= 10").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id"))).alias("t"))
    asked = queries.select(F.col("qid").cast("long"), "embedding").join(true, "qid").select("qid", "embedding", F.transform("t", lambda x: x["node_id"]).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, cases = held.value
        for b in batches:
            rows = []
            for v, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for ef, cq, mc, mg in cases:
                    f = dst_search(g, np.array(v, float), entry, ef, cq, mc, mg)
                    ids = [x for _, x in f.result[:10]]
                    rows.append((ef, cq, mc, mg, int(ids[:1] == t[:1]), len({*ids} & {*t}), len(t), f.hops, f.visited))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows, strict=True)], names)

    names = ["ef", "cq", "mc", "mg", "first", "hits", "n", "hops", "visited"]
    found = asked.mapInArrow(run, ", ".join(f"{x} int" for x in names)).groupBy("ef", "cq", "mc", "mg")
    return found.agg(F.avg("first").alias("recall_1"), (F.sum("hits") / F.sum("n")).alias("recall_10"), F.avg("hops").alias("avg_hops"), F.avg("visited").alias("avg_visited"))


def layered_search(queries: DataFrame, vectors: DataFrame, layers: DataFrame, entry: int, top: int, ef: int = 64, output: str = "results") -> DataFrame:
    """HNSW: greedy descent through the upper layers, then layer_search() from there."""
    g = queries.sparkSession.sparkContext.broadcast(load_layers(vectors, layers, top))

    def one(q: np.ndarray) -> Found:
        upper = {lv: x for lv, x in g.value.items() if lv > 0}
        return layer_search(g.value[0], q, greedy_descent(upper, q, entry), ef)

    return run_queries(queries, one, output)
