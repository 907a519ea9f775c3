"""Building layered graphs point by point, and the maintenance of indexes: marks, replacement, saving and loading.

Insertion is sequential: a point's links depend on all points before. So the points of a shard are inserted by one task, and shards are searched each by itself
and merged; a graph made from exact neighbours (graph.layered) needs no such order. What m and ef find falls with the size of a shard, so larger tables need more shards.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import hashed_level
from ..session import scratch, stored
from . import evaluation, knn

#: Nodes of a shard that one task inserts, at most.
MAX_SHARD_ROWS = 1_000_000


class Layers:
    """A layered graph that grows: links[level][node] are a node's neighbours there, as positions; into[level][node] is how many have it as a neighbour.
    Pruning never takes a node's last link, so that no node is lost."""

    def __init__(self, dim: int, m: int, ef: int) -> None:
        self.m, self.ef = m, ef
        self.vectors, self.links, self.entry, self.top = np.zeros((0, dim)), [], -1, -1
        self.into: list[dict[int, int]] = []
        self.count = 0

    def _far(self, nodes: list[int], q: np.ndarray) -> np.ndarray:
        d = self.vectors.take(nodes, 0)
        d -= q
        d *= d
        return np.add.accumulate(d, 1, out=d)[:, -1]

    def _search(self, q: np.ndarray, start: list[tuple[float, int]], level: int) -> list[tuple[float, int]]:
        """The ef nearest of a layer, from start, as a build finds them: sorted (distance, node)."""
        links, seen, ef, far = self.links[level], {x for _, x in start}, self.ef, self._far
        todo, best = list(start), [(-d, -x) for d, x in start]
        heapq.heapify(todo)
        heapq.heapify(best)
        push, replace, full = heapq.heappush, heapq.heapreplace, len(best) >= ef
        worst = -best[0][0] if full else np.inf
        while todo:
            d, c = heapq.heappop(todo)
            if d > worst:
                break
            new = [x for x in links[c] if x not in seen]
            if not new:
                continue
            seen.update(new)
            for x, dist in zip(new, far(new, q).tolist(), strict=True):
                if not full:
                    push(todo, (dist, x))
                    push(best, (-dist, -x))
                    full = len(best) >= ef
                elif dist < worst:
                    push(todo, (dist, x))
                    replace(best, (-dist, -x))
                else:
                    continue
                worst = -best[0][0] if full else np.inf
        return sorted((-d, -x) for d, x in best)

    def _diverse(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Of sorted neighbours those nearer to the point than to each one taken; fewer than most stay as they are."""
        if len(near) < most:
            return [x for _, x in near]
        taken: list[int] = []
        left, d = np.array([x for _, x in near]), np.array([d for d, _ in near])
        while len(left) and len(taken) < most:
            x, left, d = int(left[0]), left[1:], d[1:]
            taken.append(x)
            if len(left) and len(taken) < most:
                open_ = self._far(left, self.vectors[x]) > d
                left, d = left[open_], d[open_]
        return taken

    def _prune(self, x: int, level: int, bound: int) -> None:
        """Leaves bound of x's bound + 1 neighbours at most: the diverse ones, and those that nothing else links to in place of the farthest that others link to."""
        links, into = self.links[level], self.into[level]
        near = sorted(zip(self._far(links[x], self.vectors[x]).tolist(), links[x], strict=True))
        kept = self._diverse(near, bound)
        gone = [y for y in links[x] if y not in kept]
        last = [y for y in gone if into[y] == 1]
        for y in gone:
            into[y] -= 1
        homeless = []
        for y in last:
            if len(kept) == bound:
                other = next((z for z in reversed(kept) if into[z] > 1), None)
                if other is None:
                    homeless.append(y)
                    continue
                kept.remove(other)
                into[other] -= 1
            kept.append(y)
            into[y] += 1
        if last:
            at = {y: k for k, (_, y) in enumerate(near)}
            kept.sort(key=at.__getitem__)
        links[x] = kept
        for y in homeless:
            self._take_in(y, x, level, bound)

    def _take_in(self, y: int, start: int, level: int, bound: int) -> None:
        """Links to y from the first node in breadth from start that has room or a neighbour to which others link. There is one: were all lists full of
        nodes with one link each, there would be more links than nodes."""
        links, into = self.links[level], self.into[level]
        walk = [start]
        for x in walk:
            other = next((z for z in reversed(links[x]) if into[z] > 1), None)
            if x != y and (len(links[x]) < bound or other is not None):
                if len(links[x]) >= bound:
                    links[x].remove(other)
                    into[other] -= 1
                links[x].append(y)
                into[y] += 1
                return
            walk += [z for z in links[x] if z not in walk]

    def insert(self, vector: np.ndarray, level: int) -> None:
        node = self.count
        if node == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros((max(1024, node), self.vectors.shape[1]))])
        self.vectors[node] = vector
        self.count += 1
        while len(self.links) <= level:
            self.links.append({})
            self.into.append({})
        for lv in range(level + 1):
            self.links[lv][node] = []
            self.into[lv][node] = 0
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        start = [self._descend(vector, level)]
        for lv in range(min(level, self.top), -1, -1):
            start = self._search(vector, start, lv)
            bound = self.m if lv else 2 * self.m
            chosen = self._diverse(start, self.m)
            self.links[lv][node] = list(chosen)
            self.into[lv][node] = len(chosen)
            for x in chosen:
                self.into[lv][x] += 1
                back = self.links[lv][x]
                back.append(node)
                if len(back) > bound:
                    self._prune(x, lv, bound)
        if level > self.top:
            self.entry, self.top = node, level

    def _descend(self, q: np.ndarray, level: int) -> tuple[float, int]:
        """Distance and node where moving to a strictly nearer neighbour ends, from the top layer down to the one above level."""
        here, far = self.entry, float(self._far([self.entry], q)[0])
        for lv in range(self.top, level, -1):
            while near := self.links[lv][here]:
                d = self._far(near, q)
                k = int(d.argmin())
                if not d[k] < far:
                    break
                here, far = near[k], float(d[k])
        return far, here

    def nearest(self, q: np.ndarray) -> list[tuple[float, int]]:
        """The ef nearest as a layered search finds them: sorted (distance, node)."""
        return self._search(q, [self._descend(q, 0)], 0)

    @classmethod
    def of(cls, vectors: np.ndarray, levels: list[int], links: Iterable[tuple[int, int, int]], m: int, ef: int) -> Layers:
        """A graph that was built, for searches: the nodes' vectors and levels in the order of insertion, and (level, node, neighbour) in the order of the lists."""
        made = cls(vectors.shape[1], m, ef)
        made.vectors, made.count, made.top = vectors, len(levels), max(levels)
        made.entry = levels.index(made.top)
        made.links = [{x: [] for x, own in enumerate(levels) if own >= lv} for lv in range(made.top + 1)]
        for lv, x, y in links:
            made.links[lv][x].append(y)
        return made


def dealt(vectors: DataFrame, most: int) -> DataFrame:
    """vectors with shard, for inserted() and searched(): rows are numbered in the order of ids and dealt in turn, so that shards are alike whatever the ids are,
    and none has more than most rows."""
    shards = max(1, -(-vectors.count() // most))
    return _numbered(vectors, "node_id").withColumn("shard", F.pmod("k", F.lit(shards)).cast("int")).drop("k")


def _shard(vectors: DataFrame, shards: int) -> Column:
    return F.col("shard") if "shard" in vectors.columns else F.pmod("node_id", F.lit(shards)).cast("int")


def inserted(vectors: DataFrame, m: int, ef: int = 128, shards: int = 1) -> DataFrame:
    """shard, level, src, dst, pos: links of layered graphs, one for each shard (id modulo shards, or the column shard where vectors have it), whose points
    are inserted in id order with hashed levels. ValueError if a shard has more than MAX_SHARD_ROWS points."""
    shard = _shard(vectors, shards)
    most, n = vectors.groupBy(shard.alias("s")).count().agg(F.max("count"), F.count("*")).first()
    if (most or 0) > MAX_SHARD_ROWS:
        raise ValueError("a shard has too many points for one task; use more shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, layers = None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            for lv, links in enumerate(layers.links if layers else ()):
                rows = [(at, lv, ids[x], ids[y], p) for x, near in links.items() for p, y in enumerate(near)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["shard", "level", "src", "dst", "pos"])

        for b in batches:
            for s, node, level, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != at:
                    yield from told()
                    at, ids, layers = s, [], Layers(len(v), m, ef)
                ids.append(node)
                layers.insert(np.array(v, float), level)
        yield from told()

    rows = vectors.select(shard.alias("shard"), F.col("node_id").cast("long"), hashed_level(F.col("node_id"), m).alias("level"), "embedding")
    return rows.repartition(max(1, n), "shard").sortWithinPartitions("shard", "node_id").mapInArrow(run, "shard int, level int, src long, dst long, pos int")


def searched(queries: DataFrame, vectors: DataFrame, edges: DataFrame, m: int, ef: int, k: int, shards: int = 1) -> DataFrame:
    """qid, rank, node_id, dist: the k nearest (ef at most) of layered searches in all shards of inserted(), each by itself, merged. vectors, m and shards as
    they were told to it. A task holds one shard at a time and a block of the queries; blocks are taken as in knn.knn()."""
    spark = vectors.sparkSession
    asked = queries.select(F.col("qid").cast("long"), "embedding")
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    parts = vectors.select(_shard(vectors, shards).alias("shard")).distinct().count()
    if not n or not parts:
        return spark.createDataFrame([], "qid long, rank int, node_id long, dist double")
    nodes = vectors.select(_shard(vectors, shards).alias("shard"), F.col("node_id").cast("long"), hashed_level(F.col("node_id"), m).alias("level"), "embedding")
    links = edges.select("shard", "level", "src", "dst", "pos").repartition(parts, "shard").groupBy("shard")
    both = nodes.repartition(parts, "shard").groupBy("shard").cogroup(links)

    def scan(some: DataFrame) -> DataFrame:
        held = some.toArrow()
        block = spark.sparkContext.broadcast((held.column("qid").to_pylist(), knn._matrix(held.column("embedding").combine_chunks(), dim)))

        def run(own: pa.Table, near: pa.Table) -> pa.Table:
            own, near = own.sort_by("node_id"), near.sort_by([(c, "ascending") for c in ("level", "src", "pos")])
            ids = own.column("node_id").to_numpy()
            src, dst = (np.searchsorted(ids, near.column(c).to_numpy()).tolist() for c in ("src", "dst"))
            matrix = knn._matrix(own.column("embedding").combine_chunks(), dim)
            layers = Layers.of(matrix, own.column("level").to_pylist(), zip(near.column("level").to_pylist(), src, dst, strict=True), m, ef)
            found = [(qid, int(ids[x]), d) for qid, q in zip(*block.value, strict=True) for d, x in layers.nearest(q)[:k]]
            return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["qid", "node_id", "dist"])

        return knn.top_k(both.applyInArrow(run, "qid long, node_id long, dist double"), k).select("qid", "rank", "node_id", "dist")

    blocks = -(-n * 8 * dim // knn.BLOCK_BYTES)
    if blocks == 1:
        return scan(asked)
    at = scratch(spark, "searched")
    for block in range(blocks):
        scan(asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)).write.parquet(f"{at}/block={block}")
    return spark.read.parquet(at).select("qid", "rank", "node_id", "dist")


def recall_of(vectors: DataFrame, edges: DataFrame, queries: DataFrame, ef: int) -> float:
    """Recall at 10 of the layered searches over the shards of edges, made with m = 8."""
    found = searched(queries, vectors, edges, 8, ef, 11).drop("rank")  # the query itself may be one of them
    found = knn.top_k(found.where("qid <> node_id"), 10)
    return evaluation.recall_at(found, knn.knn(queries, vectors, 10), [10]).first().recall


def mark(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """vectors with deleted, true for the ids in gone and for those marked before."""
    return _flagged(vectors, gone, True)


def unmark(vectors: DataFrame, back: DataFrame) -> DataFrame:
    """vectors with deleted, false for the ids in back."""
    return _flagged(vectors, back, False)


def _flagged(vectors: DataFrame, ids: DataFrame, to: bool) -> DataFrame:
    before = F.col("deleted") if "deleted" in vectors.columns else F.lit(False)
    some = ids.select("node_id").distinct().withColumn("__hit", F.lit(True))
    return vectors.join(some, "node_id", "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(to)).otherwise(before)).drop("__hit")


def replace_deleted(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors (node_id, embedding, label, deleted) with the rows of new (label, embedding) in marked places, by ascending id and label; what finds no
    place gets ids after the greatest. Only ids and labels are ranked, in ranges that are counted first."""
    places = _numbered(vectors.where("deleted").select("node_id"), "node_id")
    asked = _numbered(new.select("label"), "label")
    last = vectors.agg(F.max("node_id").alias("last"), F.count(F.when(F.col("deleted"), 1)).alias("n"))
    at = asked.join(places, "k", "left").crossJoin(F.broadcast(last)).select("label", F.coalesce("node_id", F.col("last") + F.col("k") - F.col("n") + 1).alias("node_id"))
    rows = new.join(at, "label").withColumn("deleted", F.lit(False))
    return vectors.join(at.select("node_id"), "node_id", "left_anti").unionByName(rows.select(vectors.columns))


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """rows with k, their number from 0 in the order of by: ranges are sorted by themselves, and counts of those before are added."""
    ranges = rows.repartitionByRange(by).withColumn("part", F.spark_partition_id())
    ranges = stored(ranges, "dealt")
    before = ranges.groupBy("part").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return ranges.withColumn("own", own).join(F.broadcast(before.select("part", "before")), "part").select(*rows.columns, (F.col("own") + F.col("before")).alias("k"))


def save(path: str, vectors: DataFrame, edges: DataFrame, entry: int) -> None:
    """Writes a graph, with its vectors and its entry, in place of what is there."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = json.dumps({"entry": entry})
    vectors.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Vectors, edges and figures of a saved graph."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/edges"), json.loads(spark.read.text(f"{path}/meta").first()[0])
