"""Exact nearest neighbours, label filters, and merging of top-k lists.

knn() sends a query block of checked size to every task and multiplies matrices there; each task gives k rows a query at most, which
are merged by a ranked window. More queries than fit a block are taken block by block, each one's result written to the shared folder, so
that neither the driver nor a task ever holds more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS
from ..session import scratch

#: Bytes of query vectors in a task at a time, as doubles.
BLOCK_BYTES = 32 << 20


def top_k(rows: DataFrame, k: int, by: str = "qid", dist: str = "dist", node: str = "node_id", largest: bool = False) -> DataFrame:
    """The k rows of least (or largest) distance for each by, ties by node, with rank from 1. Ranks are cut before the shuffle too."""
    order = [F.col(dist).desc() if largest else F.col(dist).asc(), F.col(node).asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def merge(parts: list[DataFrame], k: int | None) -> DataFrame:
    """Lists (qid, node_id, dist) of several servers or shards as one, cut at k or not, with rank."""
    rows = parts[0].select("qid", "node_id", "dist")
    for p in parts[1:]:
        rows = rows.unionByName(p.select("qid", "node_id", "dist"))
    if k is None:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "node_id")))
    return top_k(rows, k)


def pairs(queries: DataFrame, base: DataFrame, metric: str = "l2") -> DataFrame:
    """qid, node_id, dist of all pairs, as expressions: for a small stated query set, which is broadcast."""
    q = queries.select(F.col("qid"), F.col("embedding").alias("q"))
    return base.select("node_id", "embedding").crossJoin(F.broadcast(q)).select("qid", "node_id", METRICS[metric](F.col("q"), F.col("embedding")).alias("dist"))


def knn_by_expression(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = True, allowed: Column | None = None) -> DataFrame:
    """As knn(), with any metric that is a column expression; allowed is a predicate on base's columns."""
    rows = pairs(queries, base if allowed is None else base.where(allowed), metric)
    return top_k(rows.where("qid <> node_id") if exclude_self else rows, k).select("qid", "rank", "node_id", "dist")


def _sum(terms: Callable[[int], np.ndarray], n: int, dim: int) -> np.ndarray:
    """The sum of terms(0), terms(1), … from the left."""
    out = np.zeros(n)
    for d in range(dim):
        out += terms(d)
    return out


def _fold(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of q and v, dimension by dimension from the left; infinite where a zero vector has no cosine."""
    n, dim = q.shape
    if metric == "l2":
        return _sum(lambda d: (q[:, d] - v[:, d]) ** 2, n, dim)
    dot = _sum(lambda d: q[:, d] * v[:, d], n, dim)
    if metric == "ip":
        return 1.0 - dot
    norm = np.sqrt(_sum(lambda d: q[:, d] * q[:, d], n, dim)) * np.sqrt(_sum(lambda d: v[:, d] * v[:, d], n, dim))
    return 1.0 - np.divide(dot, norm, out=np.full(n, -np.inf), where=norm > 0)


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero vectors become NaN."""
    norm = np.sqrt((m * m).sum(1))
    return m / np.where(norm > 0, norm, np.nan)[:, None]


class Running:
    """The k nearest rows of each query so far, by distance and id: what a task keeps of all its batches."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.held = 0

    def add(self, q: np.ndarray, node: np.ndarray, dist: np.ndarray) -> None:
        """Rows of queries' positions, ids and distances; they are cut when there are as many new ones as kept."""
        self.rows = tuple(np.concatenate(x) for x in zip(self.rows, (q, node, dist), strict=True))
        if len(self.rows[0]) > 2 * self.held + (1 << 16):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, node, dist = self.rows
        order = np.lexsort((node, dist, q))
        q = q[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        keep = order[np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < self.k]
        self.rows = (self.rows[0][keep], node[keep], dist[keep])
        self.held = len(keep)
        return self.rows

    def edges(self, n: int) -> np.ndarray:
        """Of each of n queries the distance beyond which nothing new can count, as far as that is known from the last cut."""
        q, _, dist = self.rows[0][: self.held], None, self.rows[2][: self.held]
        worst = np.full(n, np.inf)
        full = np.bincount(q, minlength=n) >= self.k
        last = np.zeros(n)
        np.maximum.at(last, q, dist)
        worst[full] = last[full]
        return worst


def _nearest(q: np.ndarray, qids: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int, metric: str, exclude_self: bool, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's position, node and exact distance of the k nearest of each query that are within worst. Products of matrices preselect, with slack for their
    rounding; what is left is measured anew."""
    if metric == "cosine":
        rough = np.nan_to_num(1.0 - _unit(q) @ _unit(v).T, copy=False, nan=4.0)  # beyond all cosines
    else:
        product = q @ v.T
        rough = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * product if metric == "l2" else 1.0 - product
    if exclude_self:
        rough[qids[:, None] == ids[None, :]] = np.inf
    take = min(k, rough.shape[1])
    edge = np.minimum(np.partition(rough, take - 1, 1)[:, take - 1], worst)
    scale = np.zeros(len(q)) if metric == "cosine" else np.abs(q).sum(1) * max(1.0, float(np.abs(v).max(initial=0))) + (q * q).sum(1) + float((v * v).sum(1).max(initial=0))
    a, b = np.nonzero((rough <= (edge + 1e-10 * (1 + scale))[:, None]) & np.isfinite(rough))
    return a, ids[b], _fold(q[a], v[b], metric)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2", exclude_self: bool = True) -> DataFrame:
    """qid, rank, node_id, dist: the k nearest of base (node_id, embedding) for each of queries (qid, embedding); l2, ip or cosine.

    Equal distances go by node_id. With fewer than k candidates there are fewer rows. Distances are doubles, added from left
    to right; a zero vector's cosine distance is NaN, which comes last. Empty tables give no rows; null embeddings are left out.
    """
    spark = base.sparkSession
    asked = queries.where("embedding is not null").select(F.col("qid").cast("long").alias("qid"), "embedding")
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return spark.createDataFrame([], "qid long, rank int, node_id long, dist double")
    vectors = base.where("embedding is not null").select(F.col("node_id").cast("long").alias("node_id"), "embedding")
    blocks = -(-n * 8 * dim // BLOCK_BYTES)
    if blocks == 1:
        found, _ = _scan(asked, vectors, k, metric, exclude_self, dim)
        return top_k(found, k).select("qid", "rank", "node_id", "dist")
    at = scratch(spark, "knn")
    for block in range(blocks):
        found, held = _scan(asked.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block), vectors, k, metric, exclude_self, dim)
        top_k(found, k).select("qid", "rank", "node_id", "dist").write.parquet(f"{at}/block={block}")
        held.destroy()
    return spark.read.parquet(at).select("qid", "rank", "node_id", "dist")


def _scan(queries: DataFrame, vectors: DataFrame, k: int, metric: str, exclude_self: bool, dim: int) -> tuple[DataFrame, Broadcast]:
    """k rows a query at most from each task, for queries that fit a block; and the block."""
    held = queries.toArrow()
    block = queries.sparkSession.sparkContext.broadcast((held.column("qid").to_numpy(), _matrix(held.column("embedding").combine_chunks(), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = block.value
        best = [Running(k) for _ in range(0, len(qids), 1024)]
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                v, ids = _matrix(part.column(1), q.shape[1]), part.column(0).to_numpy()
                for kept, s in zip(best, range(0, len(qids), 1024), strict=True):
                    some = q[s : s + 1024]
                    kept.add(*_nearest(some, qids[s : s + 1024], v, ids, k, metric, exclude_self, kept.edges(len(some))))
        for kept, s in zip(best, range(0, len(qids), 1024), strict=True):
            a, n, d = kept.cut()
            d = np.where(np.isposinf(d), np.nan, d) if metric == "cosine" else d
            yield pa.RecordBatch.from_arrays([pa.array(qids[s + a]), pa.array(n), pa.array(d, from_pandas=False)], ["qid", "node_id", "dist"])

    return vectors.mapInArrow(run, "qid long, node_id long, dist double"), block


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
