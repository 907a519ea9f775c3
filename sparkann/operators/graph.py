"""Proximity graphs: building, pruning, repairing, checking. Edges are rows (src, dst, pos), vectors rows (node_id, embedding)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import squared_l2
from ..functions.hashing import hashed_level
from ..session import stored
from .knn import knn


def knn_graph(vectors: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """src, dst, pos, dist: each node's k nearest, pos from 0; with keep_self the node itself comes first."""
    found = knn(vectors.select(F.col("node_id").alias("qid"), "embedding"), vectors, k, exclude_self=not keep_self)
    return found.select(F.col("qid").alias("src"), F.col("node_id").alias("dst"), (F.col("rank") - 1).alias("pos"), "dist")


def with_reverse(edges: DataFrame, max_degree: int) -> DataFrame:
    """src, dst, pos, dist: edges and their reverses, each pair once, the max_degree nearest of each node."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).where("src <> dst").dropDuplicates(["src", "dst"])
    pos = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return both.withColumn("pos", pos - 1).where(F.col("pos") < max_degree)


def degree_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("d")).agg(F.max("d").alias("max_degree"), F.min("d").alias("min_degree"), F.avg("d").alias("avg_degree"), F.count("*").alias("n"))


def integrity(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """self_loops, duplicates, out_of_range, unreached, min_in, max_in of a graph; 0 is a valid id."""
    known = vectors.select(F.col("node_id").alias("dst"))
    per_pair = edges.groupBy("src", "dst").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("c"))), F.lit(0)).alias("self_loops"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))
    out = edges.join(known, "dst", "left_anti").agg(F.count("*").alias("out_of_range"))
    degree = known.join(edges.groupBy("dst").agg(F.count("*").alias("c")), "dst", "left").agg(F.sum(F.when(F.col("c").isNull(), 1).otherwise(0)).alias("unreached"), F.min(F.coalesce("c", F.lit(0))).alias("min_in"), F.max(F.coalesce("c", F.lit(0))).alias("max_in"))
    return per_pair.crossJoin(out).crossJoin(degree)


def two_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_id, dst: what is within two hops of nodes (node_id), each once, the node left out."""
    start = nodes.select("node_id").join(edges.select(F.col("src").alias("node_id"), F.col("dst").alias("mid")), "node_id")
    far = start.join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("node_id", "dst")
    return start.select("node_id", F.col("mid").alias("dst")).unionByName(far).where("node_id <> dst").distinct()


def mean_vector(vectors: DataFrame) -> DataFrame:
    """One row: mean, the element-wise average as an array."""
    by_pos = vectors.select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return by_pos.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def medoid(vectors: DataFrame) -> DataFrame:
    """node_id, dist of the vector next to the mean; ties by id."""
    near = vectors.crossJoin(F.broadcast(mean_vector(vectors))).select("node_id", squared_l2(F.col("embedding"), F.col("mean")).alias("dist"))
    return near.agg(F.min(F.struct("dist", "node_id")).alias("m")).select("m.node_id", "m.dist")


def select_diverse(edges: DataFrame, vectors: DataFrame, m: int, fill: bool = False) -> DataFrame:
    """src, dst, pos, dist: of each node's neighbours, nearest first, those nearer to the node than to every one already taken, m at most. Nodes with fewer
    than m neighbours keep them all; with fill, the nearest others take the free places. Neighbours come sorted, and a task holds m of a node's at
    most (2 m with fill), so a hub with very many is only read through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"src": None}
        out: list[tuple[int, int, int, float]] = []

        def close() -> None:
            if state["src"] is None:
                return
            if state["n"] < m:
                rows = state["first"]
            else:
                rows = sorted(state["taken"] + state["first"][: m - len(state["taken"])] if fill else state["taken"])
            out.extend((state["src"], dst, k, dist) for k, (dist, dst) in enumerate(rows))

        for b in batches:
            src, dst, dist, vectors_ = (b.column(k) for k in range(4))
            flat = vectors_.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            for k, (s, x, d) in enumerate(zip(src.to_pylist(), dst.to_pylist(), dist.to_pylist(), strict=True)):
                if s != state["src"]:
                    close()
                    state = {"src": s, "n": 0, "first": [], "taken": [], "at": np.zeros((m, flat.shape[1]))}
                state["n"] += 1
                t = len(state["taken"])
                if t < m and (not t or (((state["at"][:t] - flat[k]) ** 2).sum(1) > d).all()):
                    state["at"][t] = flat[k]
                    state["taken"].append((d, x))
                    if state["n"] < m:
                        state["first"].append((d, x))
                elif len(state["first"]) < m:
                    state["first"].append((d, x))
            if len(out) > 10_000:
                yield batch(out)
                out.clear()
        close()
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["src", "dst", "pos", "dist"])

    full = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), "dist").join(vectors.select(F.col("node_id").cast("long").alias("dst"), "embedding"), "dst")
    full = full.select("src", "dst", "dist", "embedding").repartition("src").sortWithinPartitions("src", "dist", "dst")
    return full.mapInArrow(run, "src long, dst long, pos int, dist double")


def mutual(edges: DataFrame, vectors: DataFrame, m: int) -> DataFrame:
    """Edges and their reverses, pruned again where a node has more than m."""
    both = edges.select("src", "dst", "dist").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).where("src <> dst").dropDuplicates(["src", "dst"])
    crowded = both.groupBy("src").agg(F.count("*").alias("c")).where(F.col("c") > m).select("src")
    pos = (F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")) - 1).cast("int")
    as_is = both.join(crowded, "src", "left_anti").select("src", "dst", pos.alias("pos"), "dist")
    return as_is.unionByName(select_diverse(both.join(crowded, "src", "left_semi"), vectors, m))


def reachable(edges: DataFrame, entry: int, checkpoint_every: int = 4) -> DataFrame:
    """node_id of what entry reaches, by rounds of frontier joins whose lineage is cut in the shared folder."""
    seen = edges.sparkSession.createDataFrame([(entry,)], "node_id long")
    frontier, turn = seen, 0
    while True:
        turn += 1
        new = stored(frontier.join(edges.select(F.col("src").alias("node_id"), "dst"), "node_id").select(F.col("dst").alias("node_id")).distinct().join(seen, "node_id", "left_anti"))
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new
        if turn % checkpoint_every == 0:
            seen = stored(seen)


def navigating_graph(vectors: DataFrame, k: int, degree: int) -> tuple[DataFrame, int]:
    """An NSG-like graph and its entry: the kNN graph pruned for diversity, the medoid as navigating node, and what it doesn't reach
    tied to the nearest node that it does."""
    near = stored(knn_graph(vectors, k))
    entry = medoid(vectors).first().node_id
    edges = stored(select_diverse(near, vectors, degree))
    while True:
        seen = reachable(edges, entry)
        lost = vectors.join(seen, "node_id", "left_anti")
        if lost.isEmpty():
            return edges, entry
        there = vectors.join(seen, "node_id", "left_semi")
        tie = knn(lost.select(F.col("node_id").alias("qid"), "embedding"), there, 1, exclude_self=False)
        made = tie.select(F.col("node_id").alias("src"), F.col("qid").alias("dst"), F.lit(-1).alias("pos"), "dist")
        edges = stored(edges.select("src", "dst", "pos", "dist").unionByName(made.withColumn("pos", F.col("pos").cast("int"))))


def levels(vectors: DataFrame, m: int) -> DataFrame:
    """node_id, level: hashed HNSW levels, the same in every run."""
    return vectors.select("node_id", hashed_level(F.col("node_id"), m).alias("level"))


def layered(vectors: DataFrame, m: int) -> tuple[DataFrame, int, int]:
    """Edges (level, src, dst, pos, dist) of every HNSW layer, the entry and the top level: each layer is the diverse mutual graph of the nodes
    that reach it, with 2m links at most on layer 0 and m above."""
    own = stored(levels(vectors, m))
    top = own.agg(F.max("level")).first()[0]
    entry = own.where(F.col("level") == top).agg(F.min("node_id")).first()[0]
    layers = None
    for level in range(top + 1):
        here = vectors.join(own.where(F.col("level") >= level), "node_id").select("node_id", "embedding")
        cap = 2 * m if level == 0 else m
        one = mutual(select_diverse(knn_graph(here, 4 * m), here, m), here, cap).select(F.lit(level).alias("level"), "src", "dst", "pos", "dist")
        layers = one if layers is None else layers.unionByName(one)
    return stored(layers), entry, top


def shard(rows: DataFrame, n: int, column: str = "node_id", size: int | None = None) -> DataFrame:
    """rows with shard_id: round robin by id modulo n, or ranges of size ids."""
    return rows.withColumn("shard_id", F.floor(F.col(column) / size).cast("long") if size else F.pmod(F.col(column), F.lit(n)))


def remove(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """vectors without the ids in gone."""
    return vectors.join(gone, "node_id", "left_anti")


def upsert(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """vectors with rows of new added, or in place of those with the same id."""
    return remove(vectors, new.select("node_id")).unionByName(new.select(vectors.columns))


def repair_after_delete(edges: DataFrame, vectors: DataFrame, gone: DataFrame, m: int) -> DataFrame:
    """Edges after gone (node_id) left: nodes that pointed there are linked anew to the most diverse of their two-hop neighbours."""
    lost = edges.join(gone.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
    lost = lost.join(gone, "node_id", "left_anti")
    around = two_hop(edges, lost).join(gone.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    left = remove(vectors, gone)
    a, b = left.select("node_id", F.col("embedding").alias("a")), left.select(F.col("node_id").alias("dst"), F.col("embedding").alias("b"))
    scored = around.join(a, "node_id").join(b, "dst").select(F.col("node_id").alias("src"), "dst", squared_l2(F.col("a"), F.col("b")).alias("dist"))
    kept = edges.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti").join(lost.select(F.col("node_id").alias("src")), "src", "left_anti")
    return kept.select("src", "dst", "pos", "dist").unionByName(select_diverse(scored, left, m))
