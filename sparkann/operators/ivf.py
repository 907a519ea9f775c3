"""Inverted files and product quantization. Vectors (node_id, embedding), centroids (cell_id, centroid), queries (qid, embedding)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import squared_l2
from ..session import stored
from .knn import Running, knn, top_k

#: Bytes of lookup tables in a task at a time.
TABLE_BYTES = 64 << 20
#: Probed queries that are broadcast, and centroids, at most.
MAX_PROBES, MAX_CENTROIDS = 100_000, 100_000


def label_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """cell_id, centroid: the mean vector of each label, as deterministic cells."""
    mean = vectors.select(F.col(label).alias("cell_id"), F.posexplode("embedding").alias("pos", "x")).groupBy("cell_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))


#: Rows of a k-means sample, at most.
SAMPLE_ROWS = 256_000


def sampled(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of least hashed id, some rows of them: those under a bound of hashes, so that nothing is sorted."""
    n = vectors.count()
    bound = -(1 << 63) + (1 << 64) * rows // max(1, n)
    return vectors if n <= rows else vectors.where(F.xxhash64("node_id") <= F.lit(min(bound, (1 << 63) - 1)))


def lloyd(vectors: DataFrame, cells: int, rounds: int = 3, digits: int = 6) -> DataFrame:
    """cell_id, centroid by k-means over sampled(): seeds are the cells vectors of least id, means are rounded to digits so that every run agrees; a cell
    that gets no vector keeps its centroid. A round is an assignment row by row and a sum by cell, which is pre-aggregated."""
    sample = sampled(vectors.select("node_id", "embedding"))
    first = sample.orderBy("node_id").limit(cells)
    found = first.select((F.row_number().over(Window.orderBy("node_id")) - 1).alias("cell_id"), F.col("embedding").cast("array<double>").alias("centroid"))
    for _ in range(rounds):
        found = stored(found, "centroids")
        sums = assign(sample, found).select("cell_id", F.posexplode("embedding").alias("pos", "x")).groupBy("cell_id", "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
        moved = sums.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("moved"))
        found = found.join(moved, "cell_id", "left").select("cell_id", F.coalesce("moved", "centroid").alias("centroid"))
    return stored(found, "centroids")


def trained_codebook(vectors: DataFrame, m: int, dim: int, codes: int, rounds: int = 3, digits: int = 6) -> DataFrame:
    """part, code, word: k-means of every part's slices, all parts in one pass a round; seeds, means and empty words are as in lloyd()."""
    sample = stored(sampled(vectors.select("node_id", "embedding")), "sample")
    parts = sub_vectors(sample, "node_id", "embedding", m, dim)
    found = sampled_codebook(sample, m, dim, codes).select("part", "code", F.col("word").cast("array<double>").alias("word"))
    for _ in range(rounds):
        found = stored(found, "words")
        words = found.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("code", "word"))).alias("words"))
        near = F.array_min(F.transform("words", lambda w: F.struct(squared_l2(F.col("sub"), w["word"]).alias("d"), w["code"].alias("code"))))["code"]
        rows = parts.join(F.broadcast(words), "part").select("part", near.alias("code"), F.posexplode("sub").alias("pos", "x"))
        sums = rows.groupBy("part", "code", "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
        moved = sums.groupBy("part", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("moved"))
        found = found.join(moved, ["part", "code"], "left").select("part", "code", F.coalesce("moved", "word").alias("word"))
    return stored(found, "codebook")


def rotation(vectors: DataFrame, m: int, dim: int, codes: int = 16, rounds: int = 8, rows: int = 10_000) -> np.ndarray:
    """An orthogonal matrix after which parts quantize better, learnt on the driver from rows vectors of sampled() at most: codes and the rotation that fits
    them best (by singular values) take turns."""
    held = sampled(vectors.select("node_id", "embedding"), rows).orderBy("node_id").limit(rows).toArrow()
    x = held.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    turn, width = np.eye(dim), dim // m
    books = [None] * m
    for _ in range(rounds):
        y, back = x @ turn, np.empty_like(x)
        for p in range(m):
            sub = y[:, p * width : (p + 1) * width]
            words = sub[:codes].copy() if books[p] is None else books[p]
            near = ((sub[:, None, :] - words[None]) ** 2).sum(2).argmin(1)
            for c in np.unique(near):
                words[c] = sub[near == c].mean(0)
            books[p], back[:, p * width : (p + 1) * width] = words, words[near]
        u, _, v = np.linalg.svd(x.T @ back)
        turn = u @ v
    return turn


def rotated(vectors: DataFrame, turn: np.ndarray) -> DataFrame:
    """vectors with their embeddings turned."""
    kind = vectors.select("embedding").schema["embedding"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(turn)
    at = vectors.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(at).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) @ shared.value
            item = b.column(at).type.value_type
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()).cast(item))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    assert kind.startswith("array")
    return vectors.mapInArrow(run, vectors.schema)


class Factory(NamedTuple):
    """What a factory string asks for: whether to rotate, cells (0: none), parts (0: whole vectors)."""

    rotate: bool
    cells: int
    parts: int


def factory(text: str) -> Factory:
    """Reads strings like "IVF64,PQ8", "OPQ8,IVF64,PQ8", "IVF64,Flat", "PQ8"; ValueError for others."""
    found = re.fullmatch(r"(?:OPQ(\d+),)?(?:IVF(\d+),)?(?:PQ(\d+)|Flat)", text)
    if not found or (found[1] and found[1] != found[3]):
        raise ValueError(f"unknown index {text}")
    return Factory(bool(found[1]), int(found[2] or 0), int(found[3] or 0))


class Index(NamedTuple):
    """An index by a factory string, with its tables written once: centroids, codebook, rows (node_id, cell_id, embedding or code)."""

    kind: Factory
    dim: int
    turn: np.ndarray | None
    centroids: DataFrame | None
    codebook: DataFrame | None
    rows: DataFrame


def build(vectors: DataFrame, text: str, dim: int, codes: int = 16) -> Index:
    """The index that a factory string names, over vectors (node_id, embedding): centroids and words are trained, codes are stored."""
    kind = factory(text)
    base = vectors.select("node_id", "embedding")
    turn = rotation(base, kind.parts, dim, codes) if kind.rotate else None
    base = stored(rotated(base, turn), "rotated") if turn is not None else base
    centroids = lloyd(base, kind.cells) if kind.cells else None
    rows = assign(base, centroids) if kind.cells else base.withColumn("cell_id", F.lit(0))
    book = None
    if kind.parts:
        left = _minus(rows, centroids) if kind.cells else rows
        left = stored(left, "residuals")
        book = trained_codebook(left, kind.parts, dim, codes)
        rows = encode(left, book, kind.parts, dim)
    return Index(kind, dim, turn, centroids, book, stored(rows, "index"))


def search_index(queries: DataFrame, index: Index, nprobe: int, k: int, exclude_self: bool = False) -> DataFrame:
    """qid, rank, node_id, dist from an index, by exact or asymmetric distances."""
    asked = rotated(queries.select("qid", "embedding"), index.turn) if index.turn is not None else queries.select("qid", "embedding")
    if not index.kind.parts:
        if not index.kind.cells:
            return knn(asked, index.rows, k, exclude_self=exclude_self)
        return search(asked, index.rows, index.centroids, nprobe, k, exclude_self)
    if not index.kind.cells:
        return adc_search(asked, index.rows, index.codebook, index.kind.parts, index.dim, k)
    return residual_search(asked, index.rows, index.centroids, index.codebook, index.kind.parts, index.dim, nprobe, k)


def _minus(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """node_id, cell_id, embedding: vectors less their centroids."""
    return assigned.join(F.broadcast(centroids), "cell_id").select("node_id", "cell_id", F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") - b).alias("embedding"))


def coarse(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """qid, cell_id, rank, dist: the nprobe nearest cells of each query; ties by cell. More than MAX_CENTROIDS cells are searched as vectors are, in blocks of queries."""
    if centroids.limit(MAX_CENTROIDS + 1).count() > MAX_CENTROIDS:
        return knn(queries, centroids.select(F.col("cell_id").alias("node_id"), F.col("centroid").alias("embedding")), nprobe, exclude_self=False).withColumnRenamed("node_id", "cell_id")
    near = queries.crossJoin(F.broadcast(centroids)).select("qid", F.col("cell_id").alias("node_id"), squared_l2(F.col("embedding"), F.col("centroid")).alias("dist"))
    return top_k(near, nprobe).withColumnRenamed("node_id", "cell_id")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """vectors with cell_id, that of the nearest centroid: an arg-min row by row, no window and no shuffle of vectors."""
    cells = centroids.agg(F.array_sort(F.collect_list(F.struct("cell_id", "centroid"))).alias("cells"))
    each = F.transform("cells", lambda c: F.struct(squared_l2(F.col("embedding"), c["centroid"]).alias("d"), c["cell_id"].alias("cell_id")))
    return vectors.crossJoin(F.broadcast(cells)).withColumn("cell_id", F.array_min(each)["cell_id"]).drop("cells")


def search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, nprobe: int, k: int, exclude_self: bool = True) -> DataFrame:
    """qid, rank, node_id, dist: the k nearest within the probed cells, exact distances."""
    probes = coarse(queries, centroids, nprobe).select("qid", "cell_id")
    q = probes.join(queries.select("qid", F.col("embedding").alias("q")), "qid")
    few = q.limit(MAX_PROBES + 1).count() <= MAX_PROBES
    # Beyond, a join by cell, in which adaptive execution splits the cells that are hot.
    rows = assigned.join(F.broadcast(q) if few else q, "cell_id").select("qid", "node_id", squared_l2(F.col("q"), F.col("embedding")).alias("dist"))
    return top_k(rows.where("qid <> node_id") if exclude_self else rows, k).select("qid", "rank", "node_id", "dist")


def sub_vectors(rows: DataFrame, key: str, column: str, m: int, dim: int) -> DataFrame:
    """key, part, sub: m slices of an array of dim."""
    width = dim // m
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.struct(i.alias("part"), F.slice(column, i * width + 1, width).alias("sub")))
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.part", "p.sub")


def sampled_codebook(vectors: DataFrame, m: int, dim: int, codes: int) -> DataFrame:
    """part, code, word: the slices of the codes vectors of least id, as a deterministic codebook."""
    chosen = vectors.orderBy("node_id").limit(codes).withColumn("code", F.row_number().over(Window.orderBy("node_id")) - 1)
    return sub_vectors(chosen.select("code", "embedding"), "code", "embedding", m, dim).select("part", "code", F.col("sub").alias("word"))


def encode(vectors: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """node_id, code: the nearest word of each part, as an array; ties by code. Row by row against the codebook, which is m times some hundred words;
    vectors are not shuffled, and other columns are kept."""
    width = dim // m
    words = codebook.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("code", "word"))).alias("words"))
    book = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "words"))), lambda p: p["words"]).alias("book"))

    def nearest(part: Column, words: Column) -> Column:
        sub = F.slice(F.col("embedding"), part * width + 1, F.lit(width))
        return F.array_min(F.transform(words, lambda w: F.struct(squared_l2(sub, w["word"]).alias("d"), w["code"].alias("code"))))["code"]

    code = F.transform("book", lambda words, part: nearest(part, words))
    return vectors.crossJoin(F.broadcast(book)).withColumn("code", code).drop("book", "embedding")


def lookup_tables(queries: DataFrame, codebook: DataFrame, m: int, dim: int, key: str = "qid", column: str = "embedding") -> DataFrame:
    """key, part, lut: the distances of the query's part to each word in code order."""
    rows = sub_vectors(queries, key, column, m, dim).join(F.broadcast(codebook), "part").select(key, "part", "code", squared_l2(F.col("sub"), F.col("word")).alias("d"))
    return rows.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("code", "d"))), lambda s: s["d"]).alias("lut"))


def residuals(queries: DataFrame, probes: DataFrame, centroids: DataFrame) -> DataFrame:
    """qid, cell_id, residual: query minus centroid for every probed cell."""
    joined = probes.select("qid", "cell_id").join(queries, "qid").join(F.broadcast(centroids), "cell_id")
    return joined.select("qid", "cell_id", F.zip_with("embedding", "centroid", lambda a, b: a.cast("double") - b).alias("residual"))


def tables_of(queries: DataFrame, codebook: DataFrame, m: int, dim: int, key: str = "qid", column: str = "embedding") -> DataFrame:
    """key, luts: the lookup tables of all parts, as one array of arrays."""
    return lookup_tables(queries, codebook, m, dim, key, column).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "lut"))), lambda s: s["lut"]).alias("luts"))


def _scanned(codes: DataFrame, tables: DataFrame, k: int, lanes: int | None, lane_k: int | None) -> DataFrame:
    """qid, node_id, dist: of each query the k nearest codes that each task sees (codes: node_id, cell_id, code) by the tables (qid, cell_id, luts) of the code's cell; a null
    cell_id stands for all. Tables are told to the tasks in blocks of TABLE_BYTES, a scan of the codes for each."""
    spark = codes.sparkSession
    n, size = tables.agg(F.count("*"), F.max(F.size("luts") * F.size(F.col("luts")[0]))).first()
    blocks = max(1, min(n, -(-n * (size or 0) * 8 // TABLE_BYTES)))
    kind, out = "qid long, node_id long, dist double", []
    for block in range(blocks):
        some = tables.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block).orderBy("cell_id", "qid").toArrow()
        if not some.num_rows:
            continue
        luts = np.array(some.column("luts").to_pylist(), float)
        cells = some.column("cell_id").to_pylist()
        shared = spark.sparkContext.broadcast((some.column("qid").to_numpy(), cells, luts))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            qids, cells, luts = shared.value
            own = [np.arange(len(qids))] if cells[:1] == [None] else {c: np.flatnonzero([x == c for x in cells]) for c in set(cells)}
            names, q = np.unique(qids, return_inverse=True)
            best = {lane: Running(lane_k or k) for lane in range(lanes or 1)}
            for b in batches:
                ids, cell = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                code = b.column(2).flatten().to_numpy().reshape(b.num_rows, -1)
                for c in [None] if cells[:1] == [None] else np.unique(cell):
                    at, rows = (own[0], np.arange(b.num_rows)) if c is None else (own.get(int(c), np.zeros(0, int)), np.flatnonzero(cell == c))
                    for lo in range(0, len(rows), 1024):
                        for some in (at[x : x + 1024] for x in range(0, len(at), 1024)):
                            part = rows[lo : lo + 1024]
                            dist = np.zeros((len(some), len(part)))
                            for p in range(code.shape[1]):
                                dist += luts[some, p][:, code[part, p]]
                            for lane, kept in best.items():
                                mine = np.flatnonzero(ids[part] % lanes == lane) if lanes else np.arange(len(part))
                                i, j = np.nonzero(dist[:, mine] <= kept.edges(len(names))[q[some]][:, None])
                                kept.add(q[some][i], ids[part][mine][j], dist[:, mine][i, j])
            for kept in best.values():
                a, node, d = kept.cut()
                yield pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(node), pa.array(d)], ["qid", "node_id", "dist"])

        out.append(codes.select(F.col("node_id").cast("long"), F.col("cell_id").cast("long"), F.col("code").cast("array<int>")).mapInArrow(run, kind))
    rows = spark.createDataFrame([], kind)
    for one in out:
        rows = rows.unionByName(one)
    return rows


def adc_search(queries: DataFrame, codes: DataFrame, codebook: DataFrame, m: int, dim: int, k: int, lanes: int | None = None, lane_k: int | None = None) -> DataFrame:
    """qid, rank, node_id, dist by asymmetric distances over codes (node_id, code): the sum over parts of lut[code].

    Tasks keep k rows a query. With lanes and lane_k, each lane (id modulo lanes) first keeps only lane_k rows, an approximation that can lose true neighbours."""
    tables = tables_of(queries, codebook, m, dim).withColumn("cell_id", F.lit(None).cast("int"))
    rows = _scanned(codes.withColumn("cell_id", F.lit(0)), tables, k, lanes, lane_k)
    if lanes:
        w = Window.partitionBy("qid", F.pmod("node_id", F.lit(lanes))).orderBy("dist", "node_id")
        rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= lane_k).drop("r")
    return top_k(rows, k).select("qid", "rank", "node_id", "dist")


def residual_codes(assigned: DataFrame, centroids: DataFrame, codebook: DataFrame, m: int, dim: int) -> DataFrame:
    """node_id, cell_id, code of vectors less their centroids, to be stored once."""
    return encode(_minus(assigned, centroids), codebook, m, dim)


def residual_search(queries: DataFrame, codes: DataFrame, centroids: DataFrame, codebook: DataFrame, m: int, dim: int, nprobe: int, k: int) -> DataFrame:
    """qid, rank, node_id, dist over residual_codes(): tables of query minus centroid for each probed cell, which only that cell's codes meet."""
    asked = residuals(queries, coarse(queries, centroids, nprobe), centroids).select(F.struct("qid", "cell_id").alias("key"), "residual")
    tables = tables_of(asked, codebook, m, dim, "key", "residual").select("key.qid", "key.cell_id", "luts")
    return top_k(_scanned(codes, tables, k, None, None), k).select("qid", "rank", "node_id", "dist")


def ivfpq_search(queries: DataFrame, assigned: DataFrame, centroids: DataFrame, codebook: DataFrame, m: int, dim: int, nprobe: int, k: int) -> DataFrame:
    """residual_search() over codes that are made for it."""
    return residual_search(queries, stored(residual_codes(assigned, centroids, codebook, m, dim), "codes"), centroids, codebook, m, dim, nprobe, k)


def least_nprobe(recalls: DataFrame, target: float) -> DataFrame:
    """config, nprobe: the least nprobe of each config whose recall reaches target, null if none does."""
    return recalls.groupBy("config").agg(F.min(F.when(F.col("recall") >= target, F.col("nprobe"))).alias("nprobe"))
