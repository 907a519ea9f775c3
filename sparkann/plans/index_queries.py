"""Queries on trained indexes, queues, filters' variants and single-precision distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.hashing import sql_murmur2
from ..operators import evaluation, graph, ivf, knn, membership, queues, traversal
from . import traversal_sql as T
from .analysis_queries import _ASSIGN, _BOOK, _COARSE, _MEAN, _SUB, book, cells
from .registry import Q, V, asked, knn_sql, query, vectors
from .search_queries import KNN16, L2, near16


def lloyd_sql(name: str, rows: str, cells: int, dim: int, rounds: int = 3) -> str:
    """k-means of rows (grp, node_id, x) by groups, as tables name_0 to name_(rounds) of grp, cell_id, centroid: seeds are the rows of least id."""
    parts = [f"{name}_0 AS MATERIALIZED (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY node_id) - 1 AS cell_id, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS centroid FROM {rows} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY node_id) <= {cells})"]
    for r in range(rounds):
        parts.append(f"{name}_a{r} AS MATERIALIZED (SELECT v.grp, node_id, x, cell_id FROM {rows} v JOIN {name}_{r} c ON c.grp = v.grp QUALIFY row_number() OVER (PARTITION BY v.grp, node_id ORDER BY {D.sql_l2('v.x', 'c.centroid')}, cell_id) = 1)")
        mean = f"(SELECT grp, cell_id, pos, round(avg(CAST(x[pos] AS DOUBLE)), 6) AS m FROM (SELECT grp, cell_id, x, unnest(range(1, {dim + 1})) AS pos FROM {name}_a{r}) GROUP BY grp, cell_id, pos)"
        parts.append(f"{name}_{r + 1} AS MATERIALIZED (SELECT c.grp, c.cell_id, coalesce(m, centroid) AS centroid FROM {name}_{r} c LEFT JOIN (SELECT grp, cell_id, list(m ORDER BY pos) AS m FROM {mean} GROUP BY grp, cell_id) n ON n.grp = c.grp AND n.cell_id = c.cell_id)")
    return ", ".join(parts)


_ALL = "al AS (SELECT 0 AS grp, node_id, embedding AS x FROM v)"


@query(f"WITH {V}, {_ALL}, {lloyd_sql('l', 'al', 8, 64)} SELECT CAST(cell_id AS INTEGER) AS cell_id, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, unnest(centroid) AS x FROM l_3")
def x16_kmeans_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained centroids, element by element."""
    return ivf.lloyd(vectors(spark, sf_dir), 8).select("cell_id", F.posexplode("centroid").alias("pos", "x"))


_BY_LIST = f"pr AS (SELECT qid, cell_id, row_number() OVER (PARTITION BY qid ORDER BY {D.sql_l2('q.embedding', 'c.centroid')}, cell_id) AS r FROM q, c)"


@query(f"WITH {V}, {Q}, {_ALL}, {lloyd_sql('l', 'al', 8, 64)}, c AS (SELECT cell_id, centroid FROM l_3), {_BY_LIST}, {_ASSIGN} SELECT q.qid, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY {D.sql_l2('q.embedding', 'a.embedding')}, a.node_id) AS INTEGER) AS rank, a.node_id, {D.sql_l2('q.embedding', 'a.embedding')} AS dist FROM pr JOIN q ON q.qid = pr.qid JOIN a ON a.cell_id = pr.cell_id WHERE pr.r <= 3 QUALIFY row_number() OVER (PARTITION BY q.qid ORDER BY {D.sql_l2('q.embedding', 'a.embedding')}, a.node_id) <= 10")
def x16_factory_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IVF8,Flat: trained cells, whole vectors."""
    return ivf.search_index(asked(spark, sf_dir), ivf.build(vectors(spark, sf_dir), "IVF8,Flat", 64), 3, 10)


_RESIDUAL = "list_transform(list_zip({}, {}), lambda p: CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))"


def _residual_search(book: str) -> str:
    """Statements after c (centroids) and a (assignments): residual codes by the words w that book defines from own (node_id, cell_id, r), tables and distances z."""
    return f"""own AS MATERIALIZED (SELECT node_id, a.cell_id, {_RESIDUAL.format('a.embedding', 'c.centroid')} AS r FROM a JOIN c ON c.cell_id = a.cell_id), {book},
s AS (SELECT node_id, cell_id, unnest(range(0, 8)) AS part, unnest(list_transform(range(0, 8), lambda i: list_slice(r, i * 8 + 1, i * 8 + 8))) AS sub FROM own),
k AS MATERIALIZED (SELECT node_id, cell_id, part, code FROM (SELECT s.node_id, s.cell_id, s.part, w.code, row_number() OVER (PARTITION BY s.node_id, s.part ORDER BY {D.sql_l2('s.sub', 'w.word')}, w.code) AS n FROM s JOIN w ON w.part = s.part) WHERE n = 1),
g AS (SELECT pr.qid, pr.cell_id, {_RESIDUAL.format('q.embedding', 'c.centroid')} AS r FROM pr JOIN q ON q.qid = pr.qid JOIN c ON c.cell_id = pr.cell_id WHERE pr.r <= 3),
u AS (SELECT qid, cell_id, unnest(range(0, 8)) AS part, unnest(list_transform(range(0, 8), lambda i: list_slice(r, i * 8 + 1, i * 8 + 8))) AS sub FROM g),
t AS MATERIALIZED (SELECT u.qid, u.cell_id, u.part, w.code, {D.sql_l2('u.sub', 'w.word')} AS d FROM u JOIN w ON w.part = u.part),
z AS (SELECT t.qid, k.node_id, list_sum(list(t.d ORDER BY t.part)) AS dist FROM k JOIN t ON t.cell_id = k.cell_id AND t.part = k.part AND t.code = k.code GROUP BY t.qid, k.node_id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS INTEGER) AS rank, node_id, dist FROM z QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) <= 10"""


@query(f"WITH {V}, {Q}, {_MEAN}, {_BY_LIST}, {_ASSIGN}, {_residual_search(_BOOK)}")
def v3_residual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v = cells(spark, sf_dir), vectors(spark, sf_dir)
    return ivf.ivfpq_search(asked(spark, sf_dir), ivf.assign(v, c), c, book(spark, sf_dir), 8, 64, 3, 10)


_PARTS = "ps AS (" + _SUB.format(key="node_id", col="r", rows="own").replace("SELECT node_id, unnest", "SELECT node_id, unnest") + "), pg AS (SELECT part AS grp, node_id, sub AS x FROM ps)"


@query(f"WITH {V}, {Q}, {_ALL}, {lloyd_sql('l', 'al', 8, 64)}, c AS (SELECT cell_id, centroid FROM l_3), {_BY_LIST}, {_ASSIGN}, " + _residual_search(f"{_PARTS}, {lloyd_sql('b', 'pg', 16, 8)}, w AS (SELECT grp AS part, cell_id AS code, centroid AS word FROM b_3)"))
def x16_factory_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IVF8,PQ8: trained cells and words, codes stored as an index."""
    return ivf.search_index(asked(spark, sf_dir), ivf.build(vectors(spark, sf_dir), "IVF8,PQ8", 64), 3, 10)


@query(f"""WITH {V}, {Q}, {_MEAN}, {_BY_LIST}, {_ASSIGN}, gt AS ({knn_sql(L2)}), n AS (SELECT unnest([1, 2, 4, 8]) AS nprobe),
f AS (SELECT nprobe, q.qid, a.node_id, row_number() OVER (PARTITION BY nprobe, q.qid ORDER BY {D.sql_l2('q.embedding', 'a.embedding')}, a.node_id) AS k FROM n JOIN pr ON pr.r <= nprobe JOIN q ON q.qid = pr.qid JOIN a ON a.cell_id = pr.cell_id WHERE a.node_id <> q.qid)
SELECT CAST(nprobe AS INTEGER) AS nprobe, round(count(gt.node_id) / (10.0::DOUBLE * (SELECT count(*) FROM q)), 9) AS recall FROM f LEFT JOIN gt ON gt.qid = f.qid AND gt.node_id = f.node_id WHERE k <= 10 GROUP BY nprobe""")
def v4_nprobe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of nprobe 1, 2, 4, 8."""
    c, q, v = cells(spark, sf_dir), asked(spark, sf_dir), vectors(spark, sf_dir)
    assigned, truth, out = ivf.assign(v, c), knn.knn(q, v, 10), None
    for n in (1, 2, 4, 8):
        one = evaluation.recall_at(ivf.search(q, assigned, c, n, 10), truth, [10]).select(F.lit(n).alias("nprobe"), F.round("recall", 9).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {V}, {Q}, {_ALL}, {lloyd_sql('l', 'al', 40, 64, 1)}, c AS (SELECT cell_id, centroid FROM l_1), {_BY_LIST} SELECT pr.qid, CAST(r AS INTEGER) AS rank, cell_id FROM pr WHERE r <= 5")
def v5_graph_over_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells to probe, found by a search of a graph over the centroids."""
    c = ivf.lloyd(vectors(spark, sf_dir), 40, rounds=1)
    nodes = c.select(F.col("cell_id").cast("long").alias("node_id"), F.col("centroid").alias("embedding"))
    edges, entry = graph.navigating_graph(nodes, 12, 8)
    g = spark.sparkContext.broadcast(traversal.load(nodes, edges))
    found = traversal.run_queries(asked(spark, sf_dir), lambda q: traversal.layer_search(g.value, q, entry, 40))
    return found.where("rank <= 5").select("qid", "rank", F.col("node_id").alias("cell_id"))


@query(f"WITH {V}, {Q} SELECT qid, node_id, {D.sql_lane_l2('q.embedding', 'v.embedding', 64)} AS dist FROM q, v WHERE node_id % 5 = 0")
def d2_lane_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single precision, sixteen lanes added as a tree, packs in turn."""
    q = asked(spark, sf_dir).select("qid", F.col("embedding").alias("q"))
    rows = vectors(spark, sf_dir).where("node_id % 5 = 0").crossJoin(F.broadcast(q))
    return rows.select("qid", "node_id", D.lane_l2(F.col("q"), F.col("embedding"), 64).alias("dist"))


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, items: each node's 16 neighbours, farthest first."""
    rows = near16(spark, sf_dir).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", F.col("dst").alias("node_id"))), asc=False).alias("items"))
    return rows


@query(f"WITH {KNN16} SELECT src, CAST(pos + 1 AS INTEGER) AS rank, dst AS node_id, dist FROM e WHERE pos < 8")
def k2_insert_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Into a queue of 8 that is empty at first, one item after the other."""
    kept = arriving(spark, sf_dir).select("src", F.posexplode(queues.insert(queues.empty(), F.col("items"), 8)).alias("p", "x"))
    return kept.select("src", (F.col("p") + 1).alias("rank"), "x.node_id", "x.dist")


@query(f"WITH {KNN16}, b AS (SELECT src, max(dist) AS dist FROM e WHERE pos < 8 GROUP BY src), t AS (SELECT src, dst, dist, 1e9::DOUBLE AS worst FROM e) SELECT src, CAST(8 AS INTEGER) AS n, dist AS threshold FROM b")
def k1_reset_and_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full queue's threshold; an empty one lets everything in."""
    q = queues.insert(queues.empty(), F.col("items"), 8)
    return arriving(spark, sf_dir).where(queues.threshold(queues.empty(), 8) == traversal.NONE).select("src", F.size(q).alias("n"), queues.threshold(q, 8).alias("threshold"))


@query(f"WITH {KNN16} SELECT src, CASE WHEN pos < 3 THEN 'popped' ELSE 'left' END AS part, dst AS node_id FROM e")
def k5_pop_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest leave the queue."""
    top, rest = queues.pop(queues.insert(queues.empty(), F.col("items"), 16), 3)
    rows = arriving(spark, sf_dir).select("src", F.explode(F.array(F.struct(F.lit("popped").alias("part"), top.alias("q")), F.struct(F.lit("left").alias("part"), rest.alias("q")))).alias("s"))
    return rows.select("src", "s.part", F.explode("s.q").alias("x")).select("src", "part", "x.node_id")


@query(f"WITH {KNN16} SELECT src, CAST(pos + 1 AS INTEGER) AS rank, dst AS node_id FROM e")
def k10_closer_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arriving(spark, sf_dir).select("src", F.posexplode(queues.closer_first(F.col("items"))).alias("p", "x")).select("src", (F.col("p") + 1).alias("rank"), "x.node_id")


@query(f"WITH {KNN16}, m AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src % 50 = 0 AND a.src <> b.dst), {V}, s AS (SELECT m.src, m.dst, {D.sql_l2('x.embedding', 'y.embedding')} AS dist FROM m JOIN v x ON x.node_id = m.src JOIN v y ON y.node_id = m.dst) SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS INTEGER) AS rank, dst AS node_id FROM s")
def k14_sorted_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of neighbours put into a sorted list that grows."""
    e, v = near16(spark, sf_dir), vectors(spark, sf_dir).select("node_id", "embedding")
    far = e.where("src % 50 = 0").select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").where("src <> dst").select("src", "dst").distinct()
    rows = far.join(v.select(F.col("node_id").alias("src"), F.col("embedding").alias("x")), "src").join(v.select(F.col("node_id").alias("dst"), F.col("embedding").alias("y")), "dst")
    lists = rows.groupBy("src").agg(F.collect_list(F.struct(D.squared_l2(F.col("x"), F.col("y")).alias("dist"), F.col("dst").alias("node_id"))).alias("items"))
    return lists.select("src", F.posexplode(queues.insert(queues.empty(), F.col("items"), None)).alias("p", "x")).select("src", (F.col("p") + 1).alias("rank"), "x.node_id")


@query(f"SELECT qid, list(node_id ORDER BY rank) AS ids FROM ({knn_sql(L2, 7, where='true')}) GROUP BY qid")
def u1_bounded_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as an aggregate."""
    rows = knn.pairs(asked(spark, sf_dir), vectors(spark, sf_dir))
    return queues.nearest(rows, 7).select("qid", F.transform("queue", lambda x: x["node_id"]).alias("ids"))


_H = lambda key, seeds, mod="": ", ".join(f"CAST({sql_murmur2(key, s)} AS BIGINT){mod}" for s in seeds)


@query(f"WITH {V} SELECT node_id AS key, CAST(unnest([0, 1, 2]) AS INTEGER) AS h, unnest([{_H('node_id', (1, 2, 3))}]) AS hash FROM v")
def b1_streamed_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.stream_hashes(vectors(spark, sf_dir).select(F.col("node_id").alias("key")))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select(F.pmod("node_id", F.lit(3)).alias("group"), F.col("node_id").alias("pos"), F.pmod(F.col("node_id") * 37, F.lit(211)).alias("key"))


_KEYS = f"b AS (SELECT node_id % 3 AS grp, node_id AS pos, (node_id * 37) % 211 AS key, unnest([{_H('(node_id * 37) % 211', (1, 2, 3), ' % 256')}]) AS bit FROM v)"
_VALID = "(SELECT grp, pos, key, max(pos = first) AS valid FROM (SELECT *, min(pos) OVER (PARTITION BY grp, bit) AS first FROM b) GROUP BY grp, pos, key)"


@query(f'WITH {V}, {_KEYS} SELECT grp AS "group", pos // 16 AS burst, count(*) FILTER (valid) AS n FROM {_VALID} GROUP BY 1, 2')
def b4_burst_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership.burst_counts(membership.check_and_insert(_keys(spark, sf_dir), 8))


@query(f'WITH {V}, l AS (SELECT *, {T.level(4)} AS level FROM v), {_KEYS.replace("FROM v", "FROM l WHERE level = 0")} SELECT grp AS "group", pos, key, valid FROM {_VALID} UNION ALL SELECT node_id % 3, node_id, (node_id * 37) % 211, true FROM l WHERE level > 0')
def b7_upper_layers_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = graph.levels(vectors(spark, sf_dir), 4).select(F.col("node_id").alias("pos"), "level")
    return membership.check_base_only(_keys(spark, sf_dir).join(level, "pos"), 8)


@query("SELECT vec_id % 3 AS qid, vec_id AS pos, (vec_id * 37) % 101 AS node_id, coalesce(lag(vec_id % 3) OVER (PARTITION BY (vec_id * 37) % 101 ORDER BY vec_id % 3, vec_id) <> vec_id % 3, true) AS valid FROM embeddings")
def g20_visited_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node_id")
    return membership.check_tags(vectors(spark, sf_dir).select(F.pmod(n, F.lit(3)).alias("qid"), n.alias("pos"), F.pmod(n * 37, F.lit(101)).alias("node_id")))
