"""Queries on distances, exact search, graphs and traversals, over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.hashing import hashed_level, murmur2, sql_murmur2
from ..operators import evaluation, graph, knn, membership, superstep, traversal
from ..session import scratch, stored
from ..streaming import serving
from . import traversal_sql as T
from .registry import Q, V, asked, kept, knn_sql, query, vectors

L2 = D.sql_l2("q.embedding", "v.embedding")
LABEL_OK = "label % 2 = 0"
#: Edges of the k nearest, in SQL.
KNN16 = f"e AS (SELECT src, dst, dist, r - 1 AS pos FROM (SELECT a.vec_id AS src, b.vec_id AS dist_id, b.vec_id AS dst, {D.sql_l2('a.embedding', 'b.embedding')} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {D.sql_l2('a.embedding', 'b.embedding')}, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE r <= 16)"


def near16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.knn_graph(vectors(spark, sf_dir), 16)


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Vectors, the kNN graph with reverse edges, and the medoid; the graph is built once."""
    v = vectors(spark, sf_dir)
    made = kept(spark, sf_dir, "linked", lambda: (stored(graph.with_reverse(near16(spark, sf_dir), 32)), graph.medoid(v).first().node_id))
    return v, *made


def layered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """Edges, entry and top level of the layered graph, which is built once."""
    return kept(spark, sf_dir, "layered", lambda: graph.layered(vectors(spark, sf_dir), 8))


@query(knn_sql(L2))
def k9_knn_l2_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search: partial top-k in every task, then a merge."""
    return knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10)


@query(knn_sql(L2))
def d1_squared_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_by_expression(asked(spark, sf_dir), vectors(spark, sf_dir), 10)


@query(knn_sql(f"CAST({D.sql_fold('list_transform(q.embedding, lambda e: CAST(round(e * 100) AS BIGINT))', 'list_transform(v.embedding, lambda e: CAST(round(e * 100) AS BIGINT))', '(x - y) * (x - y)')} AS BIGINT)"))
def d6_l2_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL multiplies and rounds in single precision, where a product may come to lie on a half.
    whole = lambda c: F.transform(c, lambda e: F.round((e * F.lit(100).cast("float")).cast("float")).cast("long"))
    q, v = asked(spark, sf_dir).select("qid", whole("embedding").alias("q")), vectors(spark, sf_dir).select("node_id", whole("embedding").alias("v"))
    rows = v.crossJoin(F.broadcast(q)).where("qid <> node_id").select("qid", "node_id", D.squared_l2_int(F.col("q"), F.col("v")).alias("dist"))
    return knn.top_k(rows, 10).select("qid", "rank", "node_id", "dist")


@query(knn_sql(D.sql_metric("ip", "q.embedding", "v.embedding")))
def d7_inner_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10, "ip")


@query(f"SELECT qid, rank, node_id, round(dist, 9) AS dist FROM ({knn_sql(D.sql_metric('cosine', 'q.embedding', 'v.embedding'))})")
def d8_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10, "cosine").withColumn("dist", F.round("dist", 9))


@query(knn_sql(L2, where=f"qid <> node_id AND {LABEL_OK}"))
def p7_allowed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_by_expression(asked(spark, sf_dir), vectors(spark, sf_dir), 10, allowed=F.expr(LABEL_OK))


@query(knn_sql(L2, where="qid <> node_id AND node_id % 7 <> 3"))
def p8_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return knn.knn(asked(spark, sf_dir), graph.remove(v, v.where("node_id % 7 = 3").select("node_id")), 10)


@query(f"WITH {Q}, {V}, t AS ({knn_sql(L2, 64)}) SELECT qid, count(*) AS n FROM (SELECT qid, {L2} AS dist FROM q, v WHERE qid <> node_id) JOIN (SELECT qid AS q2, max(dist) AS worst FROM t GROUP BY qid) ON qid = q2 WHERE dist < worst GROUP BY qid")
def p3_result_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs strictly nearer than the worst of a full result of 64."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    worst = knn.knn(q, v, 64).groupBy("qid").agg(F.max("dist").alias("worst"))
    return knn.pairs(q, v).where("qid <> node_id").join(F.broadcast(worst), "qid").where("dist < worst").groupBy("qid").agg(F.count("*").alias("n"))


@query(f"WITH {V}, t AS ({knn_sql(L2)}) SELECT qid, rank, label FROM t JOIN v USING (node_id)")
def p11_labels_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return knn.knn(asked(spark, sf_dir), v, 10).join(v.select("node_id", "label"), "node_id").select("qid", "rank", "label")


@query("SELECT vec_id AS node_id, vec_id // 100 AS shard, vec_id % 100 AS local, (vec_id // 100) * 100 + vec_id % 100 AS rebased FROM embeddings")
def p12_rebase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = graph.shard(vectors(spark, sf_dir), 0, size=100).select("node_id", F.col("shard_id").alias("shard"))
    local = s.withColumn("local", F.pmod("node_id", F.lit(100)))
    return local.withColumn("rebased", F.col("local") + F.col("shard") * 100)


@query("SELECT vec_id AS node_id, CAST(list_sum(list_transform(embedding, lambda e: CAST(CAST(round((e + 1) * 100) AS UTINYINT) AS DOUBLE))) AS DOUBLE) AS s FROM embeddings")
def p14_bytes_to_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda e: F.round((e + 1) * 100).cast("int").cast("float"))
    return vectors(spark, sf_dir).select("node_id", F.aggregate(whole, F.lit(0.0), lambda s, x: s + x.cast("double")).alias("s"))


@query("SELECT vec_id AS node_id, label FROM embeddings WHERE vec_id < 100")
def s9_prefix_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("node_id < 100").select("node_id", "label")


@query("SELECT qid // 8 AS batch_id, count(*) AS n, min(qid) AS first, max(qid) AS last FROM (SELECT vec_id AS qid FROM embeddings) GROUP BY 1")
def s14_query_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.batches(vectors(spark, sf_dir).withColumnRenamed("node_id", "qid"), 8).groupBy("batch_id").agg(F.count("*").alias("n"), F.min("qid").alias("first"), F.max("qid").alias("last"))


@query(f"WITH {KNN16}, f AS (SELECT vec_id AS cand FROM embeddings WHERE vec_id % 50 = 0) SELECT cand, dst, CAST(pos AS INTEGER) AS pos FROM f JOIN e ON cand = src")
def j1_expand_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = asked(spark, sf_dir).select(F.col("qid").alias("cand"))
    return near16(spark, sf_dir).join(F.broadcast(front), F.col("cand") == F.col("src")).select("cand", "dst", "pos")


@query(f"WITH {KNN16} SELECT count(DISTINCT dst) AS n FROM e WHERE src % 50 = 0 AND dst NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0)")
def j7_not_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = asked(spark, sf_dir).select(F.col("qid").alias("dst"))
    return near16(spark, sf_dir).where("src % 50 = 0").join(seen, "dst", "left_anti").agg(F.countDistinct("dst").alias("n"))


@query("SELECT shard, qid FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0), (SELECT unnest(range(4)) AS shard)")
def j8_scatter_to_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    servers = spark.range(4).withColumnRenamed("id", "shard")
    return asked(spark, sf_dir).select("qid").crossJoin(F.broadcast(servers)).select("shard", "qid")


@query(f"WITH {KNN16}, a AS (SELECT src, dst FROM e WHERE src % 50 = 0), b AS (SELECT a.src, e.dst FROM a JOIN e ON a.dst = e.src) SELECT src AS node_id, count(DISTINCT dst) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE src <> dst GROUP BY src")
def j11_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = asked(spark, sf_dir).select(F.col("qid").alias("node_id"))
    return graph.two_hop(near16(spark, sf_dir), nodes).groupBy("node_id").agg(F.count("*").alias("n"))


def by_shard(spark: SparkSession, sf_dir: str, n: int, k: int) -> list[DataFrame]:
    v = graph.shard(vectors(spark, sf_dir), n)
    return [knn.knn(asked(spark, sf_dir), v.where(F.col("shard_id") == s), k) for s in range(n)]


@query(knn_sql(L2))
def k12_merge_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four round-robin shards answers; merged, it is the global result."""
    return knn.merge(by_shard(spark, sf_dir, 4, 10), 10).select("qid", "rank", "node_id", "dist")


@query(f"WITH {Q}, {V}, s AS (SELECT qid, node_id, {L2} AS dist, node_id % 3 AS shard FROM q, v WHERE qid <> node_id), t AS (SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY dist, node_id) AS r FROM s) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS INTEGER) AS rank, node_id, dist FROM t WHERE r <= 5")
def k13_merge_subgraphs_uncut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.merge(by_shard(spark, sf_dir, 3, 5), None).select("qid", "rank", "node_id", "dist")


@query(knn_sql(L2, 5, desc=" DESC"))
def k18_farthest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.pairs(asked(spark, sf_dir), vectors(spark, sf_dir)).where("qid <> node_id")
    return knn.top_k(rows, 5, largest=True).select("qid", "rank", "node_id", "dist")


@query(f"WITH {Q}, {V} SELECT qid, node_id, dist FROM (SELECT qid, node_id, {L2} AS dist FROM q, v WHERE qid <> node_id) ORDER BY dist, qid, node_id LIMIT 10")
def k16_ten_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest pairs: a report of ten rows."""
    rows = knn.pairs(asked(spark, sf_dir), vectors(spark, sf_dir)).where("qid <> node_id")
    return rows.orderBy("dist", "qid", "node_id").limit(10)


@query(f"WITH {KNN16} SELECT src, dst, CAST(pos AS INTEGER) AS pos, dist FROM e")
def x1_knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near16(spark, sf_dir)


@query(f"WITH {KNN16}, d AS (SELECT src, count(*) AS d FROM (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)) GROUP BY src) SELECT max(least(d, 32)) AS max_degree, min(least(d, 32)) AS min_degree, avg(least(d, 32)) AS avg_degree, count(*) AS n FROM d")
def x12_degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree_stats(graph.with_reverse(near16(spark, sf_dir), 32))


@query(f"WITH {KNN16}, i AS (SELECT vec_id, count(e.dst) AS c FROM embeddings LEFT JOIN e ON e.dst = vec_id GROUP BY vec_id) SELECT CAST(0 AS BIGINT) AS self_loops, CAST(0 AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS out_of_range, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unreached, min(c) AS min_in, max(c) AS max_in FROM i")
def x10_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.integrity(near16(spark, sf_dir), vectors(spark, sf_dir))


@query(f"WITH {V} SELECT node_id, CAST(floor(-ln((CAST({sql_murmur2('node_id', 1)} AS DOUBLE) + 1.0) / 4294967296.0) / ln(16)) AS INTEGER) AS level FROM v")
def x3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("node_id", hashed_level(F.col("node_id"), 16).alias("level"))


@query(f"WITH {V}, m AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM v) GROUP BY pos)) SELECT node_id FROM v, m ORDER BY round({D.sql_l2('v.embedding', 'm.mean')}, 9), node_id LIMIT 1")
def x11_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.medoid(vectors(spark, sf_dir)).select("node_id")


@query("SELECT vec_id % 4 AS shard_id, count(*) AS n FROM embeddings GROUP BY 1")
def x14_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shard(vectors(spark, sf_dir), 4).groupBy("shard_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id // 128 AS shard_id, count(*) AS n FROM embeddings GROUP BY 1")
def x13_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shard(vectors(spark, sf_dir), 0, size=128).groupBy("shard_id").agg(F.count("*").alias("n"))


@query("SELECT vec_id AS node_id, CASE WHEN vec_id < 10 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 10 <> 9")
def x15_upsert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    new = v.where("node_id < 10").withColumn("label", F.lit(-1))
    return graph.remove(graph.upsert(v, new), v.where("node_id % 10 = 9").select("node_id")).select("node_id", "label")


@query(f"WITH RECURSIVE {T.PAIRS}, {T.near('n', 16)}, {T.diverse('x', 'n', 8)} SELECT src, dst, CAST(pos AS INTEGER) AS pos, dist FROM x")
def x5_diverse_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.select_diverse(near16(spark, sf_dir), vectors(spark, sf_dir), 8)


@query(f"WITH RECURSIVE {T.PAIRS}, {T.near('n', 16)}, {T.diverse('x', 'n', 8)}, {T.mutual('y', 'x', 12)} SELECT src, dst, CAST(pos AS INTEGER) AS pos, dist FROM y")
def x6_mutual_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links both ways; a node with more than 12 is pruned again."""
    v = vectors(spark, sf_dir)
    return graph.mutual(graph.select_diverse(near16(spark, sf_dir), v, 8), v, 12)


_REPAIR = f"""{T.PAIRS}, {T.near('n', 16)}, lost AS (SELECT DISTINCT src FROM n WHERE dst < 10 AND src >= 10),
o AS (SELECT n.src, n.dst AS mid FROM n JOIN lost USING (src)), around AS (SELECT src, mid AS dst FROM o UNION SELECT o.src, n.dst FROM o JOIN n ON n.src = o.mid),
scored AS (SELECT src, dst, d AS dist FROM around JOIN pr ON a = src AND b = dst WHERE src <> dst AND dst >= 10), {T.diverse('x', 'scored', 16)}"""


@query(f"WITH RECURSIVE {_REPAIR} SELECT src, dst, CAST(pos AS INTEGER) AS pos, dist FROM x UNION ALL SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS INTEGER), dist FROM n WHERE src >= 10 AND src NOT IN (SELECT src FROM lost)")
def x7_repair_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nodes go; those that pointed there are linked anew."""
    v = vectors(spark, sf_dir)
    return graph.repair_after_delete(near16(spark, sf_dir), v, v.where("node_id < 10").select("node_id"), 16)


_NAVIGATING = f"{T.PAIRS}, {T.near('n', 24)}, {T.diverse('x', 'n', 12)}, {T.medoid('e')}, r AS (SELECT entry AS node_id FROM e UNION SELECT dst FROM r JOIN x ON src = r.node_id)"


@query(f"WITH RECURSIVE {_NAVIGATING}, l AS (SELECT vec_id AS dst FROM embeddings WHERE vec_id NOT IN (SELECT node_id FROM r)) SELECT src, dst, dist FROM x UNION ALL SELECT b AS src, a AS dst, d AS dist FROM pr WHERE a IN (SELECT dst FROM l) AND b IN (SELECT node_id FROM r) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 1")
def x11_navigating_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's edges: the pruned ones, and ties to what the navigating node doesn't reach by them."""
    return graph.navigating_graph(vectors(spark, sf_dir), 24, 12)[0].select("src", "dst", "dist")


@query("SELECT vec_id AS node_id, label FROM embeddings")
def x11_navigating_graph_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node can be reached from the navigating node."""
    v = vectors(spark, sf_dir)
    edges, entry = graph.navigating_graph(v, 24, 12)
    return graph.reachable(edges, entry).join(v, "node_id").select("node_id", "label")


@query(knn_sql(L2))
def g1_best_first_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With queues as large as the graph, best-first search is exact; a task tells the ten nearest, and one more for the query itself."""
    v, e, entry = linked(spark, sf_dir)
    n = v.count()
    found = traversal.search(asked(spark, sf_dir), v, e, entry, ef=n, cq=n, top=11)
    return knn.top_k(found.drop("rank").where("qid <> node_id"), 10).select("qid", "rank", "node_id", "dist")


@query(knn_sql(L2))
def g3_delayed_sync_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    n = v.count()
    found = traversal.search(asked(spark, sf_dir), v, e, entry, ef=n, cq=n, mc=2, mg=4, top=11)
    return knn.top_k(found.drop("rank").where("qid <> node_id"), 10).select("qid", "rank", "node_id", "dist")


def _searched(ef: int, cq: int, mc: int, mg: int) -> str:
    """The start of a statement that has the states s of a search of the linked graph."""
    return f"WITH RECURSIVE {T.linked()}, {T.settings((ef, cq, mc, mg))}, {T.search('s', 'p')}"


@query(f"{_searched(64, 32, 1, 1)} {T.listed('s')}")
def g1_best_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    return traversal.search(asked(spark, sf_dir), v, e, entry, ef=64)


@query(f"{_searched(64, 32, 4, 1)} {T.listed('s')}")
def g2_multi_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    return traversal.search(asked(spark, sf_dir), v, e, entry, ef=64, mc=4)


@query(f"{_searched(64, 32, 4, 4)} {T.listed('s')}")
def g3_delayed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    return traversal.search(asked(spark, sf_dir), v, e, entry, ef=64, mc=4, mg=4)


@query(f"{_searched(8, 8, 8, 2)} {T.listed('s')}")
def g3_superstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The superstep form, with a small queue: a round is some jobs."""
    v, e, entry = linked(spark, sf_dir)
    return superstep.search(asked(spark, sf_dir), v, e, entry, ef=8, cq=8, mc=8, mg=2)[0]


def intra_query(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results, and what each of four channels scored; searched once."""

    def run() -> tuple[DataFrame, DataFrame]:
        v, e, entry = linked(spark, sf_dir)
        results, _, scored = superstep.search(asked(spark, sf_dir), v, e, entry, ef=12, cq=8, mc=8, mg=2, channels=4)
        return stored(results), stored(scored)

    return kept(spark, sf_dir, "intra_query", run)


@query(f"{_searched(12, 8, 8, 2)} {T.listed('s')}")
def g4_intra_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels work on one query: a group's neighbours are dealt to them, each filters by the group before, and their answers are gathered."""
    return intra_query(spark, sf_dir)[0]


@query(f"{_searched(12, 8, 8, 2)} SELECT qid, node % 4 AS channel, count(*) AS n FROM (SELECT qid, unnest(V) AS node FROM s WHERE {T.DONE}) GROUP BY 1, 2")
def g7_neighbour_tasks_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many distances each channel had to compute for a query."""
    return intra_query(spark, sf_dir)[1].groupBy("qid", "channel").agg(F.count("*").alias("n"))


@query(f"{_searched(12, 8, 8, 2)} SELECT s.qid, CAST(row_number() OVER (PARTITION BY s.qid ORDER BY d, b) AS INTEGER) AS rank, b AS node_id, d AS dist FROM (SELECT qid, unnest(V) AS node FROM s WHERE {T.DONE}) s JOIN pr ON a = s.qid AND b = node")
def g8_gathered_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distances of all channels in one order."""
    scored = intra_query(spark, sf_dir)[1]
    return knn.merge([scored.where(F.col("channel") == c) for c in range(4)], None).select("qid", "rank", "node_id", "dist")


SWEEP = [(ef, 32, mc, mg) for ef in (16, 64) for mc in (1, 2, 4) for mg in (1, 2, 4)]
_SWEPT = f"""WITH RECURSIVE {T.linked()}, {T.settings(*SWEEP)}, {T.search('s', 'p')}, f AS (SELECT * FROM s WHERE {T.DONE}),
r AS (SELECT qid, ef, mc, mg, unnest(range(1, len(R) + 1)) AS rank, unnest(list_transform(R, lambda x: x.id)) AS node_id FROM f),
t AS (SELECT a AS qid, b AS node_id, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM pr WHERE a % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 10),
h AS (SELECT ef, mc, mg, sum(CASE WHEN r.rank = 1 AND t.rank = 1 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN r.rank <= 10 THEN 1 ELSE 0 END) AS h10 FROM r JOIN t USING (qid, node_id) GROUP BY ef, mc, mg),
c AS (SELECT ef, mc, mg, count(*) AS n, avg(hops) AS avg_hops, avg(visited) AS avg_visited FROM f GROUP BY ef, mc, mg)
SELECT ef, mc, mg, round(h1 / n, 9) AS recall_1, round(h10 / (n * 10), 9) AS recall_10, round(avg_hops, 6) AS avg_hops, round(avg_visited, 6) AS avg_visited FROM h JOIN c USING (ef, mc, mg)"""


@query(_SWEPT)
def g3_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall, hops and visited nodes of each setting (ef, mc, mg): one pass over the queries, the graph gathered once."""
    v, e, entry = linked(spark, sf_dir)
    q = asked(spark, sf_dir)
    out = traversal.sweep(q, v, e, entry, SWEEP, knn.knn(q, v, 10, exclude_self=False))
    return out.select("ef", "mc", "mg", *[F.round(c, 9).alias(c) for c in ("recall_1", "recall_10")], *[F.round(c, 6).alias(c) for c in ("avg_hops", "avg_visited")])


@query(f"WITH RECURSIVE {T.layered(8)}, {T.descent('t')}, {T.layer_search('s', 32, 'SELECT qid, node FROM t WHERE lev = 0')} {T.listed('s', 'NOT more')}")
def g12_layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    layers, entry, top = layered(spark, sf_dir)
    return traversal.layered_search(asked(spark, sf_dir), v, layers, entry, top, ef=32)


@query(f"WITH RECURSIVE {T.layered(8)} SELECT CAST(level AS INTEGER) AS level, src, dst, CAST(pos AS INTEGER) AS pos FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, src, dst, pos FROM m{k}" for k in range(7)) + ")")
def x2_layered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every layer."""
    return layered(spark, sf_dir)[0].select("level", "src", "dst", "pos")


@query(f"WITH RECURSIVE {T.linked()}, {T.pool_search('s', 32)} {T.listed('s', 'next IS NULL')}")
def g14_pool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    g = spark.sparkContext.broadcast(traversal.load(v, e))
    return traversal.run_queries(asked(spark, sf_dir), lambda q: traversal.pool_search(g.value, q, entry, 32))


@query(f"WITH RECURSIVE {T.linked()}, {T.layer_search('s', 32, 'SELECT qid, CAST(entry AS BIGINT) AS node FROM dd, e', 'g')} {T.listed('s', 'NOT more')}")
def g15_two_queue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same graph with two queues, the candidates' without bound."""
    v, e, entry = linked(spark, sf_dir)
    g = spark.sparkContext.broadcast(traversal.load(v, e))
    return traversal.run_queries(asked(spark, sf_dir), lambda q: traversal.layer_search(g.value, q, entry, 32))


def _half(s: int) -> str:
    """The searched half s of the ids, as states s0 or s1."""
    among = f"({{}} * 2) // (SELECT count(*) FROM embeddings) = {s}"
    return f"{T.near(f'n{s}', 16, among)}, {T.with_reverse(f'r{s}', f'n{s}', 32)}, {T.adjacency(f'g{s}', f'r{s}')}, {T.medoid(f'e{s}', among)}, {T.search(f's{s}', 'p', f'g{s}', f'e{s}')}"


@query(f"WITH RECURSIVE {T.PAIRS}, {T.settings((32, 32, 1, 1))}, {_half(0)}, {_half(1)}, u AS ({T.listed('s0')} UNION ALL {T.listed('s1')}) SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS INTEGER) AS rank, node_id, dist FROM u QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) <= 32")
def g16_subgraph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two independent graphs over id ranges, their results merged."""
    v, parts = vectors(spark, sf_dir), []
    n = v.count()
    for s in range(2):
        own = v.where(F.floor(F.col("node_id") * 2 / n) == s)
        e = graph.with_reverse(graph.knn_graph(own, 16), 32)
        parts.append(traversal.search(asked(spark, sf_dir), own, e, graph.medoid(own).first().node_id, ef=32))
    return knn.merge(parts, 32).select("qid", "rank", "node_id", "dist")


@query(f"{_searched(16, 32, 1, 1)} SELECT qid, CAST(visited - len(scored) + unnest(range(0, len(scored))) AS INTEGER) AS step, cand AS cand_id, unnest(list_transform(scored, lambda x: x.id)) AS node_id, unnest(list_transform(scored, lambda x: x.d)) AS dist FROM s WHERE len(scored) > 0")
def g17_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    return traversal.search(asked(spark, sf_dir), v, e, entry, ef=16, output="trace")


@query(f"{_searched(64, 32, 2, 2)} SELECT qid, CAST(hops AS INTEGER) AS hops, CAST(visited AS INTEGER) AS visited FROM s WHERE {T.DONE}")
def g18_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e, entry = linked(spark, sf_dir)
    return traversal.search(asked(spark, sf_dir), v, e, entry, ef=64, mc=2, mg=2, output="stats")


@query(f"{_searched(64, 32, 2, 2)} SELECT round(avg(hops), 6) AS avg_hops, round(avg(visited), 6) AS avg_visited FROM s WHERE {T.DONE}")
def e7_average_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.average_counters(g18_counters(spark, sf_dir))
    return out.select(F.round("avg_hops", 6).alias("avg_hops"), F.round("avg_visited", 6).alias("avg_visited"))


@query(f"{_searched(16, 32, 1, 1)} SELECT qid, cand AS cand_id, CAST(len(scored) AS BIGINT) AS n, CAST(visited - len(scored) AS BIGINT) AS \"offset\" FROM s WHERE len(scored) > 0")
def e8_step_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each expanded candidate's neighbours begin among all that a search scored."""
    steps = g17_trace(spark, sf_dir).groupBy("qid", "cand_id").agg(F.min("step").alias("step"), F.count("*").alias("n"))
    return evaluation.step_offsets(steps, keep=("cand_id",)).select("qid", "cand_id", "n", "offset")


@query(f"WITH {V} SELECT node_id, " + ", ".join(f"CAST({sql_murmur2('node_id', s)} AS BIGINT) AS h{s}" for s in (1, 2, 3)) + " FROM v")
def b0_murmur2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("node_id", *[murmur2(F.col("node_id"), s).alias(f"h{s}") for s in (1, 2, 3)])


_BITS = f"b AS (SELECT node_id % 3 AS grp, node_id AS pos, (node_id * 37) % 211 AS key, unnest([{', '.join(f'CAST({sql_murmur2(chr(40) + 'node_id * 37) % 211', s)} AS BIGINT) % 256' for s in (1, 2, 3))}]) AS bit FROM v)"


@query(f'WITH {V}, {_BITS} SELECT grp AS "group", pos, key, max(pos = first) AS valid FROM (SELECT *, min(pos) OVER (PARTITION BY grp, bit) AS first FROM b) GROUP BY grp, pos, key')
def b2_check_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = vectors(spark, sf_dir).select(F.pmod("node_id", F.lit(3)).alias("group"), F.col("node_id").alias("pos"), F.pmod(F.col("node_id") * 37, F.lit(211)).alias("key"))
    return membership.check_and_insert(keys, 8)


@query(f"WITH {V}, k AS (SELECT node_id AS key, unnest([{', '.join(f'CAST({sql_murmur2('node_id', s)} AS BIGINT) % 4096' for s in (1, 2, 3))}]) AS bit FROM v), o AS (SELECT DISTINCT bit FROM k WHERE key < 100), c AS (SELECT key, sum(CASE WHEN bit IN (SELECT bit FROM o) THEN 1 ELSE 0 END) AS c FROM k WHERE key >= 100 GROUP BY key) SELECT count(*) AS n, CAST(sum(CASE WHEN c = 3 THEN 1 ELSE 0 END) AS BIGINT) AS positive FROM c")
def b6_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = vectors(spark, sf_dir).select(F.col("node_id").alias("key"))
    return membership.false_positives(keys.where("key < 100"), keys.where("key >= 100"), 12)


_TRUTH = f"gt AS ({knn_sql(L2, 10)}), r AS ({knn_sql(D.sql_l2('list_slice(q.embedding, 1, 32)', 'list_slice(v.embedding, 1, 32)'), 10)})"


def halved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Results by the first 32 dimensions, and the truth."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    return knn.knn(cut(q), cut(v), 10), knn.knn(q, v, 10)


@query(f"WITH {_TRUTH}, k AS (SELECT unnest([1, 5, 10]) AS k) SELECT CAST(k AS INTEGER) AS k, CAST(sum(CASE WHEN r.rank <= k THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(CAST(sum(CASE WHEN r.rank <= k THEN 1 ELSE 0 END) AS DOUBLE) / (count(DISTINCT gt.qid) * k), 9) AS recall FROM k JOIN gt ON gt.rank <= k LEFT JOIN r ON r.qid = gt.qid AND r.node_id = gt.node_id GROUP BY k")
def e1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_at(*halved(spark, sf_dir), [1, 5, 10]).withColumn("recall", F.round("recall", 9))


@query(f"WITH {_TRUTH}, i AS (SELECT unnest([1, 5, 10]) AS i) SELECT CAST(i AS INTEGER) AS i, round(avg(CASE WHEN r.rank <= i THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall FROM i JOIN gt ON gt.rank = 1 LEFT JOIN r ON r.qid = gt.qid AND r.node_id = gt.node_id GROUP BY i")
def e3_first_neighbour_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_neighbour_recall(*halved(spark, sf_dir), [1, 5, 10]).withColumn("recall", F.round("recall", 9))


@query(f"WITH {_TRUTH} SELECT CAST(sum(CASE WHEN r.dist = gt.dist THEN 1 ELSE 0 END) AS BIGINT) AS distance_match, CAST(sum(CASE WHEN r.dist = gt.dist AND r.node_id <> gt.node_id THEN 1 ELSE 0 END) AS BIGINT) AS id_mismatch FROM gt JOIN r ON r.qid = gt.qid WHERE gt.rank = 1 AND r.rank = 1")
def e6_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.tie_counts(*halved(spark, sf_dir))


@query(f"{_searched(16, 32, 1, 1)} SELECT qid, CAST(visited - len(scored) + unnest(range(0, len(scored))) AS BIGINT) AS step, unnest(list_transform(scored, lambda x: x.id)) AS node_id FROM s WHERE len(scored) > 0")
def e8_trace_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace as a flat file of node ids, in which -1 starts a query and -2 ends one, cut into queries again."""
    trace = g17_trace(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("qid")))
    place = F.col("qid") * 1_000_000 + F.col("step") + 1
    marks = trace.select("qid", "n").distinct().select(F.explode(F.array(F.struct((F.col("qid") * 1_000_000).alias("pos"), F.lit(-1).cast("long").alias("v")), F.struct((F.col("qid") * 1_000_000 + F.col("n") + 1).alias("pos"), F.lit(-2).cast("long").alias("v")))).alias("m"))
    flat = trace.select(place.alias("pos"), F.col("node_id").alias("v")).unionByName(marks.select("m.pos", "m.v")).withColumn("file", F.lit("a"))
    cut = evaluation.segments(flat)
    first = cut.groupBy("qid").agg(F.min("pos").alias("first"))
    return cut.join(first, "qid").select((F.col("qid") * 50).alias("qid"), (F.col("pos") - F.col("first")).alias("step"), F.col("v").alias("node_id"))


@query(knn_sql(L2))
def t1_micro_batch_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries arrive as files; every micro-batch is searched; the results are those of one batch."""
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    inbox, out, state = (scratch(spark, x) for x in ("inbox", "answers", "state"))
    q.select(F.col("qid").cast("long"), F.col("embedding").cast("array<float>")).repartition(4).write.parquet(inbox)
    serving.serve(serving.query_stream(spark, inbox, 2), lambda batch: knn.knn(batch, v, 10), out, state)
    return spark.read.parquet(out).select("qid", "rank", "node_id", "dist")


@query("SELECT vec_id AS qid, embedding[1] AS first, embedding[64] AS last FROM embeddings WHERE vec_id % 50 = 0")
def t2_decode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries as hex messages of little-endian floats; a negative id ends the stream."""
    sent = serving.encode_queries(asked(spark, sf_dir)).select("qid", F.substr(F.hex("payload"), F.lit(2 * serving.PACKET + 1)).alias("payload"))
    ended = sent.unionByName(spark.createDataFrame([(-1, "")], "qid long, payload string"))
    return serving.decode(ended).select("qid", F.col("embedding")[0].alias("first"), F.col("embedding")[63].alias("last"))


@query("SELECT vec_id AS qid, CAST(pos AS INTEGER) AS pos, embedding[pos + 1] AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS pos) WHERE vec_id % 50 = 0")
def s16_sent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries sent as packets and decoded; a batch of -1 at the end."""
    sent = serving.encode_queries(asked(spark, sf_dir))
    end = spark.createDataFrame([(-1, bytearray(b"\xff" * serving.PACKET))], "qid long, payload binary")
    return serving.decode_queries(sent.unionByName(end), 64).select("qid", F.posexplode("embedding").alias("pos", "x"))


@query(f"SELECT qid, rank, node_id, CAST(dist AS FLOAT) AS dist FROM ({knn_sql(L2, 10)})")
def s17_received_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A server between packets; its answers of 16 places hold 10 results."""
    v = vectors(spark, sf_dir)
    return serving.decode_results(serving.peer(serving.encode_queries(asked(spark, sf_dir)), 64, lambda q: knn.knn(q, v, 10), 16))


@query(f"SELECT qid, list(node_id ORDER BY rank) || [-1, -1] AS ids, list(dist ORDER BY rank) || [1e20::DOUBLE, 1e20::DOUBLE] AS dists FROM ({knn_sql(L2, 10)}) GROUP BY qid")
def s15_padded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as the arrays of 12 places that a result table holds."""
    return serving.padded(knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 10), 12)


@query("SELECT vec_id AS qid, CAST(i + 1 AS INTEGER) AS rank, i AS node_id, CAST(i AS FLOAT) AS dist FROM embeddings, (SELECT unnest(range(0, 20)) AS i) WHERE vec_id % 50 = 0")
def t3_simulated_peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peer that answers without searching, over the same packets."""
    sent = serving.encode_queries(asked(spark, sf_dir))
    return serving.decode_results(serving.peer(sent, 64, lambda q: serving.simulated(q, 20), 20))
