"""Queries on the parts of searches: predicates, joins, queues, splits, layers, lanes and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.hashing import bucket, murmur2, sql_murmur2
from ..operators import evaluation, graph, ivf, knn, traversal
from . import traversal_sql as T
from .analysis_queries import _ASSIGN, _MEAN, cells
from .registry import Q, V, asked, knn_sql, query, vectors
from .search_queries import _TRUTH, KNN16, L2, halved, layered, near16

LEVEL = f"CAST(floor(-ln((CAST({sql_murmur2('node_id', 1)} AS DOUBLE) + 1.0) / 4294967296.0) / ln(16)) AS INTEGER)"


def lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, neighbors, count: padded neighbour lists of which the first count are valid."""
    full = near16(spark, sf_dir).groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("neighbors"))
    return full.withColumn("count", (F.pmod("src", F.lit(16)) + 1).cast("int"))


@query(f"WITH {KNN16} SELECT src, dst FROM e WHERE pos < src % 16 + 1")
def p1_valid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists(spark, sf_dir).select("src", F.explode(F.slice("neighbors", 1, F.col("count"))).alias("dst"))


@query(f"WITH {KNN16} SELECT dst, min(src) AS first FROM e GROUP BY dst")
def p2_first_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nodes that are met several times only the first visit counts."""
    w = Window.partitionBy("dst").orderBy("src")
    rows = near16(spark, sf_dir).withColumn("n", F.row_number().over(w))
    return rows.where("n = 1").select("dst", F.col("src").alias("first"))


@query(f"WITH {KNN16}, t AS (SELECT src, max(dist) AS worst FROM e WHERE pos < 8 GROUP BY src) SELECT e.src, count(*) AS n FROM e JOIN t USING (src) WHERE dist <= worst AND dist < 1e20 GROUP BY e.src")
def p5_expandable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates no farther than the worst of a result of 8, which is itself expandable."""
    e = near16(spark, sf_dir)
    worst = e.where("pos < 8").groupBy("src").agg(F.max("dist").alias("worst"))
    return e.join(worst, "src").where("dist <= worst and dist < 1e20").groupBy("src").agg(F.count("*").alias("n"))


@query(f"WITH {V}, l AS (SELECT {LEVEL} AS level FROM v) SELECT CASE WHEN level = 0 THEN 'base' ELSE 'upper' END AS part, count(*) AS n FROM l GROUP BY 1")
def p6_level_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = graph.levels(vectors(spark, sf_dir), 16)
    return own.groupBy(F.when(F.col("level") == 0, "base").otherwise("upper").alias("part")).agg(F.count("*").alias("n"))


@query(f"WITH {V}, l AS (SELECT {LEVEL} AS level FROM v), x AS (SELECT unnest(range(0, 8)) AS layer) SELECT CAST(layer AS INTEGER) AS layer, count(*) AS n FROM x JOIN l ON level >= layer GROUP BY layer")
def x2_layer_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each layer of a layered graph: those whose level reaches it."""
    own = graph.levels(vectors(spark, sf_dir), 16)
    at = F.broadcast(spark.range(8).select(F.col("id").cast("int").alias("layer")))
    return own.join(at, F.col("level") >= F.col("layer")).groupBy("layer").agg(F.count("*").alias("n"))


@query(f"WITH {KNN16} SELECT src % 4 AS channel, src // 4 AS at, dst FROM e")
def j2_sharded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by channel and place there: the low bits and the rest of the id."""
    e = near16(spark, sf_dir)
    return e.select(F.col("src").bitwiseAND(F.lit(3).cast("long")).alias("channel"), F.shiftright("src", 2).alias("at"), "dst")


@query(f"WITH {KNN16}, {Q}, {V} SELECT src AS qid, dst AS node_id, {L2} AS dist FROM e JOIN q ON q.qid = e.src JOIN v ON v.node_id = e.dst")
def j3_neighbour_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a frontier with their vectors, scored."""
    q = asked(spark, sf_dir).select("qid", F.col("embedding").alias("q"))
    near = near16(spark, sf_dir).join(F.broadcast(q), F.col("src") == F.col("qid")).select("qid", "q", F.col("dst").alias("node_id"))
    return near.join(vectors(spark, sf_dir), "node_id").select("qid", "node_id", D.squared_l2(F.col("q"), F.col("embedding")).alias("dist"))


@query(f"WITH {_TRUTH} SELECT r.qid, r.node_id FROM r WHERE EXISTS (SELECT 1 FROM gt WHERE gt.qid = r.qid AND gt.node_id = r.node_id)")
def j6_true_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, truth = halved(spark, sf_dir)
    return got.join(truth, ["qid", "node_id"], "left_semi").select("qid", "node_id")


@query(f"WITH {Q}, {V} SELECT qid, {L2} AS dist FROM q, v WHERE node_id = 0")
def d9_entry_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.pairs(asked(spark, sf_dir), vectors(spark, sf_dir).where("node_id = 0")).select("qid", "dist")


@query(f"WITH t AS ({knn_sql(L2, 64)}) SELECT qid, CASE WHEN count(*) < 64 THEN 1e20::DOUBLE ELSE max(dist) END AS threshold FROM t GROUP BY qid")
def k6_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 64).groupBy("qid").agg(F.count("*").alias("n"), F.max("dist").alias("worst"))
    return rows.select("qid", F.when(F.col("n") < 64, F.lit(traversal.NONE)).otherwise(F.col("worst")).alias("threshold"))


_COARSER = "list_transform({}.embedding, lambda e: CAST(round(e * 4) AS BIGINT))"


@query(knn_sql(f"CAST({D.sql_fold(_COARSER.format('q'), _COARSER.format('v'), '(x - y) * (x - y)')} AS BIGINT)", 20))
def k8_ties_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coarse integers, of which many are equally far: the smallest ids are kept."""
    whole = lambda c: F.transform(c, lambda e: F.round(e * 4).cast("long"))
    q, v = asked(spark, sf_dir).select("qid", whole("embedding").alias("q")), vectors(spark, sf_dir).select("node_id", whole("embedding").alias("v"))
    rows = v.crossJoin(F.broadcast(q)).where("qid <> node_id").select("qid", "node_id", D.squared_l2_int(F.col("q"), F.col("v")).alias("dist"))
    return knn.top_k(rows, 20).select("qid", "rank", "node_id", "dist")


@query(f"SELECT qid // 8 AS batch_id, qid, rank, node_id FROM ({knn_sql(L2, 5)})")
def k17_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn.knn(asked(spark, sf_dir), vectors(spark, sf_dir), 5)
    return found.select(F.floor(F.col("qid") / 8).alias("batch_id"), "qid", "rank", "node_id")


@query("SELECT (vec_id // 50) % 6 AS channel, count(*) AS n FROM embeddings WHERE vec_id % 50 = 0 GROUP BY 1")
def g5_split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round robin over six channels: the first n % 6 get one more."""
    return asked(spark, sf_dir).groupBy(F.pmod(F.floor(F.col("qid") / 50), F.lit(6)).alias("channel")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {T.layered(8)}, u AS (" + " UNION ALL ".join(f"SELECT {k} AS level, src, dst FROM m{k}" for k in range(1, 7)) + ") SELECT CAST(level AS INTEGER) AS level, src, dst, d AS dist FROM u JOIN pr ON a = src AND b = dst")
def g11_upper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the upper layers, by a join on level and source, with their distances."""
    v = vectors(spark, sf_dir)
    up = layered(spark, sf_dir)[0].where("level > 0").select("level", "src", "dst")
    at = graph.levels(v, 8).where("level > 0").select(F.col("node_id").alias("src"), F.explode(F.sequence(F.lit(1), "level")).alias("level"))
    here, there = v.select(F.col("node_id").alias("src"), F.col("embedding").alias("x")), v.select(F.col("node_id").alias("dst"), F.col("embedding").alias("y"))
    return at.join(up, ["level", "src"]).join(here, "src").join(there, "dst").select("level", "src", "dst", D.squared_l2(F.col("x"), F.col("y")).alias("dist"))


@query(f"WITH RECURSIVE {T.layered(8)}, {T.descent('t')} SELECT qid, CAST(1 AS INTEGER) AS rank, node AS node_id, dd[node + 1] AS dist FROM t JOIN dd USING (qid) WHERE lev = 0")
def g10_greedy_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the descent through the upper layers ends for each query."""
    v = vectors(spark, sf_dir)
    layers, entry, top = layered(spark, sf_dir)
    held = spark.sparkContext.broadcast({lv: traversal.load(v, layers.where(F.col("level") == lv)) for lv in range(1, top + 1)})

    def one(q):
        node = traversal.greedy_descent(held.value, q, entry)
        g = next(iter(held.value.values()))
        return traversal.Found([(float(traversal.distances(g, [g.at(node)], q)[0]), node)], 0, 0, [])

    return traversal.run_queries(asked(spark, sf_dir), one)


@query("SELECT vec_id AS node_id, embedding[1] AS first FROM embeddings WHERE label = 3")
def x9_lookup_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("label = 3").select("node_id", F.col("embedding")[0].alias("first"))


@query(f"WITH {_TRUTH.replace(', 10)', ', 100)')} SELECT CAST(sum(CASE WHEN r.node_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(avg(CASE WHEN r.node_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall FROM gt LEFT JOIN r ON r.qid = gt.qid AND r.node_id = gt.node_id".replace("r <= 10", "r <= 100"))
def e5_recall_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, v = asked(spark, sf_dir), vectors(spark, sf_dir)
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    return evaluation.recall_at(knn.knn(cut(q), cut(v), 100), knn.knn(q, v, 100), [100]).select("hits", F.round("recall", 9).alias("recall"))


@query(f"WITH {V}, {_MEAN}, {_ASSIGN}, n AS (SELECT cell_id, count(*) AS n FROM a GROUP BY cell_id) SELECT cell_id, n, CAST(coalesce(sum(n) OVER (ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n")
def v7_cell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each cell and where they would start; a row for each cell, of which there are few."""
    n = ivf.assign(vectors(spark, sf_dir), cells(spark, sf_dir)).groupBy("cell_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query("SELECT vec_id AS qid, CAST(p AS INTEGER) AS part, embedding[p * 8 + 1] AS first, embedding[p * 8 + 8] AS last FROM embeddings, (SELECT unnest(range(0, 8)) AS p) WHERE vec_id % 50 = 0")
def v10_sub_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ivf.sub_vectors(asked(spark, sf_dir), "qid", "embedding", 8, 64)
    return rows.select("qid", "part", F.col("sub")[0].alias("first"), F.element_at("sub", -1).alias("last"))


@query(f"WITH {V}, {_MEAN}, {_ASSIGN}, o AS (SELECT cell_id, node_id, row_number() OVER (PARTITION BY cell_id ORDER BY node_id) - 1 AS o FROM a) SELECT cell_id, o % 2 AS queue, count(*) AS n FROM o GROUP BY 1, 2")
def v14_alternate_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a cell dealt to two queues in turn."""
    w = Window.partitionBy("cell_id").orderBy("node_id")
    rows = ivf.assign(vectors(spark, sf_dir), cells(spark, sf_dir)).select("cell_id", (F.row_number().over(w) - 1).cast("long").alias("o"))
    return rows.groupBy("cell_id", F.pmod("o", F.lit(2)).alias("queue")).agg(F.count("*").alias("n"))


@query(f"WITH {V}, {_MEAN}, {_ASSIGN}, o AS (SELECT cell_id, node_id, row_number() OVER (PARTITION BY cell_id ORDER BY node_id) - 1 AS place FROM a) SELECT cell_id, place, node_id FROM o WHERE place < 3")
def v15_ids_of_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in cells turned to ids after the selection."""
    w = Window.partitionBy("cell_id").orderBy("node_id")
    places = ivf.assign(vectors(spark, sf_dir), cells(spark, sf_dir)).select("cell_id", "node_id", (F.row_number().over(w) - 1).cast("long").alias("place"))
    chosen = places.where("place < 3").select("cell_id", "place")
    return chosen.join(places, ["cell_id", "place"]).select("cell_id", "place", "node_id")


@query(f"WITH {V} SELECT CAST({sql_murmur2('node_id', 7)} AS BIGINT) % 512 AS bucket, count(*) AS n FROM v GROUP BY 1")
def b3_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bucket(murmur2(F.col("node_id"), 7), 9)
    return vectors(spark, sf_dir).groupBy(h.alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT vec_id % 3 AS part, vec_id AS node_id FROM embeddings")
def c_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three sessions hold, together."""
    v = graph.shard(vectors(spark, sf_dir), 3)
    part = lambda r: v.where(F.col("shard_id") == r).select(F.col("shard_id").alias("part"), "node_id")
    return part(0).unionByName(part(1)).unionByName(part(2))
