"""Queries on inverted files, product quantization, experiment tables, logs and file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import analytics as A
from ..operators import ivf
from ..session import scratch
from ..sources import binary, logs
from .registry import Q, V, asked, query, vectors

_MEAN = "c AS (SELECT cell_id, list(m ORDER BY pos) AS centroid FROM (SELECT label AS cell_id, pos, round(avg(CAST(embedding[pos] AS DOUBLE)), 6) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY cell_id)"
_COARSE = f"p AS (SELECT qid, cell_id, r FROM (SELECT qid, cell_id, row_number() OVER (PARTITION BY qid ORDER BY {D.sql_l2('q.embedding', 'c.centroid')}, cell_id) AS r FROM q, c) WHERE r <= 3)"
_ASSIGN = f"a AS (SELECT node_id, embedding, cell_id FROM (SELECT node_id, embedding, cell_id, row_number() OVER (PARTITION BY node_id ORDER BY {D.sql_l2('v.embedding', 'c.centroid')}, cell_id) AS r FROM v, c) WHERE r = 1)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-label centroids, rounded so that the order of the averages' sums doesn't show."""
    return ivf.label_centroids(vectors(spark, sf_dir)).withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


@query(f"WITH {Q}, {_MEAN}, {_COARSE} SELECT qid, CAST(r AS INTEGER) AS rank, cell_id FROM p")
def v1_coarse_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.coarse(asked(spark, sf_dir), cells(spark, sf_dir), 3).select("qid", "rank", "cell_id")


@query(f"WITH {V}, {_MEAN}, {_ASSIGN} SELECT cell_id, count(*) AS n FROM a GROUP BY cell_id")
def x16_assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.assign(vectors(spark, sf_dir), cells(spark, sf_dir)).groupBy("cell_id").agg(F.count("*").alias("n"))


_PROBED = f"t AS (SELECT qid, node_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS r FROM (SELECT q.qid, a.node_id, {D.sql_l2('q.embedding', 'a.embedding')} AS dist FROM p JOIN q ON q.qid = p.qid JOIN a ON a.cell_id = p.cell_id WHERE q.qid <> a.node_id))"


@query(f"WITH {Q}, {V}, {_MEAN}, {_COARSE}, {_ASSIGN}, {_PROBED} SELECT qid, CAST(r AS INTEGER) AS rank, node_id, dist FROM t WHERE r <= 10")
def v2_inverted_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return ivf.search(asked(spark, sf_dir), ivf.assign(vectors(spark, sf_dir), c), c, 3, 10)


@query(f"WITH {Q}, {V}, {_MEAN}, {_COARSE}, {_ASSIGN}, n AS (SELECT cell_id, count(*) AS n FROM a GROUP BY cell_id) SELECT qid, CAST(sum(n) AS BIGINT) AS entries, CAST(sum(CAST(ceil(n / 8.0) AS BIGINT)) AS BIGINT) AS iterations FROM p JOIN n USING (cell_id) GROUP BY qid")
def v8_cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a query's probes scan, and passes of 8 lanes."""
    c = cells(spark, sf_dir)
    n = ivf.assign(vectors(spark, sf_dir), c).groupBy("cell_id").agg(F.count("*").alias("n"))
    return ivf.coarse(asked(spark, sf_dir), c, 3).join(n, "cell_id").groupBy("qid").agg(F.sum("n").alias("entries"), F.sum(F.ceil(F.col("n") / 8.0)).alias("iterations"))


_SUB = "SELECT {key}, unnest(range(0, 8)) AS part, unnest(list_transform(range(0, 8), lambda i: list_slice({col}, i * 8 + 1, i * 8 + 8))) AS sub FROM {rows}"
_BOOK = "w AS (SELECT node_id AS code, part, sub AS word FROM (" + _SUB.format(key="node_id", col="embedding", rows="v") + ") WHERE node_id < 16)"
_CODES = "s AS (" + _SUB.format(key="node_id", col="embedding", rows="v") + f"), k AS (SELECT node_id, part, code FROM (SELECT s.node_id, s.part, w.code, row_number() OVER (PARTITION BY s.node_id, s.part ORDER BY {D.sql_l2('s.sub', 'w.word')}, w.code) AS r FROM s JOIN w USING (part)) WHERE r = 1)"
_LUT = "u AS (" + _SUB.format(key="qid", col="embedding", rows="q") + f"), l AS (SELECT u.qid, u.part, w.code, {D.sql_l2('u.sub', 'w.word')} AS d FROM u JOIN w USING (part))"


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.sampled_codebook(vectors(spark, sf_dir), 8, 64, 16)


@query(f"WITH {V}, {_BOOK}, {_CODES} SELECT node_id, CAST(part AS INTEGER) AS part, CAST(code AS INTEGER) AS code FROM k")
def v9_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.encode(vectors(spark, sf_dir), book(spark, sf_dir), 8, 64).select("node_id", F.posexplode("code").alias("part", "code"))


@query(f"WITH {V}, {Q}, {_BOOK}, {_LUT} SELECT qid, CAST(part AS INTEGER) AS part, CAST(code AS INTEGER) AS code, d FROM l")
def v11_lookup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.lookup_tables(asked(spark, sf_dir), book(spark, sf_dir), 8, 64).select("qid", "part", F.posexplode("lut").alias("code", "d"))


_ADC = "z AS (SELECT l.qid, k.node_id, list_sum(list(l.d ORDER BY l.part)) AS dist FROM k JOIN l ON l.part = k.part AND l.code = k.code GROUP BY l.qid, k.node_id)"


@query(f"WITH {V}, {Q}, {_BOOK}, {_CODES}, {_LUT}, {_ADC} SELECT qid, CAST(r AS INTEGER) AS rank, node_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS r FROM z) WHERE r <= 100")
def v16_asymmetric_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, v = book(spark, sf_dir), vectors(spark, sf_dir)
    return ivf.adc_search(asked(spark, sf_dir), ivf.encode(v, b, 8, 64), b, 8, 64, 100)


@query(f"WITH {V}, {Q}, {_BOOK}, {_CODES}, {_LUT}, {_ADC}, y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, node_id % 8 ORDER BY dist, node_id) AS x FROM z) WHERE x <= 5) SELECT qid, CAST(r AS INTEGER) AS rank, node_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, node_id) AS r FROM y) WHERE r <= 20")
def v13_truncated_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate mode: five rows a lane."""
    b, v = book(spark, sf_dir), vectors(spark, sf_dir)
    return ivf.adc_search(asked(spark, sf_dir), ivf.encode(v, b, 8, 64), b, 8, 64, 20, lanes=8, lane_k=5)


RUNS = "e AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, {t}::DOUBLE, {r1}::DOUBLE, {r10}::DOUBLE, {h}::DOUBLE, {v}::DOUBLE)" for a, b, t, r1, r10, h, v in A.RECORDED) + ") x(mc, mg, time_ms, recall_1, recall_10, avg_hops, avg_visited))"


@query("SELECT CAST(ef AS INTEGER) AS ef, CAST(mc AS INTEGER) AS mc, CAST(mg AS INTEGER) AS mg FROM (SELECT unnest(range(1, 129)) AS ef), (SELECT unnest(range(1, 5)) AS mc), (SELECT unnest(range(1, 4)) AS mg) WHERE ef & (ef - 1) = 0")
def a1_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.sweep(spark, range(1, 129), [1, 2, 3, 4], [1, 2, 3])


@query(f"WITH {RUNS}, b AS (SELECT unnest([1, 16, 64, 3000]) AS batch) SELECT mc, mg, CAST(batch AS INTEGER) AS batch, round(time_ms / ceil(10000 / batch::DOUBLE), 6) AS per_batch FROM e, b")
def a2_batch_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.broadcast(spark.createDataFrame([(1,), (16,), (64,), (3000,)], "batch int"))
    return A.experiments(spark).crossJoin(b).select("mc", "mg", "batch", F.round(A.batch_latency(F.col("time_ms"), 10_000, F.col("batch")), 6).alias("per_batch"))


@query(f"WITH {RUNS}, b AS (SELECT mc, mg FROM e ORDER BY time_ms, mc, mg LIMIT 1), s AS (SELECT unnest([1, 2, 4, 8, 16]) AS batch) SELECT DISTINCT mc, mg, CAST(batch AS INTEGER) AS batch FROM (SELECT * FROM b UNION ALL SELECT 1, 1), s")
def a3_best_then_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = A.best(A.experiments(spark), []).select("mc", "mg").unionByName(spark.createDataFrame([(1, 1)], "mc int, mg int"))
    return best.crossJoin(F.broadcast(spark.createDataFrame([(1,), (2,), (4,), (8,), (16,)], "batch int"))).distinct()


@query(f"WITH {RUNS} SELECT mc, mg, round(10000 * 1000.0::DOUBLE / time_ms, 6) AS qps FROM e")
def a4_qps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.experiments(spark).select("mc", "mg", F.round(A.qps(F.col("time_ms")), 6).alias("qps"))


@query(f"WITH {RUNS} SELECT mc, mg, time_ms FROM (SELECT *, row_number() OVER (PARTITION BY mc ORDER BY time_ms, mg) AS r FROM e) WHERE r = 1")
def k15_best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best(A.experiments(spark), ["mc"]).select("mc", "mg", "time_ms")


_LAT = "SELECT vec_id % 7 AS system, list(abs(CAST(embedding[1] AS DOUBLE)) * 1000 ORDER BY vec_id) AS xs FROM embeddings GROUP BY 1"


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, xs: arrays of numbers that stand for latencies."""
    x = F.abs(F.col("embedding")[0].cast("double")) * 1000
    rows = vectors(spark, sf_dir).select(F.pmod("node_id", F.lit(7)).alias("system"), F.struct("node_id", x.alias("x")).alias("s"))
    return rows.groupBy("system").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("xs"))


@query(f"WITH l AS ({_LAT}), t AS (SELECT system, unnest(xs) AS x FROM l) SELECT system, min(x) AS min_ms, max(x) AS max_ms, round(avg(x), 6) AS avg_ms, list_sort(list(x))[len(list(x)) // 2 + 1] AS upper_median, round(quantile_cont(x, 0.5::DOUBLE), 6) AS median, round(quantile_cont(x, 0.95::DOUBLE), 6) AS p95 FROM t GROUP BY system")
def a6_latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.latency_summary(latencies(spark, sf_dir), ["system"], "xs")
    return out.select("system", "min_ms", "max_ms", F.round("avg_ms", 6).alias("avg_ms"), "upper_median", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query(f"WITH l AS ({_LAT}) SELECT system, len(xs) - 2 AS n, xs[2] AS first, xs[len(xs) - 1] AS last FROM l")
def a7_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latencies(spark, sf_dir).withColumn("t", A.trimmed(F.col("xs")))
    return rows.select("system", F.size("t").cast("long").alias("n"), F.col("t")[0].alias("first"), F.element_at("t", -1).alias("last"))


@query(f"WITH l AS ({_LAT}), n AS (SELECT avg(x) AS net FROM (SELECT unnest(xs) AS x FROM l WHERE system = 0)) SELECT system, round(sum(x + net), 3) AS total, count(*) AS n FROM (SELECT system, unnest(xs) AS x FROM l), n GROUP BY system")
def a8_network_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with the mean of another system added."""
    rows = latencies(spark, sf_dir).select("system", F.explode("xs").alias("x"))
    net = rows.where("system = 0").agg(F.avg("x").alias("net"))
    return rows.crossJoin(F.broadcast(net)).groupBy("system").agg(F.round(F.sum(F.col("x") + F.col("net")), 3).alias("total"), F.count("*").alias("n"))


@query(f"WITH l AS ({_LAT}) SELECT CAST(system AS VARCHAR) AS label, unnest(xs) AS data, 'a' AS category FROM l UNION ALL SELECT CAST(system AS VARCHAR), unnest(xs) * 2, 'b' FROM l")
def a9_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = latencies(spark, sf_dir).select(F.col("system").cast("string").alias("label"), F.explode("xs").alias("data"))
    return one.withColumn("category", F.lit("a")).unionByName(one.select("label", (F.col("data") * 2).alias("data"), F.lit("b").alias("category")))


_SPEED = f"WITH {RUNS}, s AS (SELECT e.*, b.time_ms / e.time_ms AS speedup, e.avg_hops / b.avg_hops AS norm_hops FROM e, (SELECT * FROM e WHERE mc = 1 AND mg = 1) b)"


@query(_SPEED + " SELECT mc, mg, round(speedup, 9) AS speedup, round(norm_hops, 9) AS norm_hops, round(norm_hops * speedup, 9) AS utilization FROM s")
def j9_speedup_over_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.speedups(A.experiments(spark)).select("mc", "mg", *[F.round(c, 9).alias(c) for c in ("speedup", "norm_hops", "utilization")])


@query(_SPEED + " SELECT mc, " + ", ".join(f"round(max(CASE WHEN mg = {g} THEN speedup END), 9) AS mg{g}" for g in range(1, 7)) + " FROM s GROUP BY mc")
def a10_speedup_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = A.speedup_matrix(A.experiments(spark), list(range(1, 7)))
    return wide.select("mc", *[F.round(f"mg{g}", 9).alias(f"mg{g}") for g in range(1, 7)])


@query(_SPEED + " SELECT round(min(speedup), 9) AS low, round(max(speedup), 9) AS high FROM (SELECT mc, max(speedup) AS speedup FROM s GROUP BY mc)")
def a11_speedup_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = A.speedups(A.experiments(spark)).groupBy("mc").agg(F.max("speedup").alias("speedup"))
    return A.range_of(top, "speedup").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"WITH {RUNS} SELECT a.mc, round(a.time_ms / b.time_ms, 9) AS ratio FROM e a JOIN e b USING (mc) WHERE a.mg = 1 AND b.mg = 4")
def a12_scalability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of the times with one and four units, per configuration."""
    e = A.experiments(spark).select("mc", "mg", "time_ms")
    one, four = e.where("mg = 1").select("mc", F.col("time_ms").alias("t1")), e.where("mg = 4").select("mc", F.col("time_ms").alias("t4"))
    return one.join(four, "mc").select("mc", F.round(F.col("t1") / F.col("t4"), 9).alias("ratio"))


# Memory bandwidth of systems, GB/s.
BANDWIDTH = [("cpu", 240.0), ("gpu", 900.0), ("accelerator", 77.0)]


@query(f"WITH {RUNS}, w AS (SELECT * FROM (VALUES {', '.join(f'({chr(39)}{s}{chr(39)}, {b}::DOUBLE)' for s, b in BANDWIDTH)}) x(system, gbs)) SELECT system, mc, mg, round(10000000.0::DOUBLE / time_ms / gbs, 6) AS qps_per_gbs FROM e, w")
def a13_bandwidth_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.broadcast(spark.createDataFrame(BANDWIDTH, "system string, gbs double"))
    return A.experiments(spark).crossJoin(w).select("system", "mc", "mg", F.round(A.qps(F.col("time_ms")) / F.col("gbs"), 6).alias("qps_per_gbs"))


@query(f"WITH {RUNS} SELECT mc, min(mg) FILTER (recall_10 > 0.984) AS ef, min_by(avg_visited, mg) FILTER (recall_10 > 0.984) AS work FROM e GROUP BY mc")
def a14_work_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.experiments(spark).select("mc", F.col("mg").alias("ef"), F.col("recall_10").alias("recall"), F.col("avg_visited").alias("work"))
    return A.work_at_recall(rows, ["mc"], 0.984)


# Mean power (W) by engine, dataset and batch size.
POWER = [("faiss", "SIFT10M", 1, 75.56), ("faiss", "SIFT10M", 16, 129.99), ("faiss", "SIFT10M", 10000, 105.22), ("hnsw", "SIFT10M", 1, 66.95), ("hnsw", "SIFT10M", 16, 105.88), ("hnsw", "SIFT10M", 10000, 109.46)]
# Latencies to join them with; invented.
LATENCY = [("faiss", "SIFT10M", 1, 4.5), ("faiss", "SIFT10M", 16, 9.25), ("faiss", "SIFT10M", 32, 12.5), ("faiss", "SIFT10M", 10000, 1.0), ("hnsw", "SIFT10M", 1, 0.5), ("hnsw", "SIFT10M", 16, 2.5), ("hnsw", "SIFT10M", 10000, 700.0)]
_rows = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) for x in r) + ")" for r in rows)
_PL = f"pw AS (SELECT * FROM (VALUES {_rows(POWER)}) x(engine, dataset, batch_size, watts)), la AS (SELECT * FROM (VALUES {_rows(LATENCY)}) x(engine, dataset, batch_size, latency_ms))"


def power_and_latency(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(POWER, "engine string, dataset string, batch_size int, watts double"), spark.createDataFrame(LATENCY, "engine string, dataset string, batch_size int, latency_ms double")


@query(f"WITH {_PL} SELECT engine, dataset, batch_size, round(watts * latency_ms, 6) AS mj FROM pw JOIN la USING (engine, dataset, batch_size)")
def j12_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = power_and_latency(spark)
    return A.energy(p, t, ["engine", "dataset", "batch_size"]).withColumn("mj", F.round("mj", 6))


@query(f"WITH {_PL}, m AS (SELECT engine, batch_size, watts * latency_ms AS mj FROM pw JOIN la USING (engine, dataset, batch_size)) SELECT batch_size, round(min(mj), 6) AS best, round(max(mj) / min(mj), 6) AS ratio FROM m GROUP BY batch_size")
def a15_best_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = power_and_latency(spark)
    return A.energy(p, t, ["engine", "batch_size"]).groupBy("batch_size").agg(F.round(F.min("mj"), 6).alias("best"), F.round(F.max("mj") / F.min("mj"), 6).alias("ratio"))


@query(f"WITH {_PL} SELECT l.engine, l.batch_size, CASE WHEN l.batch_size > 32 AND z.latency_ms IS NOT NULL THEN z.latency_ms * l.batch_size / 32.0::DOUBLE ELSE l.latency_ms END AS latency_ms FROM la l LEFT JOIN la z ON z.engine = l.engine AND z.batch_size = 32")
def a20_extrapolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extrapolated(power_and_latency(spark)[1].drop("dataset"), ["engine"])


@query(f"WITH {RUNS} SELECT mc, mg, avg_visited * 6 AS check_cycles, avg_visited * 8.0::DOUBLE AS distance_cycles, avg_visited + avg_hops * 64 AS queue_cycles FROM e")
def a16_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.utilization(A.experiments(spark), 128).select("mc", "mg", "check_cycles", "distance_cycles", "queue_cycles")


@query(f"WITH {RUNS} SELECT mc, mg, round(coalesce(avg_hops / nullif(sum(avg_hops) OVER (PARTITION BY mc), 0), 0), 9) AS share FROM e")
def a17_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.experiments(spark)
    total = e.groupBy("mc").agg(F.sum("avg_hops").alias("t"))
    return e.join(total, "mc").select("mc", "mg", F.round(A.share_of(F.col("avg_hops"), F.col("t")), 9).alias("share"))


# Inference latency in ms by model and batch size.
INFERENCE = [("small", 1, 0.1892), ("small", 10000, 2.381), ("large", 1, 0.3774), ("large", 10000, 21.811)]
_INF = f"i AS (SELECT * FROM (VALUES {_rows(INFERENCE)}) x(model, batch_size, ms))"


@query(f"WITH {_PL}, {_INF} SELECT model, engine, batch_size, batch_size * 10 AS rerank, round(latency_ms / (latency_ms + ms), 9) AS retrieval_share FROM i JOIN la USING (batch_size)")
def a18_retrieval_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = spark.createDataFrame(INFERENCE, "model string, batch_size int, ms double"), power_and_latency(spark)[1]
    rows = i.join(t, "batch_size").withColumn("retrieval_share", F.round(A.share_of(F.col("latency_ms"), F.col("latency_ms") + F.col("ms")), 9))
    return rows.select("model", "engine", "batch_size", (F.col("batch_size") * 10).alias("rerank"), "retrieval_share")


@query(f"WITH {_PL}, {_INF} SELECT model, engine, batch_size, round(latency_ms + ms, 6) AS end_to_end FROM i JOIN la USING (batch_size)")
def a19_prefill_with_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, t = spark.createDataFrame(INFERENCE, "model string, batch_size int, ms double"), power_and_latency(spark)[1]
    return i.join(t, "batch_size").select("model", "engine", "batch_size", F.round(F.col("latency_ms") + F.col("ms"), 6).alias("end_to_end"))


@query(f"WITH {RUNS} SELECT mc AS config, CAST(min(CASE WHEN recall_10 >= 0.984 THEN mg END) AS INTEGER) AS nprobe FROM e GROUP BY mc")
def j10_least_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.experiments(spark).select(F.col("mc").alias("config"), F.col("mg").alias("nprobe"), F.col("recall_10").alias("recall"))
    return ivf.least_nprobe(rows, 0.984)


@query(f"WITH {RUNS} SELECT mc, mg FROM e WHERE mc = 2 AND mg = 3")
def p9_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.experiments(spark).where((F.col("mc") == 2) & (F.col("mg") == 3)).select("mc", "mg")


@query(f"WITH {RUNS} SELECT mc, mg, recall_10 FROM e WHERE recall_10 > 0.981 AND recall_10 < 0.985 AND avg_visited > 2000 AND avg_visited < 3000")
def p10_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.experiments(spark).where("recall_10 > 0.981 and recall_10 < 0.985 and avg_visited > 2000 and avg_visited < 3000").select("mc", "mg", "recall_10")


@query(f"WITH {RUNS} SELECT CASE mc WHEN 1 THEN 'single' ELSE 'multi' END AS kind, mg FROM e")
def p13_renamed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("mc") == 1, "single").otherwise("multi")
    return A.experiments(spark).select(kind.alias("kind"), "mg")


@query("SELECT CAST(pos AS INTEGER) AS pos, round(sum(x), 6) AS total FROM (SELECT unnest(range(0, 64)) AS pos, unnest(list_transform(embedding, lambda e: CAST(e AS DOUBLE))) AS x FROM embeddings) GROUP BY pos")
def c_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("embedding").cast("array<double>").alias("x"))
    return A.reduce_sum(rows, "x").withColumn("total", F.round("total", 6))


@query("WITH t AS (SELECT sum(CAST(embedding[1] AS DOUBLE)) AS first FROM embeddings) SELECT vec_id AS node_id, round(first, 6) AS first FROM embeddings, t")
def c_all_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("node_id", F.col("embedding").cast("array<double>").alias("x"))
    return A.all_reduce(rows, "x").select("node_id", F.round(F.col("total")[0], 6).alias("first"))


_LOG = "l AS (SELECT 'log' AS file, vec_id AS line_no, CASE vec_id % 3 WHEN 0 THEN 'kernel time: ' || vec_id || '.25 ms' WHEN 1 THEN 'recall@10 = 0.' || vec_id ELSE 'note' END AS value FROM embeddings)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("kernel time: "), n, F.lit(".25 ms"))).when(n % 3 == 1, F.concat(F.lit("recall@10 = 0."), n)).otherwise("note")
    return vectors(spark, sf_dir).select(F.lit("log").alias("file"), n.alias("line_no"), text.alias("value"))


@query(f"WITH {_LOG} SELECT file, line_no, CAST(regexp_extract(value, 'kernel time: *(-?[0-9]+[.]?[0-9]*)', 1) AS DOUBLE) AS x FROM l WHERE contains(value, 'kernel time')")
def s20_scrape_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.scrape(log_lines(spark, sf_dir), "kernel time")


@query("SELECT 'w' AS file, round(avg((vec_id % 50) + 60 + 3.5), 6) AS watts FROM embeddings")
def s21_turbostat(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(" ", F.lit("0 1"), F.pmod("node_id", F.lit(50)) + 60, F.lit("3.5 0.1 0.2"))
    text = vectors(spark, sf_dir).select(F.lit("w").alias("file"), F.col("node_id").alias("line_no"), line.alias("value"))
    head = spark.createDataFrame([("w", -1, "Core CPU PkgWatt RAMWatt PKG RAM")], "file string, line_no long, value string")
    return logs.turbostat_watts(head.unionByName(text)).withColumn("watts", F.round("watts", 6))


@query("SELECT 'g' AS file, round(avg(100 + vec_id), 6) AS watts FROM embeddings WHERE vec_id % 4 = 1")
def s22_gpu_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("node_id")
    text = F.when(n % 4 == 0, F.lit("| 0 GeForce RTX 3090 Off |")).otherwise(F.concat(F.lit("| 30% 40C P2 "), n + 100, F.lit("W / 350W |")))
    return logs.gpu_watts(vectors(spark, sf_dir).select(F.lit("g").alias("file"), n.alias("line_no"), text.alias("value")), "3090").withColumn("watts", F.round("watts", 6))


@query(f"WITH {RUNS}, n AS (SELECT 1 AS mc, mg, 5.0::DOUBLE AS time_ms FROM e WHERE mc = 1 AND mg < 3 UNION ALL SELECT 9, 9, 1.5::DOUBLE) SELECT mc, mg, time_ms FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.mc = e.mc AND n.mg = e.mg) UNION ALL SELECT * FROM n")
def s19_upsert_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (9, 9, 1.5)], "mc int, mg int, time_ms double")
    return logs.upsert(A.experiments(spark).select("mc", "mg", "time_ms"), new, ["mc", "mg"])


@query("SELECT vec_id AS node_id, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def s7_vector_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as a binary format and read again."""
    at = scratch(spark, "fbin")
    binary.write_vectors(vectors(spark, sf_dir), at, "fbin", part_rows=200)
    back = binary.read_parts(spark, at, "fbin")
    return back.select((F.col("part") * 200 + F.col("node_id")).alias("node_id"), F.col("embedding")[0].alias("first"), F.col("embedding")[63].alias("last"))


@query("SELECT vec_id // 4 AS batch_id, count(*) AS n FROM embeddings GROUP BY 1 HAVING vec_id // 4 > 0 AND vec_id // 4 < (SELECT max(vec_id) // 4 FROM embeddings)")
def s18_middle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches without the first and the last."""
    n = vectors(spark, sf_dir).groupBy(F.floor(F.col("node_id") / 4).alias("batch_id")).agg(F.count("*").alias("n"))
    last = n.agg(F.max("batch_id").alias("last"))
    return n.crossJoin(F.broadcast(last)).where("batch_id > 0 and batch_id < last").drop("last")
