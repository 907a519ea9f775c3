"""Analytics over tables of experiments: best configurations, speedups, percentiles, ratios, energy, utilization."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Recorded runs of one configuration (10,000 queries): mc, mg, time_ms, recall_1, recall_10, avg_hops, avg_visited.
RECORDED: list[tuple[int, int, float, float, float, float, float]] = [
    (1, 1, 641.453, 0.9939, 0.98012, 70.0091, 1745.550),
    (1, 2, 432.920, 0.9937, 0.98079, 76.1094, 1897.700),
    (1, 3, 359.513, 0.9941, 0.98132, 81.9769, 2041.470),
    (1, 4, 336.277, 0.9945, 0.98176, 87.7296, 2181.500),
    (1, 5, 338.155, 0.9943, 0.98223, 93.4252, 2317.520),
    (1, 6, 349.488, 0.9944, 0.98283, 99.0498, 2450.980),
    (2, 1, 487.520, 0.9939, 0.98069, 74.9309, 1873.300),
    (2, 2, 360.977, 0.9944, 0.98177, 86.6301, 2158.350),
    (2, 3, 351.339, 0.9943, 0.98281, 98.0128, 2429.460),
    (2, 4, 377.955, 0.9945, 0.98361, 109.1660, 2691.210),
    (2, 5, 409.247, 0.9947, 0.98416, 120.1730, 2946.890),
    (2, 6, 440.614, 0.9945, 0.98471, 131.1770, 3198.620),
    (3, 1, 440.928, 0.9940, 0.98098, 79.9239, 1999.420),
    (3, 2, 359.932, 0.9944, 0.98269, 97.2421, 2414.430),
    (3, 3, 393.020, 0.9948, 0.98377, 114.0220, 2806.250),
    (3, 4, 439.819, 0.9948, 0.98465, 130.6050, 3186.820),
    (3, 5, 484.517, 0.9950, 0.98564, 146.2620, 3544.480),
    (3, 6, 527.812, 0.9941, 0.98643, 160.5610, 3884.140),
    (4, 1, 425.007, 0.9940, 0.98134, 85.0507, 2127.120),
    (4, 2, 381.823, 0.9946, 0.98358, 107.9130, 2666.660),
    (4, 3, 439.660, 0.9946, 0.98476, 130.1560, 3177.680),
    (4, 4, 498.044, 0.9949, 0.98585, 150.4310, 3646.010),
    (4, 5, 555.324, 0.9941, 0.98647, 169.5420, 4096.260),
    (4, 6, 613.251, 0.9936, 0.98695, 189.1120, 4544.690),
]


def experiments(spark: SparkSession) -> DataFrame:
    """The recorded runs as a table."""
    return spark.createDataFrame(RECORDED, "mc int, mg int, time_ms double, recall_1 double, recall_10 double, avg_hops double, avg_visited double")


def sweep(spark: SparkSession, efs: range | list[int], mcs: list[int], mgs: list[int]) -> DataFrame:
    """ef, mc, mg: all combinations with a power of two as ef."""
    one = lambda name, values: F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} int"))
    grid = one("ef", list(efs)).crossJoin(one("mc", mcs)).crossJoin(one("mg", mgs))
    return grid.where((F.col("ef") > 0) & (F.col("ef").bitwiseAND(F.col("ef") - 1) == 0))


def qps(time_ms: Column, queries: int = 10_000) -> Column:
    return F.lit(queries * 1000.0) / time_ms


def batch_latency(time_ms: Column, queries: Column | int, batch: Column) -> Column:
    """Time of a batch: the total over the number of batches, the last of which may be short."""
    return time_ms / F.ceil((F.lit(queries) if isinstance(queries, int) else queries) / batch)


def best(rows: DataFrame, keys: list[str], by: str = "time_ms") -> DataFrame:
    """The row of least by for each keys (or of all), ties by the remaining columns in order."""
    others = [c for c in rows.columns if c not in keys and c != by]
    pick = F.min(F.struct(by, *others)).alias("b")
    found = rows.groupBy(*keys).agg(pick) if keys else rows.agg(pick)
    return found.select(*keys, "b.*").select(rows.columns)


def speedups(rows: DataFrame) -> DataFrame:
    """rows with speedup and hops relative to mc = mg = 1, and utilization = hops * speedup."""
    base = F.broadcast(rows.where("mc = 1 and mg = 1").select(F.col("time_ms").alias("t0"), F.col("avg_hops").alias("h0")))
    out = rows.crossJoin(base).withColumn("speedup", F.col("t0") / F.col("time_ms")).withColumn("norm_hops", F.col("avg_hops") / F.col("h0"))
    return out.withColumn("utilization", F.col("norm_hops") * F.col("speedup")).drop("t0", "h0")


def speedup_matrix(rows: DataFrame, mgs: list[int]) -> DataFrame:
    """mc, mg1, mg2, ...: speedups as a matrix."""
    wide = speedups(rows).groupBy("mc").pivot("mg", mgs).agg(F.max("speedup"))
    return wide.select("mc", *[F.col(str(g)).alias(f"mg{g}") for g in mgs])


def latency_summary(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """min_ms, max_ms, avg_ms, upper_median, median, p95 of arrays of latencies. upper_median is the element at half the length, from 0, of
    the sorted array; median and p95 are interpolated."""
    flat = rows.select(*keys, F.explode(column).alias("x"))
    sorted_ = F.array_sort(F.collect_list("x"))
    out = flat.groupBy(*keys).agg(F.min("x").alias("min_ms"), F.max("x").alias("max_ms"), F.avg("x").alias("avg_ms"), sorted_.alias("__sorted"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.95)).alias("p95"))
    return out.withColumn("upper_median", F.get("__sorted", F.floor(F.size("__sorted") / 2).cast("int"))).drop("__sorted")


def trimmed(latencies: Column) -> Column:
    """An array without its first and last element, if it has more than two."""
    return F.when(F.size(latencies) > 2, F.slice(latencies, 2, F.size(latencies) - 2)).otherwise(latencies)


def extrapolated(rows: DataFrame, keys: list[str], limit: int = 32) -> DataFrame:
    """rows (keys, batch_size, latency_ms): beyond limit, the latency of limit times batch / limit."""
    at = rows.where(F.col("batch_size") == limit).select(*keys, F.col("latency_ms").alias("at"))
    linear = F.col("at") * F.col("batch_size") / F.lit(limit)
    return rows.join(F.broadcast(at), keys, "left").withColumn("latency_ms", F.when((F.col("batch_size") > limit) & F.col("at").isNotNull(), linear).otherwise(F.col("latency_ms"))).drop("at")


def energy(power: DataFrame, latency: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mj: watts times milliseconds."""
    return power.join(latency, keys).select(*keys, (F.col("watts") * F.col("latency_ms")).alias("mj"))


def work_at_recall(rows: DataFrame, keys: list[str], target: float) -> DataFrame:
    """keys, ef, work: the first point, by ef, whose recall is over target; null if there is none."""
    ok = F.when(F.col("recall") > target, F.struct("ef", "work"))
    return rows.groupBy(*keys).agg(F.min(ok).alias("m")).select(*keys, "m.ef", "m.work")


def range_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def utilization(rows: DataFrame, dim: int, hashes_cycles: int = 6, lanes: int = 16, sort_cycles: int = 64) -> DataFrame:
    """rows with cycles of a query's parts: checks of visited nodes, distances, and queue work, from avg_visited and avg_hops."""
    return rows.withColumn("check_cycles", F.col("avg_visited") * hashes_cycles).withColumn("distance_cycles", F.col("avg_visited") * (dim / lanes)).withColumn("queue_cycles", F.col("avg_visited") + F.col("avg_hops") * sort_cycles)


def share_of(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def running_total(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def reduce_sum(rows: DataFrame, column: str) -> DataFrame:
    """pos, total: arrays of several sessions added element by element."""
    return rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("total"))


def all_reduce(rows: DataFrame, column: str) -> DataFrame:
    """rows with the sum of all rows' arrays: a reduction, then a broadcast of its one row."""
    total = reduce_sum(rows, column).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda s: s["total"]).alias("total"))
    return rows.crossJoin(F.broadcast(total))
