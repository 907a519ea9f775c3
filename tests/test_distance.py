import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkann.functions import distance as D
from sparkann.functions.hashing import hashed_level, murmur2, murmur2_py


def test_fold_is_left_to_right(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(20, 100)), rng.normal(size=(20, 100))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "i int, a array<double>, b array<double>")
    got = {r.i: (r.l2, r.ip) for r in df.select("i", D.squared_l2(F.col("a"), F.col("b")).alias("l2"), D.ip_distance(F.col("a"), F.col("b")).alias("ip")).collect()}
    for i in range(20):
        l2 = ip = 0.0
        for x, y in zip(a[i], b[i]):
            l2 += (x - y) * (x - y)
            ip += x * y
        assert got[i] == (l2, 1.0 - ip)


def test_integers_and_zero_vectors(spark):
    df = spark.createDataFrame([([255, 128], [0, 127], [0.0], [1.0])], "a array<int>, b array<int>, z array<float>, o array<float>")
    r = df.select(D.squared_l2_int(F.col("a"), F.col("b")).alias("d"), D.cosine_distance(F.col("z"), F.col("o")).alias("c")).first()
    assert (r.d, r.c) == (255 * 255 + 1, None)


def test_metrics_differ_on_unnormalised_vectors(spark):
    df = spark.createDataFrame([(1, [10.0, 0.0]), (2, [0.9, 0.1])], "i int, v array<double>")
    q = F.array(F.lit(1.0), F.lit(0.05))
    best = lambda m: df.orderBy(D.METRICS[m](q, F.col("v"))).first().i
    assert (best("l2"), best("ip")) == (2, 1)


def test_murmur_matches_python(spark):
    keys = [0, 1, 7, 2**31 - 1, 2**31, 2**32 - 1, 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for seed in (1, 2, 3, 0x9747B28C):
        got = [r.h for r in df.select("k", murmur2(F.col("k"), seed).alias("h")).orderBy("k").collect()]
        assert got == [murmur2_py(k, seed) for k in sorted(keys)]


@given(st.integers(0, 2**32 - 1), st.integers(0, 100))
@settings(max_examples=50, deadline=None)
def test_murmur_py_is_32_bits(key, seed):
    assert 0 <= murmur2_py(key, seed) < 2**32


def test_levels_fall_off(spark):
    rows = spark.range(5000).select(hashed_level(F.col("id"), 16).alias("l")).groupBy("l").count().collect()
    n = {r.l: r["count"] for r in rows}
    assert n[0] > 4500 and 200 < n[1] < 450
