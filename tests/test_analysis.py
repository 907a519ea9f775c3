import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import analytics, evaluation, ivf, knn, membership
from sparkann.streaming import serving
from tests.test_knn import table


@pytest.mark.parametrize("xs,median,upper", [([3.0], 3.0, 3.0), ([1.0, 2.0], 1.5, 2.0), ([5.0, 1.0, 2.0], 2.0, 2.0)])
def test_latency_summary(spark, xs, median, upper):
    r = analytics.latency_summary(spark.createDataFrame([("a", xs)], "s string, xs array<double>"), ["s"], "xs").first()
    assert (r.median, r.upper_median, r.max_ms) == (median, upper, max(xs))


@pytest.mark.parametrize("xs,left", [([1.0], [1.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 2.0, 3.0], [2.0])])
def test_trimmed(spark, xs, left):
    df = spark.createDataFrame([(xs,)], "xs array<double>")
    assert df.select(analytics.trimmed(F.col("xs")).alias("t")).first().t == left


def test_best_and_speedup(spark):
    e = analytics.experiments(spark)
    assert tuple(analytics.best(e, []).select("mc", "mg").first()) == (1, 4)
    assert round(analytics.speedups(e).where("mc = 1 and mg = 4").first().speedup, 2) == 1.91
    assert analytics.work_at_recall(spark.createDataFrame([("a", 1, 0.5, 9.0)], "k string, ef int, recall double, work double"), ["k"], 0.9).first().ef is None
    assert analytics.share_of is not None and spark.range(1).select(analytics.share_of(F.lit(1.0), F.lit(0.0)).alias("s")).first().s == 0.0


def test_bloom_against_a_loop(spark):
    from sparkann.functions.hashing import murmur2_py

    keys = [(g, p, (p * 31) % 97) for g in range(2) for p in range(120)]
    got = {(r.group, r.pos): r.valid for r in membership.check_and_insert(spark.createDataFrame(keys, "group int, pos int, key long"), 6).collect()}
    for g in range(2):
        on = set()
        for _, p, k in [x for x in keys if x[0] == g]:
            bits = {murmur2_py(k, s) & 63 for s in (1, 2, 3)}
            assert got[g, p] == bool(bits - on)
            on |= bits


def test_inverted_file_with_all_cells_is_exact(spark):
    rng = np.random.default_rng(8)
    v = table(spark, rng.normal(size=(80, 8)))
    cells = ivf.lloyd(v, 5)
    q = v.where("node_id < 4").select(F.col("node_id").alias("qid"), "embedding")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assigned = ivf.assign(v, cells)
    assert key(ivf.search(q, assigned, cells, 5, 6)) == key(knn.knn(q, v, 6))
    few = evaluation.recall_at(ivf.search(q, assigned, cells, 1, 6), knn.knn(q, v, 6), [6]).first().recall
    assert 0 < few <= 1


def test_product_codes_of_codebook_vectors_are_exact(spark):
    v = table(spark, np.random.default_rng(9).normal(size=(16, 8)))
    book = ivf.sampled_codebook(v, 4, 8, 16)
    q = v.where("node_id < 2").select(F.col("node_id").alias("qid"), "embedding")
    got = ivf.adc_search(q, ivf.encode(v, book, 4, 8), book, 4, 8, 16).collect()
    want = {(r.qid, r.node_id): r.dist for r in knn.pairs(q, v).collect()}
    assert all(abs(r.dist - want[r.qid, r.node_id]) < 1e-9 for r in got)


def test_stream_equals_batch(spark, tmp_path):
    v = table(spark, np.random.default_rng(4).normal(size=(30, 4)))
    q = v.where("node_id < 9").select(F.col("node_id").alias("qid"), "embedding")
    q.repartition(3).write.parquet(str(tmp_path / "in"))
    serving.serve(serving.query_stream(spark, str(tmp_path / "in")), lambda b: knn.knn(b, v, 3), str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "times"))
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted(tuple(r) for r in df.select("qid", "rank", "node_id", "dist").collect())
    assert key(got) == key(knn.knn(q, v, 3)) and got.select("batch_id").distinct().count() == 3
    assert spark.read.parquet(str(tmp_path / "times")).agg(F.sum("n")).first()[0] == 9


def test_segments(spark):
    flat = spark.createDataFrame([("f", i, v) for i, v in enumerate([-1, 5, 6, -2, -1, 7, -2])], "file string, pos int, v int")
    assert sorted((r.qid, r.v) for r in evaluation.segments(flat).collect()) == [(0, 5), (0, 6), (1, 7)]


def test_power_readings_that_hold_the_device_name(spark):
    """A reading of 3090 W is no line of a 3090; a device line may be followed by one without a reading."""
    from sparkann.sources import logs

    text = ["| 0 GeForce RTX 3090 Off |", "| 30% 40C P2 200W / 350W |", "| 30% 40C P2 3090W / 350W |", "| 30% 40C P2 5W / 350W |", "| 30% 40C P2 13090W / 350W |", "| 0 GeForce RTX 3090 Off |", "| 0 GeForce RTX 3090 Off |", "| 30% 40C P2 100W / 350W |"]
    rows = spark.createDataFrame([("g", i, t) for i, t in enumerate(text)], "file string, line_no long, value string")
    assert [(r.file, r.watts) for r in logs.gpu_watts(rows, "3090").collect()] == [("g", 150.0)]
