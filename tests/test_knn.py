import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import evaluation, knn


def table(spark, m, name="node_id", start=0):
    return spark.createDataFrame([(i + start, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>")


def brute(q, v, k, exclude=True):
    out = []
    for i, a in enumerate(q.astype(np.float32).astype(float)):
        d = [(float(np.cumsum((a - b) ** 2)[-1]), j) for j, b in enumerate(v.astype(np.float32).astype(float)) if not exclude or i != j]
        out += [(i, r + 1, j, x) for r, (x, j) in enumerate(sorted(d)[:k])]
    return out


@pytest.mark.parametrize("dim", [1, 7, 100])
def test_exact(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(60, dim)) * 50
    got = knn.knn(table(spark, v[:9], "qid"), table(spark, v), 5).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == brute(v[:9], v, 5)


def test_blocks_give_the_same(spark, monkeypatch):
    v = np.random.default_rng(1).normal(size=(40, 8))
    monkeypatch.setattr(knn, "BLOCK_BYTES", 8 * 8 * 3)
    got = knn.knn(table(spark, v[:10], "qid"), table(spark, v), 4).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in got] == brute(v[:10], v, 4)


def test_ties_go_by_id_and_k_may_exceed_the_base(spark):
    base = table(spark, np.array([[1.0, 0], [0, 1], [-1, 0], [5, 5]]))
    q = table(spark, np.array([[0.0, 0]]), "qid", start=100)
    assert [r.node_id for r in knn.knn(q, base, 2).orderBy("rank").collect()] == [0, 1]
    assert knn.knn(q, base, 50).count() == 4


def test_empty_tables_and_null_vectors(spark):
    base, none = table(spark, np.eye(3)), table(spark, np.zeros((0, 3)))
    assert knn.knn(none.withColumnRenamed("node_id", "qid"), base, 2).count() == 0
    assert knn.knn(base.withColumnRenamed("node_id", "qid"), none, 2).count() == 0
    holed = base.unionByName(spark.createDataFrame([(9, None)], base.schema))
    assert knn.knn(base.withColumnRenamed("node_id", "qid"), holed, 9).where("node_id = 9").count() == 0


def test_expression_form_and_filter(spark):
    v = np.random.default_rng(2).normal(size=(30, 6))
    b = table(spark, v)
    q = b.where("node_id < 3").select(F.col("node_id").alias("qid"), "embedding")
    assert knn.knn_by_expression(q, b, 4).orderBy("qid", "rank").collect() == knn.knn(q, b, 4).orderBy("qid", "rank").collect()
    assert {r.node_id % 2 for r in knn.knn_by_expression(q, b, 4, allowed=F.col("node_id") % 2 == 0).collect()} == {0}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_merged_shards_equal_the_whole(spark, n):
    v = table(spark, np.random.default_rng(3).normal(size=(50, 5)))
    q = v.where("node_id < 4").select(F.col("node_id").alias("qid"), "embedding")
    parts = [knn.knn(q, v.where(F.col("node_id") % n == s), 6) for s in range(n)]
    key = lambda df: [tuple(r) for r in df.select("qid", "rank", "node_id", "dist").orderBy("qid", "rank").collect()]
    assert key(knn.merge(parts, 6)) == key(knn.knn(q, v, 6))


def test_recall_and_ties(spark):
    cols = "qid long, rank int, node_id long, dist double"
    truth = spark.createDataFrame([(0, 1, 5, 1.0), (0, 2, 6, 2.0), (1, 1, 7, 1.0), (1, 2, 8, 2.0)], cols)
    got = spark.createDataFrame([(0, 1, 6, 1.0), (0, 2, 5, 2.0), (1, 1, 7, 1.0)], cols)
    assert {r.k: (r.hits, r.recall) for r in evaluation.recall_at(got, truth, [1, 2]).collect()} == {1: (1, 0.5), 2: (3, 0.75)}
    assert {r.i: r.recall for r in evaluation.first_neighbour_recall(got, truth, [1, 2]).collect()} == {1: 0.5, 2: 1.0}
    assert tuple(evaluation.tie_counts(got, truth).first()) == (2, 1)
