"""Queries against their SQL on tables made for a case."""

import duckdb
import numpy as np

from sparkann.plans import queries as plans


def held(spark, folder, m):
    """A folder with embeddings of the rows of m."""
    rows = [(i, [float(x) for x in v], i % 10) for i, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def both(spark, name, at):
    """Sorted rows of a query and of its SQL."""
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{at}/embeddings.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, at)
    r = c.execute(plans.SQL[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(row[names.index(x)] for x in got.columns) for row in r.fetchall()), key=repr)
    return sorted(map(tuple, got.collect()), key=repr), want


def test_integers_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    """100 times 0.105 in single precision is 10.5, in double precision less."""
    m = np.random.default_rng(2).normal(size=(60, 64)) / 8
    m[::3, 0] = 0.10499999672174454
    got, want = both(spark, "d6_l2_integers", held(spark, tmp_path, m))
    assert got == want and len(got) == 20


def test_cosine_with_copies_and_zero_vectors(spark, tmp_path, monkeypatch):
    """Copies go by id and zero vectors come last, though all pass through the task's matrices in blocks; no pair is a row of a plan."""
    from sparkann.operators import knn

    def refused(*_):
        raise AssertionError("all pairs as rows")

    monkeypatch.setattr(knn, "pairs", refused)
    m = np.random.default_rng(5).normal(size=(130, 64)) * np.random.default_rng(6).uniform(0.01, 30, size=(130, 1))
    m[60:75], m[80] = m[50], 0
    shown = lambda rows: [tuple(map(str, r)) for r in rows]
    got, want = both(spark, "d8_cosine", held(spark, tmp_path / "a", m))
    assert shown(got) == shown(want) and len(got) == 30
    m[3:120], m[0] = 0, 0
    got, want = both(spark, "d8_cosine", held(spark, tmp_path / "b", m))
    assert shown(got) == shown(want)
