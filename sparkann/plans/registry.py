"""Queries by name, each with the SQL that DuckDB answers it with, if there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            shared_dir(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_kept: dict[tuple[str, str, str], object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """What make() gives, made once an application for each sf_dir: indexes that several queries search. Their tables are in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_id, embedding, label of embeddings."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, embedding of the stated query set: ids divisible by 50."""
    return vectors(spark, sf_dir).where(F.col("node_id") % 50 == 0).select(F.col("node_id").alias("qid"), "embedding")


V = "v AS (SELECT vec_id AS node_id, embedding, label FROM embeddings)"
Q = "q AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0)"


def knn_sql(dist: str, k: int = 10, where: str = "qid <> node_id", q: str = Q, v: str = V, desc: str = "") -> str:
    """The k nearest by an expression over q.embedding and v.embedding."""
    rows = f"SELECT qid, node_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist{desc}, node_id) AS r FROM (SELECT qid, node_id, {dist} AS dist FROM q, v WHERE {where})"
    return f"WITH {q}, {v} SELECT qid, CAST(r AS INTEGER) AS rank, node_id, dist FROM ({rows}) WHERE r <= {k}"
