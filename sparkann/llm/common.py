"""What the operators of this subpackage share: scratch tables, hash splits, fresh column names, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch as scratch_path
from ..session import stored

__all__ = ["scratch_path", "stored", "lean", "sliced", "fresh", "crc_mod", "word_count", "components", "told"]

#: What separates words in every contract of this subpackage.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after which a worker gives the memory that it no longer needs back to the system: workers outlive their tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of so many at most, where what is made of a row is large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def fresh(taken: Iterable[str], stem: str) -> str:
    """A column name that none of taken equals, in any case."""
    lower, name = {c.lower() for c in taken}, f"__{stem}"
    while name.lower() in lower:
        name += "_"
    return name


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, mod n; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph.

    edges: columns a, b (long). Returns node, root: one row for each node with an edge; root is some node of its
    component, the same for all of it. Self loops count as nodes; repeated edges and nulls change nothing.

    Every round each node joins its neighbour of least hashed rank and edges are drawn between what remains, so that
    a constant share of nodes is expected to vanish a round whatever the graph's shape. All state is in DataFrames
    that are written to the shared folder after each round; a node of high degree is only ever pre-aggregated or the
    many side of a join with one row per node, which adaptive execution splits.
    """
    spark = edges.sparkSession
    edges = edges.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("node"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(F.least(rank("a"), rank("b"))).alias("m")).select("a", F.col("m.node").alias("to"))
        near = stored(near, f"near{turn}")
        if labels is None:
            labels = near.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = labels.join(near, labels.root == near.a, "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = stored(moved, f"labels{turn}")
        drawn = edges.join(near, "a").select(F.col("to").alias("x"), "b")
        drawn = drawn.join(near.withColumnRenamed("a", "b"), "b").where("x <> to")
        edges = stored(drawn.select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).distinct(), f"edges{turn}")
        turn += 1
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")


def told(df: DataFrame, rows: int) -> DataFrame:
    """df to be broadcast if it has so many rows at most; else df as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
