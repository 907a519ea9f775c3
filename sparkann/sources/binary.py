"""Binary vector files: length-prefixed rows (fvecs, bvecs, ivecs), headed matrices (fbin, ibin, int8 bin), raw floats.

Readers split a file into ranges of rows, which tasks read by themselves; on a file system that only Spark can open, a file comes whole instead, which
bounds it to 2 GiB. Parquet is the native format; these are for exchange.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


class Layout(NamedTuple):
    """element: numpy type; prefixed: each row has its length before it; header: the file has rows and length before all."""

    element: str
    prefixed: bool
    header: bool
    integer: bool


# The formats' layouts, little-endian.
LAYOUTS: dict[str, Layout] = {
    "fvecs": Layout("<f4", True, False, False),
    "bvecs": Layout("u1", True, False, False),
    "ivecs": Layout("<i4", True, False, True),
    "fbin": Layout("<f4", False, True, False),
    "ibin": Layout("<i4", False, True, True),
    "u32bin": Layout("<u4", False, True, True),
    "i64bin": Layout("<i8", False, True, True),
    "i8bin": Layout("i1", False, True, False),
    "raw": Layout("<f4", False, False, False),
}


def decode(data: bytes, layout: Layout, dim: int | None = None) -> np.ndarray:
    """The matrix in a file's bytes; ValueError if they don't fit the layout."""
    size = np.dtype(layout.element).itemsize
    if layout.header:
        n, d = struct.unpack("<ii", data[:8])
        body = np.frombuffer(data, layout.element, n * d, 8) if len(data) == 8 + n * d * size else None
    elif layout.prefixed:
        if not data:
            return np.zeros((0, 0), layout.element)
        (d,) = struct.unpack("<i", data[:4])
        row = 4 + d * size
        if len(data) % row:
            raise ValueError("the file does not hold whole rows")
        rows = np.frombuffer(data, np.uint8).reshape(-1, row)
        if (rows[:, :4] != rows[0, :4]).any():
            raise ValueError("rows differ in length")
        return rows[:, 4:].copy().view(layout.element)
    else:
        if not dim:
            raise ValueError("a file without header needs dim")
        n, d = len(data) // (dim * size), dim
        body = np.frombuffer(data, layout.element) if len(data) == n * d * size else None
    if body is None:
        raise ValueError("the file's length does not fit its header")
    return body.reshape(n, d)


def encode(matrix: np.ndarray, layout: Layout) -> bytes:
    body = np.ascontiguousarray(matrix, layout.element)
    if layout.prefixed:
        head = np.full((len(body), 1), body.shape[1], "<i4").view(np.uint8)
        return np.hstack([head, body.view(np.uint8).reshape(len(body), -1)]).tobytes()
    return (struct.pack("<ii", *body.shape) if layout.header else b"") + body.tobytes()


def _batches(file: str, first: int, m: np.ndarray, layout: Layout) -> Iterator[pa.RecordBatch]:
    """Rows file, node_id, embedding of a matrix whose first row is number first."""
    m = m.astype(np.int64 if layout.integer else np.float32)
    for lo in range(0, len(m), 10_000):
        part = m[lo : lo + 10_000]
        lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, m.shape[1], dtype=np.int32), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(np.arange(first + lo, first + lo + len(part))), lists], ["file", "node_id", "embedding"])


def ranges_of(file: str, length: int, layout: Layout, dim: int | None, rows: int) -> Iterator[tuple[str, int, int, int]]:
    """file, first row, rows and row length of the ranges of a file; ValueError if its length doesn't fit its layout."""
    size, start = np.dtype(layout.element).itemsize, 0
    if layout.header:
        n, d = struct.unpack("<ii", files.read(file, 0, 8))
        start = 8
    elif layout.prefixed:
        d = struct.unpack("<i", files.read(file, 0, 4))[0] if length else 0
        n = length // (4 + d * size) if length else 0
    else:
        if not dim:
            raise ValueError("a file without header needs dim")
        n, d = length // (dim * size), dim
    if start + n * (d * size + (4 if layout.prefixed else 0)) != length:
        raise ValueError("the file's length does not fit its header")
    for first in range(0, n, rows):
        yield file, first, min(rows, n - first), d


def read_vectors(spark: SparkSession, path: str, kind: str, dim: int | None = None, limit: int | None = None, range_rows: int = 100_000) -> DataFrame:
    """file, node_id, embedding of the files in path; ids count rows from 0 in each file. Bytes become floats, ids longs. limit keeps ids below it. A task
    reads range_rows rows of a file at a time."""
    layout = LAYOUTS[kind]
    schema = f"file string, node_id long, embedding array<{'long' if layout.integer else 'float'}>"
    listed = spark.read.format("binaryFile").load(path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield from _batches(b.column(0)[k].as_py(), 0, decode(b.column(1)[k].as_py(), layout, dim), layout)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if found := list(ranges_of(file, length, layout, dim, range_rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["file", "first", "n", "d"])

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, first, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = d * np.dtype(layout.element).itemsize + (4 if layout.prefixed else 0)
                data = files.read(file, (8 if layout.header else 0) + first * row, n * row)
                if layout.header:
                    m = np.frombuffer(data, layout.element).reshape(n, d)
                else:
                    m = decode(data, layout, d)
                yield from _batches(file, first, m, layout)

    one = listed.select("path").first()
    if one is None or not files.readable(one.path):
        rows = listed.select("path", "content").mapInArrow(whole, schema)
    else:
        tasks = spark.sparkContext.defaultParallelism
        spans = listed.select("path", "length").mapInArrow(cut, "file string, first long, n long, d long").repartition(tasks, "file", "first")
        rows = spans.mapInArrow(ranged, schema)
    return rows if limit is None else rows.where(F.col("node_id") < limit)


def ground_truth(ids: DataFrame, distances: DataFrame | None = None, cut: int = 100) -> DataFrame:
    """qid, rank, node_id (and dist) of the first cut neighbours, from read_vectors() of an id file and perhaps a distance file."""
    rows = ids.select(F.col("node_id").alias("qid"), F.posexplode("embedding").alias("p", "node_id"))
    if distances is not None:
        d = distances.select(F.col("node_id").alias("qid"), F.posexplode("embedding").alias("p", "dist"))
        rows = rows.join(d, ["qid", "p"])
    return rows.where(F.col("p") < cut).withColumn("rank", F.col("p") + 1).drop("p")


def write_vectors(rows: DataFrame, path: str, kind: str, id_col: str = "node_id", column: str = "embedding", part_rows: int = 100_000) -> None:
    """Files of part_rows vectors each in id order under path/part=N, each a whole file of the format, as rows of bytes that
    Spark's writer commits; read them with read_parts()."""
    layout = LAYOUTS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, list]]] = {}
        for b in batches:
            for part, key, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(part, []).append((key, v))
        for part, some in sorted(held.items()):
            data = encode(np.array([v for _, v in sorted(some)]), layout)
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([data], pa.binary())], ["part", "content"])

    parted = rows.select(F.floor(F.col(id_col) / part_rows).cast("long").alias("part"), F.col(id_col).alias("key"), column)
    parted.repartition("part").mapInArrow(run, "part long, content binary").write.mode("overwrite").partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str, kind: str, dim: int | None = None) -> DataFrame:
    """part, node_id, embedding of what write_vectors() wrote; ids count rows from 0 in each part."""
    layout = LAYOUTS[kind]
    item = "long" if layout.integer else "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = decode(data, layout, dim).astype(np.int64 if layout.integer else np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(m)), pa.array(np.arange(len(m))), pa.array(list(m))], ["part", "node_id", "embedding"])

    return spark.read.parquet(path).select(F.col("part").cast("long"), "content").mapInArrow(run, f"part long, node_id long, embedding array<{item}>")


def write_files(rows: DataFrame, path: str, kind: str, id_col: str = "node_id", column: str = "embedding", part_rows: int = 100_000) -> None:
    """Plain files of the format, path/part-N.kind with ids N * part_rows and on in order, each written by one task. ValueError if tasks can't write there."""
    layout = LAYOUTS[kind]
    if not files.readable(path):
        raise ValueError(f"tasks can't write to {path}; use write_vectors()")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            part = b.column(0).to_numpy()
            m = np.array(b.column(2).to_pylist(), layout.element)
            for p in np.unique(part):
                for q in [q for q in held if q < p]:
                    yield made(q, held.pop(q))
                held.setdefault(int(p), []).append(m[part == p])
        for q in sorted(held):
            yield made(q, held.pop(q))

    def made(part: int, blocks: list[np.ndarray]) -> pa.RecordBatch:
        file = f"{path.rstrip('/')}/part-{part:06}.{kind}"
        n = sum(map(len, blocks))
        head = [struct.pack("<ii", n, blocks[0].shape[1])] if layout.header else []
        files.write(file, iter([*head, *(encode(m, layout._replace(header=False)) for m in blocks)]))
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([n])], ["file", "n"])

    parted = rows.select(F.floor(F.col(id_col) / part_rows).cast("long").alias("part"), F.col(id_col).alias("key"), column)
    parted.repartition("part").sortWithinPartitions("part", "key").mapInArrow(run, "file string, n long").collect()


def export_file(rows: DataFrame, target: str, kind: str, id_col: str = "node_id", column: str = "embedding") -> None:
    """One file of the format, in id order, streamed by one task: for small exchange files."""
    n, layout = rows.count(), LAYOUTS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[bytes]:
            first = layout.header
            for b in batches:
                if not b.num_rows:
                    continue
                m = np.array(b.column(1).to_pylist(), layout.element)
                if first:
                    yield struct.pack("<ii", n, m.shape[1])
                    first = False
                yield encode(m, layout._replace(header=False))

        files.write(target, parts())
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    rows.select(F.col(id_col).alias("key"), column).repartition(1).sortWithinPartitions("key").mapInArrow(run, "n long").collect()


class Dataset(NamedTuple):
    """A catalogued dataset: directory pattern and formats of base, queries and truth; base is cut to its first rows."""

    dim: int
    base: str
    queries: str
    truth: str


# Known datasets with their dimension and formats.
CATALOGUE: dict[str, Dataset] = {
    "SIFT": Dataset(128, "bvecs", "bvecs", "ivecs"),
    "Deep": Dataset(96, "fbin", "fbin", "ibin"),
    "GLOVE": Dataset(300, "fbin", "fbin", "ibin"),
    "SBERT": Dataset(384, "raw", "raw", "ibin"),
    "SPACEV": Dataset(100, "i8bin", "i8bin", "ibin"),
}


def dataset(name: str) -> tuple[Dataset, int]:
    """The catalogue's entry of a name like SIFT1M, and its number of base rows in millions."""
    for key, found in CATALOGUE.items():
        if name.startswith(key):
            return found, int(name.removeprefix(key).removesuffix("M") or 1) * 1_000_000
    raise ValueError(f"unknown dataset {name}")
