"""Toxicity scores: logistic regression over hashed word n-grams (of words and stems) and skip-grams, trained by FTRL-proximal.

Each coordinate has a learning rate of its own, and L1 sets most weights to zero; the rest are a few thousand numbers
at most, which are broadcast. Training sees a bounded sample of labelled rows; scoring sees every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import crc_mod, stored

#: Hashed features: 2 ** BITS.
BITS = 20
#: FTRL-proximal's parameters, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 4.0, 1.0, 6
#: Labelled rows to train on, at most, and their distinct features together: what the training task holds.
SAMPLE_ROWS, SAMPLE_FEATURES = 10_000, 50_000_000

#: Lengths of stems, and distinct words that a task remembers.
STEMS, MAX_KNOWN = (3, 4, 5), 1 << 19

_WORD = re.compile(r"[^\W_]+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


class Hasher:
    """Turns texts into hashes of words and their stems (single ones), pairs of neighbours, and pairs with a word between.

    A stem is a word's first letters, for each length in STEMS that the word exceeds: languages inflect at the end.
    """

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1 << 12, 1 + len(STEMS)), np.uint64)

    def words(self, text: str | None) -> np.ndarray:
        """Rows of hashes, one for each word in order: the word's, and its stems' or else the word's again."""
        rows = self.rows
        if len(rows) > MAX_KNOWN:
            rows.clear()
        found = _WORD.findall((text or "").lower())
        for w in set(found).difference(rows):
            k = rows[w] = len(rows)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            whole = zlib.crc32(w.encode())
            self.table[k] = [whole, *(zlib.crc32(w[:n].encode(), n) if len(w) > n else whole for n in STEMS)]
        return self.table[np.fromiter(map(rows.__getitem__, found), np.int64, len(found))]

    def features(self, text: str | None) -> np.ndarray:
        """Hashes in text order, repeats included."""
        table = self.words(text)
        h, mix = table[:, 0], [table.ravel() * _ODD[0]]
        for gap, odd in ((1, _ODD[1]), (2, _ODD[3])):
            mix.append((h[:-gap] * odd) ^ (h[gap:] * _ODD[2] + odd) if len(h) > gap else h[:0])
        x = np.concatenate(mix)
        return (x ^ (x >> np.uint64(29))) * _ODD[0] >> np.uint64(64 - BITS)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the weights that are not zero; index 2 ** BITS is the intercept. Rows are seen in the given
    order, PASSES times; a row's features count once each."""
    n, z = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for x, y in rows:
            i = np.append(x.astype(np.int64), 1 << BITS)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def _within(rows: Iterator[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
    """The first rows, up to SAMPLE_FEATURES features."""
    kept, size = [], 0
    for x, y in rows:
        size += len(x)
        if size > SAMPLE_FEATURES:
            break
        kept.append((x, y))
    return kept


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from the rows of docs that have a label of 0 or 1.

    Those of least hashed id are taken, one for each id (of several texts that of least hash), up to SAMPLE_ROWS rows and SAMPLE_FEATURES
    features; one task trains with them, and the driver gets the weights. Rows with a null id or label are left out; an id with several labels
    counts as toxic if one says so; a null text is empty. Without any row the model has no weights, and every score is 0.5 at first.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    wanted = docs.select(F.col(id_col).alias("id"), mark.alias("t")).groupBy("id").agg(F.min("t").alias("t")).join(known, "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS)
    wanted = stored(wanted, "sample")
    texts = docs.select(F.col(id_col).alias("id"), mark.alias("t"), F.col(text_col).alias("text")).join(F.broadcast(wanted), ["id", "t"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for b in batches:
            # What is repeated in a task is passed on once, so that no id is hot after this.
            new = pa.array([k for k, i in enumerate(b.column(0).to_pylist()) if not (i in seen or seen.add(i))], pa.int64())
            x = [np.unique(hasher.features(t)).astype(np.uint32).tobytes() for t in b.column(1).take(new).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(new), b.column(2).take(new), pa.array(x, pa.binary())], ["id", "y", "x"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = train(_within((np.frombuffer(x.as_py(), np.uint32), y.as_py()) for b in batches for y, x in zip(b.column(1), b.column(2), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w)], ["at", "w"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.select("id", "text", "y").mapInArrow(hashed, f"id {kind}, y int, x binary")
    rows = rows.groupBy("id").agg(F.first("y").alias("y"), F.first("x").alias("x"))
    model = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(learnt, "at long, w double").collect()
    return np.array([r.at for r in model], np.int64), np.array([r.w for r in model], float)


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, score (0 to 1), predicted (1 if score is 0.5 or more): one row for each row of docs.

    A null text is scored as an empty one: by the intercept. Repeated rows are repeated; other columns are not read.
    """
    seen = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    names = [*seen.columns[:-1], "score", "predicted"]
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        w = np.zeros((1 << BITS) + 1)
        w[at] = values
        used, hasher = w != 0, Hasher()
        for b in batches:
            p = np.empty(b.num_rows)
            for k in range(b.num_rows):
                x = hasher.features(b.column(b.num_columns - 1)[k].as_py()).astype(np.int64)
                p[k] = 1 / (1 + np.exp(-np.clip(w[np.unique(x[used[x]])].sum() + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names)

    return seen.mapInArrow(run, StructType([*seen.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def held_out(key: str) -> Column:
    """Rows that a fit must not see: crc32 of the key as text is 0 modulo 5; a null key counts as held out."""
    return F.coalesce(crc_mod(F.col(key), 5) == 0, F.lit(True))
