"""Order MinHash fingerprints, which are sensitive to the edit distance of texts.

Every k-mer of a text is numbered by its occurrence. For each of COMPONENTS hash functions the TUPLE numbered k-mers of least hash
are selected, put back in text order, and hashed as a tuple. The share of equal components tells how alike two texts are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import lean, stored

#: Characters of a k-mer, hash functions, and k-mers selected by each.
K, COMPONENTS, TUPLE = 8, 64, 2
#: K-mers that are hashed by all functions at once.
BLOCK = 1 << 11
#: Rows of a range of ids, on average, ranges at most (beyond, they hold more rows), and rows sampled for each; a range is a task.
RANGE_ROWS, MAX_RANGES, SAMPLE = 4000, 20_000, 32
#: Repeated rows are told to the executors up to so many; beyond, they are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000

_RNG = np.random.default_rng(20190709)
_MULTIPLIERS = _RNG.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32) | np.uint32(1)
_SHIFTS = _RNG.integers(0, 1 << 32, COMPONENTS, dtype=np.uint32)
_P = np.uint32(0x01000193)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(0x7FEB352D)
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(0x846CA68B)
    return x ^ (x >> np.uint32(16))


def numbered(text: str) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the k-mers in text order, and of the k-mers with their occurrence numbers. A text of fewer than K
    characters is one k-mer, an empty one has none."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(c) == 0:
        return c, c
    if len(c) < K:
        c = np.concatenate([c, np.full(K - len(c), 0x110000, np.uint32)])
    h, step, power = _mix(c), 1, _P
    while step < K:
        h = h[:-step] * power + h[step:]
        step, power = 2 * step, np.uint32((int(power) * int(power)) & 0xFFFFFFFF)
    h = _mix(h)
    packed = np.sort((h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64))
    groups = (packed >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    times = np.empty(len(h), np.uint32)
    times[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.arange(len(h)) - np.repeat(first, np.diff(np.r_[first, len(h)]))
    return h, _mix(h + times * np.uint32(0x9E3779B1))


def _least(base: np.ndarray, few: int) -> np.ndarray:
    """Positions of the few least hashes of base by each function, in text order; equal hashes go by text order. BLOCK k-mers at a
    time bound the memory."""
    best, rows = [], np.arange(COMPONENTS)
    for at in range(0, len(base), BLOCK):
        part = base[at : at + BLOCK]
        h = part[None, :] * _MULTIPLIERS[:, None]
        h ^= _SHIFTS[:, None]
        for k in range(min(few, len(part))):
            i = h.argmin(1)
            best.append((h[rows, i].astype(np.uint64) << np.uint64(32)) | (i + at).astype(np.uint64))
            if k + 1 < few:
                h[rows, i] = 0xFFFFFFFF
    found = np.stack(best, 1)
    if found.shape[1] > few:
        found.partition(few - 1, 1)
    return np.sort((found[:, :few] & np.uint64(0xFFFFFFFF)).astype(np.int64), 1)


def fingerprint(text: str | None) -> np.ndarray:
    """COMPONENTS 16-bit numbers. Null and empty texts have all zeros; no other text has a zero."""
    kmers, base = numbered(text or "")
    if len(base) == 0:
        return np.zeros(COMPONENTS, np.uint16)
    chosen = _least(base, min(TUPLE, len(base)))
    value = np.arange(COMPONENTS, dtype=np.uint32)
    for i in range(chosen.shape[1]):
        value = _mix(value * _P + kmers[chosen[:, i]])
    return (1 + value % np.uint32(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal components."""
    return float((a == b).mean())


def hex_of(f: np.ndarray) -> str:
    return f.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first characters of following, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _places(cuts: list[tuple], nulls: pd.Series, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """How many of the sorted cuts (id, or None as the least one, and hash) are no greater than each row."""
    bare = np.array([h for i, h in cuts if i is None], np.int64)
    known = np.array([i for i, _ in cuts if i is not None], np.int64)
    hash_ = np.array([h for i, h in cuts if i is not None], np.int64)
    low, high = np.searchsorted(known, ids, "left"), np.searchsorted(known, ids, "right")
    out = len(bare) + low
    for k in np.flatnonzero(low < high):
        out[k] += np.searchsorted(hash_[low[k] : high[k]], hashes[k], "right")
    return np.where(nulls, np.searchsorted(bare, hashes, "right"), out)


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """range, guard, id, text, n: each text of an id once, with the number of its rows, dealt out by ranges, sorted in order within each, with the first
    row of the next range at the end of each as a guard.

    The order is by descending id, nulls last, then by descending text hash; after the last row the first one follows. Ranges are cut at quantiles of
    (id, hash) in a sample of some SAMPLE pairs a range, which is what reaches the driver; so an id with many rows is dealt over ranges by its texts, and rows that are
    the same in both are put together before anything is shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    pairs = stored(rows.groupBy("id", "h").agg(F.count("*").alias("n")), "pairs")
    n = pairs.count()
    parts = min(MAX_RANGES, max(1, -(-n // RANGE_ROWS)))
    some = pairs.where(F.pmod(F.xxhash64("h", "id"), F.lit(max(1, n // (parts * SAMPLE)))) == 0).select("id", "h") if parts > 1 else pairs.limit(0)
    found = sorted(some.distinct().collect(), key=lambda r: (r.id is not None, r.id or 0, r.h))
    cuts = sorted({(r.id, r.h) for k in range(1, parts) if found for r in [found[k * len(found) // parts]]}, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
    shared = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("long")
    def at(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        # The first range has the greatest ids.
        return pd.Series(len(shared.value) - _places(shared.value, ids.isna(), ids.fillna(0).to_numpy(np.int64), hashes.to_numpy(np.int64)))

    tops = pairs.withColumn("range", at("id", "h")).groupBy("range").agg(F.max(F.struct("id", "h")).alias("top"))
    heads = sorted(tops.collect(), key=lambda r: r["range"])
    before = [(*heads[k].top, heads[k - 1]["range"]) for k in range(len(heads))]
    told = F.broadcast(spark.createDataFrame(before, StructType([StructField("head", docs.schema[id_col].dataType), StructField("head_h", LongType()), StructField("before", LongType())])))
    again = stored(pairs.where("n > 1"), "again")
    if again.isEmpty():
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    else:
        same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
        many = again.limit(MAX_BROADCAST_ROWS + 1).count() > MAX_BROADCAST_ROWS
        twice = again.select("id", "h") if many else F.broadcast(again.select("id", "h"))
        once = rows.join(twice, same(rows, twice), "left_anti").withColumn("n", F.lit(1).cast("long"))
        rows = once.unionByName(rows.join(twice, same(rows, twice), "left_semi").groupBy("id", "h").agg(F.first("text").alias("text"), F.count("*").alias("n")))
    rows = rows.withColumn("range", at("id", "h")).join(told, F.col("id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    copies = F.array(F.struct(F.col("range"), F.lit(0).alias("guard")), F.struct(F.col("before").alias("range"), F.lit(1).alias("guard")))
    rows = rows.select(F.explode(F.when(F.col("before").isNull(), F.slice(copies, 1, 1)).otherwise(copies)).alias("c"), "id", "h", "text", "n")
    rows = rows.select("c.range", "c.guard", "id", "text", "n", "h")
    return rows.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions(F.col("range"), F.col("guard"), F.col("id").desc_nulls_last(), F.col("h").desc()).drop("h")


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row for each row of docs.

    Null texts count as empty ones; two empty texts are wholly alike. Of rows with equal ids the next one by text hash follows, and rows that are
    the same follow each other; a null id comes last. The only row of a table follows itself. Ids must be integers (TypeError). Other columns are not
    read. A text is worked on whole: some 40 bytes a character for as long as that takes.
    """
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(docs.schema[id_col].dataType.simpleString())
    if arrow is None:
        raise TypeError(f"{id_col} must be an integer column")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n"]

    def pair(held: tuple, text: str, mine: np.ndarray, n: int) -> tuple:
        """What is told of a row that text follows, n times."""
        changed = edited(held[2], text)
        after = fingerprint(changed)
        return held[1], len(held[2]), hashlib.sha256(changed.encode()).hexdigest(), hex_of(held[3]), hex_of(after), likeness(held[3], after), likeness(held[3], mine), n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for b in batches:
            for part, guard, key, text, n in zip(*b.columns, strict=True):
                part, guard, key, text, n = part.as_py(), guard.as_py(), key.as_py(), text.as_py(), n.as_py()
                mine = fingerprint(text)
                if held is not None and held[0] == part:
                    yield pair(held, text, mine, 1)
                held = None if guard else (part, key, text, mine)
                if held is not None and n > 1:
                    yield pair(held, text, mine, n - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for row in rows(batches):
            done.append(row)
            if len(done) >= 2000:
                yield table(done)
                done = []
        if done:
            yield table(done)

    id_type = docs.schema[id_col].dataType

    def table(done: list[tuple]) -> pa.RecordBatch:
        types = [arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    schema = StructType([StructField(names[0], id_type), StructField(names[1], LongType()), *[StructField(x, StringType()) for x in names[2:5]], *[StructField(x, DoubleType()) for x in names[5:7]], StructField(names[7], LongType())])
    out = with_following(docs, id_col, text_col).mapInArrow(lean(run), schema)
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("n")
