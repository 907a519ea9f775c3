"""SimHash near-duplicate detection; candidates are found and thinned out by the pigeonring principle.

A 64-bit fingerprint is read as a ring of four 16-bit segments. If two fingerprints differ in at most 3 bits, then
some segment starts a chain in which the first 1, 2 and 3 segments together differ in at most 0, 1 and 2 bits
(3/4 of a bit for each segment, rounded down). The first two conditions become the key of an equi-join: a chain's
first segment exact, and its second one with one bit masked. The third is checked before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SEED = 42
SEGMENTS, BITS, RADIUS = 4, 16, 3
#: A bucket with more fingerprints than this is split into blocks, and each pair of blocks goes to a group of its own.
BLOCK = 4096
#: Blocks and hot buckets are told to the executors up to this many buckets; beyond, they are joined.
MAX_BROADCAST_BUCKETS = 100_000

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def simhash(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a UTF-8 text, unsigned; 0 for null or a text without words. Memory is bounded by blocks of shingles."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + width - 1]
        rows = zip(*(some[k:] for k in range(width)), strict=False) if len(some) >= width else [some]
        hashes = np.frombuffer(b"".join([digest(b" ".join(t), SEED) for t in rows]), np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[k] += np.bincount(hashes[:, k], minlength=256) @ _BIT_OF_BYTE
    return int.from_bytes(np.packbits((2 * counts > n).reshape(64)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (long): one row for each row of docs. A null text counts as empty; other columns are not read."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def _tree(fps: np.ndarray, start: int, bit: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one bucket's links, by breadth-first search over numpy arrays of what is unseen."""
    left, found = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _linked(left ^ at, start, bit)
            if hit.any():
                found += [(at, x) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return found


def _linked(x: np.ndarray, start: np.ndarray | int, bit: np.ndarray | int) -> np.ndarray:
    """Whether differences x within a bucket pass the chain and then the full check.

    A pair whose second segments are equal is in 16 buckets; the one with bit 0 masked answers for it."""
    turn = np.uint64(BITS) * np.asarray(start, np.uint64)
    x = (x << turn) | (x >> ((np.uint64(64) - turn) % np.uint64(64)))
    second = (x >> np.uint64(32)) & np.uint64(0xFFFF)
    one = np.uint64(1) << np.asarray(bit, np.uint64)
    chain = ((second == one) | ((second == 0) & (one == 1))) & (np.bitwise_count(x >> np.uint64(16)) <= 2)
    return chain & (np.bitwise_count(x) <= RADIUS)


def _link_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, part, fp) sorted by key and part: edges a, b that connect what is linked within each group."""

    def edges(key: np.ndarray, part: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        n = np.diff(np.r_[at, len(key)])
        two = at[n == 2]
        tag = key[two] >> 32
        x = fp[two] ^ fp[two + 1]
        hit = two[_linked(x, tag // BITS, tag % BITS)]
        out = [np.stack([fp[hit], fp[hit + 1]], 1)]
        for i, k in zip(at[n > 2], n[n > 2], strict=True):
            if found := _tree(fp[i : i + k], int(key[i] >> 32) // BITS, int(key[i] >> 32) % BITS):
                out.append(np.array(found, np.uint64))
        pairs = np.concatenate(out).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for b in batches:
        new = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        key, part, _ = held
        last = np.flatnonzero((key != key[-1]) | (part != part[-1])) if len(key) else np.zeros(0, int)
        if len(last):
            cut = last[-1] + 1
            yield edges(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield edges(*held)


def links(fps: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints (column fp) that connect exactly what differs in at most 3 bits.

    Not every linked pair is a row: within a bucket a spanning forest is returned, so that the output is linear in
    the buckets' sizes. Each fingerprint goes to 64 buckets of 31 bits. Buckets beyond BLOCK fingerprints are dealt
    out as pairs of blocks; none is cut short.
    """
    r = [F.col("fp") if i == 0 else F.shiftleft("fp", BITS * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - BITS * i)) for i in range(SEGMENTS)]
    head = [F.shiftrightunsigned(x, 32) for x in r]
    mask = lambda j: 0xFFFFFFFF ^ (1 << j)
    key = lambda i, x, j: x.bitwiseAND(F.lit(mask(j)).cast("long")).bitwiseOR(F.lit((i * BITS + j) << 32).cast("long"))

    cells = fps.select(F.explode(F.array(*[x.bitwiseOR(F.lit(i << 32).cast("long")) for i, x in enumerate(head)])).alias("cell")).groupBy("cell").count().where(F.col("count") > BLOCK // 2)
    low, start = F.col("cell").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("cell", 32)
    masked = [low.bitwiseAND(F.lit(mask(j)).cast("long")).bitwiseOR(F.shiftleft(start * BITS + j, 32)) for j in range(BITS)]
    hot = stored(cells.select(F.explode(F.array(*masked)).alias("key"), "count").groupBy("key").agg(F.ceil((F.sum("count") + BLOCK // 2) / BLOCK).alias("blocks")), "hot")
    n_hot = hot.limit(MAX_BROADCAST_BUCKETS + 1).count()

    rows = fps.select(F.explode(F.array(*[key(i, x, j) for i, x in enumerate(head) for j in range(BITS)])).alias("key"), "fp")
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_BUCKETS else hot, "key", "left")
        own = F.pmod(F.xxhash64("fp"), "blocks")
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.shiftleft(F.least(own, q), 31).bitwiseOR(F.greatest(own, q)))
        rows = rows.select("key", F.explode(F.coalesce(pairs, F.array(F.lit(0).cast("long")))).alias("part"), "fp")
    else:
        rows = rows.select("key", F.lit(0).cast("long").alias("part"), "fp")
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_link_runs, "a long, b long")


def classes(fps: DataFrame) -> DataFrame:
    """fp, component_id, root: a row for each distinct fingerprint of fps (doc_id, fp)."""
    distinct = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp")))
    group = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(group.join(best, "root").select("fp", "component_id", "root"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id: the smallest id reachable over links of at most 3 differing bits; root: a fingerprint
    that stands for the component.

    One row for each row of docs. Null and empty texts have fingerprint 0 and are linked like any other. Rows with a
    null id are kept; their component is the smallest id that is not null, or null. Repeated rows are repeated.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return fps.join(classes(fps), "fp").select("doc_id", "fp", "component_id", "root")


def hex_of(fp: str = "fp"):
    """A long as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
