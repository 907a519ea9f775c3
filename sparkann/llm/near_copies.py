"""Near copies by the five-word rule: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are found and thinned out by the pigeonring principle over SimHashes, as in simhash.py, but with a fingerprint as long as the
text: the shingles of a set are dealt by hash to a ring of m segments, and each segment has the SimHash of its shingles. Sets of sizes s
and t that are similar differ in at most (s + t) / 9 shingles; m is one more than that. So some segment starts a chain in which the first
1, 2, 3... segments together differ in at most 0, 1, 2... shingles. Its first segment is a join key, and its second one must be equal or
one shingle away, which shows in a SimHash: one more shingle changes bits of an even set only from 0 to 1, and of an odd one from 1 to 0.
A chain that starts with empty segments has its key further on (_ring). What passes and is close by size and by a 256-bit SimHash of the
whole set is put into one coarse group, and within coarse groups similarity is exact. Links make components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, fresh, lean, sliced, stored, told

WIDTH, SEED = 5, 42
#: Bits of 256 in which a coarse pair may differ (39 are expected at similarity 0.8, with a deviation of 6); sets of under SMALL shingles
#: have no such test, as their SimHash is too rough.
RADIUS, SMALL = 80, 64
#: Shingles in SAMPLED texts of one in SAMPLE or more stay out of a ring that has enough others; any choice of them, as by MAX_LAST, is exact.
SAMPLE, SAMPLED, MAX_LAST = 16, 16, 100_000
#: What up to so many sets have as a key is returned as pairs; more are held against each other in one task, which returns a spanning forest.
FEW = 8
#: The mark of a key that has no second segment to look at.
ANY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A coarse group of more shingles than this is split into blocks, and each pair of blocks is compared on its own.
BLOCK = 1 << 18
MAX_BROADCAST_ROWS = 100_000

_SPLIT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted; of fewer words, that of all; none for no words."""
    words = (text or b"").lower().split()
    found, digest = [np.zeros(0, np.uint64)], xxhash.xxh64_digest
    for at in range(0, max(1, len(words) - WIDTH + 1) if words else 0, 1 << 16):
        some = words[at : at + (1 << 16) + WIDTH - 1]
        rows = zip(*(some[k:] for k in range(WIDTH)), strict=False) if len(some) >= WIDTH else [some]
        found.append(np.frombuffer(b"".join([digest(b" ".join(t), SEED) for t in rows]), np.uint64))
    return np.unique(np.concatenate(found))


def _key(found: np.ndarray) -> int:
    """A hash of a set, signed."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _sketch(found: np.ndarray) -> bytes:
    """The 256-bit SimHash of a set."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(found), 1 << 14):
        x = found[at : at + (1 << 14)]
        wide = np.stack([x, *((y := x * c) ^ (y >> np.uint64(29)) for c in _SPLIT)], 1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(found)).tobytes()


def _bits(x: np.ndarray) -> np.ndarray:
    """The bits of numbers, a row each."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1)


def _simhash(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHashes from how many of n shingles have a bit: those that over half of them have."""
    return np.packbits(ones > (n // 2).astype(ones.dtype)[:, None], axis=1).view(np.uint64).ravel()


def _mixed(x: np.ndarray, tag: int, at: np.ndarray | int = 0) -> np.ndarray:
    """A hash of x, a tag and a place."""
    x = x ^ (np.asarray(at, np.uint64) * _SPLIT[1] + np.array([tag + 1], np.uint64) * _SPLIT[2])
    x = (x ^ (x >> np.uint64(32))) * _SPLIT[0]
    return (x ^ (x >> np.uint64(29))) * _SPLIT[1]


def _rings(n: int) -> list[tuple[int, int]]:
    """Tag and number of segments of the rings of a set of n shingles.

    Sets of 2**k to 2**(k + 1) - 1 shingles share a ring, and those on both sides of a power of two that may be similar share another.
    """
    if not n:
        return []
    k, low = n.bit_length() - 1, 1 << (n.bit_length() - 1)
    found = [(2 * k, (4 * low - 2) // 9 + 1)]
    if 5 * n >= 8 * low:
        found.append((2 * k + 1, (2 * low - 1) // 4 + 1))
    if 4 * n <= 5 * (low - 1):
        found.append((2 * k - 1, (low - 1) // 4 + 1))
    return [(tag, m) for tag, m in found if m > 1]


def _ring(found: np.ndarray, tag: int, m: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Keys of a set in its ring of m segments, and marks of what comes second.

    Every segment that isn't empty is a key, with the next one as its mark. If a chain of two similar sets starts with an empty segment,
    then up to the first shingle that they share, each one has fewer shingles than segments; so where such a start may end, the keys are
    the segment and the segment without each one of its shingles, and, where two may differ, its single shingles.
    """
    at = ((found >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(at, minlength=m)
    border = np.r_[0, np.cumsum(size)]
    spare = np.r_[0, np.cumsum(np.tile(size - 1, 2))]
    spare = (np.maximum.accumulate(spare) - spare)[m : 2 * m]  # how many shingles may differ where a sparse start ends here
    whole, keys = np.zeros(m, np.uint64), []
    for i in range(0, m, 1 << 13):
        j = min(m, i + (1 << 13))
        some, place, n = found[border[i] : border[j]], at[border[i] : border[j]], size[i:j]
        full = np.flatnonzero(n)
        if not len(full):
            continue
        bits, ones = _bits(some), np.zeros((j - i, 64), np.uint8 if n.max() < 256 else np.int32)
        ones[full] = np.add.reduceat(bits, border[i:j][full] - border[i], axis=0, dtype=ones.dtype)
        whole[i:j] = _simhash(ones, n)
        less = np.flatnonzero((spare[place] > 0) & (size[place] > 1))
        keys.append(_mixed(_simhash(ones[place[less] - i] - bits[less], size[place[less]] - 1), 4 * tag + 1, place[less]))
    full, sparse = np.flatnonzero(size), np.flatnonzero((spare > 0) & (size > 0))
    keys += [_mixed(whole[sparse], 4 * tag + 1, sparse), _mixed(found[spare[at] > 1], 4 * tag + 2)]
    mark = np.roll(whole, -1) & np.uint64(0xFFFFFFFFFFFF) | np.minimum(np.roll(size, -1), 0xFFFF).astype(np.uint64) << np.uint64(48)
    return [_mixed(whole[full], 4 * tag, full), *keys], [mark[full], *(np.full(len(k), ANY) for k in keys)]


def ring_keys(found: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and marks by which a set meets all similar ones.

    Shingles of last (sorted) stay out, which can only lessen what differs. As fewer than m shingles differ in a ring of m segments, two
    sets share one that stayed in if m of them did in either; a set in which fewer stayed in also has a ring of all its shingles.
    """
    few = found
    if len(last):
        few = found[last[np.minimum(np.searchsorted(last, found), len(last) - 1)] != found]
    keys, marks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for tag, m in _rings(len(found)):
        for some, kind in ((few, 0), *([(found, 1)] if len(few) < m else [])):
            k, v = _ring(some, 2 * tag + kind, m)
            keys += k
            marks += v
    return np.concatenate(keys), np.concatenate(marks)


def second_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether second segments may be equal or one shingle away, by their marks: SimHashes of 48 bits under numbers of shingles."""
    low, high, cut = np.minimum(a, b), np.maximum(a, b), np.uint64(48)
    n, more = low >> cut, (high >> cut) - (low >> cut)
    even = n & np.uint64(1) == 0
    fell = np.where(even, low & ~high, high & ~low) & np.uint64(0xFFFFFFFFFFFF)
    return (a == b) | ((more == 1) & (fell == 0)) | (high >> cut == 0xFFFF)


def _forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of n nodes; near(at, left) tells which of left are linked with at."""
    left, edges = np.arange(n), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near(at, left)
            if hit.any():
                edges += [(at, x) for x in left[hit]]
                queue += list(left[hit])
                left = left[~hit]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first columns, cut between runs of these."""
    held: pa.Table | None = None
    for b in batches:
        new = pa.Table.from_batches([b])
        held = new if held is None else pa.concat_tables([held, new]).combine_chunks()
        if not held.num_rows:
            continue
        cols = [held.column(k).to_numpy() for k in range(keys)]
        other = np.flatnonzero(np.any([c != c[-1] for c in cols], axis=0))
        if len(other):
            yield held.slice(0, other[-1] + 1)
            held = held.slice(other[-1] + 1)
    if held is not None and held.num_rows:
        yield held


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of the first columns start, and the end."""
    cols = [table.column(k).to_numpy() for k in range(keys)]
    return np.r_[0, np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1, table.num_rows]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows h, key, mark sorted by h and key: pairs (null, a, b) of keys that pass the chain's second step; where many have one h, their rows."""
    for t in _runs(batches, 1):
        h, key, mark = (t.column(k).to_numpy() for k in range(3))
        new = np.r_[True, (h[1:] != h[:-1]) | (key[1:] != key[:-1])]
        h, key, mark = h[new], key[new], mark[new].view(np.uint64)
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[at, len(h)])
        pairs = [np.zeros((0, 2), np.int64)]
        for k in range(2, FEW + 1):
            run = at[n == k]
            for i, j in combinations(range(k), 2):
                hit = run[second_near(mark[run + i], mark[run + j])]
                pairs.append(np.stack([key[hit + i], key[hit + j]], 1))
        a, b = np.unique(np.concatenate(pairs), axis=0).T
        many = np.repeat(n > FEW, n)
        none = pa.nulls(len(a), pa.int64())
        cols = [pa.concat_arrays([none, pa.array(h[many])]), pa.array(np.r_[a, key[many]]), pa.array(np.r_[b, mark[many].view(np.int64)])]
        yield pa.RecordBatch.from_arrays(cols, ["h", "a", "b"])


def _edges(keys: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = keys[np.array(edges, np.int64).reshape(-1, 2)]
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _close(m: np.ndarray, n: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether sets of sizes m and n and sketches s and t are close."""
    alike = np.bitwise_count(s ^ t).sum(1, dtype=np.int64) <= RADIUS
    return (5 * np.minimum(m, n) >= 4 * np.maximum(m, n)) & (alike | (m < SMALL) | (n < SMALL))


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows a, b, m, n, s, t: pairs a, b that are close."""
    for t in batches:
        hit = _close(t.column(2).to_numpy(), t.column(3).to_numpy(), _sketches(t.column(4)), _sketches(t.column(5)))
        yield t.select(["a", "b"]).filter(pa.array(hit))


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows h, key, mark, n, sketch sorted by h: edges that connect what passes the chain's second step and is close within each h."""
    for t in _runs(batches, 1):
        key, mark, n, at = t.column(1).to_numpy(), t.column(2).to_numpy().view(np.uint64), t.column(3).to_numpy().astype(np.int64), _starts(t, 1)
        sketch = _sketches(t.column(4))
        edges = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            v, m, s = mark[i:j], n[i:j], sketch[i:j]

            def near(x: int, left: np.ndarray, v: np.ndarray = v, m: np.ndarray = m, s: np.ndarray = s) -> np.ndarray:
                return second_near(v[left], v[x]) & _close(m[left], m[x], s[left], s[x])

            edges += [(i + a, i + b) for a, b in _forest(j - i, near)]
        yield _edges(key, edges)


def exact_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect exactly the sets of similarity 0.8 or more."""
    size = np.array([len(s) for s in sets])
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(size)]
    state = {"left": np.arange(len(sets)), "flat": flat}

    def near(x: int, left: np.ndarray) -> np.ndarray:
        if len(left) < len(state["left"]):
            state["flat"] = state["flat"][np.repeat(np.isin(state["left"], left), size[state["left"]])]
            state["left"] = left
        mark = np.zeros(len(names), np.int64)
        mark[flat[at[x] : at[x + 1]]] = 1
        both = np.add.reduceat(mark[state["flat"]], np.r_[0, np.cumsum(size[left])[:-1]])
        return 9 * both >= 4 * (size[left] + size[x])

    return _forest(len(sets), near)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows group, part, key, found sorted by group and part: edges of similar sets within each."""
    for t in _runs(batches, 2):
        key, found, at = t.column(2).to_numpy(), t.column(3), _starts(t, 2)
        for i, j in zip(at[:-1], at[1:], strict=True):
            if j - i > 1:
                sets = [np.frombuffer(x, np.uint64) for x in found.slice(i, j - i).to_pylist()]
                yield _edges(key[i:j], exact_forest(sets))


def _last(texts: DataFrame) -> np.ndarray:
    """Shingles that many texts have, from one text in SAMPLE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [np.zeros(0, np.uint64), *(shingles(t) for t in b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    some = texts.where(F.pmod("t", F.lit(SAMPLE)) == 0).select("text").mapInArrow(lean(run), "h long")
    often = some.groupBy("h").count().where(F.col("count") >= SAMPLED).orderBy(F.desc("count"), "h").limit(MAX_LAST).collect()
    return np.sort(np.array([r.h for r in often], np.int64).view(np.uint64))


def links(texts: DataFrame, sets: DataFrame, last: Broadcast) -> DataFrame:
    """Edges a, b between keys of sets (key, t, n, sketch) that connect exactly the similar ones; texts has t, text."""

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies meet as one
        for b in sliced(batches, 100):
            cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
            for text in b.column(0).to_pylist():
                found = shingles(text)
                if (key := _key(found)) not in seen:
                    seen.add(key)
                    h, mark = ring_keys(found, last.value)
                    for c, x in zip(cols, (h.view(np.int64), np.full(len(h), key), mark.view(np.int64)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["h", "key", "mark"])

    posts = texts.select("text").mapInArrow(lean(ring), "h long, key long, mark long").repartition("h").sortWithinPartitions("h", "key")
    met = stored(posts.mapInArrow(lean(_met), "h long, a long, b long"), "met")
    many = met.where("h is not null").select("h", F.col("a").alias("key"), F.col("b").alias("mark"))
    many = many.join(sets.select("key", "n", "sketch"), "key").select("h", "key", "mark", "n", "sketch")
    side = lambda c, n, s: sets.select(F.col("key").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    pairs = met.where("h is null").select("a", "b").distinct().join(side("a", "m", "s"), "a").join(side("b", "n", "t"), "b")
    close = pairs.select("a", "b", "m", "n", "s", "t").mapInArrow(lean(_close_pairs), "a long, b long")
    groups = components(close.unionByName(many.repartition("h").sortWithinPartitions("h", "key").mapInArrow(lean(_coarse), "a long, b long")))
    groups = stored(groups.withColumnRenamed("node", "key").join(sets.select("key", "t", "n"), "key"), "groups")
    large = groups.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks")).where("blocks > 1")
    groups = groups.join(told(stored(large, "large"), MAX_BROADCAST_ROWS), "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), "blocks")
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda q: F.shiftleft(F.least(own, q), 31).bitwiseOR(F.greatest(own, q)))
    parts = groups.select("root", F.explode(parts).alias("part"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingles(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "found"])

    read = texts.join(told(groups.select("t"), MAX_BROADCAST_ROWS), "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    full = stored(read.select("text").mapInArrow(lean(run), "key long, found binary"), "full")
    ready = parts.join(full, "key").select("root", "part", "key", "found").repartition("root", "part").sortWithinPartitions("root", "part")
    return ready.mapInArrow(lean(_exact), "a long, b long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each component of near copies: that of smallest id, nulls last, and of least text hash.

    Words are what stands between ASCII white space, A-Z lower-cased. Texts without words, null too, are copies of each other. All columns are kept.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("t"), text.cast("binary").alias("text"))
    texts = rows.select("t", "text")
    last = spark.sparkContext.broadcast(_last(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingles(t) for t in b.column(2).to_pylist()]
            more = [pa.array([_key(x) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([_sketch(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], ["doc_id", "t", "key", "n", "sketch"])

    marks = stored(rows.mapInArrow(lean(run), f"doc_id {kind}, t long, key long, n long, sketch binary"), "marks")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    sets = stored(marks.groupBy("key").agg(F.min(rank).alias("best"), *[F.first(c).alias(c) for c in ("t", "n", "sketch")]), "sets")
    roots = stored(components(links(texts, sets, last)), "roots")
    group = sets.select("key", "best").join(told(roots.withColumnRenamed("node", "key"), MAX_BROADCAST_ROWS), "key", "left")
    kept = group.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("best").alias("best")).select("best.doc_id", "best.t")
    kept = stored(kept, "kept")

    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t"] == b["t"])
    all_ = marks.groupBy("doc_id", "t").count()
    gone = stored(all_.join(kept, same(all_, kept), "left_anti").select("doc_id", "t"), "gone")
    twice = stored(all_.where("count > 1").join(kept, same(all_, kept), "left_semi").select("doc_id", "t"), "twice")
    mark, row = fresh(docs.columns, "t"), fresh(docs.columns, "row")
    marked = docs.withColumn(mark, F.xxhash64(text))
    doc, hash_ = fresh(docs.columns, "doc"), fresh(docs.columns, "hash")
    pick = lambda df: told(df.select(F.col("doc_id").alias(doc), F.col("t").alias(hash_)), MAX_BROADCAST_ROWS)
    on = F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(mark) == F.col(hash_))
    out = marked.join(pick(gone), on, "left_anti")
    if not twice.isEmpty():
        order = [F.col(c) for c in docs.columns if docs.schema[c].dataType.simpleString() in ("string", "bigint", "int", "double")]
        again = marked.join(pick(twice), on, "left_semi").withColumn(row, F.row_number().over(Window.partitionBy(id_col, mark).orderBy(*order)))
        out = out.join(pick(twice), on, "left_anti").unionByName(again.where(F.col(row) == 1).drop(row))
    return out.drop(mark)
