import random

import pytest
import xxhash

from sparkann.llm import simhash
from sparkann.llm.common import components

SCHEMA = "doc_id long, text string, fp string, component_id int, `__key` int, key int"


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """doc ids and fingerprints to the smallest id that is reachable."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((d, min(ids, default=None)))
    return out


TEXTS = [None, "", " \t\n", "One", "one", "ONE two", "É é\u00a0x y", "a b c", "a b c d e f g", "x " * 5000, "a  b\tc", "a b c"]


def test_fingerprint_is_as_defined():
    for t in TEXTS:
        assert simhash.simhash(None if t is None else t.encode()) == brute_fingerprint(t)
    long = " ".join(str(i) for i in range(70_000))
    assert simhash.simhash(long.encode()) == brute_fingerprint(long)


def near_docs(n=60):
    r = random.Random(3)
    docs = []
    for g in range(n // 6):
        words = [r.choice("abcdefghijklmnop") * r.randint(1, 4) for _ in range(400)]
        for _ in range(6):
            w = list(words)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = "zz"
            docs.append(" ".join(w))
    r.shuffle(docs)
    return docs


def test_against_all_pairs_with_edge_cases(spark):
    rows = [(i * 3 if i != 5 else None, t) for i, t in enumerate(TEXTS + near_docs())] + [(6, "One"), (6, "One")]
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = brute_components(prints)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r.fp & (2**64 - 1) for r in got) == sorted(f for _, f in prints)


@pytest.mark.parametrize("block", [2, 7])
def test_hot_buckets_are_split_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    base = 0x0123456789ABCDEF
    r = random.Random(1)
    fps = {base}
    while len(fps) < 40:
        fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for limit in (100_000, 1):
        monkeypatch.setattr(simhash, "MAX_BROADCAST_BUCKETS", limit)
        roots = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
        groups = {}
        for x in roots:
            groups.setdefault(x.root, set()).add(x.node & (2**64 - 1))
        want = {}
        for f, c in brute_components([(f, f) for f in fps]):
            want.setdefault(c, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3)]
    got = components(spark.createDataFrame(path, "a long, b long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.root, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [list(range(51)), list(range(100, 130)), [500]]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
