import hashlib

import numpy as np
import pytest

from sparkann.llm import order_minhash as O


def brute(text):
    kmers, base = O.numbered(text or "")
    out = []
    for j in range(O.COMPONENTS):
        h = [((int(v) * int(O._MULTIPLIERS[j])) & 0xFFFFFFFF) ^ int(O._SHIFTS[j]) for v in base]
        value = np.array([j], np.uint32)
        for i in sorted(sorted(range(len(h)), key=lambda i: (h[i], i))[: O.TUPLE]):
            value = O._mix(value * O._P + kmers[i])
        out.append(1 + int(value[0]) % 0xFFFF if len(h) else 0)
    return np.array(out, np.uint16)


TEXTS = ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "ab" * 40, "l'été \U0001f600 " * 30, "the quick brown fox jumps over the lazy dog " * 60]


def test_fingerprints_are_as_defined():
    for t in TEXTS:
        assert (O.fingerprint(t) == brute(t)).all()
    assert (O.fingerprint(None) == 0).all()


def test_occurrences_are_numbered():
    _, one = O.numbered("abcdefgh" * 3)
    assert len(set(one.tolist())) == len(one)
    kmers, _ = O.numbered("abcdefgh" * 3)
    assert kmers[0] == kmers[8] == kmers[16]


def test_likeness_follows_edits_and_order():
    r = np.random.default_rng(0)
    text = "".join(chr(97 + x) for x in r.integers(0, 26, 3000))
    few = text[:1000] + "!" + text[1001:]
    many = "".join("!" if i % 20 == 0 else c for i, c in enumerate(text))
    swapped = text[1500:] + text[:1500]
    f = O.fingerprint
    near, far, moved = (O.likeness(f(text), f(x)) for x in (few, many, swapped))
    assert near > 0.9 > moved > 0.3 and far < near and far < 0.5
    assert O.likeness(f(text), f(text)) == 1.0


def ordered(spark, data):
    """By descending id, nulls last, then by descending text hash."""
    found = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in data], "t string").select("t", O.F.xxhash64("t").alias("h")).collect()}
    return sorted(data, key=lambda r: (r[0] is None, -(r[0] or 0), -found[r[1] or ""]))


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_compare_against_a_loop(spark, monkeypatch, rows):
    monkeypatch.setattr(O, "RANGE_ROWS", rows)
    data = [(7, TEXTS[7]), (3, None), (9, TEXTS[6]), (9, TEXTS[5]), (None, "null id"), (-4, TEXTS[7]), (12, TEXTS[4]), (3, "again"), (3, "again"), (100, "")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, fingerprint string, `range` int")
    got = sorted((tuple(r) for r in O.compare(df).collect()), key=repr)
    order = ordered(spark, data)
    want = []
    for k, (i, t) in enumerate(order):
        a, b = t or "", order[(k + 1) % len(order)][1] or ""
        e = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        want.append((i, len(a), hashlib.sha256(e.encode()).hexdigest(), O.hex_of(brute(a)), O.hex_of(brute(e)), O.likeness(brute(a), brute(e)), O.likeness(brute(a), brute(b))))
    assert got == sorted(want, key=repr)


def test_empty_table_and_single_row(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert O.compare(df.limit(0)).count() == 0
    assert O.compare(df).first().near_next == 1.0


@pytest.mark.parametrize("key", [7, None])
def test_a_hot_id_is_dealt_over_ranges(spark, monkeypatch, key):
    monkeypatch.setattr(O, "RANGE_ROWS", 20)
    data = [(key, f"text number {i}") for i in range(300)] + [(key, "the same text")] * 200 + [(i, f"other {i}") for i in range(100, 130)] + [(i, "low") for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    dealt = O.with_following(df, "doc_id", "text").where("guard = 0").groupBy("range").agg(O.F.count("*").alias("rows"), O.F.sum("n").alias("n")).collect()
    assert sum(r.n for r in dealt) == len(data) and max(r.rows for r in dealt) < 100 and len(dealt) > 8
    got = sorted((tuple(r)[:3] for r in O.compare(df).collect()), key=repr)
    order, want = ordered(spark, data), []
    for k, (i, a) in enumerate(order):
        want.append((i, len(a), hashlib.sha256(O.edited(a, order[(k + 1) % len(order)][1]).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError, match="integer"):
        O.compare(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
