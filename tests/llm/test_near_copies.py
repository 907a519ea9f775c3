import random

import numpy as np

import corpus_pipeline as P
from sparkann.llm import near_copies as N

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def brute_set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Indexes of rows that stay, by all pairs."""
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for g in groups.values()]


def near_texts():
    r = random.Random(5)
    texts = []
    common = [r.choice("abcdefgh") * r.randint(1, 9) for _ in range(40)]
    for _ in range(12):
        base = [str(r.randrange(500)) for _ in range(r.choice([6, 12, 30, 80, 300]))]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = "zz"
            texts.append(" ".join(w + common if r.random() < 0.2 else w))
    r.shuffle(texts)
    return texts


def test_against_all_pairs_with_edge_cases(spark, monkeypatch):
    rows = [(i * 7 % 1000, t) for i, t in enumerate(near_texts() + ["One two", "one  TWO", "one", "", None, "\n", "a b c d e"])]
    rows += [(None, "nobody has this text but me"), (None, rows[0][1]), (3000, "twice"), (3000, "thrice")]
    df = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], SCHEMA)
    want = sorted((rows[i][0] is None, rows[i][0] or 0) for i in brute_kept(rows))
    for block, order in ((1 << 18, 16), (400, 1)):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "SAMPLED", order)
        monkeypatch.setattr(N, "SAMPLE", order)
        got = P.unique(spark, df, "")
        assert got.columns == df.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == want


def test_repeated_rows_and_an_empty_table(spark):
    df = spark.createDataFrame([(5, "a b", "x", "s", 1)] * 3 + [(5, "c d", "x", "s", 1)] * 2, SCHEMA)
    assert sorted(r.text for r in N.deduplicate(df).collect()) == ["a b", "c d"]
    assert N.deduplicate(df.limit(0)).count() == 0


def test_one_of_each_stays_and_rows_without_id(spark):
    rows = [(5, "a b c d"), (2, "a b c d"), (2, "a b c d"), (9, "other words are here"), (None, "a b c d"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], SCHEMA)
    got = N.deduplicate(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, r.text or "") for r in got.collect()), key=repr)
    assert kept[:2] == [(2, "a b c d"), (9, "other words are here")] and {k for k in kept[2:]} == {(None, "")}


def sets_at_the_limit(r):
    """Two sets of similarity 0.8 or a little more, of 1 to 600 shingles, some of whose hashes are in clumps, so that many segments are empty."""
    while True:
        n = int(np.exp(r.uniform(0, np.log(600))))
        u = r.integers(0, 1 << 64, 2 * n + 20, dtype=np.uint64)
        if r.random() < 0.5:
            u = (u[r.integers(0, n // 6 + 1, len(u))] & ~np.uint64((1 << 50) - 1)) | u & np.uint64((1 << 50) - 1)
        u = r.permutation(np.unique(u))
        gone, more = int(r.integers(0, n // 5 + 1)), int(r.integers(0, n // 4 + 1))
        if gone + more and 5 * (n - gone) >= 4 * (n + more):
            return np.sort(u[:n]), np.sort(u[gone : n + more]), u


def test_similar_sets_meet_in_a_ring_and_pass_its_second_step():
    r = np.random.default_rng(7)
    for _ in range(1500):
        a, b, u = sets_at_the_limit(r)
        for last in (u[:0], np.sort(u[r.random(len(u)) < r.random()])):
            (h, v), (k, w) = N.ring_keys(a, last), N.ring_keys(b, last)
            _, i, j = np.intersect1d(h, k, return_indices=True)
            assert N.second_near(v[i], w[j]).any(), (a, b, last)


def test_segments_are_simhashes_and_the_second_step_tells_those_two_shingles_away():
    r = np.random.default_rng(3)
    for n in range(1, 9):
        x = r.integers(0, 1 << 64, n + 2, dtype=np.uint64)
        bits = [[(int(h) >> k) & 1 for h in x] for k in range(64)]
        mark = lambda idx: np.array([(len(idx) << 48) | sum((2 * sum(b[i] for i in idx) > len(idx)) << k for k, b in enumerate(bits[:48]))], np.uint64)  # noqa: B023, E731
        whole = list(range(n))
        ones = N._bits(x[:n]).sum(0)[None]
        assert int(N._simhash(ones, np.array([n]))[0]) & (1 << 48) - 1 == int(mark(whole)[0]) & (1 << 48) - 1
        assert N.second_near(mark(whole), mark(whole))[0] and N.second_near(mark(whole), mark([*whole, n]))[0] and N.second_near(mark([*whole, n]), mark(whole))[0]
        assert not N.second_near(mark(whole), mark([*whole, n, n + 1]))[0] and not N.second_near(mark(whole), mark([*whole[1:], n]))[0]


def test_links_come_by_the_ring_only(spark, monkeypatch):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], "zz", *base[i + 1 :]])) for i in (5, 50, 180)] + [(100, " ".join(f"v{i}" for i in range(200)))]
    df = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(r.doc_id for r in P.unique(spark, df, "").collect()) == [5, 100]
    monkeypatch.setattr(N, "ring_keys", lambda found, last: (np.zeros(0, np.uint64),) * 2)
    assert sorted(r.doc_id for r in P.unique(spark, df, "").collect()) == [5, 50, 100, 180]
