import zlib

import numpy as np
import pytest

from sparkann.llm import toxicity as T
from sparkann.llm import url_filter as U

URLS = {
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    "no scheme/en/": ("", "", None, "allow"),
    "http://Example.COM/en/7?x": ("example.com", "/en/7", "example.com/en/7", "allow"),
    "http://a.example.com/en/8#y": ("a.example.com", "/en/8", "com/en/", "block"),
    "http://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
    "http://x.net/de/8": ("x.net", "/de/8", "net/de/", "allow"),
    "http://notexample.net/de/8": ("notexample.net", "/de/8", "net/de/", "allow"),
    "ftp://h.org?q=/es/": ("h.org", "", None, "allow"),
    "x://y://z/es/": ("y:", "//z/es/", None, "allow"),
    "https://casino-win.example.org/fr/3": ("casino-win.example.org", "/fr/3", None, "block"),
    "http://org/es/1": ("org", "/es/1", "org/es/", "block"),
}


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(None, "http://org/es/1", "h", 1)], "page_id long, url string, html string, score int")
    got = U.judge(df).collect()
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == list(URLS.values())[r.page_id]
    assert len(got) == len(URLS) + 1 and U.judge(df.limit(0)).count() == 0


def test_url_rules_against_a_plain_scan():
    table = U.Rules(U.RULES)
    for host in ("com", "example.com", "a.b.example.net", "net", "example.org", "", "xcom"):
        for path in ("", "/", "/en/", "/en/7x", "/de/8/", "/de/", "/es/"):
            fits = [(len(h) + len(p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
            want = max(fits)[1:] if fits else None
            assert table.find(host, path) == want


# Names with words that such hosts are known by, and others; none of them, nor their hosts, is in the training table.
UNSEEN = {
    1: ["malware-drop", "gambling-hub", "porn-hub", "poker-room", "viagra-shop", "bet-house", "adult-zone", "spam-king", "track-pixel", "pills4you", "casino-lux", "hotbets", "cheap-cialis", "free-casino", "lottery-scam", "phishing-kit", "xxx-movies", "adult-dating", "click-ads", "torrent-hack"],
    0: ["oak-hill", "theron", "river-side", "book-club", "maths-help", "tionsh", "quiet-garden", "train-times", "school-dinners", "cheese-shop", "thing-the-re", "coastal-path", "bird-watch", "chess-club", "linguistics", "village-hall", "hospital-care", "film-review", "paint-box", "orchard"],
}


def test_url_classifier_on_names_it_has_not_seen():
    w = U.train()
    assert (w == U.train()).all()
    assert all((U.probability(w, *U.split_url(u)) >= 0.5) == bool(y) for u, y in U.labelled())
    assert not set(UNSEEN[0] + UNSEEN[1]) & set(U.BLOCKED + U.ALLOWED)
    share = {y: np.mean([U.probability(w, f"{n}.{end}", path) >= 0.5 for n in names for end, path in (("example.com", "/en/3"), ("net", "/"), ("example.org", "/fr/77.html"))]) for y, names in UNSEEN.items()}
    assert share[1] > 0.6 and share[0] < 0.05


def test_no_host_of_pages_is_in_the_training_table(spark):
    for sf in ("0.01", "0.1"):
        urls = [r.url for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select("url").collect()]
        words = {x for u in urls for x in U.split_url(u)[0].split(".")} - {"www", "m", "blog", "example", "com", "net", "org"}
        assert len(words) > 20 and not words & set(U.BLOCKED + U.ALLOWED)


def test_training_against_plain_loops():
    rows = [("http://aaa.b/c", 1), ("http://bbb.b/c", 0), ("http://aab.b/d?e", 1), ("http://xyz.b/", 0)]
    w = dict.fromkeys(range((1 << U.BITS) + 1), 0.0)
    xs = [(U.features(*U.split_url(u)).tolist(), y) for u, y in rows]
    for _ in range(U.EPOCHS):
        gs = [1 / (1 + np.exp(-(sum(w[i] for i in x) / len(x) ** 0.5 + w[1 << U.BITS]))) - y for x, y in xs]
        used = {i for x, _ in xs for i in x}
        step = {i: sum(g / len(x) ** 0.5 for g, (x, _) in zip(gs, xs, strict=True) if i in x) / len(xs) + U.L2 * w[i] for i in used}
        for i, d in step.items():
            w[i] -= U.RATE * d
        w[1 << U.BITS] -= U.RATE * sum(gs) / len(gs)
    got = U.train(rows)
    assert got == pytest.approx(np.array([w[i] for i in range((1 << U.BITS) + 1)]), abs=1e-6)


def test_long_and_repeated_urls(spark):
    long = "http://spam-spam-spam.com/" + "a/" * 500_000
    rows = [(1, long), (1, long), (2, "http://" + "x" * 300_000), (3, "http://org/es/" + "?" * 100_000)] * 2
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 8 and {r.path for r in got if r.page_id == 1} == {long[len("http://spam-spam-spam.com") :]}
    assert len({(r.verdict, r.score) for r in got if r.page_id == 1}) == 1
    assert {(r.rule, r.verdict) for r in got if r.page_id == 3} == {("org/es/", "block")}


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    weights = T.fit(docs.where(~T.held_out("doc_id")), labels)
    assert len(weights[0]) < 1 << 14
    held = T.score(docs.where(T.held_out("doc_id")), weights).join(labels, "doc_id").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id)
    hit = held[held.toxic == 1].predicted.mean()
    wrong = held[held.toxic == 0].predicted.mean()
    assert hit > 0.8 and wrong < 0.01


def test_ftrl_against_plain_loops():
    r = np.random.default_rng(2)
    rows = [(np.unique(r.integers(0, 40, 6)), int(v)) for v in r.integers(0, 2, 80)]
    n, z, top = {}, {}, 1 << T.BITS

    def weight(i):
        l1 = 0.0 if i == top else T.L1
        return 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((T.BETA + n.get(i, 0) ** 0.5) / T.ALPHA + T.L2)

    for _ in range(T.PASSES):
        for x, y in rows:
            at = [*x.tolist(), top]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in at:
                s = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / T.ALPHA
                z[i] = z.get(i, 0) + g - s * w[i]
                n[i] = n.get(i, 0) + g * g
    want = {i: weight(i) for i in z if weight(i)}
    at, w = T.train(rows)
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx(want)


def test_toxicity_edge_cases(spark):
    df = spark.createDataFrame([(1, "you idiot", 1), (2, None, 1), (3, "", 1), (None, "fine words", 1), (4, "ok " * 100_000, 1), (1, "you idiot", 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    got = T.score(df, T.fit(df, labels)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    untrained = T.fit(df, labels.limit(0))
    assert {r.score for r in T.score(df, untrained).collect()} == {0.5} and T.score(df.limit(0), untrained).count() == 0


def test_an_id_that_is_repeated_is_one_row_of_the_sample(spark, monkeypatch):
    """However often an id stands there, with one text or with several, the training task gets one row of it."""
    monkeypatch.setattr(T, "SAMPLE_ROWS", 40)
    schema = "doc_id long, text string"
    plain = [(i, f"word{i} fine text" if i % 2 else f"nasty{i} idiot") for i in range(30)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(30)], "doc_id long, toxic int")
    once = T.fit(spark.createDataFrame(plain, schema), labels)
    many = T.fit(spark.createDataFrame(plain + [plain[4]] * 3000, schema).repartition(7), labels)
    assert (once[0] == many[0]).all() and once[1].tolist() == many[1].tolist()
    texts = [(4, f"text {i}") for i in range(500)]
    several = T.fit(spark.createDataFrame([r for r in plain if r[0] != 4] + texts, schema), labels)
    hashes = {r.t: r.text for r in spark.createDataFrame(texts, schema).select(T.F.xxhash64("text").alias("t"), "text").collect()}
    alone = T.fit(spark.createDataFrame([r for r in plain if r[0] != 4] + [(4, hashes[min(hashes)])], schema), labels)
    assert several[1].tolist() == alone[1].tolist()


def test_the_sample_is_bounded_by_features_too(monkeypatch):
    rows = [(np.arange(k, dtype=np.uint32), k % 2) for k in (5, 4, 3, 1)]
    assert T._within(iter(rows)) == rows
    monkeypatch.setattr(T, "SAMPLE_FEATURES", 10)
    assert T._within(iter(rows)) == rows[:2]
