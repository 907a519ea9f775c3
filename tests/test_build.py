import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import build, graph, ivf, knn, queues, traversal
from sparkann.sources import binary
from tests.test_knn import table


def test_layer_search_of_a_build_is_exact_when_wide():
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 5))
    made = build.Layers(5, 6, 300)
    for v in x:
        made.insert(v, 0)
    assert made.count == 300 and all(len(n) <= 12 and len(set(n)) == len(n) and k not in n for k, n in made.links[0].items())
    d = ((x - x[7]) ** 2).sum(1)
    got = made._search(x[7], [(float(made._far([made.entry], x[7])[0]), made.entry)], 0)
    assert [n for _, n in got][:10] == np.argsort(d, kind="stable")[:10].tolist()


def test_diverse_of_a_build_by_definition():
    r = np.random.default_rng(4)
    made = build.Layers(4, 5, 10)
    made.vectors = r.normal(size=(40, 4))
    q = r.normal(size=4)
    near = sorted(zip(made._far(list(range(40)), q).tolist(), range(40), strict=True))
    want = []
    for d, x in near:
        if len(want) < 5 and all(((made.vectors[y] - made.vectors[x]) ** 2).sum() > d for y in want):
            want.append(x)
    assert made._diverse(near, 5) == want and made._diverse(near[:3], 5) == [x for _, x in near[:3]]


def test_inserted_by_shards_and_searched(spark):
    v = table(spark, np.random.default_rng(6).normal(size=(400, 8))).withColumn("label", F.lit(0)).checkpoint()
    edges = build.inserted(v, 8, 40, shards=2).checkpoint()
    assert edges.where("src % 2 <> shard or dst % 2 <> shard").isEmpty() and edges.select("src").distinct().count() == 400
    whole = build.inserted(v, 8, 40).checkpoint()
    q = v.where("node_id % 20 = 0").select(F.col("node_id").alias("qid"), "embedding")
    assert build.recall_of(v, whole, q, 40) >= 0.95
    assert build.inserted(v.limit(0), 8).isEmpty()


def test_too_large_a_shard_is_refused(spark, monkeypatch):
    monkeypatch.setattr(build, "MAX_SHARD_ROWS", 3)
    with pytest.raises(ValueError, match="shard"):
        build.inserted(table(spark, np.eye(9)), 4, shards=2)


def test_more_new_points_than_marked_places(spark):
    v = table(spark, np.eye(6)).withColumn("label", F.col("node_id"))
    marked = build.mark(v, spark.createDataFrame([(1,), (4,), (4,)], "node_id long"))
    new = spark.createDataFrame([(70 + k, [float(k)] * 6) for k in range(4)], "label long, embedding array<double>").select("label", F.col("embedding").cast(v.schema["embedding"].dataType).alias("embedding"))
    got = {r.node_id: (r.label, r.deleted) for r in build.replace_deleted(marked, new).collect()}
    assert got == {0: (0, False), 1: (70, False), 2: (2, False), 3: (3, False), 4: (71, False), 5: (5, False), 6: (72, False), 7: (73, False)}
    assert {r.node_id for r in build.unmark(marked, marked.select("node_id")).where("deleted").collect()} == set()


def test_a_hub_is_pruned_like_any_node(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 4))
    v = table(spark, x)
    d = ((x - x[0]) ** 2).sum(1)
    star = spark.createDataFrame([(0, i, float(d[i])) for i in range(1, 500)] + [(i, 0, float(d[i])) for i in range(1, 500)], "src long, dst long, dist double")
    got = [r.dst for r in graph.select_diverse(star, v, 6).where("src = 0").orderBy("pos").collect()]
    want = []
    for i in np.argsort(d, kind="stable")[1:]:
        if len(want) < 6 and all(((x[j] - x[i]) ** 2).sum() > d[i] for j in want):
            want.append(int(i))
    assert got == want
    filled = [r.dst for r in graph.select_diverse(star, v, 6, fill=True).where("src = 0").collect()]
    assert len(filled) == 6 and set(want) <= set(filled)


def test_rotation_quantizes_better(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(8, 8)) * np.array([8, 4, 2, 1, 0.5, 0.2, 0.1, 0.05])[:, None]
    v = table(spark, r.normal(size=(600, 8)) @ mix).select("node_id", "embedding").checkpoint()
    turn = ivf.rotation(v, 4, 8, 8)
    assert np.allclose(turn @ turn.T, np.eye(8), atol=1e-9)

    def error(rows):
        book = ivf.trained_codebook(rows, 4, 8, 8)
        words = {(w.part, w.code): np.array(w.word) for w in book.collect()}
        x = {q.node_id: np.array(q.embedding, float) for q in rows.collect()}
        return sum(((x[c.node_id] - np.concatenate([words[p, k] for p, k in enumerate(c.code)])) ** 2).sum() for c in ivf.encode(rows, book, 4, 8).collect())

    assert error(ivf.rotated(v, turn)) < error(v)
    index = ivf.build(v, "OPQ4,IVF4,PQ4", 8, 8)
    q = v.where("node_id < 20").select(F.col("node_id").alias("qid"), "embedding")
    found = ivf.search_index(q, index, 4, 20)
    assert found.where("qid = node_id").count() >= 18 and found.count() == 400


def test_factory_strings():
    assert ivf.factory("OPQ8,IVF64,PQ8") == (True, 64, 8) and ivf.factory("IVF4,Flat") == (False, 4, 0) and ivf.factory("PQ16") == (False, 0, 16)
    for bad in ("", "IVF4", "OPQ8,PQ4", "HNSW32"):
        with pytest.raises(ValueError):
            ivf.factory(bad)


@pytest.mark.parametrize("size", [64 << 20, 600])
def test_codes_are_scanned_in_blocks_of_tables(spark, monkeypatch, size):
    monkeypatch.setattr(ivf, "TABLE_BYTES", size)
    r = np.random.default_rng(1)
    v = table(spark, r.normal(size=(200, 8)))
    q = v.where("node_id < 9").select(F.col("node_id").alias("qid"), "embedding")
    book = ivf.sampled_codebook(v, 4, 8, 8)
    codes = ivf.encode(v, book, 4, 8).checkpoint()
    words = {(w.part, w.code): np.array(w.word, float) for w in book.collect()}
    code = {c.node_id: c.code for c in codes.collect()}
    got = {}
    for x in ivf.adc_search(q, codes, book, 4, 8, 5).orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append((x.node_id, round(x.dist, 9)))
    for x in q.collect():
        e = np.array(x.embedding, float)
        far = {n: sum(((e[2 * p : 2 * p + 2] - words[p, k]) ** 2).sum() for p, k in enumerate(c)) for n, c in code.items()}
        assert got[x.qid] == [(n, round(d, 9)) for n, d in sorted(far.items(), key=lambda t: (t[1], t[0]))[:5]]


def test_running_keeps_the_nearest_with_ties():
    r = np.random.default_rng(0)
    best, rows = knn.Running(4), []
    for _ in range(30):
        q, node, dist = r.integers(0, 5, 50), r.integers(0, 10**6, 50), r.integers(0, 40, 50).astype(float)
        edge = best.edges(5)
        keep = dist <= edge[q]
        best.add(q[keep], node[keep], dist[keep])
        best.cut()
        rows += list(zip(q.tolist(), dist.tolist(), node.tolist(), strict=True))
    got = sorted(zip(*(x.tolist() for x in best.cut()), strict=True))
    want = sorted((q, n, d) for k in range(5) for q, d, n in sorted(x for x in rows if x[0] == k)[:4])
    assert got == want


def test_queue_columns_against_lists(spark):
    r = np.random.default_rng(5)
    rows = [(k, [(float(r.integers(0, 9)), int(n)) for n in r.permutation(12)]) for k in range(30)]
    df = spark.createDataFrame(rows, f"k long, items {queues.ITEM}")
    top, rest = queues.pop(F.col("q"), 2)
    got = df.withColumn("q", queues.insert(queues.empty(), F.col("items"), 5)).select("k", "q", top.alias("top"), rest.alias("rest"), queues.threshold(F.col("q"), 5).alias("t")).collect()
    for x in got:
        want: list = []
        for item in rows[x.k][1]:
            if len(want) == 5 and not item[0] < want[-1][0]:
                continue
            want = sorted([*want[:4], item] if len(want) == 5 else [*want, item])
        assert [tuple(i) for i in x.q] == want and x.t == want[-1][0]
        assert [tuple(i) for i in x.top] == want[:2] and [tuple(i) for i in x.rest] == want[2:]
    assert df.select(queues.threshold(queues.empty(), 5)).first()[0] == traversal.NONE


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "fbin", "i8bin", "raw"])
def test_files_are_read_by_ranges(spark, tmp_path, kind):
    m = np.arange(35 * 3).reshape(35, 3) % 100
    binary.write_files(table(spark, m), f"file://{tmp_path}/x", kind, part_rows=20)
    rows = binary.read_vectors(spark, f"{tmp_path}/x", kind, dim=3, range_rows=4)
    assert rows.rdd.getNumPartitions() > 1
    got = sorted((r.file[-12:], r.node_id, list(r.embedding)) for r in rows.collect())
    assert [x[2] for x in got] == m.tolist() and [x[1] for x in got] == [*range(20), *range(15)]
    bad = tmp_path / f"bad.{kind}"
    bad.write_bytes(b"\\x03\\0\\0\\0\\x03\\0\\0\\0x")
    with pytest.raises(Exception, match="fit"):
        binary.read_vectors(spark, str(bad), kind, dim=3).collect()


def test_work_rises_with_what_is_in_flight(spark):
    """Hops and visited nodes grow with mc and mg, and recall doesn't fall, as the recorded runs have it."""
    v = table(spark, np.random.default_rng(12).normal(size=(600, 12))).checkpoint()
    e = graph.with_reverse(graph.knn_graph(v, 8), 16).checkpoint()
    q = v.where("node_id % 10 = 0").select(F.col("node_id").alias("qid"), "embedding")
    cases = [(24, 32, mc, mg) for mc in (1, 2, 4) for mg in (1, 2, 4)]
    got = {(r.mc, r.mg): r for r in traversal.sweep(q, v, e, graph.medoid(v).first().node_id, cases, knn.knn(q, v, 10, exclude_self=False)).collect()}
    assert len(got) == 9
    for mc in (1, 2, 4):
        for a, b in ((1, 2), (2, 4)):
            assert got[mc, a].avg_hops < got[mc, b].avg_hops and got[mc, a].avg_visited < got[mc, b].avg_visited
            assert got[a, mc].avg_hops < got[b, mc].avg_hops and got[mc, b].recall_10 >= got[mc, a].recall_10 - 0.01
    plain = traversal.search(q, v, e, graph.medoid(v).first().node_id, 24, 32, 2, 4, "stats").agg(F.avg("hops"), F.avg("visited")).first()
    assert (got[2, 4].avg_hops, got[2, 4].avg_visited) == tuple(plain)


def test_points_are_inserted_once(spark, tmp_path, monkeypatch):
    """The query reads its links many times; the vectors of a search are gathered once for all levels."""
    from sparkann.plans import file_queries
    from sparkann.session import ship

    ship(spark)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.random.default_rng(12).normal(size=(300, 8)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    runs, inserted = spark.sparkContext.accumulator(0), build.inserted

    def counted(*a, **b):
        def seen(batches):
            runs.add(1)
            yield from batches

        made = inserted(*a, **b)
        return made.mapInArrow(seen, made.schema)

    monkeypatch.setattr(build, "inserted", counted)
    got = file_queries.x4_inserted_points(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(300, 0, 0, 0, True, True)] and runs.value == 1


def test_levels_share_their_vectors(spark):
    v = table(spark, np.eye(5))
    edges = spark.createDataFrame([(0, 1, 2, 0), (0, 1, 9, 1), (2, 4, 0, 0), (2, 4, 3, 1)], "level int, src long, dst long, pos int")
    got = traversal.load_layers(v, edges, 2)
    assert [got[0].of(1).tolist(), got[2].of(4).tolist(), got[1].links.tolist()] == [[2], [0, 3], []] and got[0].vectors is got[2].vectors
    alone = traversal.load(v, edges.where("level = 2"))
    assert alone.of(4).tolist() == [0, 3] and alone.starts.tolist() == got[2].starts.tolist()


def test_insertion_loses_no_node():
    """Each node has a link to it, as counted, and degrees hold; a node in a hub's shadow keeps its last link."""
    r = np.random.default_rng(3)
    for x in (r.normal(size=(1500, 32)), np.r_[np.zeros((1, 8)), r.normal(size=(300, 8)), np.zeros((40, 8))]):
        made = build.Layers(x.shape[1], 4, 16)
        for k, v in enumerate(x):
            made.insert(v, int(k % 9 == 0))
        for lv, links in enumerate(made.links):
            into = dict.fromkeys(links, 0)
            for node, near in links.items():
                assert len(near) <= (4 if lv else 8) and len({*near}) == len(near) and node not in near
                for y in near:
                    into[y] += 1
            assert into == made.into[lv] and min(into.values()) > 0


def test_a_node_without_place_is_taken_in():
    made = build.Layers(1, 1, 4)
    made.vectors = np.arange(6.0)[:, None]
    made.links, made.into = [{0: [1, 2, 3], 1: [4, 5], 2: [0, 5], 3: [0], 4: [0], 5: [0]}], [{0: 4, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2}]
    made._prune(0, 0, 2)
    assert len(made.links[0][0]) == 2 and min(sum(y in n for n in made.links[0].values()) for y in range(6)) == 1
    assert {y: sum(y in n for n in made.links[0].values()) for y in range(6)} == made.into[0]


def test_recall_of_inserted_points_holds_in_larger_tables(spark, tmp_path):
    """More points than m and ef find in one graph: they are dealt to shards, whatever their ids."""
    from sparkann.plans import file_queries
    from sparkann.session import ship

    ship(spark)
    x = np.random.default_rng(13).normal(size=(3000, 64))
    rows = [(30 * i, [float(e) for e in v / np.linalg.norm(v)], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [tuple(r) for r in file_queries.x4_inserted_points(spark, str(tmp_path)).collect()] == [(3000, 0, 0, 0, True, True)]


def test_dealt_evenly_in_the_order_of_ids(spark):
    v = table(spark, np.eye(23)).select((F.col("node_id") * 12 - 60).alias("node_id"), "embedding")
    got = build.dealt(v, 4).orderBy("node_id").collect()
    assert [r.shard for r in got] == [k % 6 for k in range(23)] and [r.node_id for r in got] == [12 * k - 60 for k in range(23)]
    assert [list(r.embedding) for r in got] == np.eye(23).tolist()
    assert build.dealt(v, 23).agg(F.max("shard")).first()[0] == 0 and build.dealt(v.limit(0), 4).isEmpty()


def test_shards_are_searched_as_layered_graphs(spark, monkeypatch):
    """Each shard by the layered search, what they find merged; also with more queries than fit a block."""
    v = build.dealt(table(spark, np.random.default_rng(14).normal(size=(500, 6))), 170).checkpoint()
    edges = build.inserted(v, 4, 12).checkpoint()
    q = v.where("node_id % 10 = 0").select(F.col("node_id").alias("qid"), "embedding").checkpoint()
    parts = []
    for s in range(3):
        own, links = v.where(F.col("shard") == s), edges.where(F.col("shard") == s)
        level = build.hashed_level(F.col("node_id"), 4)
        entry = own.select("node_id", level.alias("l")).orderBy(F.desc("l"), "node_id").first()
        parts.append(traversal.layered_search(q, own.drop("shard"), links, entry.node_id, entry.l, 12))
    want = {tuple(r) for r in knn.merge(parts, 7).select("qid", "rank", "node_id", "dist").collect()}
    rows = build.searched(q, v, edges, 4, 12, 7).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) == 350
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1000)
    assert {tuple(r) for r in build.searched(q, v, edges, 4, 12, 7).collect()} == want
    assert build.searched(q.limit(0), v, edges, 4, 12, 7).isEmpty() and build.searched(q, v.limit(0), edges, 4, 12, 7).isEmpty()
