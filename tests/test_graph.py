import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkann.operators import evaluation, graph, knn, superstep, traversal
from tests.test_knn import table


@pytest.fixture(scope="module")
def small(spark):
    v = table(spark, np.random.default_rng(5).normal(size=(120, 6))).checkpoint()
    e = graph.with_reverse(graph.knn_graph(v, 6), 12).checkpoint()
    return v, e, graph.medoid(v).first().node_id


def twin(ids, vec, adj, q, entry, ef, cq, mc, mg):
    """The search's definition, with plain lists: groups are evaluated in order, the oldest is waited for."""
    dist = lambda x: float(np.cumsum((vec[x] - q) ** 2)[-1])
    result, pool, seen, hops, visited, flight = [], [], set(), 1, 0, []

    def run(group):
        nonlocal visited, result
        got = []
        for c in group:
            for x in adj[c]:
                if x in seen:
                    continue
                seen.add(x)
                visited += 1
                d = dist(x)
                if d < (result[-1][0] if len(result) == ef else 1e20):
                    result = sorted([*result, (d, x)])[:ef]
                    got.append((d, x))
        return got, result[-1][0] if len(result) == ef else 1e20

    flight.append(run([entry]))
    while flight:
        got, t = flight.pop(0)
        pool = sorted([*pool, *got])[:cq]
        while len(flight) < mg:
            group = [x for d, x in pool[:mc] if d <= t]
            if not group:
                break
            pool, hops = pool[len(group) :], hops + len(group)
            flight.append(run(group))
    return result, hops, visited


def plain(v, e):
    vec = {r.node_id: np.array(r.embedding, float) for r in v.collect()}
    adj = {i: [] for i in vec}
    for r in e.orderBy("src", "pos", "dst").collect():
        adj[r.src].append(r.dst)
    return vec, adj


@pytest.mark.parametrize("mc,mg", [(1, 1), (2, 1), (4, 1), (1, 2), (2, 2), (4, 4)])
@pytest.mark.parametrize("ef,cq", [(4, 4), (16, 32)])
def test_search_equals_its_definition(spark, small, mc, mg, ef, cq):
    v, e, entry = small
    vec, adj = plain(v, e)
    g = traversal.load(v, e)
    for qid in range(8):
        f = traversal.dst_search(g, vec[qid], entry, ef, cq, mc, mg, traced=True)
        result, hops, visited = twin(None, vec, adj, vec[qid], entry, ef, cq, mc, mg)
        assert (f.result, f.hops, f.visited) == (result, hops, visited)
        assert len(f.trace) == f.visited


@pytest.mark.parametrize("mc,mg", [(1, 1), (3, 2)])
def test_superstep_equals_per_query(spark, small, mc, mg):
    v, e, entry = small
    q = v.where("node_id < 3").select(F.col("node_id").alias("qid"), "embedding")
    got, stats = superstep.search(q, v, e, entry, ef=4, cq=4, mc=mc, mg=mg)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(got) == key(traversal.search(q, v, e, entry, 4, 4, mc, mg))
    assert key(stats) == key(traversal.search(q, v, e, entry, 4, 4, mc, mg, "stats"))


def test_disconnected_and_entry_without_links_to_it(spark):
    v = table(spark, np.array([[0.0], [1], [2], [50], [51]]))
    e = spark.createDataFrame([(0, 1, 0), (1, 2, 0), (2, 1, 0), (3, 4, 0), (4, 3, 0)], "src long, dst long, pos int")
    q = v.where("node_id = 4").select(F.col("node_id").alias("qid"), "embedding")
    assert {r.node_id for r in traversal.search(q, v, e, 0, ef=10).collect()} == {1, 2}


def test_ef_one_and_boundary_ties(spark):
    v = table(spark, np.array([[9.0], [1], [-1], [3]]))
    e = spark.createDataFrame([(0, 1, 0), (0, 2, 1), (2, 3, 0), (1, 3, 0)], "src long, dst long, pos int")
    f = traversal.dst_search(traversal.load(v, e), np.array([0.0]), 0, ef=1)
    assert f.result == [(1.0, 1)] and f.hops == 2


def test_too_large_graph_is_refused(spark, small, monkeypatch):
    monkeypatch.setattr(traversal, "MAX_GRAPH_BYTES", 10)
    with pytest.raises(ValueError, match="superstep"):
        traversal.load(*small[:2])


def test_other_searches_find_most(spark, small):
    v, e, entry = small
    q = v.where("node_id < 10").select(F.col("node_id").alias("qid"), "embedding")
    truth = knn.knn(q, v, 5, exclude_self=False)
    g = spark.sparkContext.broadcast(traversal.load(v, e))
    layers, top_entry, top = graph.layered(v, 6)
    for got in (
        traversal.run_queries(q, lambda x: traversal.pool_search(g.value, x, entry, 20)),
        traversal.run_queries(q, lambda x: traversal.layer_search(g.value, x, entry, 20)),
        traversal.layered_search(q, v, layers, top_entry, top, 20),
    ):
        assert evaluation.recall_at(got, truth, [5]).first().recall > 0.85


def test_blocked_nodes_are_walked_through(spark, small):
    v, e, entry = small
    g = traversal.load(v, e)
    even = {i for i in range(120) if i % 2 == 0}
    f = traversal.layer_search(g, g.vectors[1], entry, 10, allowed=even)
    assert len(f.result) == 10 and all(i in even for _, i in f.result)


def test_diverse_selection_by_definition(spark, small):
    v, e, _ = small
    vec, _ = plain(v, e)
    near = graph.knn_graph(v, 12)
    got = {}
    for r in graph.select_diverse(near, v, 4).orderBy("src", "pos").collect():
        got.setdefault(r.src, []).append(r.dst)
    lists = {}
    for r in near.orderBy("src", "pos").collect():
        lists.setdefault(r.src, []).append((r.dist, r.dst))
    for s, items in lists.items():
        kept = []
        for d, x in items:
            if len(kept) < 4 and all(((vec[x] - vec[y]) ** 2).sum() > d for y in kept):
                kept.append(x)
        assert got[s] == kept


def test_navigating_graph_reaches_all(spark, small):
    v = small[0]
    edges, entry = graph.navigating_graph(v, 8, 3)
    assert graph.reachable(edges, entry).count() == 120


def test_updates(spark, small):
    v, e, _ = small
    gone = spark.createDataFrame([(3,), (4,)], "node_id long")
    fixed = graph.repair_after_delete(e, v, gone, 12)
    assert fixed.where("src in (3, 4) or dst in (3, 4)").count() == 0
    bad = graph.integrity(fixed, graph.remove(v, gone)).first()
    assert (bad.self_loops, bad.duplicates, bad.out_of_range) == (0, 0, 0)
    assert graph.integrity(spark.createDataFrame([(1, 1), (1, 1), (1, 999)], "src long, dst long"), v).first()[:3] == (2, 1, 1)


@pytest.mark.parametrize("mc,mg", [(1, 1), (2, 4), (5, 2)])
def test_queues_as_large_as_the_graph(mc, mg):
    """The form for whole graphs finds what the bounded queues find, with ties, far nodes, copies and parts that are not reached; top cuts only what is told."""
    r = np.random.default_rng(10 * mc + mg)
    x = r.integers(0, 4, size=(200, 3)).astype(float)
    x[150:155] = 1e12
    adj = [r.choice(180, 5).tolist() if i < 180 else r.choice(200, 5).tolist() for i in range(200)]
    g = traversal.Graph(np.arange(200) * 3, x, np.r_[0, np.cumsum([len(a) for a in adj])], np.concatenate(adj))
    whole = traversal.Whole(g)
    for q in [x[0], x[190], r.normal(size=3)]:
        for entry in (0, 3 * 195):
            want = traversal.dst_search(g, q, entry, 200, 200, mc, mg)
            assert whole.search(q, entry, mc, mg) == want
            assert whole.search(q, entry, mc, mg, 7).result == want.result[:7]


def test_exhaustive_search_tells_only_what_is_asked(spark, small):
    v, e, entry = small
    q = v.where("node_id < 9").select(F.col("node_id").alias("qid"), "embedding")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    found = traversal.search(q, v, e, entry, ef=120, cq=120, mc=2, mg=2, top=5)
    assert found.count() == 45
    assert key(found) == key(traversal.search(q, v, e, entry, ef=120, cq=119, mc=2, mg=2).where("rank <= 5"))


def test_queries_are_dealt_to_all_tasks(spark, small):
    """Ids that are divisible by 50 too."""
    v, e, entry = small
    q = spark.range(400).select((F.col("id") * 50).alias("qid")).join(v.where("node_id = 0").select("embedding"))
    found = traversal.run_queries(q, lambda x: traversal.Found([(0.0, 1)], 1, 1, []), tasks=8)
    assert min(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) > 20 and found.select(F.spark_partition_id()).distinct().count() == 8
