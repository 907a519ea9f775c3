import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from sparkann.llm import mixing as M


def test_targets_stop_at_three_times_the_size():
    got = M.targets({"b": 10, None: 1000, "a": 5}, 1015)
    # a: weight 1, b: weight 2, null: weight 3
    assert got == {"a": 15.0, "b": 30.0, None: 970.0}
    assert M.targets({"a": 10, "b": 20}, 30) == {"a": 10.0, "b": 20.0}
    assert M.targets({"a": 0}, 0) == {"a": 0.0}


def cost(flow, supply):
    return sum(sum(min(max(sum(f.values()) - k * s, 0), s) * k for k in range(3)) for f, s in zip(flow, supply, strict=True))


def test_flow_is_greatest_and_cheapest_by_brute_force():
    r = random.Random(4)
    for _ in range(40):
        supply = [r.randint(1, 2) for _ in range(2)]
        member = [sorted(r.sample(range(2), r.randint(1, 2))) for _ in range(2)]
        quota = [r.randint(0, 5) for _ in range(2)]
        got = M.route(supply, member, quota)
        assert all(sum(f.values()) <= 3 * s for f, s in zip(got, supply, strict=True))
        assert all(sum(f.get(s, 0) for f in got) <= q for s, q in enumerate(quota))
        best = None
        arcs = [(p, s) for p in range(2) for s in member[p]]
        for values in itertools.product(range(6), repeat=len(arcs)):
            flow = [{}, {}]
            for (p, s), v in zip(arcs, values, strict=True):
                flow[p][s] = v
            if all(sum(f.values()) <= 3 * s for f, s in zip(flow, supply, strict=True)) and all(sum(f.get(s, 0) for f in flow) <= q for s, q in enumerate(quota)):
                rank = (-sum(values), cost(flow, supply))
                best = rank if best is None or rank < best else best
        assert (-sum(sum(f.values()) for f in got), cost(got, supply)) == best


def test_query_contract_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = M.mix(docs).toPandas()
    assert len(got) == docs.count() and (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    by = got.groupby(got.pattern.map(lambda p: p[0])).agg(size=("size", "sum"), known=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.known).all() and abs(by.target.sum() - got["size"].sum()) < 1e-3
    assert ((by.taken - by.target).abs() <= 0.01 * by.target).all()
    again = M.mix(docs.repartition(5)).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d.taken))
    assert key(again) == key(got)


SCHEMA = "doc_id long, source array<string>, text string, `__h` int, copies int, pattern string, size int"
ROWS = [(1, ["a", "b"], "x " * 10), (2, ["a"], "x " * 7), (3, ["b", "b"], "x " * 5), (4, None, "y"), (5, ["a", None], None), (5, ["a", None], "q r"), (None, ["a"], "n"), (6, ["b"], "")]


def test_overlap_and_edge_cases(spark):
    df = spark.createDataFrame([(*r, 1, 2, "p", 3) for r in ROWS], SCHEMA)
    got = M.mix(df).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    out = M.mixed(df)
    assert out.columns == df.columns
    copies = {}
    for r in out.collect():
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    words = {(i, t): len((t or "").split()) for i, _, t in ROWS}
    taken = {(i, t): 0 for i, _, t in ROWS}
    for key, n in copies.items():
        taken[key] += n * words[key]
    assert sum(taken.values()) == sum(r.taken for r in got) and max(copies.values()) <= 3
    assert M.mix(df.limit(0)).count() == 0 and M.mixed(df.limit(0)).count() == 0


def test_a_single_source_and_a_null_one(spark):
    df = spark.createDataFrame([(i, None, "w " * (i + 1)) for i in range(20)], "doc_id long, source string, text string")
    got = M.mix(df).collect()
    assert all(r.taken == r["size"] for r in got) and got[0].target == 210.0


def test_too_many_patterns_are_refused(spark, monkeypatch):
    monkeypatch.setattr(M, "MAX_PATTERNS", 2)
    df = spark.range(5).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("a b").alias("text"))
    with pytest.raises(ValueError, match="patterns"):
        M.mix(df)


def test_a_document_that_straddles_the_bound_leaves_no_gap(spark, monkeypatch):
    ids = spark.range(3001).select("id", M.rank_of(F.col("id")).alias("h"))
    long_one = ids.orderBy("h").collect()[500]["id"]
    size = F.when(F.col("id") == long_one, 300_000).otherwise(200).cast("long")
    sized = M.stored(ids.select(F.array(F.lit("a")).alias("pattern"), size.alias("size"), "h"), "sized")
    monkeypatch.setattr(M, "targets", lambda sizes, total: {"a": 250_000.0})
    taken = M.with_copies(sized, M.plan(sized), "pattern", "h", "copies").agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(taken - 250_000) <= 250


def test_the_straddling_document_is_taken_where_that_is_nearer(spark, monkeypatch):
    sized = M.stored(spark.range(2).select(F.array(F.lit("a")).alias("pattern"), F.lit(1000).cast("long").alias("size"), M.rank_of(F.col("id")).alias("h")), "sized")
    monkeypatch.setattr(M, "targets", lambda sizes, total: {"a": 1900.0})
    assert M.with_copies(sized, M.plan(sized), "pattern", "h", "copies").agg(F.sum(F.col("size") * F.col("copies"))).first()[0] == 2000


def plain_flow(supply, member, quota, times=3):
    """One path after the other, found by a search of its own for each token's amount."""
    flow, left = [dict.fromkeys(m, 0) for m in member], list(quota)
    for _ in range(times):
        for p0, spare in enumerate(supply):
            while spare:
                came, todo, end = {("p", p0): None}, [("p", p0)], None
                for kind, x in todo:
                    if kind == "s" and left[x]:
                        end = (kind, x)
                        break
                    for n in [("s", s) for s in flow[x]] if kind == "p" else [("p", p) for p in range(len(flow)) if flow[p].get(x)]:
                        if n not in came:
                            came[n] = (kind, x)
                            todo.append(n)
                if end is None:
                    break
                path = [end]
                while came[path[-1]]:
                    path.append(came[path[-1]])
                path = path[::-1]
                n = min([spare, left[end[1]]] + [flow[b[1]][a[1]] for a, b in zip(path, path[1:]) if a[0] == "s"])
                for a, b in zip(path, path[1:]):
                    if a[0] == "p":
                        flow[a[1]][b[1]] += n
                    else:
                        flow[b[1]][a[1]] -= n
                spare, left[end[1]] = spare - n, left[end[1]] - n
    return flow


def test_flow_against_single_paths_with_many_overlaps():
    r = random.Random(9)
    for _ in range(30):
        n, k = r.randint(1, 60), r.randint(1, 9)
        supply = [r.randint(0, 50) for _ in range(n)]
        member = [sorted(r.sample(range(k), r.randint(1, k))) for _ in range(n)]
        quota = [r.randint(0, 400) for _ in range(k)]
        got, want = M.route(supply, member, quota), plain_flow(supply, member, quota)
        assert all(0 <= sum(f.values()) <= 3 * s and min(f.values()) >= 0 for f, s in zip(got, supply, strict=True))
        assert all(sum(f.get(s, 0) for f in got) <= q for s, q in enumerate(quota))
        assert (sum(sum(f.values()) for f in got), cost(got, supply)) == (sum(sum(f.values()) for f in want), cost(want, supply))


def test_flow_of_some_thousand_overlapping_patterns():
    r = random.Random(3)
    member = [sorted(x) for x in {frozenset(r.sample(range(40), r.randint(1, 5))) for _ in range(6000)}]
    supply = [r.randint(1, 10**9) for _ in member]
    sizes = [sum(s for s, m in zip(supply, member, strict=True) if k in m) for k in range(40)]
    goal = M.targets({f"{k:02}": s for k, s in enumerate(sizes)}, sum(supply))
    began = time.monotonic()
    flow = M.route(supply, member, [round(goal[f"{k:02}"]) for k in range(40)])
    assert time.monotonic() - began < 30
    got = [sum(f.get(k, 0) for f in flow) for k in range(40)]
    assert all(abs(g - goal[f"{k:02}"]) <= 1 for k, g in enumerate(got))


def test_overlapping_sources_reach_their_targets(spark):
    r = random.Random(1)
    rows = [(i, r.sample(["a", "b", "c", "d", "e"], r.randint(1, 4)), "w " * r.randint(1, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source array<string>, text string")
    sized = M.stored(df.select(M.pattern_of(F.col("source")).alias("pattern"), M.word_count(F.col("text")).alias("size"), M.rank_of(F.col("doc_id")).alias("h")), "sized")
    made = M.plan(sized)
    total = sum(len(t.split()) for _, _, t in rows)
    assert all(abs(routed - goal) <= 1 for _, goal, routed in made.sources.values())
    got = M.mix(df).collect()
    assert abs(sum(x.taken for x in got) - total) < 0.01 * total and len(got) == 4000
    per = {}
    for x in got:
        per[tuple(x.pattern)] = per.get(tuple(x.pattern), 0) + x.taken
    sent = {tuple(x.pattern): x.sent for x in M.mix(df).groupBy("pattern").agg(F.sum("taken").alias("sent")).collect()}
    assert per == sent


def test_a_hot_null_id_is_taken_by_text(spark):
    rows = [(None, "a", f"w{i} " * 50) for i in range(600)] + [(i, "b", "w " * 50) for i in range(600)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in "ab":
        own = [r for r in got if r.pattern == [s]]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 50
    assert {r.taken for r in got if r.doc_id is None} == {0, 50}
