"""DuckDB forms of graph building and graph search: graphs by windows and a recursive fold, searches as state machines.

A search is a recursive query with a row for each query and setting. A step either evaluates the group that waits (scores its unseen
neighbours, cuts the result, notes the group's threshold) or retires the oldest group in flight (hands its neighbours to the candidates), and then
forms the next group if there is room. All scored neighbours go to the candidates; those that a full result had refused are beyond every later threshold. Node ids
must run from 0.
"""

from __future__ import annotations

from ..functions import distance as D
from ..functions.hashing import sql_murmur2

PAIR = "STRUCT(d DOUBLE, id BIGINT)[]"
#: Distances of all pairs, the ids, and each asked query's distances in id order.
PAIRS = f"pr AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {D.sql_l2('a.embedding', 'b.embedding')} AS d FROM embeddings a, embeddings b), dd AS MATERIALIZED (SELECT a AS qid, list(d ORDER BY b) AS dd FROM pr WHERE a % 50 = 0 GROUP BY a)"
#: The level of a node whose id is node_id.
LEVEL = "CAST(floor(-ln((CAST({murmur} AS DOUBLE) + 1.0) / 4294967296.0) / ln({m})) AS INTEGER)"


def level(m: int, node: str = "node_id") -> str:
    return LEVEL.format(murmur=sql_murmur2(node, 1), m=m)


def near(name: str, k: int, among: str = "true") -> str:
    """The k nearest of each node; among: a predicate of a that holds for the nodes of both ends."""
    there = among.replace("{}", "b")
    return f"{name} AS MATERIALIZED (SELECT a AS src, b AS dst, d AS dist FROM pr WHERE a <> b AND {among.replace('{}', 'a')} AND {there} QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= {k})"


def with_reverse(name: str, of: str, degree: int) -> str:
    """Edges and their reverses, the nearest of each node."""
    return f"{name} AS MATERIALIZED (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS pos FROM (SELECT DISTINCT src, dst, dist FROM (SELECT src, dst, dist FROM {of} UNION ALL SELECT dst, src, dist FROM {of})) QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= {degree})"


def diverse(name: str, of: str, m: int) -> str:
    """Of each node's neighbours, nearest first, those nearer to it than to each one taken; nodes with fewer than m keep all. Blockers of a
    neighbour are the nearer ones that are no farther from it than the node."""
    return f"""{name}_n AS MATERIALIZED (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS i, count(*) OVER (PARTITION BY src) AS n FROM {of}),
{name}_b AS MATERIALIZED (SELECT x.src, x.i, any_value(x.dst) AS dst, any_value(x.dist) AS dist, coalesce(list(y.dst) FILTER (pr.d <= x.dist), CAST([] AS BIGINT[])) AS blockers FROM {name}_n x LEFT JOIN {name}_n y ON y.src = x.src AND y.i < x.i LEFT JOIN pr ON pr.a = y.dst AND pr.b = x.dst WHERE x.n >= {m} GROUP BY x.src, x.i),
{name}_s AS (SELECT DISTINCT src, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS dst, CAST(NULL AS DOUBLE) AS dist FROM {name}_b
  UNION ALL SELECT s.src, s.i + 1, CASE WHEN ok THEN list_append(taken, c_dst) ELSE taken END, CASE WHEN ok THEN c_dst END, c_dist FROM
  (SELECT s.src, s.i, s.taken, b.dst AS c_dst, b.dist AS c_dist, len(s.taken) < {m} AND NOT list_has_any(s.taken, b.blockers) AS ok FROM {name}_s s JOIN {name}_b b ON b.src = s.src AND b.i = s.i + 1) s),
{name} AS MATERIALIZED (SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS pos FROM (SELECT src, dst, dist FROM {name}_s WHERE dst IS NOT NULL UNION ALL SELECT src, dst, dist FROM {name}_n WHERE n < {m}))"""


def mutual(name: str, of: str, m: int) -> str:
    """Edges and their reverses, pruned again where a node has more than m."""
    return f"""{name}_a AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY src) AS c FROM (SELECT DISTINCT src, dst, dist FROM (SELECT src, dst, dist FROM {of} UNION ALL SELECT dst, src, dist FROM {of}))),
{name}_c AS (SELECT src, dst, dist FROM {name}_a WHERE c > {m}),
{diverse(f"{name}_d", f"{name}_c", m)},
{name} AS MATERIALIZED (SELECT src, dst, dist, pos FROM {name}_d UNION ALL SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 FROM {name}_a WHERE c <= {m})"""


def medoid(name: str, among: str = "true") -> str:
    """The node next to the mean."""
    some = f"(SELECT vec_id AS node_id, embedding FROM embeddings WHERE {among.replace('{}', 'vec_id')})"
    mean = f"(SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM {some}) GROUP BY pos))"
    return f"{name} AS MATERIALIZED (SELECT node_id AS entry FROM {some} v, {mean} m ORDER BY round({D.sql_l2('v.embedding', 'm.mean')}, 9), node_id LIMIT 1)"


def adjacency(name: str, of: str) -> str:
    """One row: the neighbours of all nodes as lists, in id order."""
    return f"{name} AS MATERIALIZED (SELECT list(coalesce(l, CAST([] AS BIGINT[])) ORDER BY vec_id) AS a FROM embeddings LEFT JOIN (SELECT src, list(dst ORDER BY pos) AS l FROM {of} GROUP BY src) ON src = vec_id)"


def linked(k: int = 16, degree: int = 32) -> str:
    """Pairs, the kNN graph with reverse edges as adjacency g, and the medoid e."""
    return f"{PAIRS}, {near('knn', k)}, {with_reverse('edges', 'knn', degree)}, {adjacency('g', 'edges')}, {medoid('e')}"


_FRESH = "list_filter(list_filter(met, lambda x: NOT list_contains(V, x)), lambda x, i: list_position(list_filter(met, lambda y: NOT list_contains(V, y)), x) = i)"


def search(name: str, settings: str, graph: str = "g", entry: str = "e") -> str:
    """States of delayed-synchronization search; settings: a table of ef, cq, mc, mg. A search ends in its row with an empty group and nothing in flight."""
    return f"""{name} AS (SELECT qid, ef, cq, mc, mg, [CAST(entry AS BIGINT)] AS grp, CAST([] AS {PAIR}) AS R, CAST([] AS {PAIR}) AS C, CAST([] AS BIGINT[]) AS V, CAST([] AS STRUCT(adm {PAIR}, t DOUBLE)[]) AS fl, 1e20::DOUBLE AS t,
  CAST(1 AS BIGINT) AS hops, CAST(0 AS BIGINT) AS visited, CAST(NULL AS BIGINT) AS cand, CAST([] AS {PAIR}) AS scored FROM dd, {entry}, {settings}
  UNION ALL SELECT qid, ef, cq, mc, mg, list_transform(list_slice(ready, 1, mc), lambda x: x.id), R, list_slice(C, len(list_slice(ready, 1, mc)) + 1, len(C)), V, fl, t, hops + len(list_slice(ready, 1, mc)), visited, cand, sc FROM
  (SELECT *, CASE WHEN len(fl) < mg THEN list_filter(C, lambda x: x.d <= t AND x.d < 1e20) ELSE CAST([] AS {PAIR}) END AS ready FROM
  (SELECT qid, ef, cq, mc, mg, R1 AS R, CASE WHEN eval THEN C ELSE list_slice(list_sort(list_concat(C, fl[1].adm)), 1, cq) END AS C, list_concat(V, list_transform(sc, lambda x: x.id)) AS V,
   CASE WHEN eval THEN list_append(fl, struct_pack(adm := sc, t := CASE WHEN len(R1) = ef THEN R1[ef].d ELSE 1e20::DOUBLE END)) ELSE list_slice(fl, 2, len(fl)) END AS fl, CASE WHEN eval THEN t ELSE fl[1].t END AS t, hops, visited + len(sc) AS visited, grp[1] AS cand, sc FROM
  (SELECT *, list_slice(list_sort(list_concat(R, sc)), 1, ef) AS R1 FROM
  (SELECT *, list_transform({_FRESH}, lambda x: struct_pack(d := dd[x + 1], id := x)) AS sc FROM
  (SELECT s.*, dd.dd, len(grp) > 0 AS eval, coalesce(flatten(list_transform(grp, lambda c: a[c + 1])), CAST([] AS BIGINT[])) AS met FROM {name} s JOIN dd USING (qid), {graph} WHERE len(grp) > 0 OR len(fl) > 0))))))"""


def settings(*rows: tuple[int, int, int, int], name: str = "p") -> str:
    """A table of (ef, cq, mc, mg)."""
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(map(str, rows))}) x(ef, cq, mc, mg))"


DONE = "len(grp) = 0 AND len(fl) = 0"


def listed(state: str, where: str = DONE, of: str = "R") -> str:
    """Rows qid, rank, node_id, dist of the lists of final states."""
    return f"SELECT qid, CAST(unnest(range(1, len({of}) + 1)) AS INTEGER) AS rank, unnest(list_transform({of}, lambda x: x.id)) AS node_id, unnest(list_transform({of}, lambda x: x.d)) AS dist FROM {state} WHERE {where}"


def pool_search(name: str, ef: int, graph: str = "g", entry: str = "e") -> str:
    """States of the search with one pool: the nearest that is not expanded yet is next, until all of the pool are."""
    first = "struct_pack(d := dd[entry + 1], id := CAST(entry AS BIGINT))"
    return f"""{name} AS (SELECT qid, [{first}] AS R, [CAST(entry AS BIGINT)] AS V, CAST([] AS BIGINT[]) AS done, CAST(entry AS BIGINT) AS next FROM dd, {entry}
  UNION ALL SELECT qid, R, V, done, list_filter(R, lambda x: NOT list_contains(done, x.id))[1].id FROM
  (SELECT qid, list_slice(list_sort(list_concat(R, sc)), 1, {ef}) AS R, list_concat(V, list_transform(sc, lambda x: x.id)) AS V, list_append(done, next) AS done FROM
  (SELECT *, list_transform({_FRESH}, lambda x: struct_pack(d := dd[x + 1], id := x)) AS sc FROM
  (SELECT s.*, dd.dd, a[next + 1] AS met FROM {name} s JOIN dd USING (qid), {graph} WHERE next IS NOT NULL))))"""


def layered(m: int, levels: int = 7) -> str:
    """Adjacencies g0 to g(levels - 1) of a layered graph (of layers that no node reaches all lists are empty), the entry e and top level."""
    parts = [f"{PAIRS}, lv AS MATERIALIZED (SELECT vec_id AS node_id, {level(m, 'vec_id')} AS level FROM embeddings), e AS MATERIALIZED (SELECT min(node_id) AS entry, level AS top FROM lv WHERE level = (SELECT max(level) FROM lv) GROUP BY level)"]
    for k in range(levels):
        among = f"{{}} IN (SELECT node_id FROM lv WHERE level >= {k})"
        parts += [near(f"n{k}", 4 * m, among), diverse(f"d{k}", f"n{k}", m), mutual(f"m{k}", f"d{k}", m if k else 2 * m), adjacency(f"g{k}", f"m{k}")]
    return ", ".join(parts)


def descent(name: str, levels: int = 7) -> str:
    """States of the greedy descent from the entry; it ends at level 0."""
    at = "CASE lev " + " ".join(f"WHEN {k} THEN g{k}.a[node + 1]" for k in range(1, levels)) + " END"
    graphs = ", ".join(f"g{k}" for k in range(1, levels))
    return f"""{name} AS (SELECT qid, top AS lev, CAST(entry AS BIGINT) AS node FROM dd, e
  UNION ALL SELECT qid, CASE WHEN best.d < here THEN lev ELSE lev - 1 END, CASE WHEN best.d < here THEN best.id ELSE node END FROM
  (SELECT s.qid, lev, node, dd.dd[node + 1] AS here, list_sort(list_transform({at}, lambda x: struct_pack(d := dd.dd[x + 1], id := x)))[1] AS best FROM {name} s JOIN dd USING (qid), {graphs} WHERE lev > 0))"""


def layer_search(name: str, ef: int, start: str, graph: str = "g0") -> str:
    """States of the base-layer search from start (qid, node): candidates without bound, until the nearest is beyond a full result."""
    first = "struct_pack(d := dd[node + 1], id := node)"
    return f"""{name} AS (SELECT qid, [{first}] AS R, [{first}] AS C, [node] AS V, true AS more FROM dd JOIN ({start}) USING (qid)
  UNION ALL SELECT qid, R, C, V, len(C) > 0 AND NOT (len(R) = {ef} AND C[1].d > R[{ef}].d) FROM
  (SELECT qid, list_slice(list_sort(list_concat(R, sc)), 1, {ef}) AS R, list_sort(list_concat(list_slice(C, 2, len(C)), sc)) AS C, list_concat(V, list_transform(sc, lambda x: x.id)) AS V FROM
  (SELECT *, list_transform({_FRESH}, lambda x: struct_pack(d := dd[x + 1], id := x)) AS sc FROM
  (SELECT s.*, dd.dd, a[C[1].id + 1] AS met FROM {name} s JOIN dd USING (qid), {graph} WHERE more))))"""
