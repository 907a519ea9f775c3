"""Mixing of overlapping sources to target weights, by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. Each pattern offers its tokens once for nothing, a second time at a
cost, a third time at a higher one; the flow routes them to the sources' quotas. What a pattern sends is then selected by
seeded hashes: every document some whole number of times, and a part of them once more.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored, told, word_count

#: Weights of the sources in order, again and again; copies of a document at most; the seed of the selection.
WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 20240229
#: Patterns that the driver solves for, at most; it raises an error beyond. A pattern is a row of counts, whatever it stands for. So many are broadcast; more are joined.
MAX_PATTERNS, MAX_BROADCAST_PATTERNS = 1_000_000, 100_000
#: Bits of the two levels of the hash histogram, and documents that are tried to fill the last gap of a pattern, on average.
LEVEL_BITS, FILL = 12, 256
#: A gap of more than this share of what a pattern sends is filled from all documents.
GAP = 0.001
MAX_BROADCAST_ROWS = 1_000_000


def targets(sizes: dict[str | None, int], total: int, weights: tuple[int, ...] = WEIGHTS, times: int = MAX_COPIES) -> dict[str | None, float]:
    """Shares of total by weight, the weights dealt to the sources by code point, null last. A target stops at times its source's
    size; what is over is shared again among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    capped: dict[str | None, float] = {}
    while True:
        rest, open_ = total - sum(capped.values()), [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s: float(times * sizes[s]) for s in open_ if share[s] > times * sizes[s]}
        if not over:
            return {s: capped.get(s, share.get(s, 0.0)) for s in order}
        capped |= over


def route(supply: list[int], member: list[list[int]], quota: list[int], times: int = MAX_COPIES) -> list[dict[int, int]]:
    """Flow from each pattern to its sources, of greatest amount, and of least cost among those.

    A pattern's k-th use of its supply costs k - 1 a token. The costs are on the arcs into the patterns alone, so the
    shortest augmenting paths use up all arcs of one cost before the next: a greatest flow for each use, by level graphs. A path goes from a pattern to
    a source, and on from a source that is full by way of any pattern that sends it something and could send that elsewhere; so
    levels are kept for sources only, and each pattern is looked at once to find them.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in member]
    left, of_source = list(quota), [[] for _ in quota]
    for p, m in enumerate(member):
        for s in m:
            of_source[s].append(p)
    for _ in range(times):
        spare = list(supply)
        while True:
            level = _levels(flow, left, of_source)
            starts = [p for p, n in enumerate(spare) if n and any(s in level for s in flow[p])]
            if not starts:
                break
            at = [0] * len(quota)
            for p in starts:
                for s in sorted((s for s in flow[p] if s in level), key=level.__getitem__):
                    while spare[p] and (sent := _push(s, spare[p], flow, left, of_source, level, at)):
                        flow[p][s] += sent
                        spare[p] -= sent
    return flow


def _levels(flow: list[dict[int, int]], left: list[int], of_source: list[list[int]]) -> dict[int, int]:
    """Of each source, over how many patterns the nearest one that is not full can be reached."""
    level = {s: 0 for s, n in enumerate(left) if n}
    queue, seen = deque(level), set()
    while queue:
        t = queue.popleft()
        for p in of_source[t]:
            if p not in seen:
                seen.add(p)
                for s, n in flow[p].items():
                    if n and s not in level:
                        level[s] = level[t] + 1
                        queue.append(s)
    return level


def _push(start: int, most: int, flow: list[dict[int, int]], left: list[int], of_source: list[list[int]], level: dict[int, int], at: list[int]) -> int:
    """Sends up to most from a source down the levels; what was sent, 0 if no way is left. at: how far each source's patterns are tried."""
    path: list[tuple[int, int, int]] = []
    s = start
    while start in level:
        if left[s]:
            amount = min([most, left[s], *(flow[p][a] for a, p, _ in path)])
            for a, p, b in path:
                flow[p][a] -= amount
                flow[p][b] += amount
            left[s] -= amount
            return amount
        while at[s] < len(of_source[s]):
            p = of_source[s][at[s]]
            if flow[p][s] and (t := next((t for t in flow[p] if level.get(t, -2) == level[s] - 1), None)) is not None:
                path.append((s, p, t))
                s = t
                break
            at[s] += 1
        else:
            del level[s]
            if path:
                s = path.pop()[0]
    return 0


class Plan(NamedTuple):
    """rows: pattern, pid, copies, bound; chosen: pid, h; figures of each source: size, target, routed."""

    rows: DataFrame
    chosen: DataFrame
    sources: dict[str | None, tuple[int, float, int]]


def pattern_of(sources: Column) -> Column:
    """The sorted distinct sources of an array; null sources last. A null array is the pattern of the null source."""
    return F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))


def rank_of(key: Column, text: Column | None = None) -> Column:
    """A seeded hash of 63 bits, by which rows are selected: those of the same key together, and those without a key by text."""
    whole = F.xxhash64(key, F.lit(SEED))
    if text is not None:
        whole = F.when(key.isNull(), F.xxhash64(F.lit(SEED), text)).otherwise(whole)
    return F.shiftrightunsigned(whole, 1)


def plan(sized: DataFrame) -> Plan:
    """What to take of sized (pattern, h, size), which is read several times."""
    spark = sized.sparkSession
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(s is None, s or "") for s in r.pattern])
    sizes: dict[str | None, int] = {}
    for r in found:
        for s in r.pattern:
            sizes[s] = sizes.get(s, 0) + r["size"]
    goal = targets(sizes, sum(r["size"] for r in found)) if found else {}
    order = list(goal)
    at = {s: k for k, s in enumerate(order)}
    flow = route([r["size"] for r in found], [[at[s] for s in r.pattern] for r in found], [round(goal[s]) for s in order])
    sent = [sum(f.values()) for f in flow]
    figures = {s: (sizes[s], goal[s], sum(f.get(at[s], 0) for f in flow)) for s in order}
    kinds = "pattern array<string>, pid int, copies int, rest long, n long"
    rows = [(list(r.pattern), k, t // r["size"] if r["size"] else 1, t % r["size"] if r["size"] else 0, r.n) for k, (r, t) in enumerate(zip(found, sent, strict=True))]
    wanted = told(spark.createDataFrame(rows, kinds), MAX_BROADCAST_PATTERNS)

    part = sized.join(wanted, sized.pattern.eqNullSafe(wanted.pattern)).where("rest > 0").select("pid", "rest", "n", "h", "size")
    second, chosen = _take(part)
    rows = wanted.join(second, "pid", "left").select("pattern", "pid", "copies", F.coalesce("bound", F.lit(0)).alias("bound"))
    return Plan(stored(rows, "plan"), _topped_up(part, second, chosen, sent).select("pid", "h"), figures)


def _take(part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of part (pid, rest, n, h, size): pid, bound, gap for what is short of rest below a bound of hashes; and pid, h, size of those after it
    that fill the gap. A pattern that doesn't reach its rest has no row."""
    one, two = 63 - LEVEL_BITS, 63 - 2 * LEVEL_BITS
    upto = Window.partitionBy("pid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    first = part.groupBy("pid", "rest", F.shiftright("h", one).alias("b")).agg(F.sum("size").alias("size"))
    first = first.withColumn("cum", F.sum("size").over(upto)).where("cum > rest").groupBy("pid", "rest").agg(F.min_by(F.struct("b", F.col("rest") - F.col("cum") + F.col("size")), "b").alias("x"))
    first = told(stored(first.select("pid", F.col("x.b").alias("b1"), F.col("x.col2").alias("gap1")), "level1"), MAX_BROADCAST_PATTERNS)
    inner = part.join(first, "pid").where(F.shiftright("h", one) == F.col("b1"))
    second = inner.groupBy("pid", "gap1", F.shiftright("h", two).alias("b")).agg(F.sum("size").alias("size"))
    second = second.withColumn("cum", F.sum("size").over(upto)).where("cum > gap1").groupBy("pid").agg(F.min_by(F.struct("b", F.col("gap1") - F.col("cum") + F.col("size")), "b").alias("x"))
    second = stored(second.select("pid", F.col("x.b").alias("bound"), F.col("x.col2").alias("gap")), "level2")
    width = F.ceil(F.lit(FILL << (2 * LEVEL_BITS)) / F.col("n"))
    near = part.join(told(second, MAX_BROADCAST_PATTERNS), "pid").where((F.shiftright("h", two) >= F.col("bound")) & (F.shiftright("h", two) <= F.col("bound") + width))
    chosen = near.groupBy("pid", "gap", "h").agg(F.sum("size").alias("size")).groupBy("pid").applyInPandas(_fill, "pid int, h long, size long")
    return second, stored(chosen, "chosen")


def _topped_up(part: DataFrame, bounds: DataFrame, chosen: DataFrame, sent: list[int]) -> DataFrame:
    """chosen, and what closes gaps that are large against what the pattern sends. The selection is repeated over all documents that are left
    and no larger than the gap; each turn takes one at least. When none is left, one of under twice the gap lands nearer than nothing."""
    spark, two = part.sparkSession, 63 - 2 * LEVEL_BITS
    gaps = {r.pid: r.gap for r in bounds.collect()}
    large = lambda: {p: g for p, g in gaps.items() if g > GAP * sent[p]}
    table = lambda found: F.broadcast(spark.createDataFrame(list(found.items()), "pid int, rest long"))

    def closed(picks: DataFrame) -> None:
        for r in picks.groupBy("pid").agg(F.sum("size").alias("size")).collect():
            gaps[r.pid] -= r["size"]

    closed(chosen)
    if not large():
        return chosen
    free = part.join(told(bounds, MAX_BROADCAST_PATTERNS), "pid").join(table(large()).select("pid"), "pid", "left_semi").where(F.shiftright("h", two) >= F.col("bound"))
    free = free.groupBy("pid", "h").agg(F.sum("size").alias("size")).where("size > 0").join(chosen, ["pid", "h"], "left_anti")
    free = stored(free, "free")
    while now := large():
        fits = free.join(table(now), "pid").where("size <= rest")
        fits = stored(fits.join(told(fits.groupBy("pid").agg(F.count("*").alias("n")), MAX_BROADCAST_PATTERNS), "pid"), "fits")
        if fits.isEmpty():
            break
        bound, filled = _take(fits)
        below = fits.join(told(bound, MAX_BROADCAST_PATTERNS), "pid", "left").where(F.col("bound").isNull() | (F.shiftright("h", two) < F.col("bound")))
        picks = stored(below.select("pid", "h", "size").unionByName(filled), "picks")
        closed(picks)
        chosen = chosen.unionByName(picks)
        free = stored(free.join(picks, ["pid", "h"], "left_anti"), "free")
    if now := large():
        over = free.join(table(now), "pid").where((F.col("size") > F.col("rest")) & (F.col("size") < 2 * F.col("rest")))
        best = over.groupBy("pid").agg(F.min(F.struct("size", "h")).alias("x"))
        chosen = chosen.unionByName(best.select("pid", F.col("x.h").alias("h"), F.col("x.size").alias("size")))
    return stored(chosen, "chosen")


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a pattern's candidates in hash order, each that still fits the gap."""
    rows, taken = rows.sort_values("h"), []
    gap = int(rows["gap"].iloc[0])
    for h, size in zip(rows["h"], rows["size"], strict=True):
        if 0 < size <= gap:
            taken.append(h)
            gap -= size
    held = rows.set_index("h")["size"].loc[taken].to_numpy()
    return pd.DataFrame({"pid": pd.Series([rows["pid"].iloc[0]] * len(taken), dtype="int32"), "h": pd.Series(taken, dtype="int64"), "size": pd.Series(held, dtype="int64")})


def with_copies(rows: DataFrame, made: Plan, pattern: str, h: str, copies: str) -> DataFrame:
    """rows with a column copies: how often the plan takes each. pattern and h name columns of rows."""
    pid, base, bound, extra, key = (fresh([*rows.columns, pattern, h, copies], x) for x in ("pid", "base", "bound", "extra", "key"))
    plans = told(made.rows.select(F.col("pattern").alias(key), F.col("pid").alias(pid), F.col("copies").alias(base), F.col("bound").alias(bound)), MAX_BROADCAST_PATTERNS)
    out = rows.join(plans, rows[pattern].eqNullSafe(F.col(key)), "left").drop(key)
    picks = told(made.chosen, MAX_BROADCAST_ROWS).select(F.col("pid").alias(extra), F.col("h").alias(key))
    out = out.join(picks, (F.col(pid) == F.col(extra)) & (F.col(h) == F.col(key)), "left")
    more = F.when((F.shiftright(h, 63 - 2 * LEVEL_BITS) < F.col(bound)) | F.col(extra).isNotNull(), 1).otherwise(0)
    return out.withColumn(copies, F.col(base) + more).drop(pid, base, bound, extra, key)


def _sources(docs: DataFrame, source_col: str) -> Column:
    """The column as an array of sources."""
    c = F.col(source_col)
    return c if docs.schema[source_col].dataType.typeName() == "array" else F.array(c.cast("string"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, pattern, size, source_size, target, taken: one row for each row of docs.

    source_col is a source, or an array of the sources that the document belongs to; null is a source. size is the number of words of the text,
    0 for null; source_size and target are those of the document's first source. taken is size times the copies taken, of
    which there are MAX_COPIES at most. Rows with the same id are taken together, those without one by text. A table without words takes nothing; an empty one
    gives no rows. Reruns agree: order and layout of the rows don't matter.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), pattern_of(_sources(docs, source_col)).alias("pattern"), word_count(F.col(text_col)).alias("size"), rank_of(F.col(id_col), F.col(text_col)).alias("h"))
    sized = stored(sized, "sized")
    made = plan(sized)
    known = docs.sparkSession.createDataFrame([(s, size, goal) for s, (size, goal, _) in made.sources.items()], "source string, source_size long, target double")
    out = with_copies(sized, made, "pattern", "h", "copies").withColumn("first", F.col("pattern")[0])
    out = out.join(F.broadcast(known), F.col("first").eqNullSafe(F.col("source")), "left")
    return out.select("doc_id", "pattern", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() takes it. Texts are not shuffled."""
    pattern, h, copies, size = (fresh(docs.columns, x) for x in ("pattern", "h", "copies", "size"))
    marked = docs.withColumn(pattern, pattern_of(_sources(docs, source_col))).withColumn(h, rank_of(F.col(id_col), F.col(text_col)))
    sized = marked.select(F.col(pattern).alias("pattern"), F.col(h).alias("h"), word_count(F.col(text_col)).alias("size"))
    out = with_copies(marked, plan(stored(sized, "sized")), pattern, h, copies)
    return out.withColumn(size, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).drop(pattern, h, copies, size)
