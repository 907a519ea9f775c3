"""Distances between array columns, and the same for DuckDB.

Elements are cast to double and added from left to right, which is bit for bit what the SQL forms do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, each: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: each(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def squared_l2_int(a: Column, b: Column) -> Column:
    """For arrays of integers: exact, as a long."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("long") - y.cast("long")) * (x.cast("long") - y.cast("long"))), F.lit(0).cast("long"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def ip_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; null if a vector is zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def lane_l2(a: Column, b: Column, dim: int, lanes: int = 16) -> Column:
    """Squared L2 in single precision, in the order of an adder tree: neighbours are added pairwise within each pack of lanes (a power of two), and the packs' sums from left to
    right; what a last pack lacks is zero."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("float") - y.cast("float")) * (x.cast("float") - y.cast("float")))
    zero = F.lit(0.0).cast("float")

    def total(s: Column) -> Column:
        def tree(lo: int, n: int) -> Column:
            return F.get(s, F.lit(lo)) if n == 1 else tree(lo, n // 2) + tree(lo + n // 2, n // 2)

        out = zero
        for lo in range(0, dim, lanes):
            out = out + tree(lo, lanes)
        return out

    return F.get(F.transform(F.array(F.concat(square, F.array_repeat(zero, -dim % lanes))), total), F.lit(0))


#: What a metric= argument names.
METRICS: dict[str, Callable[[Column, Column], Column]] = {"l2": squared_l2, "ip": ip_distance, "cosine": cosine_distance}


def sql_fold(a: str, b: str, each: str) -> str:
    """each: an expression of x and y."""
    body = each.replace("x", "CAST(p[1] AS DOUBLE)").replace("y", "CAST(p[2] AS DOUBLE)")
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {body}))"


def sql_l2(a: str, b: str) -> str:
    return sql_fold(a, b, "(x - y) * (x - y)")


def sql_dot(a: str, b: str) -> str:
    return sql_fold(a, b, "x * y")


def sql_metric(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return sql_l2(a, b)
    if metric == "ip":
        return f"1.0 - {sql_dot(a, b)}"
    return f"1.0 - {sql_dot(a, b)} / (sqrt({sql_dot(a, a)}) * sqrt({sql_dot(b, b)}))"


def sql_lane_l2(a: str, b: str, dim: int, lanes: int = 16) -> str:
    """lane_l2() of two expressions of FLOAT lists whose length the lanes divide."""
    at = lambda k: f"(CAST({a}[{k}] AS FLOAT) - CAST({b}[{k}] AS FLOAT)) * (CAST({a}[{k}] AS FLOAT) - CAST({b}[{k}] AS FLOAT))"

    def tree(lo: int, n: int) -> str:
        return f"({at(lo)})" if n == 1 else f"({tree(lo, n // 2)} + {tree(lo + n // 2, n // 2)})"

    total = "CAST(0 AS FLOAT)"
    for k in range(dim // lanes):
        total = f"({total} + {tree(k * lanes + 1, lanes)})"
    return total
