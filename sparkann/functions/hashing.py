"""MurmurHash2 of 4-byte keys as column expressions, and what is built on it."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The multiplier and shift of MurmurHash2, 32 bits.
M, R = 0x5BD1E995, 24
_MASK = 0xFFFFFFFF


def _mul(a: Column) -> Column:
    """a * M modulo 2**32, without overflow of a long: high and low halves by themselves."""
    high = F.shiftright(a, 16) * F.lit(M).cast("long")
    low = a.bitwiseAND(F.lit(0xFFFF).cast("long")) * F.lit(M).cast("long")
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF).cast("long")), 16) + low).bitwiseAND(F.lit(_MASK).cast("long"))


def murmur2(key: Column, seed: int) -> Column:
    """The hash of a key (0 to 2**32 - 1, as a long), as a long."""
    k = _mul(key.cast("long").bitwiseAND(F.lit(_MASK).cast("long")))
    k = _mul(k.bitwiseXOR(F.shiftright(k, R)))
    h = _mul(F.lit(seed ^ 4).cast("long")).bitwiseXOR(k)
    h = _mul(h.bitwiseXOR(F.shiftright(h, 13)))
    return h.bitwiseXOR(F.shiftright(h, 15))


def murmur2_py(key: int, seed: int) -> int:
    k = key * M & _MASK
    k = (k ^ k >> R) * M & _MASK
    h = (seed ^ 4) * M & _MASK ^ k
    h = (h ^ h >> 13) * M & _MASK
    return h ^ h >> 15


def sql_murmur2(key: str, seed: int) -> str:
    """DuckDB's form; key is an expression of a number."""
    mul = lambda e: f"(CAST({e} AS HUGEINT) * {M} % 4294967296)"
    shift = lambda e, n: f"({e} // {2**n})"
    xor = lambda a, b: f"CAST(xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT)) AS HUGEINT)"
    return f"(SELECT {xor('h2', shift('h2', 15))} FROM (SELECT {mul(xor('h1', shift('h1', 13)))} AS h2 FROM (SELECT {xor(mul(str(seed ^ 4)), 'k2')} AS h1 FROM (SELECT {mul(xor('k1', shift('k1', R)))} AS k2 FROM (SELECT {mul(key)} AS k1)))))"


def bucket(h: Column, bits: int) -> Column:
    """The low bits of a hash."""
    return h.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def unit_interval(key: Column, seed: int = 1) -> Column:
    """A number in (0, 1] for each key, the same in every run."""
    return (murmur2(key, seed).cast("double") + 1.0) / F.lit(4294967296.0)


def hashed_level(key: Column, m: int, seed: int = 1) -> Column:
    """An HNSW level: floor(-ln(u) / ln(m)) with the key's hash as u."""
    return F.floor(-F.log(unit_interval(key, seed)) / F.lit(math.log(m))).cast("int")
