"""Bloom filters over MurmurHash2."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket, murmur2


def bits_of(keys: DataFrame, bits: int, hashes: int = 3, seed: int = 1) -> DataFrame:
    """keys with h (0 to hashes - 1) and bit, a row for each hash function."""
    each = F.array(*[F.struct(F.lit(i).alias("h"), bucket(murmur2(F.col("key"), seed + i), bits).alias("bit")) for i in range(hashes)])
    return keys.withColumn("x", F.explode(each)).select("*", "x.h", "x.bit").drop("x")


def check_and_insert(keys: DataFrame, bits: int, hashes: int = 3, seed: int = 1) -> DataFrame:
    """group, pos, key, valid: keys (group, pos, key) pass a filter of 2 ** bits bits one after the other, one filter for each group.

    A key is valid if one of its bits was clear, and sets them all. A bit is clear for the first key, by pos, that has it; so
    a key is valid if it is first for one of its bits, which needs no sequential pass.
    """
    first = Window.partitionBy("group", "bit").orderBy("pos")
    rows = bits_of(keys, bits, hashes, seed).withColumn("first", F.min("pos").over(first) == F.col("pos"))
    return rows.groupBy("group", "pos", "key").agg(F.max("first").alias("valid"))


def false_positives(inserted: DataFrame, probes: DataFrame, bits: int, hashes: int = 3, seed: int = 1) -> DataFrame:
    """n, positive: of probes (key), how many seem to be among inserted (key)."""
    on = bits_of(inserted.select("key"), bits, hashes, seed).select("bit").distinct()
    hit = bits_of(probes.select("key"), bits, hashes, seed).join(on.withColumn("on", F.lit(1)), "bit", "left")
    return hit.groupBy("key").agg(F.count("on").alias("c")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("c") == hashes, 1).otherwise(0)).alias("positive"))


def stream_hashes(keys: DataFrame, hashes: int = 3, seed: int = 1) -> DataFrame:
    """keys with h (0 to hashes - 1) and hash: the full hashes of each key in turn."""
    each = F.array(*[F.struct(F.lit(i).alias("h"), murmur2(F.col("key"), seed + i).alias("hash")) for i in range(hashes)])
    return keys.withColumn("x", F.explode(each)).select("*", "x.h", "x.hash").drop("x")


def check_base_only(keys: DataFrame, bits: int, hashes: int = 3, seed: int = 1) -> DataFrame:
    """As check_and_insert(), for keys with level: those above the base layer pass by the filter, and leave no bits in it."""
    upper = keys.where("level > 0").select("group", "pos", "key", F.lit(True).alias("valid"))
    return check_and_insert(keys.where("level = 0").drop("level"), bits, hashes, seed).unionByName(upper)


def burst_counts(checked: DataFrame, burst: int = 16) -> DataFrame:
    """group, burst, n: how many valid keys stand in each run of burst positions."""
    return checked.groupBy("group", F.floor(F.col("pos") / burst).cast("long").alias("burst")).agg(F.count(F.when(F.col("valid"), 1)).alias("n"))


def check_tags(visits: DataFrame) -> DataFrame:
    """qid, pos, node_id, valid: an exact visited set kept as a tag with each node, the query that last came by. Queries run one after the other; a visit
    is valid if the tag is another query's."""
    last = Window.partitionBy("node_id").orderBy("qid", "pos")
    return visits.withColumn("valid", F.coalesce(F.lag("qid").over(last) != F.col("qid"), F.lit(True)))
