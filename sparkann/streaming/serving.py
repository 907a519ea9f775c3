"""Serving of query batches as a stream: files of queries in, results out, batch by batch until the input ends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = "qid long, embedding array<float>"


def query_stream(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Queries from Parquet files that arrive in path; files_at_once bounds what is in flight."""
    return spark.readStream.schema(QUERY_SCHEMA).option("maxFilesPerTrigger", files_at_once).parquet(path)


def serve(stream: DataFrame, search: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, latencies: str | None = None) -> None:
    """Answers each micro-batch by search and writes the results to output under batch_id=N, until the input that is there ends.

    A batch that is run again after a failure replaces its own results. latencies gets batch_id, n, started and ended of each.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        began = spark.range(1).select(F.current_timestamp()).first()[0]
        search(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
        if latencies:
            ended = spark.range(1).select(F.current_timestamp()).first()[0]
            spark.createDataFrame([(batch.count(), began, ended)], "n long, started timestamp, ended timestamp").write.mode("overwrite").parquet(f"{latencies}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def batches(queries: DataFrame, size: int) -> DataFrame:
    """queries with batch_id, size of them in each by id."""
    return queries.withColumn("batch_id", F.floor(F.col("qid") / size).cast("long"))


def decode(rows: DataFrame) -> DataFrame:
    """qid, embedding of messages (qid, payload: little-endian floats as hex); a qid below 0 ends the stream and is left out."""
    width = F.floor(F.length("payload") / 8).cast("int")
    part = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.expr("payload").substr(i * 8 + 1, F.lit(8)))
    return rows.where("qid >= 0").select("qid", F.transform(part, _float_of_hex).alias("embedding"))


def _float_of_hex(h):
    """An IEEE single from the hex of its little-endian bytes."""
    big = F.concat(F.substr(h, F.lit(7), F.lit(2)), F.substr(h, F.lit(5), F.lit(2)), F.substr(h, F.lit(3), F.lit(2)), F.substr(h, F.lit(1), F.lit(2)))
    bits = F.conv(big, 16, 10).cast("long")
    sign = F.when(F.shiftright(bits, 31) == 1, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("long"))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1).cast("long")) / F.lit(float(1 << 23))
    value = F.when(exponent == 0, fraction * F.pow(F.lit(2.0), F.lit(-126.0))).otherwise((F.lit(1.0) + fraction) * F.pow(F.lit(2.0), exponent - 127))
    return (sign * value).cast("float")


#: Bytes of a packet; headers and arrays are padded to whole ones.
PACKET = 64
#: What fills a result list up to its length.
NO_ID, NO_DIST = -1, 1e20


def _packets(values: list | np.ndarray, kind: str) -> bytes:
    data = np.asarray(values, kind).tobytes()
    return data + bytes(-len(data) % PACKET)


def encode_queries(queries: DataFrame) -> DataFrame:
    """qid, payload (binary): a packet with the batch's size, 1, then the query's floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packets([1], "<i4") + _packets(v, "<f4") for v in b.column(1).to_pylist()], pa.binary())], ["qid", "payload"])

    return queries.select(F.col("qid").cast("long"), "embedding").mapInArrow(run, "qid long, payload binary")


def decode_queries(messages: DataFrame, dim: int) -> DataFrame:
    """qid, embedding of messages; a batch size of -1 or 0 ends the stream, and such messages are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, np.frombuffer(p, "<f4", dim, PACKET)) for q, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if np.frombuffer(p, "<i4", 1)[0] > 0]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.list_(pa.float32()))], ["qid", "embedding"])

    return messages.select("qid", "payload").mapInArrow(run, "qid long, embedding array<float>")


def padded(results: DataFrame, ef: int) -> DataFrame:
    """qid, ids, dists: each query's results (qid, rank, node_id, dist) as arrays of ef, filled up with NO_ID and NO_DIST."""
    own = results.where(F.col("rank") <= ef).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", "dist"))).alias("r"))
    at = F.sequence(F.lit(0), F.lit(ef - 1))
    return own.select("qid", F.transform(at, lambda i: F.coalesce(F.get("r", i)["node_id"], F.lit(NO_ID).cast("long"))).alias("ids"), F.transform(at, lambda i: F.coalesce(F.get("r", i)["dist"], F.lit(NO_DIST))).alias("dists"))


def encode_results(results: DataFrame, ef: int) -> DataFrame:
    """qid, payload (binary): a packet with ef, the ids as 4-byte numbers, and the distances as floats, each filled up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packets([ef], "<i4") + _packets(i, "<i4") + _packets(d, "<f4") for i, d in rows], pa.binary())], ["qid", "payload"])

    return padded(results, ef).mapInArrow(run, "qid long, payload binary")


def decode_results(messages: DataFrame) -> DataFrame:
    """qid, rank, node_id, dist (float) of answers, without what only fills them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for q, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ef = int(np.frombuffer(p, "<i4", 1)[0])
                ids = np.frombuffer(p, "<i4", ef, PACKET).tolist()
                dists = np.frombuffer(p, "<f4", ef, PACKET + -(-4 * ef // PACKET) * PACKET).tolist()
                rows += [(q, k + 1, i, d) for k, (i, d) in enumerate(zip(ids, dists, strict=True)) if i != NO_ID]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.float32()), strict=True)], ["qid", "rank", "node_id", "dist"])

    return messages.select("qid", "payload").mapInArrow(run, "qid long, rank int, node_id long, dist float")


def peer(messages: DataFrame, dim: int, search: Callable[[DataFrame], DataFrame], ef: int) -> DataFrame:
    """A server between messages: queries in, answers out."""
    return encode_results(search(decode_queries(messages, dim)), ef)


def simulated(queries: DataFrame, ef: int) -> DataFrame:
    """Answers of a peer that doesn't search: ids 0 to ef - 1 at distances of the same size."""
    each = queries.select(F.col("qid").cast("long"), F.explode(F.sequence(F.lit(0), F.lit(ef - 1))).alias("i"))
    return each.select("qid", (F.col("i") + 1).alias("rank"), F.col("i").cast("long").alias("node_id"), F.col("i").cast("double").alias("dist"))
