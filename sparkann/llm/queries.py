"""Queries of this subpackage: the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, license_scan, mixing, order_minhash, packing, quality, simhash, toxicity, url_filter, warc
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by sentence rules."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, with repeated payloads resolved, and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, by a model of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.fit(held.where(~F.col("held_out")))
    return language_id.classify(held, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return order_minhash.compare(table(spark, sf_dir, "documents"))


def op7_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the URLs of all pages."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by weights learnt from labels of those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", toxicity.held_out("doc_id"))
    weights = toxicity.fit(docs.where(~F.col("held_out")), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights, keep=("held_out",))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of all documents."""
    return quality.figures(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_license": op2_license,
        "op3_warc": op3_warc,
        "op4_language": op4_language,
        "op5_mixing": op5_mixing,
        "op6_order_minhash": op6_order_minhash,
        "op7_url": op7_url,
        "op8_toxicity": op8_toxicity,
        "op9_packing": op9_packing,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license": license_scan.scan_sql(),
        "op10_quality": quality.figures_sql(),
    }
