"""Numbers from text logs, power readings, and tables of experiments. Lines are rows (file, line_no, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = "(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value: a file is read as one row, so that its lines keep their numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole.where("value <> ''")


def scrape(lines: DataFrame, keyword: str) -> DataFrame:
    """file, line_no, x: the first number after keyword in each line that has it."""
    hit = lines.where(F.contains("value", F.lit(keyword)))
    after = F.substring_index(F.col("value"), keyword, -1)
    return hit.select("file", "line_no", F.regexp_extract(after, NUMBER, 1).cast("double").alias("x"))


def turbostat_watts(lines: DataFrame, columns: tuple[int, ...] = (-4, -3)) -> DataFrame:
    """file, watts: the mean of the sum of columns, counted from the end, over lines of numbers; headers are skipped."""
    cells = lines.select("file", F.split(F.trim("value"), "\\s+").alias("c")).where(F.element_at("c", -1).rlike("^-?[0-9.]+$"))
    total = sum((F.try_element_at("c", F.lit(i)).cast("double") for i in columns[1:]), F.try_element_at("c", F.lit(columns[0])).cast("double"))
    return cells.groupBy("file").agg(F.avg(total).alias("watts"))


def gpu_watts(lines: DataFrame, match: str) -> DataFrame:
    """file, watts: the mean of the first "NW /" on the line after each device line, which has match and no reading of its own ("3090W /" is not a
    device); lines without a reading don't count."""
    reading = F.nullif(F.regexp_extract("value", "([0-9]+)W /", 1), F.lit(""))
    device = F.contains("value", F.lit(match)) & reading.isNull()
    rows = lines.withColumn("after", F.lag(device).over(Window.partitionBy("file").orderBy("line_no"))).where("after")
    return rows.groupBy("file").agg(F.avg(reading.cast("double")).alias("watts"))


def latency_json(lines: DataFrame) -> DataFrame:
    """file, json: lines like "model: M batch size: B latency: L" as {"M": {"B": L}}."""
    get = lambda what: F.regexp_extract("value", what + ":? *([A-Za-z0-9_.]+)", 1)
    rows = lines.select("file", get("model").alias("model"), get("batch size").alias("batch"), get("latency").cast("double").alias("latency")).where("model <> ''")
    per = rows.groupBy("file", "model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("batch", "latency")))).alias("by_batch"))
    return per.groupBy("file").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.to_json("by_batch")))))).alias("json"))


def upsert(table: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of new in place of those with the same keys."""
    if table is None:
        return new
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def config(defaults: dict, overrides: dict) -> dict:
    """Settings with those overrides that are given (not None)."""
    return defaults | {k: v for k, v in overrides.items() if v is not None}
