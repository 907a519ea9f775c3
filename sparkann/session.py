"""Sessions: settings for local runs, and the package for the executors."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def local_session(app: str = "sparkann", cpus: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session in one JVM, with adaptive execution and UTC."""
    build = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    session = build.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once an application, so that functions in them can run there. They go
    through the shared folder, from which executors that start later fetch them too."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    at = scratch(spark, "sparkann.zip")
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(held.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(at)
    _shipped.add(app)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see. Where that is unset, one of our own on a single machine; RuntimeError
    elsewhere, as a folder of one machine would lose what others write."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines see")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sparkann-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    at = f"{shared_dir(spark)}/sparkann/{uuid.uuid4().hex}/{name}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
