"""Session helpers: shipping the package to executors and durable intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int = 8, name: str = "spanveil") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


#: Bytes of an Arrow batch. Texts differ in length a thousandfold, so batches of a number of rows have no bound.
BATCH_BYTES = "4m"
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Prepare a session for the Arrow functions: bounded batches, unless the session sets its own bound, and, once per
    application, the package's source for the executors."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_CONF, "67108864b") == "67108864b":  # Spark's default
        spark.conf.set(_BATCH_CONF, BATCH_BYTES)
    if getattr(sc, "_spanveil_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(PACKAGE.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="spanveil-"), "spanveil.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._spanveil_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what spark.checkpoint.dir names, a mounted file: path included. Where none is set, a local master gets one of its own; on a cluster, a
    machine's folder would not reach the others, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_spanveil_shared", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-spanveil-")
            spark.sparkContext._spanveil_shared = base
    return base.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/spanveil-{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)
    files.deleteOnExit(hadoop)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor. The table goes when the application ends.
    """
    path = shared_path(df.sparkSession, label) + "/t"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._spanveil_kept = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables that `keep` wrote and nothing reads any more: those of an iteration's finished rounds."""
    for df in kept:
        path = getattr(df, "_spanveil_kept", None)
        if path:
            hadoop = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
            hadoop.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
