"""Job queue: files that arrive become batches of jobs, worked off once each, however often a batch is run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spanveil.session import ship


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def done(spark: SparkSession, out: str, number: int) -> bool:
    """Whether a batch has been written to its end: its files' committer leaves a mark last."""
    p, fs = _files(spark, f"{out}/batch={number}/_SUCCESS")
    return fs.exists(p)


def put_batch(rows: DataFrame, out: str, number: int) -> bool:
    """Write a batch's rows under its number, unless that is done; what an attempt before left half-written is replaced. False if there was nothing to do."""
    if done(rows.sparkSession, out, number):
        return False
    rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return True


def finished(spark: SparkSession, out: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches that were written to their end, with `batch`."""
    p, fs = _files(spark, out)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    numbers = sorted(int(name[6:]) for name in found if name.startswith("batch=") and done(spark, out, int(name[6:])))
    if not numbers:
        return spark.createDataFrame([], schema).selectExpr("*", "CAST(NULL AS INT) AS batch")
    return spark.read.schema(schema).option("basePath", out).parquet(*[f"{out}/batch={n}" for n in numbers])


def work_off(
    spark: SparkSession, inbox: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1, form: str = "parquet", before: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Take the files of a folder, `files` a batch, through `work`, into numbered batches of `out`; ends when no file is left.

    The checkpoint fixes which files a number stands for before the batch runs. A stream that dies runs its last batch again when it is started
    anew: then its rows are replaced or, if they were whole, left as they are. `work` must depend on its rows only. `before` is told each number.
    """
    ship(spark)

    def batch(rows: DataFrame, number: int) -> None:
        if before:
            before(number)
        put_batch(work(rows), out, number)

    source = spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", files).load(inbox)
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
