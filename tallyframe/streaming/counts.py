"""Counts over streams: an incremental build in micro-batches, by event time, and the hot window over one sequence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators.counts import Spec, exact_counts, merge
from tallyframe.operators.tables import shared_path
from tallyframe.operators.windows import with_ordinal


def build_incrementally(stream: DataFrame, spec: Spec, observe: Callable[[DataFrame], DataFrame], path: str):
    """Starts a query that writes each micro-batch's partial counts to ``path``/batch=<id>.

    Counts are additive, so a batch is a table of its own; one that is run again overwrites its own folder, which
    makes the sum exact. ``current`` reads the sum.
    """

    def add(batch: DataFrame, number: int) -> None:
        exact_counts(observe(batch), spec).write.mode("overwrite").parquet(f"{path}/counts/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    return merge(spark.read.parquet(f"{path}/counts").drop("batch"))


def _stream(spark: SparkSession, folder: str, pattern: str, files: int) -> DataFrame:
    """The table as a stream of its files, whether it is one file or a folder of part files."""
    path = f"{folder}/{pattern}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def count_stream(spark: SparkSession, folder: str, pattern: str, spec: Spec, observe: Callable[[DataFrame], DataFrame], *, files: int = 100) -> DataFrame:
    """All that is there now, counted as a stream of files."""
    path = shared_path(spark, "stream")
    build_incrementally(_stream(spark, folder, pattern, files), spec, observe, path).awaitTermination()
    return current(spark, path)


def watermarked_counts(stream: DataFrame, time_col: str, *, window: str, late: str) -> DataFrame:
    """(start, key, label, cnt) by event time, rows over ``late`` behind dropped: an addition to arrival windows."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window), "key", "label").agg(F.count("*").cast("double").alias("cnt")).select(F.col("window.start").alias("start"), "key", "label", "cnt")


def hot_window_stream(spark: SparkSession, folder: str, pattern: str, observe: Callable[[DataFrame], DataFrame], *, order: str, count_table_size: int, keep: int, files: int = 100) -> DataFrame:
    """(key, label, cnt): the hot window's merged view after all that is there now, over one sequence of arrivals.

    A micro-batch is numbered in parallel, after the arrivals of the batches before it, and counted by window, key and
    label in Spark; what is kept is a table of window counts and the number of arrivals for each batch, so a batch
    that is run again replaces itself. No task holds a batch, and windows that have left the view aren't read.
    """
    path = shared_path(spark, "stream")

    def add(batch: DataFrame, number: int) -> None:
        before = 0
        if number:
            before = spark.read.parquet(f"{path}/arrivals").where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        rows = with_ordinal(observe(batch), order).withColumn("window_id", F.floor((F.col("ordinal") + before) / count_table_size))
        rows.groupBy("window_id", "key", "label").agg(F.count("*").cast("double").alias("cnt")).write.mode("overwrite").parquet(f"{path}/windows/batch={number}")
        spark.read.parquet(f"{path}/windows/batch={number}").agg(F.coalesce(F.sum("cnt"), F.lit(0.0)).cast("long").alias("n")).write.mode("overwrite").parquet(f"{path}/arrivals/batch={number}")

    stream = _stream(spark, folder, pattern, files)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    now = spark.read.parquet(f"{path}/arrivals").agg(F.sum("n")).first()[0] // count_table_size
    frozen = spark.read.parquet(f"{path}/windows").where((F.col("window_id") < now) & (F.col("window_id") >= now - keep))
    return frozen.groupBy("key", "label").agg(F.sum("cnt").alias("cnt"))
