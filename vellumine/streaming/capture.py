"""Incremental capture: sessions and pages are taken once, as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream over the files that arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def take_once(stream: DataFrame, ledger: str, checkpoint: str, key: str, apply: Callable[[DataFrame], None]) -> StreamingQuery:
    """Apply each key's rows once, over restarts too; the ledger is a Parquet folder of keys.

    A batch is a pure function of its files and of the ledger written before it:
    each batch's keys go to a folder named by its number, so a batch that is run
    again after a failure overwrites its own entry and sees the same ledger.
    ``apply`` must be idempotent, as for every such sink.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        kept = rows
        if store.exists(root):
            done = spark.read.option("basePath", ledger).parquet(ledger).where(F.col("batch") < number)
            kept = rows.join(done.select(key), key, "left_anti")
        apply(kept)
        kept.select(key).distinct().write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append (event_date, event_type, text) to the activity log's folder, once each."""
    from vellumine.operators.capture import log_lines

    return log_lines(stream).writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events per tumbling window and kind; batch or stream, UTC."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(time, late)
    return timed.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
