"""Structured Streaming forms of the tick and equity operators. Event time comes from the messages; late rows are
dropped by the watermark. Sources and sinks are files in a shared folder, so any executor can take over a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import work_dir
from .ordered import (Ordered, cooldown_filter_stream, edge_latch, equity_guard_stream, kyle_lambda_stream, lead_signal_stream, rolling_ofi_stream,  # noqa: F401
                      rolling_tick_stats_stream)


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream the parquet files of a folder that match a name pattern, with the schema of the files."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    df = r.parquet(folder)
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def drain(out: DataFrame | Ordered, name: str, mode: str = "append", complete: bool = False) -> DataFrame:
    """Run a streaming query over everything available, into files, and return the written table. Spark's own state is kept in RocksDB.
    complete, for a stream folded in order: the input has ended, so rows that wait for the watermark leave as well."""
    if isinstance(out, Ordered):
        return out.drain(name, complete)
    spark = out.sparkSession
    path, key = work_dir(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (out.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", work_dir(spark, name + "-state"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(out.schema).parquet(path)


def tick_to_bar_stream(ticks: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """OHLCV per symbol over tumbling or sliding windows; a bar is final once the watermark passes its end."""
    o = F.struct("ts", "seq")
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return ticks.withWatermark("ts", delay).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("volume").alias("volume")
    ).select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("end_ts"), "open", "high", "low", "close", "volume")


def activity_sessions(ticks: DataFrame, gap: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of ticks per symbol, closed after ``gap`` without one."""
    return ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("ticks"), F.sum("volume").alias("volume")).select("symbol", F.col("w.start").alias("start_ts"), F.col("w.end").alias("end_ts"), "ticks", "volume")
