"""Watching a growing ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.ledger_log import LEDGER_SCHEMA


def ledger_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The lines of a folder of ledger files, as files arrive."""
    return spark.readStream.schema(LEDGER_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def throughput(lines: DataFrame, width: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Calls, failures, cache hits and tokens by window of the call's own time. Lines that come
    later than ``late`` behind the newest are left out and their windows' state is dropped."""
    ts = F.try_to_timestamp(F.substring("ts_utc", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    w = lines.withColumn("ts", ts).withWatermark("ts", late).groupBy(F.window("ts", width))
    out = w.agg(F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if("cached").alias("n_cached"), F.sum("output_tokens").alias("output_tokens"))
    return out.select(F.col("window.start").alias("window_start"), "n_calls", "n_failed", "n_cached", "output_tokens", (F.col("n_failed") / F.col("n_calls")).alias("failure_rate"))


def once(lines: DataFrame, late: str = "2 days") -> DataFrame:
    """Lines without those that were written twice, within the watermark."""
    ts = F.try_to_timestamp(F.substring("ts_utc", 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return lines.withColumn("ts", ts).withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "cache_key", "tag", "attempt", "cached"])
