"""Audit of pages as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.registry import RULES
from ..plans.audit import audit, pages_as_files, tables
from ..plans.incremental import CROSS_FILE


def watch_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, per_batch: int = 1000) -> StreamingQuery:
    """Audit new Parquet files of pages by the rules that look at one file at a time. A
    batch's findings are a folder of ``out`` that is replaced as a whole, so a batch that
    is run again after a restart is not there twice."""
    pages = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", per_batch).parquet(folder)
    rules = [r for r in RULES if r not in CROSS_FILE]

    def batch(rows: DataFrame, batch_id: int) -> None:
        files = pages_as_files(rows)
        with tables(files) as t:  # a batch's tables are given back at its end
            audit(files, rules, t).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time; rows later than the watermark are dropped by it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events")).select(F.col("window.start").alias("start"), "event_type", "events")
