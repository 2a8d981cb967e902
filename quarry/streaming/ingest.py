"""Incremental ingest: new files become chunks as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.runtime import prepare
from quarry.operators import chunkers
from quarry.sources.parsers import parse_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Files of a folder as a stream, at most max_files a batch."""
    return prepare(spark).readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)


def ingest(files: DataFrame, out: str, checkpoint: str, chunker: str = "sentence", settings: dict | None = None, trigger: dict | None = None):
    """Streams files into Parquet chunks below `out`. Each batch is written to its own folder, so a batch that is
    tried again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        docs = parse_files(batch.select("path", "length", "content"))
        chunks = chunkers.resolve(chunker)(docs, **(settings or {}))
        chunks.withColumn("arrived", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day", value: Callable | None = None) -> DataFrame:
    """Rows of a stream counted by window and key; those later than the watermark are left out."""
    counted = F.count("*").alias("n") if value is None else value().alias("n")
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(counted)
