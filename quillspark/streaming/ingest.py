"""Ingestion that goes on where it stopped: files that arrive in a folder, each taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = 50  # files between two checkpoints


def arriving_files(spark: SparkSession, folder: str, batch: int = BATCH) -> DataFrame:
    """path, length, content of files as they come, at most batch of them between two checkpoints."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batch).load(folder).select("path", "length", "content")


def arriving_lines(spark: SparkSession, folder: str, schema: str, batch: int = BATCH) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", batch).json(folder)


def run_once(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Take what is there and stop; a later run takes only what is new."""
    return df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, time: str, kind: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events per kind and window of time; those later than late are dropped."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", kind, "n")
