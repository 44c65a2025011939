"""Helpers shared by the corpus operators: table access, lineage cuts, distributed ranks."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many rows; there are fewer hot keys than this.
HOT_SHARE = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of
    our own if driver and executors are one process (as in tests); on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = getattr(spark, "_quill_shared", None)
        if not found:
            found = spark._quill_shared = tempfile.mkdtemp(prefix="quill-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors,
    and keeps column pruning for what reads it. The table goes when the driver ends, or by release().

    drop_shuffles: have the driver collect its garbage, upon which Spark deletes the shuffle files
    of finished steps; else they wait for the next collection, however much disk they take."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    TABLES.append(path)
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    if drop_shuffles:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


#: Paths of the tables that materialize() has made and that are still there.
TABLES: list[str] = []


def release(df: DataFrame) -> None:
    """Delete the table that materialize() made for df. Only for one whose every reader is itself a written table."""
    delete(df.sparkSession, df._quill_path)


def delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)
    TABLES.remove(path)


def release_unread(df: DataFrame, paths: list[str]) -> list[str]:
    """Delete those of the tables that df doesn't read; the others' paths. For when all results that read them are written."""
    there = [p for p in paths if p in TABLES]
    read = df.inputFiles() if there else []
    kept = [p for p in there if any(p.rsplit("/", 1)[-1] in f for f in read)]
    for p in there:
        if p not in kept:
            delete(df.sparkSession, p)
    return kept


def carried(df: DataFrame, *names: str) -> DataFrame:
    """The rows of df as one struct, row, beside some of its columns: whatever else df has cannot clash
    with the names that an operator needs. row.* gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{c}`") for c in names])


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with table, which has a row per key and, in n, how many of rows have it.

    Hot keys, fewer than HOT_SHARE, are broadcast, so that their rows need not meet in one task; rows
    without a key meet nothing. rows is read up to four times, so it should be a table."""
    hot = table.where(F.col("n") * HOT_SHARE > rows.count()).collect()
    some = rows.where(F.col(key).isNotNull())
    parts = [some.join(table, key, how)]
    if hot:
        known = rows.sparkSession.createDataFrame(hot, table.schema)
        is_hot = F.col(key).isin([r[key] for r in hot])
        parts = [some.where(~is_hot).join(table, key, how), some.where(is_hot).join(F.broadcast(known), key)]
    if how == "left":
        parts.append(rows.where(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in table.schema if f.name != key}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def bucket_count(rows: int) -> int:
    """About the square root: neither the buckets' rows nor the table of buckets grows as the data."""
    return max(1, math.isqrt(max(0, rows - 1)) + 1)


def ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], *, total: str = "n_in_group", rank: str = "rank_in_group") -> DataFrame:
    """Add each row's rank (from 0) within its keys, by bucket and then by order, and the size of its group.

    A group may hold any share of all rows: rows are numbered within (keys, bucket), and the
    buckets' counts, a small table, give the offsets. Keys must not be null. df is read twice."""
    part = [*keys, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*keys).orderBy("_bucket")
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        *part,
        (F.sum("_n").over(before) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(total),
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return rows.join(counts, part).withColumn(rank, F.col("_before") + within).drop("_bucket", "_before")
