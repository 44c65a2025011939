"""Listings of image files. Contents are read only where they are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import basename, suffix
from quillspark.operators.records import natural_order, outside

FLAT = [".png", ".jpg", ".jpeg"]
IMAGES = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]


def listing(spark: SparkSession, folder: str, recursive: bool = False, suffixes: list[str] | None = None, content: bool = False) -> DataFrame:
    """path, file_name, modified, length (and content) of the files with one of the suffixes, in either case."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    columns = ["path", basename(F.col("path")).alias("file_name"), F.col("modificationTime").alias("modified"), "length"]
    return df.select(*columns, *["content"] * content).where(suffix(F.col("file_name")).isin(suffixes or (IMAGES if recursive else FLAT)))


def supported(spark: SparkSession, path: str, recursive: bool, suffixes: list[str] | None = None) -> DataFrame:
    """A folder's images, or the one file that the path is; another kind of file is an error."""
    name = path.rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(tuple(suffixes or IMAGES)):
        raise ValueError(f"not an image: {name}")
    return listing(spark, path, recursive, suffixes or IMAGES)


def ordered(df: DataFrame, natural: bool = False) -> DataFrame:
    return df.orderBy(*natural_order()) if natural else df.orderBy("path")


def inputs(df: DataFrame, output_folder: str) -> DataFrame:
    return df.where(outside(F.col("path"), output_folder))
