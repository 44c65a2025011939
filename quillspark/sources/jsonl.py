"""Files with one JSON object a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.jsonx import json_object, json_value
from quillspark.functions.text import basename, stripped


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (rising within a file and over files in order of path, with gaps), value."""
    df = spark.read.text(path)
    return df.select(F.monotonically_increasing_id().alias("line_no"), "value")


def entries(df: DataFrame) -> DataFrame:
    """line_no, file_name, entry of lines that are objects with a name; others are dropped."""
    v = json_object(F.col("value"))
    name = stripped(F.coalesce(F.try_variant_get(v, "$.file_name", "string"), F.lit("")))
    return df.where(stripped(F.col("value")) != "").select("line_no", name.alias("file_name"), F.col("value").alias("entry"), v.isNotNull().alias("_ok")).where("_ok").drop("_ok")


def strict(df: DataFrame) -> DataFrame:
    """Entries by lower-case name, of several the last; a line that isn't JSON is an error with its number."""
    bad = (stripped(F.col("value")) != "") & json_value(F.col("value")).isNull()
    checked = df.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(" isn't JSON")))).otherwise(F.col("value")))
    rows = entries(checked).where("file_name != ''").withColumn("file_name", F.lower("file_name"))
    return rows.groupBy("file_name").agg(F.max_by("entry", "line_no").alias("entry"), F.max("line_no").alias("line_no"))


def permissive(df: DataFrame) -> DataFrame:
    """All entries, bad lines dropped, in order."""
    return entries(df)


def without(df: DataFrame, name: str) -> DataFrame:
    """Entries but those of a name; all of its duplicates go."""
    return df.where(basename(F.col("file_name")) != name)


def document(spark: SparkSession, path: str) -> DataFrame:
    """value: the one JSON object of a file as a variant; {} where it is missing or isn't an object."""
    empty = F.parse_json(F.lit("{}"))
    try:
        df = spark.read.option("wholetext", "true").text(path)
        df.schema  # noqa: B018
    except Exception:  # no such file
        return spark.range(1).select(empty.alias("value"))
    return df.select(F.coalesce(json_object(F.col("value")), empty).alias("value"))
