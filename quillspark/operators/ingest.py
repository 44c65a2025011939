"""Batches of files: what is new, what is done, what came of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import basename, normalized_path


def with_keys(df: DataFrame, path: str = "image_path") -> DataFrame:
    return df.withColumn("normalized_path", normalized_path(F.col(path))).withColumn("lower_name", F.lower(basename(F.col(path))))


def without_duplicates(batch: DataFrame, existing: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of batch whose path and file name are both new, also among the rows before them.

    Equal on either key is a duplicate; two anti joins by key, where one join on OR would compare all pairs.
    Of rows with one name the first counts; equal paths have equal names."""
    batch, existing = with_keys(batch), with_keys(existing)
    fresh = batch.join(existing.select("normalized_path").distinct(), "normalized_path", "left_anti")
    fresh = fresh.join(existing.select("lower_name").distinct(), "lower_name", "left_anti")
    # A path has one name, so rows dropped above can't hide a row that stays.
    return first_of_each(fresh, "lower_name", order)


def outcome_counts(df: DataFrame, outcome: str = "outcome") -> DataFrame:
    return df.groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))


def one_per_content(df: DataFrame, content: Column, order: list[Column]) -> DataFrame:
    """The first row of every content, by digest, and how many there were."""
    return first_of_each(df.withColumn("content_key", F.sha2(content, 256)), "content_key", order, "copies")


def first_of_each(df: DataFrame, key: str, order: list[Column], copies: str | None = None) -> DataFrame:
    """The first row of every key in ascending order, and how many there were: an aggregate that
    combines before its shuffle, so a key's rows never meet in one task."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    found = df.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row"), *([F.count(F.lit(1)).alias(copies)] if copies else []))
    return found.select(key, "_row.*", *([copies] if copies else []))


def source_name(output: Column, mode: str) -> Column:
    """The name that an output of the mode (mask or crop) was made from; null if it isn't one."""
    found = F.regexp_replace(output, rf"(?i)^(.+)_{mode}(\.[^.]+)?$", "$1$2")
    return F.when(output.rlike(rf"(?i)^.+_{mode}(\.[^.]+)?$"), found)


def output_name(name: Column, mode: str) -> Column:
    return F.regexp_replace(name, r"(?s)^(.+?)(\.[^.]*)?$", f"$1_{mode}$2")


def processed(state: DataFrame, metadata: DataFrame, outputs: DataFrame, mode: str) -> DataFrame:
    """Sources that a state, the metadata's names or the outputs' names say are done."""
    parts = [state.select("file_name"), *[x.select(source_name(F.col("file_name"), mode).alias("file_name")) for x in (metadata, outputs)]]
    return parts[0].union(parts[1]).union(parts[2]).where("file_name IS NOT NULL").distinct()


def pending(sources: DataFrame, done: DataFrame, outputs: DataFrame, skipped: DataFrame, mode: str) -> DataFrame:
    """Sources still to do: all but those done whose output is there or that are known to give none."""
    made = outputs.select(source_name(F.col("file_name"), mode).alias("file_name")).where("file_name IS NOT NULL")
    settled = done.select("file_name").join(made.union(skipped.select("file_name")).distinct(), "file_name", "left_semi")
    return sources.join(settled, "file_name", "left_anti")


def with_metadata(images: DataFrame, metadata: DataFrame) -> DataFrame:
    """Images with the metadata entry of their name, in either case, of several the last; missing: none found."""
    entries = metadata.groupBy(F.lower("file_name").alias("_key")).agg(F.max_by("entry", "line_no").alias("entry"))
    return images.withColumn("_key", F.lower("file_name")).join(entries, "_key", "left").withColumn("missing", F.col("entry").isNull()).drop("_key")


def resolved_path(df: DataFrame, listing: DataFrame, folder: str) -> DataFrame:
    """df(image_path) with the path if it is in the listing(path), else the same name in folder if that is, else as it is."""
    known = listing.select("path").distinct()
    there = known.select(F.col("path").alias("image_path"), F.lit(True).alias("_there"))
    other = known.select(F.col("path").alias("_other"), F.lit(True).alias("_moved"))
    df = df.withColumn("_other", F.concat(F.lit(folder.rstrip("/") + "/"), basename(F.col("image_path"))))
    df = df.join(there, "image_path", "left").join(other, "_other", "left")
    path = F.when(F.col("_there"), F.col("image_path")).when(F.col("_moved"), F.col("_other")).otherwise(F.col("image_path"))
    return df.withColumn("resolved_path", path).drop("_there", "_moved", "_other")


def unchecked(files: DataFrame, markers: DataFrame) -> DataFrame:
    """Files whose (modified, length) differs from the marker kept for their path."""
    return files.join(markers, ["path", "modified", "length"], "left_anti")


def cached(results: DataFrame, capacity: int) -> DataFrame:
    """What a cache of this capacity holds after writes(content_key, written): the last written; reading doesn't count."""
    last = results.groupBy("content_key").agg(F.max("written").alias("written"))
    return last.orderBy(F.desc("written"), "content_key").limit(capacity)


def cache_misses(requests: DataFrame, results: DataFrame) -> DataFrame:
    return requests.join(results.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])
