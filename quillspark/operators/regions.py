"""The machine-readable region of a page, from its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry, scores
from quillspark.functions.base import let
from quillspark.functions.text import region_text


def scored_lines(lines: DataFrame) -> DataFrame:
    """doc_id, image size, order, box sides, text and score of the lines that may belong to a region."""
    b = F.col("bbox")
    rows = lines.where("bbox IS NOT NULL AND image_width > 0 AND image_height > 0")

    def scored(clean):
        score = scores.region_score(clean, b["left"], b["top"], b["left"] + b["width"], b["bottom"], F.col("image_width"), F.col("image_height"))
        return F.when(F.length(clean) >= scores.MIN_LENGTH, F.struct(clean.alias("clean"), score.alias("score")))

    # Cleaned and scored once, in a generator: a filter on either would be pushed below and compute both again.
    found = F.filter(F.array(let(region_text(F.coalesce("text", F.lit(""))), scored)), lambda x: x["score"] >= scores.MIN_SCORE)
    rows = rows.select("doc_id", "image_width", "image_height", "order", b["top"].alias("top"), b["bottom"].alias("bottom"), F.explode(found).alias("x"))
    return rows.select("doc_id", "image_width", "image_height", "order", "x.clean", "top", "bottom", "x.score")


def regions(lines: DataFrame) -> DataFrame:
    """doc_id, region: the full width from above the strong lines down, or above the two lowest if none is strong."""
    rows = scored_lines(lines)
    strong = (F.col("score") >= scores.STRONG) & (F.col("top") >= F.floor(F.col("image_height") * scores.LOW))
    lowest = Window.partitionBy("doc_id").orderBy(F.desc("bottom"), F.desc("score"), "order")
    rows = rows.withColumn("strong", strong).withColumn("nth", F.row_number().over(lowest))
    by = rows.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("strong"), F.col("top"))), F.min(F.when(F.col("nth") <= 2, F.col("top")))).alias("top"),
        F.max("image_width").alias("w"), F.max("image_height").alias("h"),
    )
    top = F.greatest(F.lit(0), F.col("top") - F.greatest(F.lit(4), F.floor(F.col("h") * scores.PAD)))
    return by.select("doc_id", geometry.box(F.lit(0), top, F.col("w"), F.col("h")).alias("region"))


def kept_part(found: DataFrame, mode: str) -> DataFrame:
    """What masking whites out, or cropping keeps: a box for the pixel step, that runs elsewhere."""
    r = F.col("region")
    part = r if mode == "mask" else geometry.box(F.lit(0), F.lit(0), r["right"], r["top"])
    return found.select("doc_id", part.alias("box"))
