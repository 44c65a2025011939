"""Reading order of boxes on a page, and the ids that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry
from quillspark.functions.base import computed


def line_starts(boxes: Column, tolerance: Column) -> Column:
    """boxes: array of (top, left, nth) by top and left; the places (from 1) at which a line starts.

    A box joins the line if its top is within tolerance of the line's first; a fold in the JVM that holds the starts only."""
    start = F.struct(F.lit(None).cast("int").alias("top"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(a, b):
        stays = F.coalesce(F.abs(b["top"] - a["top"]) <= tolerance, F.lit(False))
        n = a["n"] + 1
        return F.when(stays, F.struct(a["top"].alias("top"), n.alias("n"), a["out"].alias("out"))).otherwise(F.struct(b["top"].cast("int").alias("top"), n.alias("n"), F.concat(a["out"], F.array(n)).alias("out")))

    return F.aggregate(boxes, start, step, lambda a: a["out"])


def in_reading_order(entries: DataFrame, key: str = "doc_id", nth: str = "nth") -> DataFrame:
    """entries(key, nth, left, top, right, bottom, ...) with line and position (both from 1)."""
    own = [c for c in entries.columns if c != key]
    return pages_in_order(entries.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("entries")), key, nth)


def pages_in_order(pages: DataFrame, key: str = "doc_id", nth: str = "nth") -> DataFrame:
    """The same of pages(key, entries: an array of them). A page's entries are folded together in their row: they aren't
    joined or windowed, and shuffled only by who collects them."""
    heights = F.sort_array(F.transform("entries", lambda e: F.greatest(F.lit(1), e["bottom"] - e["top"])))
    placed = F.sort_array(F.transform("entries", lambda e: F.struct(e["top"].cast("int").alias("top"), e["left"].cast("int").alias("left"), e[nth].alias("nth"), e.alias("e"))))
    pages = computed(pages, _heights=heights, _boxes=placed).drop("entries")
    at = lambda k: F.get("_heights", k.cast("int"))
    n = F.size("_heights")
    pages = computed(pages, _m=(at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0)
    boxes = F.transform("_boxes", lambda b: F.struct(b["top"].alias("top"), b["left"].alias("left"), b["nth"].alias("nth")))
    pages = computed(pages, _starts=line_starts(boxes, F.greatest(F.lit(10), F.floor(F.col("_m") * 0.6))))
    line = lambda s, k: F.slice("_boxes", s, F.coalesce(F.get("_starts", k + 1), F.size("_boxes") + 1) - s)
    across = lambda b, k: F.struct(b["e"]["left"].alias("left"), b["e"]["top"].alias("top"), b["nth"].alias("nth"), (k + 1).alias("line"), b["e"].alias("e"))
    ordered = F.flatten(F.transform("_starts", lambda s, k: F.sort_array(F.transform(line(s, k), lambda b: across(b, k)))))
    rows = pages.select(key, F.posexplode(ordered).alias("_at", "_z"))
    return rows.select(key, "_z.e.*", F.col("_z.line").alias("line"), (F.col("_at") + 1).alias("position"))


def numbered(entries: DataFrame, prefix: str, digits: int, position: str = "position") -> DataFrame:
    return entries.withColumn("id", F.format_string(f"{prefix}_%0{digits}d", F.col(position)))


def words_of_lines(lines: DataFrame) -> DataFrame:
    """A word per word box of a line: with polygons if there are any, else from boxes, else the line as one word.

    lines: doc_id, id, text, confidence, rotation, order, box, polygons, boxes, texts."""
    none = F.array().cast("array<int>")
    boxes = F.when(F.size("polygons") > 0, F.transform("polygons", geometry.polygon_box)).when(F.size("boxes") > 0, F.col("boxes")).otherwise(F.array("box"))
    texts = F.when((F.size("polygons") > 0) | (F.size("boxes") > 0), F.col("texts")).otherwise(F.array("text"))
    rows = lines.select("doc_id", F.col("id").alias("line_id"), "confidence", "rotation", F.col("order").alias("line_order"), F.posexplode(F.arrays_zip(texts.alias("t"), boxes.alias("b"))).alias("nth", "w"))
    rows = rows.select("doc_id", "line_id", "confidence", "rotation", "line_order", "nth", F.col("w.t").alias("text"), F.coalesce("w.b", none).alias("box")).where("text IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("line_order", "nth")
    return numbered(rows.withColumn("order", F.row_number().over(order)), "word", 4, "order")
