"""Faces found on pages: duplicates, suppression, the portrait, the primary one.

faces: doc_id, left, top, width, height, score, and where known sharpness and contrast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import geometry
from quillspark.functions.base import computed, let
from quillspark.schema import BOX


def distinct_faces(faces: DataFrame) -> DataFrame:
    """Of faces that are equal to about four pixels, the first by order."""
    near = [F.rint(F.col(k) / 4).alias(f"_{k}") for k in ("left", "top", "width", "height")]
    first = F.row_number().over(Window.partitionBy("doc_id", *[f"_{k}" for k in ("left", "top", "width", "height")]).orderBy("order"))
    rows = faces.select("*", *near).withColumn("_nth", first).where("_nth = 1")
    return rows.drop("_nth", "_left", "_top", "_width", "_height")


def suppressed(faces: DataFrame, overlap: float = 0.3, least: float = 0.7, most: int = 5000) -> DataFrame:
    """Faces that no better face of the page overlaps by more than the limit; a fold by score, page by page, in the JVM.

    Boxes count as whole numbers, at least 1 wide and high; a face must score above least (as a 32-bit number).
    most: of the faces with the highest scores, as many are looked at; a detector's own limit per page, not one of ours."""
    whole = lambda c: F.when(~F.isnan(c.cast("double")), F.when(c < 0, F.ceil(c.cast("double"))).otherwise(F.floor(c.cast("double"))).cast("double"))
    sides = [*[whole(F.col(k)).alias(f"_{k[0]}") for k in ("left", "top")], *[F.when(F.col(k).isNotNull(), F.greatest(F.lit(1.0), whole(F.col(k)))).alias(f"_{k[0]}") for k in ("width", "height")]]
    rows = faces.where(F.col("score").cast("float") > F.lit(least).cast("float"))
    own = F.struct(*faces.columns)
    ranked = F.struct((-F.col("score")).alias("_s"), F.col("order").isNull().alias("_none"), F.col("order").alias("_o"), *sides, own.alias("_face"))
    limit = F.lit(overlap).cast("float").cast("double")

    def covers(a, b):
        side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
        both = side("_l", "_w") * side("_t", "_h")
        known = (a["_l"] + a["_t"] + a["_w"] + a["_h"] + b["_l"] + b["_t"] + b["_w"] + b["_h"]).isNotNull()
        return known & (both > limit * (a["_w"] * a["_h"] + b["_w"] * b["_h"] - both))

    pages = rows.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list(ranked)), 1, most).alias("_f"))
    kept = F.aggregate("_f", F.slice("_f", 1, 0), lambda out, f: F.when(F.exists(out, lambda k: covers(k, f)), out).otherwise(F.concat(out, F.array(f))))
    return pages.select(F.explode(kept).alias("_k")).select("_k._face.*")


def as_box(df: DataFrame) -> DataFrame:
    return df.withColumn("face", geometry.box(F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")))


def text_penalty(boxes: DataFrame, words: DataFrame, key: list[str], name: str = "penalty") -> DataFrame:
    """boxes (doc_id, key, box) with the penalty for the words that overlap the box; joined by document."""
    area = geometry.overlap_area(F.col("box"), F.col("bbox"))
    hits = boxes.select("doc_id", *key, "box").join(words.where("bbox IS NOT NULL").select("doc_id", "bbox"), "doc_id").withColumn("area", area).where("area > 0")
    sums = hits.groupBy("doc_id", *key).agg(F.count(F.lit(1)).alias("_n"), F.sum("area").alias("_area"))
    n, a = F.coalesce("_n", F.lit(0)), F.coalesce("_area", F.lit(0.0))
    return boxes.join(sums, ["doc_id", *key], "left").withColumn(name, geometry.overlap_penalty(n, a, F.col("box"))).drop("_n", "_area")


def penalty_of(box: Column, boxes: Column) -> Column:
    """The same of a box, by its page's array of words' boxes."""
    areas = F.filter(F.transform(boxes, lambda b: geometry.overlap_area(box, b)), lambda x: x > 0)
    return let(areas, lambda a: geometry.overlap_penalty(F.size(a), F.aggregate(a, F.lit(0.0), lambda s, x: s + x), box))


def preferred_side(document: Column, boxes: Column) -> Column:
    """Where a document has less text, if that is clear."""
    sides = F.array(*[penalty_of(r, boxes) for r in geometry.portrait_regions(document)])
    return F.when(document.isNotNull(), let(sides, lambda p: F.when(F.abs(p[0] - p[1]) >= 0.6, F.when(p[0] < p[1], "left").otherwise("right"))))


def portraits(faces: DataFrame, pages: DataFrame, words: DataFrame) -> DataFrame:
    """doc_id, face, portrait, score: the face that does best on each page(doc_id, image_width, image_height)."""
    by_page = words.groupBy("doc_id").agg(F.collect_list("bbox").alias("boxes"))
    return portraits_on(faces, pages.join(by_page, "doc_id", "left").withColumn("boxes", F.coalesce("boxes", F.array().cast(f"array<{BOX}>"))))


def portraits_on(faces: DataFrame, pages: DataFrame) -> DataFrame:
    """The same on pages that have their words' boxes as an array: words are neither shuffled nor joined."""
    doc = geometry.document_box(F.col("boxes"), F.col("image_width"), F.col("image_height"))
    pages = computed(pages, document=doc)
    pages = computed(pages, side=preferred_side(F.col("document"), F.col("boxes")))
    own = [c for c in faces.columns if c != "doc_id"]
    by_doc = faces.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("_faces"))
    # The penalties are taken before faces part from their page.
    face = lambda f: geometry.box(f["left"], f["top"], f["left"] + f["width"], f["top"] + f["height"])
    made = lambda f: F.struct(f.alias("f"), let(geometry.portrait_box(face(f), F.col("image_width"), F.col("image_height")), lambda p: penalty_of(p, F.col("boxes"))).alias("penalty"))
    pages = pages.join(by_doc, "doc_id").select("doc_id", "image_width", "image_height", "document", "side", F.explode(F.transform("_faces", made)).alias("_x"))
    rows = as_box(pages.select("*", "_x.f.*", "_x.penalty").drop("_x"))
    w, h, doc = F.col("image_width"), F.col("image_height"), F.col("document")
    rows = rows.withColumn("portrait", geometry.portrait_box(F.col("face"), w, h)).withColumn("inside", geometry.in_portrait_region(F.col("face"), doc))
    pixel = lambda k: F.coalesce(k, F.lit(0.0)) if k in faces.columns else F.lit(0.0)
    rows = rows.withColumn("score", geometry.face_score(F.col("face"), w, h, doc, F.col("side"), pixel("sharpness"), pixel("contrast"), F.col("penalty")))
    # Faces off the usual places count only where there is no other.
    by = Window.partitionBy("doc_id")
    rows = rows.withColumn("_any", F.max("inside").over(by)).where("inside OR NOT _any")
    area = F.col("width") * F.col("height")
    sizes = by.orderBy(F.desc(area), "order")
    rows = rows.withColumn("_nth", F.row_number().over(sizes)).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_largest", F.max(area).over(by))
    rows = rows.withColumn("_second", F.max(F.when(F.col("_nth") == 2, area)).over(by))
    several = F.col("_n") > 1
    rows = rows.where(doc.isNotNull() | ~several | (area >= F.floor(F.col("_largest") * 0.9)))
    best = rows.withColumn("_k", F.row_number().over(by.orderBy(F.desc("score"), F.when(doc.isNull(), F.col("_nth")).otherwise(F.col("order"))))).where("_k = 1")
    bonus = F.when(~several, 0.0).when(doc.isNull(), 0.4).when((F.col("_nth") == 1) & (F.col("_largest") >= F.floor(F.col("_second") * 1.12)), 0.12).otherwise(0.0)
    return best.select("doc_id", "face", "portrait", (F.col("score") + bonus).alias("score"))


def primary(faces: DataFrame) -> DataFrame:
    """Of every page the face with the largest score times area, the first of equals."""
    rank: Column = F.col("score") * F.greatest(F.lit(1.0), F.col("width").cast("double") * F.col("height"))
    return faces.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(rank), "order"))).where("_nth = 1").drop("_nth")
