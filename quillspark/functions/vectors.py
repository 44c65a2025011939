"""Expressions over arrays of floats. Products are taken in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH, REVIEW = 0.363, 0.300


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def decision(score: Column, match: float = MATCH, review: float = REVIEW) -> Column:
    return F.when(score >= match, "match").when(score >= review, "review").otherwise("mismatch")


def softmax(v: Column) -> Column:
    most = F.array_max(v).cast("double")
    e = F.transform(v, lambda x: F.exp(x.cast("double") - most))
    return F.transform(e, lambda x: x / total(e))


def argmax(v: Column) -> Column:
    """Place of the largest value, the first of equals, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def classified(logits: Column, names: list[str]) -> Column:
    """label, class_id and confidence; a class without a name goes by its number."""
    k = argmax(logits)
    label = F.coalesce(F.get(F.array(*map(F.lit, names)).cast("array<string>"), k), k.cast("string"))
    return F.struct(label.alias("label"), k.alias("class_id"), F.round(F.get(softmax(logits), k), 6).alias("confidence"))


def decoded_faces(classes: Column, objects: Column, boxes: Column, points: Column, stride: int, columns: int, scale_x: Column, scale_y: Column, least: float = 0.7) -> Column:
    """Faces of one level of a grid detector: array of (left, top, width, height, landmarks, score).

    classes, objects: a value per cell; boxes: per cell offsets of the center, and log sizes, in strides; points: per cell
    five landmarks as offsets in strides, x and y in turn. Levels, one per stride, are joined by all_levels."""
    clip = lambda x: F.least(F.greatest(x.cast("double"), F.lit(0.0)), F.lit(1.0))

    def cell(c, i):
        o, b, marks = F.get(objects, i), F.get(boxes, i), F.get(points, i)
        row, column = F.floor(i / columns), i % columns
        w, h = F.exp(b[2].cast("double")) * stride, F.exp(b[3].cast("double")) * stride
        x, y = (column + b[0]) * stride, (row + b[1]) * stride
        landmarks = F.transform(marks, lambda p, k: F.when(k % 2 == 0, (p.cast("double") + column) * stride * scale_x).otherwise((p.cast("double") + row) * stride * scale_y))
        return F.struct(
            ((x - w / 2) * scale_x).alias("left"), ((y - h / 2) * scale_y).alias("top"), (w * scale_x).alias("width"), (h * scale_y).alias("height"), landmarks.alias("landmarks"), F.sqrt(clip(c) * clip(o)).alias("score")
        )

    return F.filter(F.transform(classes, cell), lambda f: f["score"] >= least)


def all_levels(*levels: Column) -> Column:
    """The faces of all levels of a detector, one after the other."""
    return F.concat(*levels)
