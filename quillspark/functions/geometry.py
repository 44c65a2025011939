"""Expressions over boxes and polygons. A box is a struct left, top, right, bottom, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.base import let
from quillspark.schema import BOX


def rounded(c: Column) -> Column:
    """To a whole number, halves to the even one."""
    return F.rint(c).cast("int")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    left, top, right, bottom = (c.cast("int") for c in (left, top, right, bottom))
    width, height = F.greatest(F.lit(0), right - left), F.greatest(F.lit(0), bottom - top)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), width.alias("width"), height.alias("height"))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def far_right(b: Column) -> Column:
    return F.when(_zero(b["right"]) != 0, b["right"]).otherwise(_zero(b["left"]) + _zero(b["width"]))


def far_bottom(b: Column) -> Column:
    return F.when(_zero(b["bottom"]) != 0, b["bottom"]).otherwise(_zero(b["top"]) + _zero(b["height"]))


def union_of(boxes: Column, fallback: Column | None = None) -> Column:
    """The smallest box around an array of boxes; the fallback, or null, if there is none."""

    def around(v):
        low = lambda k: F.array_min(F.transform(v, lambda b: _zero(b[k])))
        sides = low("left"), low("top"), F.array_max(F.transform(v, far_right)), F.array_max(F.transform(v, far_bottom))
        names = ("left", "top", "right", "bottom")
        made = let(F.struct(*[x.cast("int").alias(n) for n, x in zip(names, sides)]), lambda x: box(*[x[n] for n in names]))
        return F.when(F.size(v) > 0, made).otherwise(F.lit(None).cast(BOX))

    if fallback is None:
        return let(F.array_compact(boxes), around)
    return let(F.array_compact(boxes), lambda v: let(F.when(F.size(v) > 0, v).otherwise(F.array_compact(F.array(fallback))), around))


def union_agg(b: Column) -> Column:
    """The same as an aggregate over rows."""
    return F.when(
        F.count(b) > 0, box(F.min(_zero(b["left"])), F.min(_zero(b["top"])), F.max(far_right(b)), F.max(far_bottom(b)))
    ).otherwise(F.lit(None).cast(BOX))


def document_box(boxes: Column, width: Column, height: Column) -> Column:
    """Around the words that have an area, padded and within the image; null if that is nothing."""
    return let(F.filter(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0)), lambda real: _padded(real, width, height))


def document_agg(b: Column, width: Column, height: Column) -> Column:
    """The same as an aggregate over rows."""
    only = lambda c: F.when((b["width"] > 0) & (b["height"] > 0), c)
    return _around(F.min(only(b["left"])), F.min(only(b["top"])), F.max(only(b["left"] + b["width"])), F.max(only(b["top"] + b["height"])), width, height)


def _padded(real: Column, width: Column, height: Column) -> Column:
    low = lambda k: F.array_min(F.transform(real, lambda b: b[k])).alias(k)
    far = lambda k, size: F.array_max(F.transform(real, lambda b: b[k] + b[size]))
    sides = F.struct(low("left"), low("top"), far("left", "width").alias("right"), far("top", "height").alias("bottom"))
    return let(sides, lambda s: F.when(F.size(real) > 0, _around(s["left"], s["top"], s["right"], s["bottom"], width, height)))


def _around(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    w, h = F.greatest(F.lit(1.0), (right - left).cast("double")), F.greatest(F.lit(1.0), (bottom - top).cast("double"))
    a, b = F.greatest(F.lit(0), rounded(left - w * 0.12)), F.greatest(F.lit(0), rounded(top - h * 0.1))
    c, d = F.least(width, rounded(right + w * 0.08)), F.least(height, rounded(bottom + h * 0.12))
    return F.when(left.isNotNull() & (c > a) & (d > b), box(a, b, c, d))


def center_x(b: Column) -> Column:
    return _zero(b["left"]) + _zero(b["width"]) / 2.0


def center_y(b: Column) -> Column:
    return _zero(b["top"]) + _zero(b["height"]) / 2.0


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])
    h = F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"])
    return F.when((w > 0) & (h > 0), w.cast("double") * h).otherwise(0.0)


def overlap_penalty(n: Column, area: Column, portrait: Column) -> Column:
    """Of n words that together cover area of a portrait's box."""
    whole = F.greatest(F.lit(1.0), portrait["width"].cast("double") * portrait["height"])
    return F.least(n * 0.55 + area / whole * 18.0, F.lit(7.5))


def percent(v: Column, total: Column) -> Column:
    return F.when(total <= 0, 0.0).otherwise(F.bround(v / total * 100.0, 4))


def box_percent(b: Column, width: Column, height: Column) -> Column:
    return F.struct(
        percent(b["left"], width).alias("left"), percent(b["top"], height).alias("top"), percent(b["width"], width).alias("width"), percent(b["height"], height).alias("height")
    )


def turned(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box as four integers after the page of this size is turned by a multiple of 90 degrees."""
    left, top, right, bottom = (F.get(b, F.lit(k)) for k in range(4))
    angle = F.pmod(angle, F.lit(360))
    return (
        F.when(F.size(b) < 4, b)
        .when(angle == 90, F.array(top, width - right, bottom, width - left))
        .when(angle == 180, F.array(width - right, height - bottom, width - left, height - top))
        .when(angle == 270, F.array(height - bottom, left, height - top, right))
        .otherwise(F.slice(b, 1, 4))
    )


def turned_back(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box found on a turned page, on the page as it was (of this size), within its bounds."""
    angle = F.pmod(angle, F.lit(360))
    by = lambda a, c, d, e: F.when(angle == 90, a).when(angle == 180, c).when(angle == 270, d).otherwise(e)
    left = by(b["top"], width - b["right"], width - b["bottom"], b["left"])
    right = by(b["bottom"], width - b["left"], width - b["top"], b["right"])
    top = by(height - b["right"], height - b["bottom"], b["left"], b["top"])
    bottom = by(height - b["left"], height - b["top"], b["right"], b["bottom"])
    zero = F.lit(0)
    return F.when(angle == 0, b).otherwise(box(F.greatest(zero, left), F.greatest(zero, top), F.least(width, right), F.least(height, bottom)))


def polygon_points(p: Column) -> Column:
    """The points with two coordinates at least."""
    return F.transform(F.filter(p, lambda x: (F.size(x) >= 2) & x[0].isNotNull() & x[1].isNotNull()), lambda x: F.slice(x, 1, 2))


def polygon_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda x: x[0]), F.transform(p, lambda x: x[1])
    return F.when(F.size(p) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def rectangle(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.array(F.array(left, top), F.array(right, top), F.array(right, bottom), F.array(left, bottom))


def polygon_rotation(p: Column) -> Column:
    """Degrees of the first edge; 0 without one."""
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when(F.size(p) < 2, 0.0).otherwise(F.degrees(F.atan2((b[1] - a[1]).cast("double"), (b[0] - a[0]).cast("double"))))


def portrait_box(face: Column, width: Column, height: Column) -> Column:
    """A face's box with room around it, within the image."""
    pad, above, below = face["width"] * 0.18, face["height"] * 0.40, face["height"] * 0.42
    left, top = F.greatest(F.lit(0), rounded(face["left"] - pad)), F.greatest(F.lit(0), rounded(face["top"] - above))
    right, bottom = F.least(width, rounded(face["right"] + pad)), F.least(height, rounded(face["bottom"] + below))
    right = F.when(right <= left, F.least(width, left + face["width"])).otherwise(right)
    bottom = F.when(bottom <= top, F.least(height, top + face["height"])).otherwise(bottom)
    return box(left, top, right, bottom)


def portrait_regions(doc: Column) -> tuple[Column, Column]:
    """Where a portrait may be on a document: at its left and at its right."""
    top = doc["top"] + rounded(doc["height"] * 0.2)
    bottom = F.least(doc["bottom"], doc["top"] + rounded(doc["height"] * 0.82))
    side = rounded(doc["width"] * 0.36)
    return box(doc["left"], top, doc["left"] + side, bottom), box(F.greatest(doc["left"], doc["right"] - side), top, doc["right"], bottom)


def _relative(face: Column, doc: Column) -> tuple[Column, Column]:
    x = (center_x(face) - doc["left"]) / F.greatest(F.lit(1.0), doc["width"].cast("double"))
    y = (center_y(face) - doc["top"]) / F.greatest(F.lit(1.0), doc["height"].cast("double"))
    return x, y


def in_portrait_region(face: Column, doc: Column) -> Column:
    x, y = _relative(face, doc)
    inside = center_x(face).between(doc["left"], doc["right"]) & center_y(face).between(doc["top"], doc["bottom"])
    return doc.isNull() | F.coalesce(inside & x.between(0.04, 0.96) & y.between(0.22, 0.9) & ((x <= 0.42) | (x >= 0.58)), F.lit(False))


def layout_score(face: Column, doc: Column) -> Column:
    """Bonus less penalty for a face's place on its document; 0 without a document."""
    x, y = _relative(face, doc)
    area = face["width"].cast("double") * face["height"] / F.greatest(F.lit(1.0), doc["width"].cast("double") * doc["height"])
    down = F.when(y.between(0.26, 0.78), 3.4).otherwise(-F.least(F.abs(y - 0.52) * 10.0, F.lit(5.2)))
    across = F.when((x <= 0.34) | (x >= 0.66), 2.4).otherwise(-F.least(F.abs(x - 0.5) * 6.0, F.lit(2.6)))
    size = F.when(area.between(0.012, 0.085), 1.6).otherwise(-F.least(F.abs(area - 0.038) * 36.0, F.lit(3.4)))
    return F.when(doc.isNull(), 0.0).otherwise(down + across + size)


def face_score(face: Column, width: Column, height: Column, doc: Column, preferred: Column, sharpness: Column, contrast: Column, penalty: Column) -> Column:
    """How well a face would do as the document's portrait.

    sharpness and contrast are measured upstream on the pixels; penalty is overlap_penalty of its portrait box."""
    area = face["width"].cast("double") * face["height"] / F.greatest(F.lit(1.0), width.cast("double") * height)
    x, y = center_x(face) / F.greatest(F.lit(1.0), width.cast("double")), center_y(face) / F.greatest(F.lit(1.0), height.cast("double"))
    side = F.when(_relative(face, doc)[0] <= 0.5, "left").otherwise("right")
    return (
        F.least(area * 28.0, F.lit(6.0))
        + F.when((x <= 0.42) | (x >= 0.58), 1.4).otherwise(-1.5)
        + F.when(y.between(0.18, 0.72), 1.0).otherwise(-0.8)
        + layout_score(face, doc)
        + F.when(doc.isNull() | preferred.isNull(), 0.0).when(side == preferred, 2.6).otherwise(-0.9)
        + F.least(sharpness / 120.0, F.lit(2.5))
        + F.least(contrast / 35.0, F.lit(1.5))
        - F.abs(1.0 - face["width"] / F.greatest(F.lit(1.0), face["height"].cast("double"))) * 0.6
        - penalty
    )
