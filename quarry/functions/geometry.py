"""Boxes [x, y, width, height] and vectors as columns."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a box may stick out at the right or bottom by rounding.
EDGE = 1 + 8 * sys.float_info.epsilon
#: The longest vector a feature may have.
MOST_DIMENSIONS = 4096


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def box_is_valid(box: Column) -> Column:
    """Four finite numbers, a positive size, inside the unit square; a null box is none and valid."""
    x, y, w, h = (box[k] for k in range(4))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x <= 1) & (y <= 1) & (x + w <= EDGE) & (y + h <= EDGE)
    return F.when(box.isNull(), True).when(F.size(box) != 4, False).otherwise(F.coalesce(F.forall(box, finite) & inside, F.lit(False)))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    width = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    common = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    union = a[2] * a[3] + b[2] * b[3] - common
    return F.when(union > 0, common / F.when(union > 0, union)).when(union.isNotNull(), 0.0)


def pair_overlaps(face: Column, body: Column, other_face: Column, other_body: Column) -> dict[str, Column]:
    """What a pair of instances is scored by: the overlaps of their faces and bodies, null where one is missing, and whether neither has a face."""
    return {"faces": iou(face, other_face), "bodies": iou(body, other_body), "faceless": face.isNull() & other_face.isNull()}


def overlap_score(faces: Column | str = "faces", bodies: Column | str = "bodies", faceless: Column | str = "faceless", min_face: float = 0.75, min_body: float = 0.8, min_companion: float = 0.5) -> Column:
    """How well two instances fit: by faces, whose bodies must not contradict, or by bodies where neither has a face; else null."""
    faces, bodies, faceless = (F.col(c) if isinstance(c, str) else c for c in (faces, bodies, faceless))
    by_face = (faces >= min_face) & (bodies.isNull() | (bodies >= min_companion))
    return F.when(faces.isNotNull(), F.when(by_face, faces)).when(faceless, F.when(bodies >= min_body, bodies))


def pair_score(face: Column, body: Column, other_face: Column, other_body: Column, **least: float) -> Column:
    """The score from the boxes. Over many rows, overlaps as columns of their own are made once instead of at each mention."""
    return overlap_score(**pair_overlaps(face, body, other_face, other_body), **least)


def dot(a: Column, b: Column) -> Column:
    """In double precision, whatever the vectors' type."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length or the lengths differ, so that no threshold is passed by NaN."""
    size = norm(a) * norm(b)
    value = dot(a, b) / F.when(size > 0, size)
    return F.when((F.size(a) == F.size(b)) & ~F.isnan(value), value)


def cosine_to(a: Column, query: list[float]) -> Column:
    """cosine() with one known vector, whose length is taken once."""
    length = sum((float(x) * float(x) for x in query), 0.0) ** 0.5
    size = norm(a) * length
    value = dot(a, F.array(*(F.lit(float(x)) for x in query))) / F.when(size > 0, size)
    return F.when((F.size(a) == len(query)) & ~F.isnan(value), value)


def unit(a: Column) -> Column:
    """The vector at length 1; null where its length is zero or not finite."""
    size = norm(a)
    return F.when((size > sys.float_info.epsilon**0.5) & finite(size), F.transform(a, lambda x: (x.cast("double") / size).cast("float")))


def vector_is_valid(a: Column) -> Column:
    """One to MOST_DIMENSIONS finite numbers of length 1, within 0.001."""
    return F.coalesce(F.size(a).between(1, MOST_DIMENSIONS) & F.forall(a, finite) & (F.abs(norm(a) - 1) <= 0.001), F.lit(False))


def cluster_vector(a: Column, dimensions: int = 512) -> Column:
    """The vector where clustering can use it: the right dimension, and a squared length within 0.002 of 1; else null."""
    square = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when((F.size(a) == dimensions) & (F.abs(square - 1) < 0.002), a)


def face_quality(score: Column, box: Column) -> Column:
    return score * F.sqrt(box[2] * box[3])


def clamp_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A corner box cut to the picture, as unit [x, y, width, height]; null where nothing is left."""
    left, top = F.greatest(x1, F.lit(0.0)), F.greatest(y1, F.lit(0.0))
    right, bottom = F.least(x2, width), F.least(y2, height)
    return F.when((right > left) & (bottom > top), F.array(left / width, top / height, (right - left) / width, (bottom - top) / height))
