"""Embedding arithmetic as Column expressions: no UDF, sums in double precision.

Vectors are array<float>. A null or empty embedding, or vectors of different lengths, give a null distance (zip_with pads the
shorter one with nulls); NaN elements give NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_squared(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def negative_dot(a: Column, b: Column) -> Column:
    """The inner product as a distance: smaller is closer."""
    return -dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, never below 0; 1 if either embedding is zero."""
    length = norm(a) * norm(b)
    d = F.when(length == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / length)
    return F.when(d < 0, 0.0).otherwise(d)


METRICS = {"cosine": cosine_distance, "euclidean": l2, "squared_euclidean": l2_squared, "dot": negative_dot}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric](a, b)


def normalize(a: Column) -> Column:
    """The embedding at length 1; a zero embedding stays as it is."""
    length = norm(a)
    return F.when(length == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / length))


def residual(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def literal(embedding: list[float]) -> Column:
    """An embedding given by the caller, rounded to single precision as stored vectors are."""
    return F.array(*(F.lit(float(x)).cast("float") for x in embedding))
