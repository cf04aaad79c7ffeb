"""The distances and other scalar functions as SQL functions, whose bodies the optimizer inlines: no UDF runs."""

from __future__ import annotations

from pyspark.sql import SparkSession

_ADD = "(s, x) -> s + x"
_PAIR = "a ARRAY<FLOAT>, b ARRAY<FLOAT>"
_DOT = "CASE WHEN size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * y), 0D, {add}) END".format(add=_ADD)
#: name: (parameters, type, body)
FUNCTIONS = {
    "vt_dot": (_PAIR, "DOUBLE", _DOT),
    "vt_norm": ("a ARRAY<FLOAT>", "DOUBLE", "CASE WHEN size(a) > 0 THEN sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x)) END"),
    "vt_l2_squared": (_PAIR, "DOUBLE", f"CASE WHEN size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, {_ADD}) END"),
    "vt_l2": (_PAIR, "DOUBLE", "sqrt(vt_l2_squared(a, b))"),
    "vt_cosine_distance": (_PAIR, "DOUBLE", "CASE WHEN vt_norm(a) * vt_norm(b) = 0 THEN 1D ELSE greatest(0D, 1 - vt_dot(a, b) / (vt_norm(a) * vt_norm(b))) END"),
    "vt_int8_dot": ("a ARRAY<INT>, b ARRAY<INT>", "BIGINT", f"CASE WHEN size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> CAST(x AS BIGINT) * y), 0L, {_ADD}) END"),
    "vt_int8_l2_squared": ("a ARRAY<INT>, b ARRAY<INT>", "BIGINT", f"CASE WHEN size(a) > 0 THEN aggregate(zip_with(a, b, (x, y) -> CAST(x - y AS BIGINT) * (x - y)), 0L, {_ADD}) END"),
    "vt_haversine_m": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE",
        "DOUBLE",
        "2 * 6371000D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
}


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to the session."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {gives} RETURN {body}")
    return spark
