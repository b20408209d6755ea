"""Box functions for SQL text, as SQL functions over arrays: nothing leaves the JVM, the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "xl array<double>, xu array<double>, v array<double>, w array<double>"
_SIDES = "zip_with(xu, w, (a, b) -> a - b), zip_with(v, xl, (a, b) -> a - b)"

FUNCTIONS = {
    "box_membership": (f"{_BOX}, g double", "double", f"array_min(transform(concat({_SIDES}), z -> 1.0D - greatest(0.0D, least(1.0D, z * g))))"),
    "box_overlaps": ("v1 array<double>, w1 array<double>, v2 array<double>, w2 array<double>", "boolean",
                     "forall(zip_with(v1, w1, (a, b) -> a <= b), t -> t) AND forall(zip_with(v2, w2, (a, b) -> a <= b), t -> t) AND forall(zip_with(v1, w2, (a, b) -> a <= b), t -> t) AND forall(zip_with(v2, w1, (a, b) -> a <= b), t -> t)"),
    "box_contains": ("v1 array<double>, w1 array<double>, v2 array<double>, w2 array<double>", "boolean", "forall(zip_with(v2, v1, (a, b) -> a <= b), t -> t) AND forall(zip_with(w1, w2, (a, b) -> a <= b), t -> t)"),
    "box_distance": ("x array<double>, v array<double>, w array<double>", "double", "aggregate(zip_with(x, zip_with(v, w, (a, b) -> (a + b) / 2), (a, b) -> abs(a - b)), 0.0D, (s, z) -> s + z)"),
    "pair_code": ("a bigint, b bigint", "bigint", "greatest(a, b) * (greatest(a, b) + 1) DIV 2 + least(a, b)"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (takes, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS {returns} RETURN {body}")
    return sorted(FUNCTIONS)
