"""Vector functions under names that SQL text can use."""

from __future__ import annotations

from pyspark.sql import SparkSession

_VECTOR = "ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
_LENGTH = "sqrt(aggregate({v}, 0D, (s, x) -> s + x * x))"
_A, _B = _LENGTH.format(v="a"), _LENGTH.format(v="b")

#: name -> (parameters, type, body); bodies are built-in functions, so they stay in the plan.
FUNCTIONS = {
    "vec_dot": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", _DOT),
    "vec_norm": (f"a {_VECTOR}", "DOUBLE", _A),
    "vec_cosine": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", f"CASE WHEN {_A} = 0 OR {_B} = 0 THEN 0D ELSE {_DOT} / ({_A} * {_B}) END"),
    "vec_l2": (f"a {_VECTOR}, b {_VECTOR}", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "vec_normalise": (f"a {_VECTOR}", _VECTOR, f"transform(a, x -> CASE WHEN {_A} = 0 THEN 0D ELSE x / {_A} END)"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
