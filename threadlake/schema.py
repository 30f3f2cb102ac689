"""Struct types from short declarations, without a running session."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def kind(name: str) -> T.DataType:
    """``bigint``, ``array<string>``, ``array<array<double>>`` and so on."""
    if name.startswith("array<"):
        return T.ArrayType(kind(name[6:-1]))
    return _KINDS[name]


def struct(declared: str) -> T.StructType:
    """A struct from ``"name kind, name kind"``."""
    return T.StructType([T.StructField(n, kind(k)) for n, k in (part.split() for part in declared.split(","))])
