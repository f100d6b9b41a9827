"""Declared column types -> Spark types."""

from __future__ import annotations

from collections.abc import Mapping

# Declared type name -> Spark type.
TYPES = {
    "varchar": "string",
    "char": "string",
    "longvarchar": "string",
    "integer": "int",
    "smallint": "smallint",
    "bigint": "bigint",
    "byteint": "tinyint",
    "decimal": "decimal",
    "number": "decimal(38,10)",
    "float": "double",
    "double": "double",
    "date": "date",
    "time": "string",
    "timestamp": "timestamp",
    "binary": "binary",
    "varbinary": "binary",
    "longvarbinary": "binary",
}


def spark_type(spec: Mapping) -> str:
    """Spark type of ``{"type", "length", "precision", "scale"}``; unknown names are refused."""
    name = str(spec["type"]).lower()
    if name not in TYPES:
        raise ValueError(f"unknown declared type {spec['type']!r}")
    if name == "decimal":
        return f"decimal({spec.get('precision') or 10},{spec.get('scale') or 0})"
    return TYPES[name]
