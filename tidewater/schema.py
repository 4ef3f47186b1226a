"""Schemas given as Arrow integration JSON."""

from __future__ import annotations

import json

from pyspark.sql import types as T


def _type(spec: dict, children: list[dict]) -> T.DataType:
    name = spec["name"]
    if name == "int":
        width = spec["bitWidth"] if spec.get("isSigned", True) else 2 * spec["bitWidth"]
        return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType(), 128: T.LongType()}[width]
    if name == "floatingpoint":
        return T.DoubleType() if spec["precision"] == "DOUBLE" else T.FloatType()
    if name == "timestamp":
        return T.TimestampType() if spec.get("timezone") else T.TimestampNTZType()
    if name == "decimal":
        return T.DecimalType(spec["precision"], spec["scale"])
    if name in ("list", "largelist"):
        return T.ArrayType(_field(children[0]).dataType, children[0].get("nullable", True))
    if name == "struct":
        return T.StructType([_field(c) for c in children])
    plain = {"utf8": T.StringType(), "largeutf8": T.StringType(), "bool": T.BooleanType(), "binary": T.BinaryType(), "largebinary": T.BinaryType(), "date": T.DateType(), "null": T.NullType()}
    if name not in plain:
        raise ValueError(f"no Spark type for the Arrow type {name!r}")
    return plain[name]


def _field(field: dict) -> T.StructField:
    return T.StructField(field["name"], _type(field["type"], field.get("children", [])), field.get("nullable", True))


def struct_from_json(text: str | dict) -> T.StructType:
    """The Spark schema for ``{"fields": [{"name", "nullable", "type", "children"}]}``."""
    spec = json.loads(text) if isinstance(text, str) else text
    return T.StructType([_field(f) for f in spec["fields"]])
