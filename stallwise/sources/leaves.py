"""Nested tables read by leaf.

The optimizer finds out by itself which fields of a struct, or of an array of
structs, are used.  It doesn't look into arrays inside arrays, and would read every
field of their elements.  So the leaves are named, and the reader gets a schema with
nothing else in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def declared(schema: str) -> T.StructType:
    """A schema written as column definitions."""
    return T.StructType.fromDDL(schema)


def pruned(kind: T.DataType, leaves: list[list[str]]) -> T.DataType:
    """A type with only the fields on the way to the leaves; an empty path keeps all that is below."""
    if [] in leaves:
        return kind
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(pruned(kind.elementType, leaves), kind.containsNull)
    if not isinstance(kind, T.StructType):
        raise ValueError(f"no fields in {kind.simpleString()}: {leaves}")
    missing = {path[0] for path in leaves} - set(kind.fieldNames())
    if missing:
        raise ValueError(f"no such fields: {sorted(missing)}")
    fields = []
    for field in kind.fields:
        below = [path[1:] for path in leaves if path[0] == field.name]
        if below:
            fields.append(T.StructField(field.name, pruned(field.dataType, below), field.nullable))
    return T.StructType(fields)


def read_leaves(spark: SparkSession, path: str, schema: str, leaves: list[str]) -> DataFrame:
    """A nested table with the named leaves only, such as ``cities.zones.name``; a name without dots may be a whole column."""
    return spark.read.schema(pruned(declared(schema), [leaf.split(".") for leaf in leaves])).parquet(path)
