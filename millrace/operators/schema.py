"""Schemas: equality, missing fields, alignment and migration."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import MERGE_KEY

_INTS = (T.ByteType, T.ShortType, T.IntegerType)
CDM = {"guid": T.StringType(), "string": T.StringType(), "int64": T.LongType(), "decimal": T.DoubleType(), "dateTime": T.TimestampNTZType(), "dateTimeOffset": T.TimestampType(), "boolean": T.BooleanType()}
JDBC = {
    "BIGINT": T.LongType(), "INTEGER": T.IntegerType(), "SMALLINT": T.IntegerType(), "TINYINT": T.IntegerType(), "BINARY": T.BinaryType(), "VARBINARY": T.BinaryType(), "BIT": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "CHAR": T.StringType(), "VARCHAR": T.StringType(), "NCHAR": T.StringType(), "NVARCHAR": T.StringType(), "LONGVARCHAR": T.StringType(), "LONGNVARCHAR": T.StringType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampNTZType(),
    "TIMESTAMP_WITH_TIMEZONE": T.TimestampType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(),
}


def jdbc_type(name: str, precision: int = 0, scale: int = 0) -> T.DataType:
    if name in ("DECIMAL", "NUMERIC"):
        return T.DecimalType(precision or 38, scale)
    if name not in JDBC:
        raise ValueError(f"unsupported type {name}")
    return JDBC[name]


def manifest_schema(manifest: str, entity: str) -> T.StructType:
    """The schema of an entity in a folder manifest (JSON), every field nullable; unknown types are text."""
    for e in json.loads(manifest)["entities"]:
        if e["name"].lower() == entity.lower():
            return T.StructType([T.StructField(a["name"], CDM.get(a["dataType"], T.StringType()), True) for a in e["attributes"]])
    raise ValueError(f"no entity {entity}")


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equality that takes small integers for integers, and structs for sets of fields; decimals differ by precision and scale."""
    if isinstance(a, _INTS) and isinstance(b, _INTS):
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return same_type(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return len(a) == len(b) and all(any(same_field(x, y) for y in b) for x in a)
    return a.simpleString() == b.simpleString()


def same_field(a: T.StructField, b: T.StructField) -> bool:
    return a.name.lower() == b.name.lower() and same_type(a.dataType, b.dataType)


def missing_fields(target: T.StructType, source: T.StructType) -> list[T.StructField]:
    """The source's fields without an identical one in the target, in order."""
    return [f for f in source if not any(same_field(f, g) for g in target)]


def evolved(target: T.StructType, source: T.StructType) -> T.StructType:
    """The target with missing fields added at its end, nullable. A field whose type changed is an error."""
    missing = missing_fields(target, source)
    names = {f.name.lower() for f in target}
    clash = [f.name for f in missing if f.name.lower() in names]
    if clash:
        raise ValueError(f"fields have another type than the target's: {clash}")
    return T.StructType([*target, *(T.StructField(f.name, f.dataType, True) for f in missing)])


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns by name in any case, null where the data has none. Others are dropped."""
    known = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{known[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in known else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def with_merge_key(schema: T.StructType) -> T.StructType:
    return schema if MERGE_KEY in schema.names else T.StructType([*schema, T.StructField(MERGE_KEY, T.StringType(), True)])


def without_merge_key(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != MERGE_KEY])


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Changesets of different folders or shards as one, by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
