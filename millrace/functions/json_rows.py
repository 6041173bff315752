"""JSON documents to rows: pointers, arrays of rows, defaults and variants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pointer_parts(pointer: str) -> list[str]:
    """The names of an RFC 6901 pointer; the empty pointer is the whole document."""
    if not pointer:
        return []
    if not pointer.startswith("/"):
        raise ValueError(f"not a JSON pointer: {pointer}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def json_path(pointer: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in pointer_parts(pointer))


def at_pointer(text: Column, pointer: str) -> Column:
    """The JSON text at a pointer; a document without it is an error."""
    found = F.get_json_object(text, json_path(pointer)) if pointer else text
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit(f"JSON pointer {pointer} not found in "), F.substring(text, 1, 200)))).otherwise(found)


def root_rows(df: DataFrame, text: str, pointer: str = "", out: str = "root") -> DataFrame:
    """A row per root object: an object is one, an array gives one per element, anything else is an error."""
    found = F.trim(at_pointer(F.col(text), pointer))
    kind = F.substring(found, 1, 1)
    items = F.when(kind == "[", F.from_json(found, "array<string>")).when(kind == "{", F.array(found)).otherwise(F.raise_error(F.lit("the JSON root is neither an object nor an array")))
    return df.withColumn(out, F.explode(items))


def _field(text: Column, name: str) -> Column:
    return F.get_json_object(text, json_path("/" + name.replace("~", "~0").replace("/", "~1")))


def exploded_rows(df: DataFrame, root: str, schema: T.StructType, arrays: Sequence[tuple[str, Mapping[str, str]]] = ()) -> DataFrame:
    """The schema's columns from root objects, with arrays exploded in order.

    ``arrays`` has (pointer, {element's field: schema's field}). The first name of a pointer leaves the root; an element's
    fields replace the root's of the same name; later pointers work on what the earlier ones made (a pointer that the root
    doesn't have is looked up in the last element). An empty array gives no row, and anything but an array is an error.
    Fields that are missing or null are null.
    """
    dropped: set[str] = set()
    sources: dict[str, tuple[str, str]] = {}
    level = root
    elements: list[str] = []
    for k, (pointer, renames) in enumerate(arrays):
        top = pointer_parts(pointer)[0]
        options = [F.get_json_object(F.col(x), json_path(pointer)) for x in [level, *reversed(elements), root]]
        found = F.trim(F.coalesce(*options))
        items = F.when(F.substring(found, 1, 1) == "[", F.from_json(found, "array<string>")).otherwise(F.raise_error(F.lit(f"{pointer} is not an array")))
        name = f"__element_{k}"
        df = df.withColumn(name, F.explode(items))
        elements.append(name)
        if level == root:
            dropped.add(top)
        level = name
        for inner, outer in renames.items():
            sources[outer.lower()] = (name, inner)
    columns = []
    for field in schema:
        if field.name.lower() in sources:
            raw = _field(F.col(sources[field.name.lower()][0]), sources[field.name.lower()][1])
        elif field.name in dropped:
            raw = F.lit(None).cast("string")
        else:
            raw = F.coalesce(*(_field(F.col(x), field.name) for x in [root, *(elements if len(arrays) > 1 else [])]))
        columns.append(typed(raw, field.dataType).alias(field.name))
    return df.select(*[c for c in df.columns if c != root and c not in elements], *columns)


def typed(raw: Column, kind: T.DataType) -> Column:
    """A JSON value's text as a Spark type; nested types are parsed, variants kept as they are."""
    if isinstance(kind, T.StringType):
        return raw
    if isinstance(kind, T.VariantType):
        return F.try_parse_json(raw)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(raw, kind)
    return raw.cast(kind)


_AVRO = {"string": T.StringType(), "enum": T.StringType(), "fixed": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType()}


def avro_schema(document: Mapping) -> T.StructType:
    """A Spark schema from an Avro record's JSON: every field must be nullable with a default; nested ones become variants."""
    fields = []
    for f in document["fields"]:
        kinds = f["type"] if isinstance(f["type"], list) else [f["type"]]
        rest = [k for k in kinds if k != "null"]
        if len(rest) == len(kinds) or len(rest) != 1 or "default" not in f:
            raise ValueError(f"field {f['name']} must be [null, type] with a default")
        kind = rest[0]["type"] if isinstance(rest[0], dict) else rest[0]
        logical = rest[0].get("logicalType", "") if isinstance(rest[0], dict) else ""
        spark = T.VariantType() if kind in ("record", "array", "map") else T.DateType() if logical == "date" else T.TimestampType() if logical.startswith("timestamp") else _AVRO[kind]
        fields.append(T.StructField(f["name"], spark, True))
    return T.StructType(fields)
