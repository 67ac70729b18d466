"""Type texts, schemas as text, defaults, comparison, field marks."""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import types as T

_NAMES: dict[str, T.DataType] = {
    "null": T.NullType(), "void": T.NullType(), "boolean": T.BooleanType(), "bool": T.BooleanType(),
    "int8": T.ByteType(), "tinyint": T.ByteType(), "byte": T.ByteType(), "int16": T.ShortType(), "smallint": T.ShortType(), "short": T.ShortType(),
    "int32": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(), "int64": T.LongType(), "bigint": T.LongType(), "long": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float": T.FloatType(), "real": T.FloatType(), "float64": T.DoubleType(), "double": T.DoubleType(),
    "utf8": T.StringType(), "string": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "largeutf8": T.StringType(), "utf8view": T.StringType(),
    "binary": T.BinaryType(), "bytes": T.BinaryType(), "varbinary": T.BinaryType(), "largebinary": T.BinaryType(), "geometry": T.BinaryType(), "geography": T.BinaryType(),
    "date": T.DateType(), "date32": T.DateType(), "date64": T.DateType(), "timestamp": T.TimestampType(), "timestampltz": T.TimestampType(), "timestamptz": T.TimestampType(),
    "timestamp_ntz": T.TimestampNTZType(), "timestampntz": T.TimestampNTZType(), "duration": T.DayTimeIntervalType(), "variant": T.VariantType(),
}


class TypeText:
    """Recursive descent over a type text such as ``struct<a: int64!, b: list<decimal(9,2)>>``; ``!`` marks a required child."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, re.findall(r"[A-Za-z_]\w*|`[^`]*`|\d+|'[^']*'|[<>(),:!?\[\]]", text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if want and got != want:
            raise ValueError(f"expected {want!r} but found {got!r} in type {self.text!r}")
        self.at += 1
        return got

    def type(self, depth: int = 0) -> T.DataType:
        if depth > 64:
            raise ValueError("type nests deeper than 64 levels")
        name = self.take().lower()
        if name in ("list", "array", "largelist", "listview"):
            self.take("<")
            item, null = self.child(depth)
            self.take(">")
            return T.ArrayType(item, null)
        if name == "map":
            self.take("<")
            key, _ = self.child(depth)
            self.take(",")
            value, null = self.child(depth)
            self.take(">")
            return T.MapType(key, value, null)
        if name in ("struct", "record", "row"):
            self.take("<")
            fields = []
            while self.peek() != ">":
                child = self.take().strip("`")
                if self.peek() == ":":
                    self.take()
                kind, null = self.child(depth)
                fields.append(T.StructField(child, kind, null))
                if self.peek() == ",":
                    self.take()
            self.take(">")
            return T.StructType(fields)
        if name in ("decimal", "numeric", "decimal32", "decimal64", "decimal128", "decimal256"):
            p, s = 38 if name != "numeric" else 10, 0
            if self.peek() == "(":
                self.take()
                p = int(self.take())
                if self.peek() == ",":
                    self.take()
                    s = int(self.take())
                self.take(")")
            if p > 38:
                raise ValueError(f"decimal precision {p} exceeds 38")
            return T.DecimalType(p, s)
        if name not in _NAMES:
            raise ValueError(f"unknown type {name!r} in {self.text!r}")
        found = _NAMES[name]
        if self.peek() == "(":
            args = []
            self.take()
            while self.peek() != ")":
                args.append(self.take().strip("'"))
                if self.peek() == ",":
                    self.take()
            self.take(")")
            if name == "timestamp" and args and args[0] not in ("us", "UTC") and len(args) < 3 and args[0] in ("s", "ms", "ns"):
                raise ValueError(f"timestamp unit {args[0]} has no lossless Spark type; use us")
            if name == "timestamp":
                return T.TimestampType() if len(args) > 1 else T.TimestampNTZType()
        return found

    def child(self, depth: int) -> tuple[T.DataType, bool]:
        kind = self.type(depth + 1)
        if self.peek() == "!":
            self.take()
            return kind, False
        if self.peek() == "?":
            self.take()
        return kind, True


def parse_type(text: str) -> T.DataType:
    p = TypeText(text)
    found = p.type()
    if p.peek():
        raise ValueError(f"unexpected {p.peek()!r} after type {text!r}")
    return found


def parse_schema(text: str) -> T.StructType:
    """``id int64!, name utf8`` as a root struct."""
    return parse_type(f"struct<{text}>")


def type_text(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{f.name}: {type_text(f.dataType)}{'' if f.nullable else '!'}" for f in kind) + ">"
    if isinstance(kind, T.ArrayType):
        return f"list<{type_text(kind.elementType)}{'' if kind.containsNull else '!'}>"
    if isinstance(kind, T.MapType):
        return f"map<{type_text(kind.keyType)}, {type_text(kind.valueType)}{'' if kind.valueContainsNull else '!'}>"
    if isinstance(kind, T.DecimalType):
        return f"decimal({kind.precision}, {kind.scale})"
    names = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "string": "utf8", "void": "null", "timestamp": "timestamptz"}
    return names.get(kind.simpleString(), "duration" if isinstance(kind, T.DayTimeIntervalType) else kind.simpleString())


def default_of(kind: T.DataType, nullable: bool = False):
    """The canonical default: null where nullable, else zero, the empty text, false, the epoch, or defaults all the way down."""
    if nullable or isinstance(kind, (T.NullType, T.VariantType)):
        return None
    if isinstance(kind, T.StructType):
        return tuple(default_of(f.dataType, f.nullable) for f in kind)
    if isinstance(kind, T.ArrayType):
        return []
    if isinstance(kind, T.MapType):
        return {}
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, T.BinaryType):
        return b""
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(0).scaleb(-kind.scale)
    if isinstance(kind, T.DateType):
        return datetime.date(1970, 1, 1)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime(1970, 1, 1)
    if isinstance(kind, T.DayTimeIntervalType):
        return datetime.timedelta(0)
    return 0.0 if isinstance(kind, (T.FloatType, T.DoubleType)) else 0


def diff(left: T.StructType, right: T.StructType, at: str = "") -> list[str]:
    """Readable differences of two schemas; names compare without case."""
    out, other = [], {f.name.lower(): f for f in right}
    for f in left:
        g, path = other.pop(f.name.lower(), None), f"{at}{f.name}"
        if g is None:
            out.append(f"- {path}: {type_text(f.dataType)}")
        elif isinstance(f.dataType, T.StructType) and isinstance(g.dataType, T.StructType):
            out += diff(f.dataType, g.dataType, f"{path}.")
        elif f.dataType != g.dataType:
            out.append(f"~ {path}: {type_text(f.dataType)} -> {type_text(g.dataType)}")
        if g is not None and f.nullable != g.nullable:
            out.append(f"~ {path}: {'nullable' if f.nullable else 'required'} -> {'nullable' if g.nullable else 'required'}")
    return out + [f"+ {at}{g.name}: {type_text(g.dataType)}" for g in other.values()]


def with_meta(f: T.StructField, **more) -> T.StructField:
    return T.StructField(f.name, f.dataType, f.nullable, (f.metadata or {}) | more)


def mark_partitions(schema: T.StructType, names: list[str]) -> T.StructType:
    known = {n.lower() for n in names}
    if missing := known - {f.name.lower() for f in schema}:
        raise ValueError(f"no field {sorted(missing)}")
    return T.StructType([with_meta(f, partition=f.name.lower() in known) for f in schema])


def partition_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if (f.metadata or {}).get("partition")]


def without_fields(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([f for f in schema if f.name.lower() not in {n.lower() for n in names}])


def assign_ids(schema: T.StructType, start: int = 1) -> T.StructType:
    """Field ids in the metadata that Parquet readers and writers of Spark know."""
    return T.StructType([with_meta(f, **{"parquet.field.id": start + i}) for i, f in enumerate(schema)])


def field_by_id(schema: T.StructType, number: int) -> T.StructField | None:
    return next((f for f in schema if (f.metadata or {}).get("parquet.field.id") == number), None)


def pretty(schema: T.StructType, indent: int = 0) -> str:
    out = []
    for f in schema:
        kind = f.dataType
        if isinstance(kind, T.StructType):
            out.append(f"{'  ' * indent}{f.name}: struct{'' if f.nullable else '!'}")
            out.append(pretty(kind, indent + 1))
        else:
            out.append(f"{'  ' * indent}{f.name}: {type_text(kind)}{'' if f.nullable else '!'}")
    return "\n".join(out)


def from_hints(cls: type) -> T.StructType:
    """A root schema from a class's type hints (T | None: nullable)."""
    import types as pytypes
    import typing

    simple = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType(), datetime.timedelta: T.DayTimeIntervalType(), decimal.Decimal: T.DecimalType(38, 18)}

    def of(hint) -> tuple[T.DataType, bool]:
        origin, args = typing.get_origin(hint), typing.get_args(hint)
        if origin in (typing.Union, pytypes.UnionType):
            rest = [a for a in args if a is not type(None)]
            if len(rest) != 1:
                raise ValueError(f"no single type for {hint}")
            return of(rest[0])[0], True
        if origin is list:
            kind, null = of(args[0])
            return T.ArrayType(kind, null), False
        if origin is dict:
            (key, _), (value, null) = of(args[0]), of(args[1])
            return T.MapType(key, value, null), False
        if hint in simple:
            return simple[hint], False
        if isinstance(hint, type) and hasattr(hint, "__annotations__"):
            return from_hints(hint), False
        raise ValueError(f"no type for {hint}")

    return T.StructType([T.StructField(n, *of(h)) for n, h in typing.get_type_hints(cls).items()])


#: Names of primitive types in the published table schema form.
_TABLE_NAMES = {"boolean": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "long", "float": "float", "double": "double", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "string": "string", "binary": "binary"}


def table_json(schema: T.StructType) -> dict:
    """A schema in the published JSON form of table formats: every field, element, key and value has an id of its own, children after their level."""
    last = 0

    def fresh() -> int:
        nonlocal last
        last += 1
        return last

    def of(kind: T.DataType):
        if isinstance(kind, T.StructType):
            ids = [fresh() for _ in kind]
            return {"type": "struct", "fields": [{"id": i, "name": f.name, "required": not f.nullable, "type": of(f.dataType)} for i, f in zip(ids, kind, strict=True)]}
        if isinstance(kind, T.ArrayType):
            i = fresh()
            return {"type": "list", "element-id": i, "element-required": not kind.containsNull, "element": of(kind.elementType)}
        if isinstance(kind, T.MapType):
            k, v = fresh(), fresh()
            return {"type": "map", "key-id": k, "key": of(kind.keyType), "value-id": v, "value-required": not kind.valueContainsNull, "value": of(kind.valueType)}
        if isinstance(kind, T.DecimalType):
            return f"decimal({kind.precision}, {kind.scale})"
        if (name := _TABLE_NAMES.get(kind.simpleString())) is None:
            raise ValueError(f"no table type for {kind.simpleString()}")
        return name

    return {**of(schema), "schema-id": 0}


def from_table_json(found) -> T.DataType:
    """The type of a schema in that form; ids stay in the metadata of fields."""
    if isinstance(found, dict):
        if found["type"] == "struct":
            return T.StructType([T.StructField(f["name"], from_table_json(f["type"]), not f["required"], {"parquet.field.id": f["id"]}) for f in found["fields"]])
        if found["type"] == "list":
            return T.ArrayType(from_table_json(found["element"]), not found["element-required"])
        return T.MapType(from_table_json(found["key"]), from_table_json(found["value"]), not found["value-required"])
    if found.startswith("decimal"):
        return T.DecimalType(*(int(x) for x in found[8:-1].split(",")))
    names = {v: k for k, v in _TABLE_NAMES.items() if k not in ("tinyint", "smallint")}
    if found in names:
        return T._parse_datatype_string(names[found])
    raise ValueError(f"no type {found!r}")
