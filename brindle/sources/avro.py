"""Avro object container files: codec of values and blocks, schema mapping, distributed read and write."""

from __future__ import annotations

import datetime
import decimal
import io
import json
import os
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAGIC = b"Obj\x01"


class Reader:
    def __init__(self, raw: bytes):
        self.f = io.BytesIO(raw)

    def take(self, n: int) -> bytes:
        got = self.f.read(n)
        if len(got) != n:
            raise ValueError("truncated avro data")
        return got

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 127) << shift
            if b < 128:
                return (n >> 1) ^ -(n & 1)
            shift += 7
            if shift > 63:
                raise ValueError("avro long is too long")

    def bytes(self) -> bytes:
        n = self.long()
        if n < 0:
            raise ValueError("negative length")
        return self.take(n)


def put_long(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    out = bytearray()
    while n & ~127:
        out.append((n & 127) | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


_EPOCH = datetime.datetime(1970, 1, 1)


def decode(schema, r: Reader, names: dict | None = None):
    names = {} if names is None else names
    if isinstance(schema, list):
        return decode(schema[r.long()], r, names)
    if isinstance(schema, str):
        schema = names.get(schema, {"type": schema})
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return decode(kind, r, names)
    if "name" in schema:
        names[schema["name"]] = schema
    if kind == "null":
        return None
    if kind == "boolean":
        return r.take(1) != b"\0"
    if kind in ("int", "long"):
        n = r.long()
        if logical == "date":
            return datetime.date(1970, 1, 1) + datetime.timedelta(n)
        if logical in ("timestamp-micros", "local-timestamp-micros"):
            return _EPOCH + datetime.timedelta(microseconds=n)
        return _EPOCH + datetime.timedelta(milliseconds=n) if logical in ("timestamp-millis", "local-timestamp-millis") else n
    if kind == "float":
        return struct.unpack("<f", r.take(4))[0]
    if kind == "double":
        return struct.unpack("<d", r.take(8))[0]
    if kind in ("bytes", "fixed"):
        raw = r.bytes() if kind == "bytes" else r.take(schema["size"])
        return decimal.Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-schema.get("scale", 0)) if logical == "decimal" else raw
    if kind == "string":
        return r.bytes().decode()
    if kind == "enum":
        return schema["symbols"][r.long()]
    if kind == "record":
        return {f["name"]: decode(f["type"], r, names) for f in schema["fields"]}
    if kind in ("array", "map"):
        out = []
        while n := r.long():
            if n < 0:
                n = -n
                r.long()
            for _ in range(n):
                out.append((r.bytes().decode(), decode(schema["values"], r, names)) if kind == "map" else decode(schema["items"], r, names))
        return dict(out) if kind == "map" else out
    raise ValueError(f"unknown avro type {kind!r}")


def encode(schema, v) -> bytes:
    if isinstance(schema, list):
        for i, s in enumerate(schema):
            if (v is None) == (s == "null"):
                return put_long(i) + encode(s, v)
        raise ValueError("null where none is allowed")
    if isinstance(schema, str):
        schema = {"type": schema}
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return encode(kind, v)
    if kind == "null":
        return b""
    if kind == "boolean":
        return b"\1" if v else b"\0"
    if kind in ("int", "long"):
        if isinstance(v, datetime.datetime):
            v = (v.replace(tzinfo=None) - _EPOCH) // datetime.timedelta(microseconds=1)
        elif isinstance(v, datetime.date):
            v = (v - datetime.date(1970, 1, 1)).days
        return put_long(v)
    if kind == "float":
        return struct.pack("<f", v)
    if kind == "double":
        return struct.pack("<d", v)
    if kind in ("bytes", "fixed"):
        if logical == "decimal":
            n = int(v.scaleb(schema.get("scale", 0)))
            v = n.to_bytes(schema["size"] if kind == "fixed" else (n.bit_length() + 8) // 8, "big", signed=True)
        return v if kind == "fixed" else put_long(len(v)) + v
    if kind == "string":
        return put_long(len(v.encode())) + v.encode()
    if kind == "record":
        return b"".join(encode(f["type"], v.get(f["name"])) for f in schema["fields"])
    if kind == "array":
        return (put_long(len(v)) + b"".join(encode(schema["items"], x) for x in v) if v else b"") + b"\0"
    if kind == "map":
        return (put_long(len(v)) + b"".join(encode("string", k) + encode(schema["values"], x) for k, x in v.items()) if v else b"") + b"\0"
    raise ValueError(f"unknown avro type {kind!r}")


def container(schema: dict, rows, codec: str = "deflate", meta: dict | None = None, block: int = 4000) -> bytes:
    sync = os.urandom(16)
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()} | {k: v.encode() for k, v in (meta or {}).items()}
    out = [MAGIC, put_long(len(head)), *(encode("string", k) + encode("bytes", v) for k, v in head.items()), b"\0", sync]
    rows = list(rows)
    for at in range(0, len(rows), block):
        body = b"".join(encode(schema, r) for r in rows[at : at + block])
        if codec == "deflate":
            z = zlib.compressobj(wbits=-15)
            body = z.compress(body) + z.flush()
        elif codec == "zstandard":
            import zstandard

            body = zstandard.compress(body)
        elif codec != "null":
            raise ValueError(f"no codec {codec!r}")
        out += [put_long(len(rows[at : at + block])), put_long(len(body)), body, sync]
    return b"".join(out)


def header(r: Reader) -> tuple[dict, dict, bytes]:
    if r.take(4) != MAGIC:
        raise ValueError("no avro container")
    meta = decode({"type": "map", "values": "bytes"}, r)
    return json.loads(meta["avro.schema"]), meta, r.take(16)


def rows_of(raw: bytes):
    r = Reader(raw)
    schema, meta, sync = header(r)
    codec = meta.get("avro.codec", b"null").decode()
    while r.f.tell() < len(raw):
        n, body = r.long(), r.bytes()
        if r.take(16) != sync:
            raise ValueError("avro block has no sync marker")
        if codec == "deflate":
            body = zlib.decompress(body, -15)
        elif codec == "zstandard":
            import zstandard

            body = zstandard.decompress(body)
        elif codec != "null":
            raise ValueError(f"no codec {codec!r}")
        inner = Reader(body)
        for _ in range(n):
            yield decode(schema, inner)


def avro_type(kind: T.DataType, nullable: bool, name: str = "root"):
    simple = {T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "bytes"}
    if type(kind) in simple:
        out = simple[type(kind)]
    elif isinstance(kind, T.DateType):
        out = {"type": "int", "logicalType": "date"}
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = {"type": "long", "logicalType": "timestamp-micros" if isinstance(kind, T.TimestampType) else "local-timestamp-micros"}
    elif isinstance(kind, T.DecimalType):
        out = {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    elif isinstance(kind, T.ArrayType):
        out = {"type": "array", "items": avro_type(kind.elementType, kind.containsNull, f"{name}_item")}
    elif isinstance(kind, T.MapType):
        out = {"type": "map", "values": avro_type(kind.valueType, kind.valueContainsNull, f"{name}_value")}
    elif isinstance(kind, T.StructType):
        out = {"type": "record", "name": name, "fields": [{"name": f.name, "type": avro_type(f.dataType, f.nullable, f"{name}_{f.name}")} for f in kind]}
    else:
        raise ValueError(f"no avro type for {kind}")
    return ["null", out] if nullable else out


def spark_type(schema) -> tuple[T.DataType, bool]:
    if isinstance(schema, list):
        rest = [s for s in schema if s != "null"]
        if len(rest) != 1:
            raise ValueError("only unions of null and one branch")
        return spark_type(rest[0])[0], "null" in schema
    if isinstance(schema, str):
        schema = {"type": schema}
    kind, logical = schema["type"], schema.get("logicalType")
    if isinstance(kind, (dict, list)):
        return spark_type(kind)
    if kind == "record":
        return T.StructType([T.StructField(f["name"], *spark_type(f["type"])) for f in schema["fields"]]), False
    if kind == "array":
        return T.ArrayType(*spark_type(schema["items"])), False
    if kind == "map":
        return T.MapType(T.StringType(), *spark_type(schema["values"])), False
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0)), False
    named = {"date": T.DateType(), "timestamp-micros": T.TimestampType(), "timestamp-millis": T.TimestampType(), "local-timestamp-micros": T.TimestampNTZType(), "local-timestamp-millis": T.TimestampNTZType()}
    if logical in named:
        return named[logical], False
    return {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "fixed": T.BinaryType(), "enum": T.StringType()}[kind], False


def write(df: DataFrame, path: str, mode: str = "overwrite", codec: str = "deflate") -> None:
    from brindle.sources.ipc import write_blobs

    schema = avro_type(df.schema, False)

    def run(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"name": [f"part-{uuid.uuid4().hex}.avro"], "content": pa.array([container(schema, rows, codec)], pa.binary())})

    write_blobs(df.mapInArrow(run, "name string, content binary"), path, mode)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all containers under path; a root that is no record is one column, value."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = raw.select("content").first()
    if head is None:
        raise ValueError(f"{path} holds no avro file")
    kind, _ = spark_type(header(Reader(bytes(head["content"])))[0])
    record = isinstance(kind, T.StructType)
    schema = kind if record else T.StructType([T.StructField("value", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for content in b.column(0).to_pylist():
                rows = list(rows_of(content)) if record else [{"value": v} for v in rows_of(content)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema=arrow)

    return raw.select("content").mapInArrow(run, schema)


def fingerprint(canonical: str) -> int:
    """64-bit Rabin fingerprint of a canonical schema."""
    empty = 0xC15D213AA4D7A795
    fp = empty
    for byte in canonical.encode():
        x = (fp ^ byte) & 0xFF
        for _ in range(8):
            x = (x >> 1) ^ (empty & -(x & 1))
        fp = (fp >> 8) ^ x
    return fp


def canonical(schema) -> str:
    """Parsing canonical form: only what matters to data, in fixed order."""
    if isinstance(schema, str):
        return json.dumps(schema)
    if isinstance(schema, list):
        return "[" + ",".join(map(canonical, schema)) + "]"
    if set(schema) <= {"type", "logicalType", "precision", "scale"} and isinstance(schema["type"], str):
        return json.dumps(schema["type"])
    parts = []
    for k in ("name", "type", "fields", "symbols", "items", "values", "size"):
        if k in schema:
            v = schema[k]
            if k == "fields":
                parts.append('"fields":[' + ",".join('{"name":' + json.dumps(f["name"]) + ',"type":' + canonical(f["type"]) + "}" for f in v) + "]")
            else:
                parts.append(f'"{k}":' + (canonical(v) if k in ("type", "items", "values") else json.dumps(v, separators=(",", ":"))))
    return "{" + ",".join(parts) + "}"


def single_object(schema, value) -> bytes:
    return b"\xc3\x01" + fingerprint(canonical(schema)).to_bytes(8, "little") + encode(schema, value)
