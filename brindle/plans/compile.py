"""Typed compilation of expressions to Columns.

Types are decided here before Spark sees anything: text never meets a number, a boolean meets only itself, decimals don't meet floats.
A literal takes the other side's type where it keeps its value. Arithmetic that overflows or divides by zero is null.
"""

from __future__ import annotations

import decimal
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import type_text
from brindle.plans import ast as A
from brindle.plans.parser import parse, parse_statement

_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)
_TIMES = (T.TimestampType, T.TimestampNTZType)
_WIDTH = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


class BindError(ValueError):
    pass


@dataclass
class Typed:
    col: Column
    type: T.DataType
    literal: A.Literal | None = None

    def to(self, kind: T.DataType) -> Column:
        return self.col if self.type == kind else self.col.cast(kind)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, _INT) and isinstance(b, _INT):
        return T.LongType()
    if isinstance(a, (*_INT, *_FLOAT)) and isinstance(b, (*_INT, *_FLOAT)):
        return T.DoubleType()
    ints = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    if isinstance(a, T.DecimalType) and isinstance(b, (T.DecimalType, *_INT)) or isinstance(b, T.DecimalType) and isinstance(a, _INT):
        (p, s), (q, r) = ((x.precision, x.scale) if isinstance(x, T.DecimalType) else (ints[type(x)], 0) for x in (a, b))
        scale = max(s, r)
        return T.DecimalType(min(38, max(p - s, q - r) + scale), scale)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    raise BindError(f"{type_text(a)} and {type_text(b)} have no common type; cast one of them")


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        if isinstance(kind, _INT):
            return -(1 << _WIDTH[type(kind)] - 1) <= value < 1 << _WIDTH[type(kind)] - 1
        if isinstance(kind, T.DecimalType):
            return abs(value) < 10 ** (kind.precision - kind.scale)
        return isinstance(kind, _FLOAT) and int(float(value)) == value
    if isinstance(value, float):
        if isinstance(kind, T.DecimalType):
            d = decimal.Decimal(repr(value))
            return d.is_finite() and -d.as_tuple().exponent <= kind.scale and abs(d) < 10 ** (kind.precision - kind.scale)
        return isinstance(kind, _FLOAT) or isinstance(kind, _INT) and value.is_integer() and _fits(int(value), kind)
    return False


class Compiler:
    def __init__(self, schema: T.StructType, parameters: dict | None = None, attributes: dict[str, Column] | None = None):
        self.schema, self.parameters, self.attributes = schema, parameters or {}, attributes or {}

    def boolean(self, n: A.Node) -> Column:
        t = self.expr(n)
        if not isinstance(t.type, (T.BooleanType, T.NullType)):
            raise BindError(f"{n} is {type_text(t.type)}, not a boolean")
        return t.to(T.BooleanType())

    def pair(self, a: A.Node, b: A.Node) -> tuple[Column, Column, T.DataType]:
        x, y = self.expr(a), self.expr(b)
        if y.literal is not None and x.literal is None and y.literal.type is None and _fits(y.literal.value, x.type):
            y = Typed(F.lit(decimal.Decimal(repr(y.literal.value)) if isinstance(x.type, T.DecimalType) else y.literal.value).cast(x.type), x.type)
        elif x.literal is not None and y.literal is None and x.literal.type is None and _fits(x.literal.value, y.type):
            x = Typed(F.lit(decimal.Decimal(repr(x.literal.value)) if isinstance(y.type, T.DecimalType) else x.literal.value).cast(y.type), y.type)
        kind = common_type(x.type, y.type)
        return x.to(kind), y.to(kind), kind

    def unify(self, nodes) -> tuple[list[Column], T.DataType]:
        found = [self.expr(n) for n in nodes]
        kind: T.DataType = T.NullType()
        for t in sorted(found, key=lambda t: t.literal is not None):
            if t.literal is not None and t.literal.type is None and _fits(t.literal.value, kind):
                continue
            kind = common_type(kind, t.type)
        return [t.to(kind) for t in found], kind

    def field(self, name: str, fields) -> T.StructField:
        found = [f for f in fields if f.name.lower() == name.lower()]
        if not found:
            raise BindError(f"no column {name!r}")
        if len(found) > 1:
            raise BindError(f"column {name!r} is ambiguous")
        return found[0]

    def expr(self, n: A.Node) -> Typed:
        return getattr(self, f"_{type(n).__name__.lower()}")(n)

    def _literal(self, n: A.Literal) -> Typed:
        if n.type is not None:
            return Typed(F.lit(n.value).cast(n.type), n.type, n)
        kind = T.NullType() if n.value is None else T.BooleanType() if isinstance(n.value, bool) else T.LongType() if isinstance(n.value, int) else T.DoubleType() if isinstance(n.value, float) else T.StringType()
        return Typed(F.lit(n.value).cast(kind), kind, n)

    def _column(self, n: A.Column) -> Typed:
        f = self.field(n.name, self.schema)
        return Typed(F.col(f"`{f.name}`"), f.dataType)

    def _step(self, t: Typed, kind: str, v) -> Typed:
        if isinstance(t.type, T.StructType) and kind in ("field", "key"):
            f = self.field(v, t.type)
            return Typed(t.col.getField(f.name), f.dataType)
        if isinstance(t.type, T.ArrayType) and kind == "index":
            return Typed(F.try_element_at(t.col, F.lit(v + 1 if v >= 0 else v)), t.type.elementType)
        if isinstance(t.type, T.MapType) and kind in ("key", "index"):
            return Typed(F.try_element_at(t.col, F.lit(v).cast(t.type.keyType)), t.type.valueType)
        raise BindError(f"{type_text(t.type)} has no step {v!r}")

    def _path(self, n: A.Path) -> Typed:
        t = self.expr(n.base)
        for kind, v in n.steps:
            t = self._step(t, kind, v)
        return t

    def _attribute(self, n: A.Attribute) -> Typed:
        path = F.col("_metadata.file_path")
        name = F.element_at(F.split(path, "/"), -1)
        stem = F.regexp_extract(name, r"^(\.?[^.]*)", 1)
        known = {
            "url": (path, T.StringType()), "path": (F.regexp_replace(path, r"^[a-z0-9+.-]+:/+", "/"), T.StringType()), "name": (name, T.StringType()), "stem": (stem, T.StringType()),
            "extension": (F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit("")), T.StringType()), "scheme": (F.nullif(F.regexp_extract(path, r"^([a-z0-9+.-]+):", 1), F.lit("")), T.StringType()),
            "parent": (F.regexp_replace(path, r"/[^/]*$", ""), T.StringType()), "depth": (F.size(F.filter(F.split(F.regexp_replace(path, r"^[a-z0-9+.-]+:/+", ""), "/"), lambda x: x != "")).cast("long"), T.LongType()),
            "size": (F.col("_metadata.file_size"), T.LongType()), "kind": (F.lit("file"), T.StringType()), "is_container": (F.lit(False), T.BooleanType()), "is_empty": (F.col("_metadata.file_size") == 0, T.BooleanType()),
            "mime_type": (F.when(name.endswith(".parquet"), "application/vnd.apache.parquet").when(name.endswith(".avro"), "application/avro").when(name.rlike(r"\.(txt|log)$"), "text/plain").when(name.endswith(".json"), "application/json"), T.StringType()),
        }
        if n.name in self.attributes:
            return Typed(self.attributes[n.name], T.StringType())
        if n.name == "partition":
            return Typed(F.nullif(F.regexp_extract(path, f"/{re.escape(n.argument)}=([^/]*)/", 1), F.lit("")), T.StringType())
        return Typed(*known[n.name])

    def _parameter(self, n: A.Parameter) -> Typed:
        if n.name not in self.parameters:
            raise BindError(f"parameter :{n.name} has no value")
        v = self.parameters[n.name]
        if isinstance(v, A.Node):
            return self.expr(v)
        if v is None or isinstance(v, (bool, int, float, str)):
            return self._literal(A.Literal(v))
        col = F.lit(v)
        import datetime

        kind = T.DecimalType(38, max(0, -v.as_tuple().exponent)) if isinstance(v, decimal.Decimal) else T.BinaryType() if isinstance(v, (bytes, bytearray)) else (T.TimestampType() if v.tzinfo else T.TimestampNTZType()) if isinstance(v, datetime.datetime) else T.DateType() if isinstance(v, datetime.date) else T.DayTimeIntervalType() if isinstance(v, datetime.timedelta) else None
        if kind is None:
            raise BindError(f"no type for the value of :{n.name}")
        return Typed(col.cast(kind), kind)

    def _and(self, n: A.And) -> Typed:
        out = F.lit(True)
        for k, x in enumerate(n.items):
            out = self.boolean(x) if not k else out & self.boolean(x)
        return Typed(out, T.BooleanType())

    def _or(self, n: A.Or) -> Typed:
        out = F.lit(False)
        for k, x in enumerate(n.items):
            out = self.boolean(x) if not k else out | self.boolean(x)
        return Typed(out, T.BooleanType())

    def _not(self, n: A.Not) -> Typed:
        return Typed(~self.boolean(n.item), T.BooleanType())

    def _compare(self, n: A.Compare) -> Typed:
        a, b, kind = self.pair(n.left, n.right)
        if isinstance(kind, T.StructType):
            return Typed(F.lit(None).cast("boolean"), T.BooleanType())
        col = {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "same": lambda: a.eqNullSafe(b), "distinct": lambda: ~a.eqNullSafe(b)}[n.op]()
        return Typed(col, T.BooleanType())

    def _in(self, n: A.In) -> Typed:
        cols, _ = self.unify((n.item, *n.options))
        col = cols[0].isin(*cols[1:])
        return Typed(~col if n.negated else col, T.BooleanType())

    def _between(self, n: A.Between) -> Typed:
        both = A.And((A.Compare(">=", n.item, n.low), A.Compare("<=", n.item, n.high)))
        return self.expr(A.Not(both) if n.negated else both)

    def _isnull(self, n: A.IsNull) -> Typed:
        c = self.expr(n.item).col
        return Typed(c.isNotNull() if n.negated else c.isNull(), T.BooleanType())

    def text(self, n: A.Node) -> Column:
        t = self.expr(n)
        if not isinstance(t.type, (T.StringType, T.NullType)):
            raise BindError(f"{n} is {type_text(t.type)}, not text")
        return t.to(T.StringType())

    def _like(self, n: A.Like) -> Typed:
        c = self.text(n.item)
        escape = n.escape or next(chr(k) for k in range(1, 0x110000) if chr(k) not in n.pattern)
        col = (F.ilike if n.fold else F.like)(c, F.lit(n.pattern), F.lit(escape))
        return Typed(~col if n.negated else col, T.BooleanType())

    def _glob(self, n: A.Glob) -> Typed:
        return Typed(self.text(n.item).rlike(glob_regex(n.pattern)), T.BooleanType())

    def _negate(self, n: A.Negate) -> Typed:
        t = self.expr(n.item)
        if not isinstance(t.type, (*_INT, *_FLOAT, T.DecimalType, T.DayTimeIntervalType)):
            raise BindError(f"no negative of {type_text(t.type)}")
        if isinstance(t.type, (*_FLOAT, T.DecimalType)):
            return Typed((-t.col).cast(t.type), t.type)
        return Typed(F.try_subtract(F.lit(0).cast(t.type), t.col), t.type) if isinstance(t.type, _INT) else Typed(-t.col, t.type)

    def _arithmetic(self, n: A.Arithmetic) -> Typed:
        x, y, op = self.expr(n.left), self.expr(n.right), n.op
        span = T.DayTimeIntervalType
        if isinstance(x.type, (*_TIMES, T.DateType, span)) or isinstance(y.type, (*_TIMES, T.DateType, span)):
            if op in "+-" and isinstance(x.type, (*_TIMES, T.DateType)) and isinstance(y.type, span):
                return Typed(((F.try_add if op == "+" else F.try_subtract)(x.col, y.col)).cast(x.type), x.type)
            if op == "+" and isinstance(x.type, span) and isinstance(y.type, (*_TIMES, T.DateType)):
                return Typed(F.try_add(y.col, x.col).cast(y.type), y.type)
            if op == "-" and type(x.type) is type(y.type) and not isinstance(x.type, span):
                return Typed((x.col - y.col).cast(span()), span())
            if op in "+-" and isinstance(x.type, span) and isinstance(y.type, span):
                return Typed((F.try_add if op == "+" else F.try_subtract)(x.col, y.col), span())
            raise BindError(f"no {op} of {type_text(x.type)} and {type_text(y.type)}")
        a, b, kind = self.pair(n.left, n.right)
        if isinstance(kind, T.NullType):
            return Typed(F.lit(None), kind)
        if isinstance(kind, T.DecimalType):
            return self._decimal(op, x, y)
        if isinstance(kind, _INT):
            if op == "/":
                return Typed(_int_div(a, b, kind), kind)
            if op == "%":
                return Typed(F.try_mod(a, b).cast(kind), kind)
            return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b).cast(kind), kind)
        if isinstance(kind, _FLOAT):
            if op == "/":
                nan, inf = F.lit(float("nan")), F.lit(float("inf"))
                zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)
                return Typed(F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(F.try_divide(a, b)).cast(kind), kind)
            if op == "%":
                return Typed(F.when(b == 0, F.when(a.isNotNull(), F.lit(float("nan")))).otherwise(F.try_mod(a, b)).cast(kind), kind)
            return Typed({"+": a + b, "-": a - b, "*": a * b}[op].cast(kind), kind)
        raise BindError(f"no {op} of {type_text(x.type)} and {type_text(y.type)}")

    def _decimal(self, op: str, x: Typed, y: Typed) -> Typed:
        ints = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}

        def shape(t: Typed) -> tuple[Column, int, int]:
            if t.literal is not None and t.literal.type is None:
                d = decimal.Decimal(repr(t.literal.value))
                s = max(0, -d.as_tuple().exponent)
                p = max(len(d.as_tuple().digits), s)
                return F.lit(d).cast(T.DecimalType(p, s)), p, s
            if isinstance(t.type, T.DecimalType):
                return t.col, t.type.precision, t.type.scale
            p = ints[type(t.type)]
            return t.col.cast(T.DecimalType(p, 0)), p, 0

        (a, p, s), (b, q, r) = shape(x), shape(y)
        top = max(s, r)
        if op in "+-":
            kind = T.DecimalType(min(38, max(p - s, q - r) + 1 + top), top)
            return Typed((F.try_add if op == "+" else F.try_subtract)(a, b).try_cast(kind), kind)
        if op == "*":
            kind = T.DecimalType(min(38, p + q), min(38, s + r))
            return Typed(F.try_multiply(a, b).try_cast(kind), kind)
        if op == "%":
            kind = T.DecimalType(min(38, max(p - s, q - r) + top), top)
            return Typed(F.try_mod(a, b).try_cast(kind), kind)
        scale = max(s, r, 6)
        kind = T.DecimalType(min(38, p - s + r + scale), scale)
        # exact and truncated: whole quotient of both sides brought to integers
        l, d = F.try_multiply(a.cast(T.DecimalType(38, s)), F.lit(decimal.Decimal(10) ** (scale + r)).cast(T.DecimalType(38, 0))), F.try_multiply(b, F.lit(decimal.Decimal(10) ** r).cast(T.DecimalType(38, 0)))
        whole = T.DecimalType(38, 0)
        l, d = l.try_cast(whole), d.try_cast(whole)
        quotient = F.try_divide((l - F.try_mod(l, d)), d).cast(whole)
        return Typed(F.try_multiply(quotient, F.lit(decimal.Decimal(1).scaleb(-scale)).cast(T.DecimalType(scale + 1, scale))).try_cast(kind), kind)

    def _function(self, n: A.Function) -> Typed:
        S, L, B = T.StringType(), T.LongType(), T.BooleanType()
        name, args = n.name, n.args
        if name in ("lower", "upper"):
            return Typed(getattr(F, name)(self.text(args[0])), S)
        if name == "trim":
            return Typed(F.regexp_replace(self.text(args[0]), r"(?U)^\s+|\s+$", ""), S)
        if name == "length":
            t = self.expr(args[0])
            if not isinstance(t.type, (T.StringType, T.BinaryType, T.NullType)):
                raise BindError(f"length of {type_text(t.type)}")
            return Typed(F.length(t.col).cast(L), L)
        if name == "substring":
            s = self.text(args[0])
            ints = [self.expr(a) for a in args[1:]]
            if not all(isinstance(t.type, (*_INT, T.NullType)) for t in ints):
                raise BindError("substring takes integers")
            start, size = ints[0].to(L), F.length(s)
            at = F.when(start < 0, size + start + 1).otherwise(start)
            if len(ints) == 1:
                return Typed(F.substring(s, F.greatest(at, F.lit(1)).cast("int"), size), S)
            count = ints[1].to(L)
            begin, end = F.greatest(at, F.lit(1)), F.least(at + count, size + 1)
            return Typed(F.when(count < 0, F.raise_error(F.lit("substring: negative length")).cast("string")).otherwise(F.substring(s, begin.cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))), S)
        if name in ("starts_with", "ends_with", "contains"):
            return Typed(getattr(F, name.replace("_", ""))(self.text(args[0]), self.text(args[1])), B)
        if name == "concat":
            return Typed(F.concat(*map(self.text, args)), S)
        if name in ("year", "month", "day", "hour"):
            t = self.expr(args[0])
            if not isinstance(t.type, (*_TIMES, T.DateType, T.NullType)):
                if isinstance(t.type, T.DayTimeIntervalType):
                    return Typed(F.lit(None).cast("int"), T.IntegerType())
                raise BindError(f"{name} of {type_text(t.type)}")
            zone = next((f.metadata["zone"] for f in self.schema if isinstance(args[0], A.Column) and f.name.lower() == args[0].name.lower() and "zone" in (f.metadata or {})), None)
            col = F.from_utc_timestamp(t.col, zone) if zone and isinstance(t.type, T.TimestampType) else t.col
            if name == "hour" and isinstance(t.type, T.DateType):
                return Typed(F.when(t.col.isNotNull(), F.lit(0)), T.IntegerType())
            return Typed({"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour}[name](col).cast("int"), T.IntegerType())
        if name == "truncate":
            t = self.expr(args[0])
            if isinstance(t.type, _INT):
                w = self.expr(args[1])
                if not isinstance(w.type, _INT):
                    raise BindError("truncate takes an integer width")
                width = F.abs(w.to(L))
                return Typed(F.when(width != 0, F.try_subtract(t.to(L), F.pmod(t.to(L), F.nullif(width, F.lit(0).cast(L))))).cast(t.type), t.type)
            if isinstance(t.type, _FLOAT):
                return Typed(F.lit(None).cast(t.type), t.type)
            unit = args[1].value.lower() if isinstance(args[1], A.Literal) and isinstance(args[1].value, str) else None
            if isinstance(t.type, T.DecimalType) or unit not in ("second", "minute", "hour", "day"):
                raise BindError("truncate takes second, minute, hour or day")
            return t if isinstance(t.type, T.DateType) else Typed(F.date_trunc(unit, t.col).cast(t.type), t.type)
        if name in ("coalesce", "if_null"):
            cols, kind = self.unify(args)
            return Typed(F.coalesce(*cols), kind)
        if name == "size":
            t = self.expr(args[0])
            if not isinstance(t.type, (T.ArrayType, T.MapType)):
                raise BindError(f"size of {type_text(t.type)}")
            return Typed(F.when(t.col.isNotNull(), F.size(t.col)).cast(L), L)
        t, k = self.expr(args[0]), self.expr(args[1])  # get
        if isinstance(t.type, T.ArrayType) and isinstance(k.type, _INT):
            i = k.to(T.IntegerType())
            return Typed(F.try_element_at(t.col, F.when(i >= 0, i + 1).otherwise(i)), t.type.elementType)
        if isinstance(t.type, T.MapType):
            return Typed(F.try_element_at(t.col, k.to(t.type.keyType)), t.type.valueType)
        if isinstance(t.type, T.StructType) and k.literal is not None:
            return self._step(t, "key", k.literal.value)
        raise BindError(f"get of {type_text(t.type)}")

    def _cast(self, n: A.Cast) -> Typed:
        t = self.expr(n.item)
        return Typed(t.col.try_cast(n.type) if n.safe else t.col.cast(n.type), n.type)

    def _case(self, n: A.Case) -> Typed:
        values = [v for _, v in n.branches] + ([n.otherwise] if n.otherwise is not None else [])
        cols, kind = self.unify(values)
        out = None
        for (when, _), c in zip(n.branches, cols, strict=False):
            out = F.when(self.boolean(when), c) if out is None else out.when(self.boolean(when), c)
        return Typed(out.otherwise(cols[-1]) if n.otherwise is not None else out, kind)

    def _struct(self, n: A.Struct) -> Typed:
        found = [(k, self.expr(x)) for k, x in n.items]
        return Typed(F.struct(*(t.col.alias(k) for k, t in found)), T.StructType([T.StructField(k, t.type) for k, t in found]))

    def _listof(self, n: A.ListOf) -> Typed:
        cols, kind = self.unify(n.items) if n.items else ([], T.NullType())
        return Typed(F.array(*cols), T.ArrayType(kind))

    def _mapof(self, n: A.MapOf) -> Typed:
        keys, k = self.unify([a for a, _ in n.items])
        values, v = self.unify([b for _, b in n.items])
        return Typed(F.create_map(*(c for p in zip(keys, values, strict=True) for c in p)), T.MapType(k, v))


def _int_div(a: Column, b: Column, kind: T.DataType) -> Column:
    """Whole quotient toward zero; the one that overflows (least / -1) is null."""
    least = F.lit(-(1 << _WIDTH[type(kind)] - 1)).cast(kind)
    safe = F.when((a == least) & (b == F.lit(-1).cast(kind)), F.lit(None)).otherwise(a)
    return F.call_function("div", safe, F.nullif(b, F.lit(0).cast(kind))).try_cast(kind)


def glob_regex(pattern: str) -> str:
    """Java (and Python) regex of a path pattern: without a separator it matches at any depth, with one it is anchored at the root."""
    anchored = "/" in pattern.rstrip("/")
    body, i, p = "", 0, pattern.strip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:[^/]+/)*", i + 3
        elif p.startswith("**", i):
            body, i = body + ".*", i + 2
        elif p[i] == "*":
            body, i = body + "[^/]*", i + 1
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            inner = p[i + 1 : end]
            body, i = body + "[" + ("^" + inner[1:] if inner[:1] in "!^" else inner) + "]", end + 1
        else:
            body, i = body + re.escape(p[i]), i + 1
    return f"^/?{body}$" if anchored else f"(?:^|/){body}$"


def compile_expression(expression: str | A.Node, schema: T.StructType, parameters: dict | None = None) -> Typed:
    return Compiler(schema, parameters).expr(parse(expression) if isinstance(expression, str) else expression)


def filter_rows(df: DataFrame, predicate: str | A.Node, parameters: dict | None = None) -> DataFrame:
    """Rows for which the predicate is exactly true."""
    return df.where(Compiler(df.schema, parameters).boolean(parse(predicate) if isinstance(predicate, str) else predicate))


def run(df: DataFrame, statement: str | A.Statement, parameters: dict | None = None) -> DataFrame:
    """where, then order by (input columns), then select, then limit; order with limit is a top-k."""
    s = parse_statement(statement) if isinstance(statement, str) else statement
    c = Compiler(df.schema, parameters)
    out = df
    if s.where is not None:
        out = out.where(c.boolean(s.where))
    if s.order:
        keys = []
        for o in s.order:
            col, first = c.expr(o.expression).col, o.descending if o.nulls_first is None else o.nulls_first
            keys.append((col.desc_nulls_first() if first else col.desc_nulls_last()) if o.descending else (col.asc_nulls_first() if first else col.asc_nulls_last()))
        out = out.orderBy(*keys)
    cols = []
    for p in s.projections:
        cols += [F.col(f"`{n}`") for n in df.columns] if p.expression is None else [c.expr(p.expression).col.alias(p.name)]
    out = out.select(*cols)
    return out if s.limit is None else out.limit(s.limit)
