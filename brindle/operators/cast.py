"""Schema-directed casts: one select, recursive, names matched without case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import default_of, type_text


class CastError(ValueError):
    pass


def default_column(kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*((F.lit(None).cast(f.dataType) if f.nullable else default_column(f.dataType)).alias(f.name) for f in kind))
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    return F.lit(default_of(kind)).cast(kind)


def cast_column(col: Column, have: T.DataType, want: T.DataType, nullable: bool = True, safe: bool = True, at: str = "") -> Column:
    """col of type have as want. safe: what can't be converted is null, else an error. A required target replaces null by its default."""
    if isinstance(have, T.VariantType) != isinstance(want, T.VariantType) and not isinstance(have, T.NullType):
        raise CastError(f"{at}: a variant casts only to itself")
    if isinstance(want, T.MapType) and not isinstance(have, (T.MapType, T.NullType)):
        raise CastError(f"{at}: {type_text(have)} can't become a map")
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        names: dict[str, list[T.StructField]] = {}
        for f in have:
            names.setdefault(f.name.lower(), []).append(f)
        parts = [_child(lambda f, c=col: c.getField(f.name), names, f, safe, at) for f in want]
        out = F.when(col.isNotNull(), F.struct(*parts))
    elif isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        out = col if have.elementType == want.elementType and want.containsNull else F.transform(col, lambda x: cast_column(x, have.elementType, want.elementType, want.containsNull, safe, f"{at}[]"))
    elif isinstance(want, T.MapType) and isinstance(have, T.MapType):
        keys = F.transform(F.map_keys(col), lambda k: cast_column(k, have.keyType, want.keyType, False, safe, f"{at}.key"))
        values = F.transform(F.map_values(col), lambda v: cast_column(v, have.valueType, want.valueType, want.valueContainsNull, safe, f"{at}.value"))
        out = F.map_from_arrays(keys, values)
    elif isinstance(want, (T.StructType, T.ArrayType)) and not isinstance(have, T.NullType):
        raise CastError(f"{at}: {type_text(have)} can't become {type_text(want)}")
    elif have == want:
        out = col
    else:
        out = col.try_cast(want) if safe else col.cast(want)
    return out if nullable else F.coalesce(out, default_column(want))


def _child(get, names, f: T.StructField, safe: bool, at: str) -> Column:
    found = names.get(f.name.lower(), [])
    if len(found) > 1:
        raise CastError(f"{at}{f.name} is ambiguous")
    if not found:
        return (F.lit(None).cast(f.dataType) if f.nullable else default_column(f.dataType)).alias(f.name)
    return cast_column(get(found[0]), found[0].dataType, f.dataType, f.nullable, safe, f"{at}{f.name}").alias(f.name)


def cast_to(df: DataFrame, schema: T.StructType, safe: bool = True) -> DataFrame:
    """df in the order and types of schema: extra columns go, missing ones are null or the default of a required field."""
    names: dict[str, list[T.StructField]] = {}
    for f in df.schema:
        names.setdefault(f.name.lower(), []).append(f)
    return df.select(*(_child(lambda f: F.col(f"`{f.name}`"), names, f, safe, "") for f in schema))
