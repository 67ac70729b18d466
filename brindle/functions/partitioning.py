"""Partition transforms of table formats as columns: identity, void, bucket[n], truncate[w], year, month, day, hour."""

from __future__ import annotations

import re
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Constants of 32-bit Murmur3.
_C1, _C2, _ADD, _F1, _F2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35
_MASK = 0xFFFFFFFF


def _turned(x: int, by: int) -> int:
    return (x << by | x >> (32 - by)) & _MASK


def _zero_seed() -> int:
    """The int whose hash() is 0. Spark seeds each column's hash with that of the one before: after this int, a hash starts from 0."""
    # backwards through one round from the state 4, which the last mix of a 4-byte value turns into 0
    before = _turned((4 - _ADD) * pow(5, -1, 1 << 32) & _MASK, 19) ^ 42
    x = _turned(before * pow(_C2, -1, 1 << 32) & _MASK, 17) * pow(_C1, -1, 1 << 32) & _MASK
    return x - (1 << 32) if x >> 31 else x


ZERO_SEED = _zero_seed()


def murmur3(values: list[bytes | None]) -> np.ndarray:
    """32-bit Murmur3, seed 0, of each value as int32 (of a null: 0), all values of one length at a time."""
    out = np.zeros(len(values), np.uint32)
    sizes = np.array([-1 if v is None else len(v) for v in values], np.int64)

    def turned(x, by):
        return x << np.uint32(by) | x >> np.uint32(32 - by)

    for size in np.unique(sizes[sizes >= 0]).tolist():
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(values[i] + bytes(-size % 4) for i in at), "<u4").reshape(len(at), -(-size // 4))
        h = np.zeros(len(at), np.uint32)
        for block in range(raw.shape[1]):
            h ^= turned(raw[:, block] * np.uint32(_C1), 15) * np.uint32(_C2)
            if block < size // 4:
                h = turned(h, 13) * np.uint32(5) + np.uint32(_ADD)
        h ^= np.uint32(size)
        h = (h ^ h >> np.uint32(16)) * np.uint32(_F1)
        h = (h ^ h >> np.uint32(13)) * np.uint32(_F2)
        out[at] = h ^ h >> np.uint32(16)
    return out.view(np.int32)


def _hash_bytes(column: Column) -> Column:
    @F.pandas_udf("int")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(murmur3([None if v is None else bytes(v) for v in values]))

    return F.when(column.isNotNull(), run(column))


def _bucket(c: Column, kind: T.DataType, count: int) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        code = _hash_bytes(c.cast("binary"))
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        code = F.hash(F.lit(ZERO_SEED), c.cast("long"))
    elif isinstance(kind, T.DateType):
        code = F.hash(F.lit(ZERO_SEED), F.unix_date(c).cast("long"))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        code = F.hash(F.lit(ZERO_SEED), _micros(c, kind))
    else:
        raise ValueError(f"no bucket of {kind.simpleString()}")
    return F.when(c.isNotNull(), code.bitwiseAND(F.lit(0x7FFFFFFF)) % F.lit(count))


def _micros(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _truncate(c: Column, kind: T.DataType, width: int) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.substring(c, 1, width)
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return (c - F.pmod(c, F.lit(width).cast(kind))).cast(kind)
    if isinstance(kind, T.DecimalType):  # the width counts units of the last place
        return (c - F.pmod(c, F.lit(Decimal(width).scaleb(-kind.scale)))).cast(kind)
    raise ValueError(f"no truncate of {kind.simpleString()}")


def _since(c: Column, kind: T.DataType, unit: str) -> Column:
    """Whole years, months, days or hours (int) since the start of 1970; earlier times count down."""
    if isinstance(kind, T.DateType) and unit != "hour":
        days = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros, size = _micros(c, kind), F.lit(3_600_000_000 if unit == "hour" else 86_400_000_000)
        days = ((micros - F.pmod(micros, size)) / size).cast("int")
    else:
        raise ValueError(f"no {unit} of {kind.simpleString()}")
    if unit in ("day", "hour"):
        return days
    date = F.date_from_unix_date(days)
    return F.year(date) - 1970 if unit == "year" else (F.year(date) - 1970) * 12 + F.month(date) - 1


def partition_value(df: DataFrame, column: str, transform: str) -> Column:
    """The value of a transform ("bucket[16]", "day", ...) of df's column. Nulls stay null; a type it does not take is a ValueError."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    found = re.fullmatch(r"(identity|void|year|month|day|hour)|(bucket|truncate)\[([1-9]\d*)\]", transform)
    if not found:
        raise ValueError(f"no transform {transform!r}")
    if found[2]:
        return (_bucket if found[2] == "bucket" else _truncate)(c, kind, int(found[3]))
    if transform == "identity":
        return c
    return F.lit(None).cast(kind) if transform == "void" else _since(c, kind, transform)
