"""Scalar helpers as Columns or plain functions: FNV-1a, WKB, placeholders, structured texts."""

from __future__ import annotations

import json
import re
import struct
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fnv1a(raw: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in raw:
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


def _fnv(s: pd.Series) -> pd.Series:
    import numpy as np

    # column by column of bytes over all rows that still have one
    rows = [None if x is None else x.encode() for x in s]
    h = np.full(len(rows), 0xCBF29CE484222325, np.uint64)
    size = np.array([0 if r is None else len(r) for r in rows])
    flat = np.frombuffer(b"".join(r or b"" for r in rows), np.uint8)
    start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    alive, prime = len(rows), np.uint64(0x100000001B3)
    with np.errstate(over="ignore"):
        for k in range(int(size.max(initial=0))):
            while alive and size[order[alive - 1]] <= k:
                alive -= 1
            at = order[:alive]
            h[at] = (h[at] ^ flat[start[at] + k]) * prime
    out = pd.Series(h.view(np.int64)).astype("Int64")
    out[[r is None for r in rows]] = pd.NA
    return out


def hash_text(c: Column | str) -> Column:
    """FNV-1a 64 of the UTF-8 text as a signed long."""
    return F.pandas_udf(_fnv, T.LongType())(c)


def wkb_text(raw: bytes) -> str:
    """WKT of a WKB geometry (points, lines, polygons and their collections; two dimensions)."""
    names = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT", 5: "MULTILINESTRING", 6: "MULTIPOLYGON", 7: "GEOMETRYCOLLECTION"}
    at = 0

    def take(fmt):
        nonlocal at
        got = struct.unpack_from(fmt, raw, at)
        at += struct.calcsize(fmt)
        return got

    def point(e):
        x, y = take(f"{e}2d")
        return f"{x:g} {y:g}"

    def line(e):
        return "(" + ", ".join(point(e) for _ in range(take(f"{e}I")[0])) + ")"

    def geometry(named=True):
        e = "<" if take("<B")[0] else ">"
        kind = take(f"{e}I")[0]
        if kind not in names:
            raise ValueError(f"no geometry type {kind}")
        if kind == 1:
            body = f"({point(e)})"
        elif kind == 2:
            body = line(e)
        elif kind == 3:
            body = "(" + ", ".join(line(e) for _ in range(take(f"{e}I")[0])) + ")"
        else:
            body = "(" + ", ".join(geometry(kind == 7) for _ in range(take(f"{e}I")[0])) + ")"
        return f"{names[kind]} {body}" if named else body

    out = geometry()
    if at != len(raw):
        raise ValueError("bytes behind the geometry")
    return out


def placeholders(value, known: dict[str, str], environment: bool = False):
    """{{ NAME }} in texts of a tree replaced from a closed table; an unknown name is an error."""
    import os

    def one(m):
        n = m.group(1)
        if n in known:
            return known[n]
        if environment and n in os.environ:
            return os.environ[n]
        raise KeyError(f"no value for placeholder {n}")

    if isinstance(value, str):
        return re.sub(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", one, value)
    if isinstance(value, dict):
        return {k: placeholders(v, known, environment) for k, v in value.items()}
    return [placeholders(v, known, environment) for v in value] if isinstance(value, list) else value


def load(text: str, fmt: str):
    if fmt == "json":
        return json.loads(text)
    if fmt == "jsonl":
        return [json.loads(x) for x in text.splitlines() if x.strip()]
    if fmt == "toml":
        return tomllib.loads(text)
    if fmt == "yaml":
        import yaml

        return yaml.safe_load(text)
    raise ValueError(f"no format {fmt!r}")


def dump(value, fmt: str) -> str:
    if fmt == "json":
        return json.dumps(value, default=str)
    if fmt == "jsonl":
        return "".join(json.dumps(v, default=str) + "\n" for v in value)
    if fmt == "yaml":
        import yaml

        return yaml.safe_dump(value, sort_keys=False)
    raise ValueError(f"no format {fmt!r}")
