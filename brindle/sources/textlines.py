"""Log text to typed rows: records open at every line, at a timestamp, or at a pattern; other lines continue the record before.

A file is the unit of parallelism (records span lines, gzip can't be split); a task streams its file and yields bounded batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAMP = r"\[?(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d{1,9}(?:_\d{1,3})*))?(Z|[+-]\d{2}:?\d{2})?\]?"
LEVELS = {"TRACE": "TRACE", "TT": "TRACE", "DEBUG": "DEBUG", "DD": "DEBUG", "INFO": "INFO", "II": "INFO", "WARN": "WARN", "WARNING": "WARN", "WW": "WARN", "ERROR": "ERROR", "EE": "ERROR", "FATAL": "FATAL", "FF": "FATAL", "CRITICAL": "CRITICAL"}
_LEVEL = "|".join(sorted(LEVELS, key=len, reverse=True))


@dataclass(frozen=True)
class LineOptions:
    opening: str = "line"  # line | timestamp | a regex
    log: bool = False
    captures: str | None = None  # a regex with named groups
    constants: tuple[tuple[str, object], ...] = ()
    zone: str = "UTC"
    strip: bool = True
    line_sep: str | None = None  # None: \n, \r\n or \r


def capture_schema(pattern: str) -> list[T.StructField]:
    r"""One nullable column a named group: \d+ is a long, \d+\.\d+ a double, else text."""
    out = []
    for m in re.finditer(r"\(\?P?<([A-Za-z_]\w*)>", pattern):
        depth, i = 1, m.end()
        while depth and i < len(pattern):
            depth += {"(": 1, ")": -1}.get(pattern[i], 0) if pattern[i - 1] != "\\" else 0
            i += 1
        body = pattern[m.end() : i - 1]
        kind = T.LongType() if body in (r"\d+", "[0-9]+") else T.DoubleType() if body in (r"\d+\.\d+", r"[0-9]+\.[0-9]+") else T.StringType()
        out.append(T.StructField(m.group(1), kind))
    return out


BASE = "url string, rownum long, header string, message string, offset long, lines int"


def _records(options: LineOptions):
    opens = None if options.opening == "line" else re.compile(STAMP if options.opening == "timestamp" else options.opening)
    head = re.compile(rf"^{STAMP}")
    sep = re.compile(r"\r\n|\n|\r" if options.line_sep is None else re.escape(options.line_sep))

    def run(batches):
        for batch in batches:
            for url, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = content.decode("utf-8", "replace")
                rows: list[tuple] = []
                at = n = 0
                start, first, count, number = 0, None, 0, 0
                byte = 0
                held: list[str] = []

                def close():
                    nonlocal number
                    number += 1
                    body = "".join(held)
                    m = head.match(body)
                    h = m.group(0) if m else None
                    msg = body[m.end() :] if m else body
                    rows.append((url, number, h, msg.strip() if options.strip else msg, start, count))

                pieces = [(m.start(), m.end()) for m in sep.finditer(text)]
                if not pieces or pieces[-1][1] < len(text):
                    pieces.append((len(text), len(text)))
                gap = ""
                for end, after in pieces:
                    line = text[at:end]
                    if first is None or opens is None or opens.match(line):
                        if first is not None:
                            close()
                        held, start, first, count = [line], byte, True, 1
                    else:
                        held += [gap, line]
                        count += 1
                    gap = text[end:after]
                    byte += len(text[at:after].encode())
                    at = after
                    n += 1
                    if len(rows) >= 65_536:
                        yield _batch(rows)
                        rows.clear()
                if first is not None and text:
                    close()
                yield _batch(rows)

    return run


def _batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32())
    names = ("url", "rownum", "header", "message", "offset", "lines")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def typed(records: DataFrame, options: LineOptions = LineOptions()) -> DataFrame:  # noqa: B008
    """Adds date, time (microseconds of the local day), unix (nanoseconds), hash, and what the options ask for. Columns only."""
    from brindle.functions.values import hash_text

    part = lambda i: F.nullif(F.regexp_extract("header", STAMP, i), F.lit(""))
    day, clock = part(1), part(2)
    digits = F.rpad(F.regexp_replace(F.coalesce(part(3), F.lit("")), "_", ""), 9, "0").cast("long")
    zone = F.when(part(4).isNull(), F.lit(options.zone)).when(part(4) == "Z", F.lit("UTC")).otherwise(F.regexp_replace(part(4), r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    local = F.try_to_timestamp(F.concat(day, F.lit(" "), clock))
    unix = F.unix_seconds(F.to_utc_timestamp(local, zone)) * 1_000_000_000 + digits
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    out = records.withColumns({"date": F.to_date(local), "time": seconds.cast("long") * 1_000_000 + F.floor(digits / 1000), "unix": unix, "hash": hash_text("message")})
    if options.log:
        token = rf"(?i)(?:^|[\s\[(])({_LEVEL})(?=$|[\s\])])"
        level = F.upper(F.nullif(F.regexp_extract("message", token, 1), F.lit("")))
        level = F.element_at(F.create_map(*(F.lit(x) for p in LEVELS.items() for x in p)), level)
        bracket = F.regexp_extract_all("message", F.lit(r"\[([^\]\s]+)\]"), F.lit(1))
        is_thread = lambda x: x.rlike(r"^[A-Za-z0-9-]*-?[0-9A-Fa-f:-]*:[0-9A-Fa-f:-]*$") & x.rlike(r"\d")
        plain = F.filter(bracket, lambda x: ~is_thread(x) & ~F.upper(x).isin(*LEVELS))
        out = out.withColumns({"level": level, "logger": F.get(plain, F.lit(0)), "thread": F.get(F.filter(bracket, is_thread), F.lit(0))})
    if options.captures:
        java = re.sub(r"\(\?P<", "(?<", options.captures)
        for i, f in enumerate(capture_schema(options.captures)):
            group = _group_number(options.captures, f.name)
            out = out.withColumn(f.name, F.nullif(F.regexp_extract("message", java, group), F.lit("")).cast(f.dataType))
            del i
    for name, value in options.constants:
        out = out.withColumn(name, F.lit(value))
    return out


def _group_number(pattern: str, name: str) -> int:
    return re.compile(re.sub(r"\(\?<(?=[A-Za-z_])", "(?P<", pattern)).groupindex[name]


def read_text_lines(spark: SparkSession, path: str, options: LineOptions = LineOptions()) -> DataFrame:  # noqa: B008
    """Records of all files under path. gzip, zstandard and deflate are decoded by their name."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def unpacked(batches):
        import gzip
        import zlib

        for b in batches:
            urls, out = b.column(0).to_pylist(), []
            for url, c in zip(urls, b.column(1).to_pylist(), strict=True):
                while True:
                    if url.endswith(".gz"):
                        c, url = gzip.decompress(c), url[:-3]
                    elif url.endswith(".zst"):
                        import zstandard

                        c, url = zstandard.ZstdDecompressor().stream_reader(c).read(), url[:-4]
                    elif url.endswith((".zz", ".zlib")):
                        c, url = zlib.decompress(c), url.rpartition(".")[0]
                    else:
                        break
                out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(urls), pa.array(out, pa.binary())], names=["path", "content"])

    inner = _records(options)
    return typed(raw.mapInArrow(lambda b: inner(unpacked(b)), BASE), options)


def records_of(df: DataFrame, url_col: str, text_col: str, options: LineOptions = LineOptions()) -> DataFrame:  # noqa: B008
    """Records of texts held in a column, each row a file named by url_col."""
    inner = _records(options)
    return typed(df.select(F.col(url_col).cast("string").alias("path"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("content")).mapInArrow(inner, BASE), options)


def write_text_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows with message and maybe header as lines."""
    line = F.concat(F.coalesce("header", F.lit("")), F.when(F.col("header").isNotNull(), F.lit(" ")).otherwise(""), "message") if "header" in df.columns else F.col("message")
    df.select(line.alias("value")).write.mode(mode).text(path)
