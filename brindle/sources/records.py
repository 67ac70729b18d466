"""The record surface: read, write (or merge), append; over files and Hive-partitioned folders."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.types import partition_names
from brindle.operators.cast import cast_to
from brindle.operators.merge import merged
from brindle.sources import avro, ipc


@dataclass(frozen=True)
class Options:
    """Shaping of a read or write, applied in this order: schema, selection, cast, partition filter, limits."""

    schema: T.StructType | None = None
    select_by_names: tuple[str, ...] = ()
    filter_partitions: tuple[tuple[str, object], ...] = ()
    max_row_size: int | None = None
    max_byte_size: int | None = None
    merge_by_names: tuple[str, ...] = ()
    ordinal: str | None = None
    safe: bool = True
    compression: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.merge_by_names and (self.max_row_size is not None or self.max_byte_size is not None):
            raise ValueError("a merge takes no limit")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Absence is success."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def select_by_names(df: DataFrame, names) -> DataFrame:
    """The named columns in that order, without case; an unknown name is an error."""
    have = {c.lower(): c for c in df.columns}
    if missing := [n for n in names if n.lower() not in have]:
        raise ValueError(f"no column {missing}")
    return df.select(*(F.col(f"`{have[n.lower()]}`") for n in names))


def where_partitions(df: DataFrame, pairs) -> DataFrame:
    """Rows whose columns equal the values; over a partitioned folder Spark prunes the paths too. None asks for null."""
    return reduce(lambda d, p: d.where(F.col(f"`{p[0]}`").isNull() if p[1] is None else F.col(f"`{p[0]}`") == F.lit(p[1])), pairs, df)


def limit_bytes(df: DataFrame, most: int) -> DataFrame:
    """Leading rows whose Arrow size stays within `most` bytes; one row at least unless most is 0."""
    if most == 0:
        return df.limit(0)

    def run(batches):
        left, first = most, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            each = max(1, batch.nbytes // n)
            take = min(n, max(int(left // each), 1 if first else 0))
            if take:
                yield batch.slice(0, take)
            left, first = left - take * each, False
            if take < n:
                return

    return df.coalesce(1).mapInArrow(run, df.schema)


def shaped(df: DataFrame, o: Options) -> DataFrame:
    if o.schema is not None:
        df = cast_to(df, o.schema, o.safe)
    if o.filter_partitions:
        df = where_partitions(df, o.filter_partitions)
    if o.select_by_names:
        df = select_by_names(df, o.select_by_names)
    if o.max_row_size is not None:
        df = df.limit(o.max_row_size)
    return df if o.max_byte_size is None else limit_bytes(df, o.max_byte_size)


def read(spark: SparkSession, path: str, fmt: str = "parquet", options: Options = Options()) -> DataFrame:  # noqa: B008
    """Rows of a file or folder; an absent one has no rows but the declared schema. Partition columns are text unless declared."""
    if not exists(spark, path):
        if options.schema is None:
            raise ValueError(f"{path} doesn't exist and no schema is declared")
        return shaped(spark.createDataFrame([], options.schema), options)
    if fmt == "ipc":
        return shaped(ipc.read(spark, path), options)
    if fmt == "avro":
        return shaped(avro.read(spark, path), options)
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.read.options(**options.extra).format(fmt).load(path)
    finally:
        spark.conf.set(key, before)
    return shaped(df, options)


def read_schema(spark: SparkSession, path: str, fmt: str = "parquet", options: Options = Options()) -> T.StructType:  # noqa: B008
    return options.schema or read(spark, path, fmt).schema


def _write(df: DataFrame, path: str, fmt: str, mode: str, o: Options, partitions: list[str]) -> None:
    if fmt == "ipc":
        return ipc.write(df, path, mode)
    if fmt == "avro":
        return avro.write(df, path, mode)
    w = df.write.mode(mode).format(fmt).options(**o.extra)
    if o.compression:
        w = w.option("compression", o.compression)
    if partitions:
        w = w.partitionBy(*partitions)
    w.save(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", options: Options = Options()) -> None:  # noqa: B008
    """Overwrites, or merges where options name a key. Rows are cast to the declared schema and onto the stored columns.

    The new content is written beside the old and takes its place by renames at the end, so a failed write leaves the old rows.
    """
    spark = df.sparkSession
    there = exists(spark, path)
    if options.schema is not None:
        df = cast_to(df, options.schema, options.safe) if options.ordinal is None else df
    parts = partition_names(options.schema) if options.schema is not None else []
    if there:
        old = read(spark, path, fmt)
        layout = [f.name for f in spark.read.format(fmt).load(path).schema if f"/{f.name}=" in "".join(spark.read.format(fmt).load(path).inputFiles()[:1])] if fmt not in ("ipc", "avro") else []
        if parts and layout and parts != layout:
            raise ValueError(f"the folder is partitioned by {layout}, the schema by {parts}")
        parts = parts or layout
        target = options.schema or old.schema
        df = merged(cast_to(old, target), df, list(options.merge_by_names), options.ordinal, options.safe) if options.merge_by_names else cast_to(df, old.schema if options.schema is None else target, True)
    elif options.merge_by_names:
        empty = options.schema or T.StructType([f for f in df.schema if f.name != options.ordinal])
        df = merged(spark.createDataFrame([], empty), df, list(options.merge_by_names), options.ordinal, options.safe)
    df = shaped(df, Options(select_by_names=options.select_by_names, max_row_size=options.max_row_size, max_byte_size=options.max_byte_size))
    staged = f"{path.rstrip('/')}.__new_{uuid.uuid4().hex}"
    _write(df, staged, fmt, "overwrite", options, parts)
    p, fs = _path(spark, path)
    if there:
        aside, _ = _path(spark, f"{path.rstrip('/')}.__old_{uuid.uuid4().hex}")
        fs.rename(p, aside)
        fs.rename(_path(spark, staged)[0], p)
        fs.delete(aside, True)
    else:
        if not fs.rename(_path(spark, staged)[0], p):
            fs.mkdirs(p.getParent())
            fs.rename(_path(spark, staged)[0], p)


def append(df: DataFrame, path: str, fmt: str = "parquet", options: Options = Options()) -> None:  # noqa: B008
    """Adds rows cast onto the stored columns; with a key it is a merge."""
    if options.merge_by_names or not exists(df.sparkSession, path):
        return write(df, path, fmt, options)
    old = read(df.sparkSession, path, fmt).schema
    files = df.sparkSession.read.format(fmt).load(path).inputFiles()[:1] if fmt not in ("ipc", "avro") else []
    parts = [f.name for f in old if files and f"/{f.name}=" in files[0]]
    _write(shaped(cast_to(df, old, options.safe), Options(max_row_size=options.max_row_size)), path, fmt, "append", options, parts)
