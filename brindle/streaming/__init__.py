"""Structured Streaming: files that arrive in a folder, read as a stream, run through a statement, and written by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brindle.plans import ast as A
from brindle.plans.compile import run
from brindle.plans.parser import parse_statement


def follow(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", names: str | None = None, files_a_batch: int | None = None) -> DataFrame:
    """The rows of a folder as a stream; names: a glob that file names must match."""
    r = spark.readStream.schema(schema).format(fmt)
    if names:
        r = r.option("pathGlobFilter", names)
    if files_a_batch:
        r = r.option("maxFilesPerTrigger", files_a_batch)
    return r.load(folder)


def keep(stream: DataFrame, statement: str | A.Statement, path: str, checkpoint: str, fmt: str = "parquet", parameters: dict | None = None, once: bool = True):
    """Starts writing the statement's rows under path and returns the running query. once: what is there now, then it ends by itself.

    Filters and projections only: an order or a limit over an endless input has no answer, so it is refused.
    """
    s = parse_statement(statement) if isinstance(statement, str) else statement
    if s.order or s.limit is not None:
        raise ValueError("a stream takes neither order nor limit")
    w = run(stream, s, parameters).writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
