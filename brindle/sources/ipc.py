"""Arrow IPC streams: one file a partition, read by tasks through binaryFile, so any Hadoop file system works."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


def encode(df_schema, batches) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, df_schema) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def write(df: DataFrame, path: str, mode: str = "overwrite", suffix: str = "arrows") -> None:
    schema = to_arrow_schema(df.schema)

    def run(batches):
        batches = list(b.cast(schema) if b.schema != schema else b for b in batches)
        yield pa.RecordBatch.from_pydict({"name": [f"part-{uuid.uuid4().hex}.{suffix}"], "content": pa.array([encode(schema, batches)], pa.binary())})

    write_blobs(df.mapInArrow(run, "name string, content binary"), path, mode)


def write_blobs(files: DataFrame, path: str, mode: str) -> None:
    """Rows (name, content) as files under path. Attempts write names of their own."""
    from pyarrow import fs

    spark = files.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    hadoop = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if mode == "overwrite":
        hadoop.delete(p, True)
    hadoop.mkdirs(p)
    root = hadoop.makeQualified(p).toString()

    def put(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, base = fs.FileSystem.from_uri(root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root)
                with system.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    files.mapInArrow(put, "n long").collect()


def read(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = raw.select("content").first()
    if head is None:
        raise ValueError(f"{path} holds no stream")
    schema = from_arrow_schema(pa.ipc.open_stream(head["content"]).schema)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                yield from pa.ipc.open_stream(content.as_buffer())

    return raw.select("content").mapInArrow(run, schema)
