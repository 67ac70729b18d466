"""Token-id files with a keyed index (operator 2).

Documents are dealt by range of their id, so one task holds a run of ascending ids and writes it as shards. A shard is two files
in the shared folder:

* `<name>.bin`: the ids of its documents, one after the other, raw little-endian (16 bits where the vocabulary allows, else 32);
* `<name>.idx`: the document keys in order, and a minimal perfect hash over them whose slot holds a stored fingerprint and the
  document's offset and length, so a key leads to its ids in constant time and a foreign key is refused by its fingerprint.

The hash is the cascade of bit arrays of Limasset et al. (2017): a key owns a bit of the first level where it meets no other;
the rank of that bit is its slot. Shards hold disjoint ranges of ids, so a manifest of one row a shard routes a key.
Attempts write files of their own names, and the manifest names those of the attempts that succeeded: lost executors and
speculative copies leave no wrong file in use. Files are reached through pyarrow's file systems by the folder's URI.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import pieces
from brindle.llm._util import fresh_dir, slices, stored, text_of

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of x with a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _GOLD * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: slot(keys) is a bijection onto 0..n-1 for them; others get any slot or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(base + np.cumsum(ones) - ones)
            base += int(ones.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        left, levels = np.asarray(keys).astype(np.uint64), []
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        while len(left):
            words = max(1, int(np.ceil(gamma * len(left) / 64)))
            at = mix(left, len(levels)) % np.uint64(words * 64)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys).astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            todo = np.flatnonzero(out < 0)
            if not len(todo):
                break
            at = mix(keys[todo], k) % np.uint64(len(bits) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (ranks[word] + below)[hit]
        return out


def key_hash(keys: list) -> np.ndarray:
    """64-bit hash of integer or string keys."""
    if all(isinstance(k, int) for k in keys):
        return mix(np.array(keys, np.int64).view(np.uint64), 101)
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(str(k)) for k in keys], np.uint64)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes, 77) >> np.uint64(32)).astype("<u4")


class Index:
    """The .idx file of a shard. Null keys have a place in the order but no entry; a repeated key leads to its first document."""

    def __init__(self, keys: list, offsets: np.ndarray, lengths: np.ndarray, width: int):
        self.keys, self.offsets, self.lengths, self.width = keys, offsets, lengths, width
        first: dict = {}
        for i, k in enumerate(keys):
            if k is not None:
                first.setdefault(k, i)
        hashes = key_hash(list(first)) if first else np.zeros(0, np.uint64)
        self.hash = PerfectHash.build(hashes)
        slots, rows = self.hash.slot(hashes), np.fromiter(first.values(), np.int64, len(first))
        self.prints, self.rows = np.zeros(len(first), "<u4"), np.zeros(len(first), "<i8")
        self.prints[slots], self.rows[slots] = fingerprint(hashes), rows

    def to_bytes(self) -> bytes:
        head = json.dumps({"width": self.width, "n": len(self.keys), "levels": [len(x) for x in self.hash.levels], "indexed": len(self.rows), "keys": self.keys if any(isinstance(k, str) for k in self.keys) else None}).encode()
        ints = np.array([0 if k is None or isinstance(k, str) else k for k in self.keys], "<i8")
        null = np.array([k is None for k in self.keys], "u1")
        parts = [b"BRTI0001", len(head).to_bytes(8, "little"), head, ints.tobytes(), null.tobytes(), self.offsets.astype("<i8").tobytes(), self.lengths.astype("<i8").tobytes(), self.prints.tobytes(), self.rows.tobytes(), *(x.astype("<u8").tobytes() for x in self.hash.levels)]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        f = io.BytesIO(raw)
        if f.read(8) != b"BRTI0001":
            raise ValueError("no index file")
        head = json.loads(f.read(int.from_bytes(f.read(8), "little")))
        take = lambda kind, n: np.frombuffer(f.read(n * np.dtype(kind).itemsize), kind)
        self = cls.__new__(cls)
        n, self.width = head["n"], head["width"]
        ints, null = take("<i8", n), take("u1", n)
        self.keys = head["keys"] or [None if z else int(k) for k, z in zip(ints, null, strict=True)]
        self.offsets, self.lengths = take("<i8", n), take("<i8", n)
        self.prints, self.rows = take("<u4", head["indexed"]), take("<i8", head["indexed"])
        self.hash = PerfectHash([take("<u8", w) for w in head["levels"]])
        return self

    def find(self, keys: list) -> np.ndarray:
        """Row of each key, -1 where the key isn't in the shard."""
        if not len(self.rows) or not keys:
            return np.full(len(keys), -1, np.int64)
        hashes = key_hash(keys)
        slot = self.hash.slot(hashes)
        known = (slot >= 0) & (self.prints[slot] == fingerprint(hashes))
        return np.where(known, self.rows[slot], -1)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes) -> None:
    system, path = _filesystem(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path) as f:
        f.write(data)


def _read(uri: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = _filesystem(uri)
    with system.open_input_file(path) as f:
        return f.read_at(f.size() - start if size is None else size, start)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, shard_tokens: int = 8_000_000) -> DataFrame:
    """Encodes every whole text, appends end_id, writes shards in ascending order of id_col, returns the manifest.

    Manifest: one row a shard in order: seq long, path string, low and high (least and greatest key), n_docs, n_tokens, start
    (ids in all shards before it). Null or empty text: end_id alone. Null keys come first and can't be looked up. Repeated keys
    keep their rows side by side. An empty table gives an empty manifest. Other columns are ignored. A task holds at most one
    shard of about shard_tokens ids. The manifest is stored as one file: one a task would be a row each.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "token-files")
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        def make():
            tokenizer = Tokenizer.from_file(tokenizer_path)
            return pieces.bytes_coder(tokenizer, pieces.special_strings(tokenizer), limit=800_000)

        coder = pieces.of_worker(("bytes", tokenizer_path), make)
        narrow = coder.tokenizer.get_vocab_size(with_added_tokens=True) <= 65_536 and end_id < 65_536
        end, part, shard = pieces.as_bytes([end_id]), TaskContext.get().partitionId(), 0
        keys: list = []
        lengths: list[int] = []
        chunks: list[bytes] = []
        held = 0

        def flush():
            nonlocal keys, lengths, chunks, held, shard
            name = f"{folder}/{part:06d}-{shard:04d}-{uuid.uuid4().hex[:12]}"
            size = np.array(lengths, np.int64)
            _write(f"{name}.bin", b"".join(chunks))
            _write(f"{name}.idx", Index(keys, np.cumsum(size) - size, size, 2 if narrow else 4).to_bytes())
            known = [k for k in keys if k is not None]
            row = {"seq": [part * 100_000 + shard], "path": [name], "low": pa.array([known[0] if known else None], low), "high": pa.array([known[-1] if known else None], low), "n_docs": [len(keys)], "n_tokens": [int(size.sum())]}
            keys, lengths, chunks, held, shard = [], [], [], 0, shard + 1
            return pa.RecordBatch.from_pydict(row)

        low = None
        for batch, texts in slices(batches, 1):
            low = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                raw = coder.encode(text) + end
                keys.append(key)
                lengths.append(len(raw) // 4)
                chunks.append(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if narrow else raw)
                held += lengths[-1]
                if held >= shard_tokens:
                    yield flush()
        if keys:
            yield flush()

    dealt = docs.select(id_col, text_of(text_col).alias("text")).repartitionByRange(id_col).sortWithinPartitions(id_col)
    shards = dealt.mapInArrow(run, f"seq long, path string, low {kind}, high {kind}, n_docs long, n_tokens long")
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return stored(shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files alone; each document is found through the index.

    A task reads whole shards one after the other, one task for four shuffle partitions: reading is a small part of the work, and
    each task leaves a file. start: ids of all documents before it; ids_crc32: unsigned crc32 of its ids as little-endian unsigned
    32-bit integers.
    """
    kind = manifest.schema["low"].dataType.simpleString()
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index, raw = Index.from_bytes(_read(f"{path}.idx")), _read(f"{path}.bin")
                n = len(index.keys)
                known = [k for k in index.keys if k is not None]
                found = iter(index.find(known).tolist())
                rows, seen = np.arange(n), set()
                for i, k in enumerate(index.keys):
                    if k is not None:
                        at = next(found)
                        if index.keys[at] != k:
                            raise ValueError(f"the index of {path} doesn't lead to {k}")
                        rows[i] = i if k in seen else at
                        seen.add(k)
                ids = np.frombuffer(raw, "<u2" if index.width == 2 else "<u4").astype("<u4")
                crc = [zlib.crc32(ids[index.offsets[i] : index.offsets[i] + index.lengths[i]].tobytes()) for i in rows]
                key = pa.array(index.keys, pa_kind(kind))
                yield pa.RecordBatch.from_arrays([key, pa.array(index.offsets[rows] + start, pa.int64()), pa.array(index.lengths[rows], pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").repartition(tasks).mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def pa_kind(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]


def lookup(manifest: DataFrame, keys: list) -> dict:
    """key -> its ids, for a few keys (None if unknown): routes by the manifest, then one index probe and one ranged read."""
    shards = [r for r in manifest.orderBy("seq").collect() if r["low"] is not None]
    out: dict = {}
    for key in keys:
        out[key] = None
        for r in shards:
            if r["low"] <= key <= r["high"]:
                index = Index.from_bytes(_read(f"{r['path']}.idx"))
                row = int(index.find([key])[0])
                if row >= 0 and index.keys[row] == key:
                    w = index.width
                    raw = _read(f"{r['path']}.bin", int(index.offsets[row]) * w, int(index.lengths[row]) * w)
                    out[key] = np.frombuffer(raw, f"<u{w}").tolist()
                    break
    return out
