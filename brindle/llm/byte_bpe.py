"""Byte-level BPE encoding and decoding (operator 9) with the tokenizers library over Arrow batches.

A rank file becomes a BPE model of the library: every way to write a token as two tokens is a merge, in the order of the
token's rank, which is what merging the lowest rank first means. The library works on characters, so bytes are mapped to its
256 printable characters. Decoding reverses that table; a character split over several tokens is whole again once their bytes
are joined, and bytes that are no UTF-8 decode to U+FFFD in text (the bytes themselves are always kept).
"""

from __future__ import annotations

import base64
import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brindle.llm import pieces
from brindle.llm._util import slices, text_of


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def model_json(path: str) -> str:
    """The library's form of a rank file (a fixed size for a vocabulary, so it may be broadcast)."""
    ranks = read_ranks(path)
    name = {token: "".join(map(pieces.BYTE_TO_CHAR.__getitem__, token)) for token in ranks}
    merges = [[name[t[:i]], name[t[i:]]] for t, _ in sorted(ranks.items(), key=lambda x: x[1]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": byte_level, "post_processor": None, "decoder": byte_level, "model": model})


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, model: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(model)
        self.coder = pieces.bytes_coder(tokenizer, limit=limit)
        vocab = tokenizer.get_vocab()
        self.table: list[bytes] = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(map(pieces.CHAR_TO_BYTE.__getitem__, token))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.coder.encode(text), "<u4").tolist()

    def offsets(self, ids: list[int]) -> list[int]:
        """Where each token ends, in bytes of the text."""
        return np.cumsum([len(self.table[i]) for i in ids], dtype=np.int64).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _codec(model: str) -> Codec:
    return pieces.of_worker(("codec", len(model), hash(model)), lambda: Codec(model))


def _column(docs: DataFrame, name: str) -> str:
    return f"`{name}` {docs.select(name).schema[0].dataType.simpleString()}"


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, byte_ends array<long>): the ids of each whole text and the byte at which each token ends.

    Null or empty text: empty arrays. Null ids stay null; repeated rows are repeated; an empty table gives an empty one; other
    columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_json(ranks_path))

    def run(batches):
        codec = _codec(model.value)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.offsets(x) for x in ids], pa.list_(pa.int64()))], names=[id_col, "ids", "byte_ends"])

    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"{_column(docs, id_col)}, ids array<int>, byte_ends array<long>")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text string, bytes binary) of rows with token ids; null ids decode to the empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(model_json(ranks_path))

    def run(batches):
        codec = _codec(model.value)
        for batch in batches:
            raw = [codec.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string()), pa.array(raw, pa.binary())], names=[id_col, "text", "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{_column(encoded, id_col)}, text string, bytes binary")


def digests(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of each whole text: encodes, decodes the ids again and hashes either.

    Nulls, repeats, empty tables and other columns as in encode_documents; one pass, nothing is shuffled.
    """
    model = docs.sparkSession.sparkContext.broadcast(model_json(ranks_path))

    def run(batches):
        codec = _codec(model.value)
        spelt = [str(i) for i in range(len(codec.table))]
        for batch, texts in slices(batches, 1):
            n, a, b = [], [], []
            for text in texts:
                ids = codec.encode(text)
                n.append(len(ids))
                a.append(hashlib.sha256(" ".join(map(spelt.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"{_column(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
