"""A corpus pipeline: toxic documents go, common lines go, one document of each near-duplicate group stays, leaked benchmark passages go,
what is left is encoded as token ids. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import byte_bpe, chosen_path, decontaminate, line_dedup, toxicity
from brindle.llm._util import stored, table
from brindle.llm.queries import CATEGORIES, chain_labels

#: Words in a shingle, and least similarity in percent, of the near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the chain calls toxic. Labels train it; it judges every document by its text."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, chain_labels(table(spark, sf_dir, "labels")), CATEGORIES))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that 10 or more documents share; n_chars follows. A document that loses all lines stays as an empty one."""
    done = line_dedup.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group; documents without words are in no group."""
    gone = chosen_path.near_duplicates(docs, SHINGLE, PERCENT).where("not kept").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text that is left."""
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("byte_bpe", encode),
]

#: A trained chain and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
