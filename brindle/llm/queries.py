"""The queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import byte_bpe, chosen_path, decontaminate, line_dedup, nn_descent, suffix_dedup, surrogates, token_counts, token_files, toxicity
from brindle.llm._util import table

#: The categories of the chain, in order. The labels tell quality and toxicity; low quality comes first.
CATEGORIES = ("low_quality", "toxic")
#: The key of op7's query where the session sets no spark.brindle.surrogateKey.
SURROGATE_KEY = "brindle surrogate key 1"


def chain_labels(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, chain_labels(table(spark, sf_dir, "labels")), CATEGORIES)
    return toxicity.score(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read_token_files(spark, manifest)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("spark.brindle.surrogateKey", SURROGATE_KEY))
    return done.select("doc_id", F.col("_n_entities").alias("n_entities"), "text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_toxicity, op2_token_files, op3_nearest, op4_suffix_dedup, op5_chosen_path, op6_line_dedup, op7_surrogates, op8_token_counts, op9_byte_bpe, op10_decontaminate)
    return {f.__name__: f for f in own} | {"pipeline": pipeline}


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6_SQL = f"""
with lines as (
  select doc_id, p, line,
    translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents)),
common as (select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
marked as (select l.*, c.k is not null as gone from lines l left join common c on l.k = c.k)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

OP4_SQL = """
with texts as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
sizes as (select doc_id, x, (length(x) // 2)::bigint as n from texts),
windows as (select doc_id, i, substr(x, 2 * i + 1, 100) as w from (select doc_id, x, unnest(range(0, n - 49)) as i from sizes where n >= 50)),
least_id as (select w, min(doc_id) as m from windows group by w),
hits as (select doc_id, i from windows join least_id using (w) where m < doc_id),
runs as (select doc_id, i, sum(case when i <= before + 50 then 0 else 1 end) over (partition by doc_id order by i) as r
  from (select doc_id, i, lag(i, 1, -100) over (partition by doc_id order by i) as before from hits)),
spans as (select doc_id, r, min(i) as a, max(i) + 50 as b from runs group by doc_id, r),
gaps as (select s.doc_id, a, b, lead(a) over (partition by s.doc_id order by a) as next_a, row_number() over (partition by s.doc_id order by a) as k, x, n from spans s join sizes using (doc_id)),
kept as (select doc_id, sum(b - a)::bigint as n_removed, count(*)::bigint as n_spans,
  string_agg(case when k = 1 then substr(x, 1, 2 * a) else '' end || substr(x, 2 * b + 1, 2 * (coalesce(next_a, n) - b)), '' order by a) as h from gaps group by doc_id)
select s.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(h, x))) as kept_sha256
from sizes s left join kept using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": OP6_SQL, "op4_suffix_dedup": OP4_SQL}
