import hashlib

import corpus_pipeline
from conftest import SF
from test_joins import brute_groups
from test_text_operators import brute_lines, tiktoken_encoding


def test_stages_take_effect_and_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert sorted(now.columns) == sorted(docs.columns)
        held.append({r["doc_id"]: r["text"] for r in now.collect()})
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    gone = set(before) - set(held[0])
    assert gone and all(labels.get(d, 1) == 1 for d in gone)
    want = {d: s for d, _, _, s in brute_lines(list(held[0].items()))}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in held[1].items()} == want
    groups = brute_groups(list(held[1].items()), 5)
    assert set(held[2]) == {d for d, (_, c) in groups.items() if c == d}
    assert set(held[3]) == {d for d, t in held[2].items() if not any(i in t for i in items)}
    enc = tiktoken_encoding()
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()}
    assert out == {d: len(enc.encode_ordinary(t)) for d, t in held[3].items()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(out)
