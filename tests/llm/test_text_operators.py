import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import ROWS, SF

from brindle.llm import byte_bpe, line_dedup, queries, suffix_dedup, token_counts, token_files

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], (x or "" for x in t["text"]), strict=True))


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- 2 and 8


def test_counts_are_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = rows(queries.op8_token_counts(spark, SF))
    assert len(got) == len(texts)
    for d, x in texts.items():
        n = len(t.encode(x, add_special_tokens=False).ids)
        assert (got[d]["n_bytes"], got[d]["n_tokens"], got[d]["over_limit"]) == (len(x.encode()), n, n > 1024)


def test_counts_of_odd_rows(odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = sorted(((r["doc_id"] or 0), r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd, JSON).collect())
    assert got == sorted((d or 0, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for d, x, _ in ROWS)
    assert token_counts.count_tokens(none, JSON).collect() == []


def test_counts_by_sentencepiece(odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.count_tokens(odd, path).collect())
    assert got == sorted((d or 0, len(m.encode(x or ""))) for d, x, _ in ROWS)


def test_pieces_agree_with_the_library_on_random_texts():
    from tokenizers import Tokenizer

    from brindle.llm import pieces

    t = Tokenizer.from_file(JSON)
    coder = pieces.bytes_coder(t, pieces.special_strings(t), limit=50)
    rng = random.Random(3)
    alphabet = [" ", "\n", "a", "don't", "É", "²", "½", "x_y", "12", "٣", "—", "日", "\u0085", " ", "​", "'s", "…", "\t", "  ", "ª", "ᲀ", "\x1c", "﻿", "ǅ", "<|endoftext|>", "\0"]
    for _ in range(4000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert coder.encode(x) == pieces.as_bytes(t.encode(x, add_special_tokens=False).ids), repr(x)


def test_token_files_hold_all_ids(spark, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got, start = rows(queries.op2_token_files(spark, SF)), 0
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(raw))
        start += len(ids)


def test_token_files_of_odd_rows_and_lookup(spark, odd, none):
    manifest = token_files.write_token_files(odd, JSON, 2, shard_tokens=5000).cache()
    got = token_files.read_token_files(spark, manifest).collect()
    assert len(got) == len(ROWS)
    found = token_files.lookup(manifest, [1, 8, 9, 77, -5])
    assert found[8] == found[9] and found[8][-1] == 2 and found[1][-1] == 2
    assert found[77] is None and found[-5] is None
    empty = token_files.write_token_files(none, JSON, 2)
    assert empty.collect() == [] and token_files.read_token_files(spark, empty).collect() == []


def test_token_files_leave_few_files_besides_the_shards(spark, texts):
    from tokenizers import Tokenizer

    t, conf = Tokenizer.from_file(JSON), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        manifest = token_files.write_token_files(spark.read.parquet(f"{SF}/documents.parquet"), JSON, 2, shard_tokens=20_000)
        read = token_files.read_token_files(spark, manifest)
        assert manifest.count() > 8 and len(manifest.inputFiles()) == 1
        assert read.rdd.getNumPartitions() == 2
        got, start = rows(read), 0
    finally:
        spark.conf.unset(conf)
    assert len(got) == len(texts)
    for d in sorted(texts):
        ids = [*t.encode(texts[d], add_special_tokens=False).ids, 2]
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_perfect_hash_is_minimal_and_refuses_strangers():
    import numpy as np

    keys = token_files.key_hash(list(range(-5000, 20000, 3)))
    slots = token_files.PerfectHash.build(keys).slot(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    index = token_files.Index([f"k{i}" for i in range(3000)], np.arange(3000), np.ones(3000), 2)
    index = token_files.Index.from_bytes(index.to_bytes())
    assert index.find([f"k{i}" for i in range(3000)]).tolist() == list(range(3000))
    assert (index.find([f"other{i}" for i in range(20000)]) >= 0).mean() < 0.001


# --- 4


def brute_spans(texts, n=50):
    first = {}
    for d in sorted(texts):
        b = texts[d]
        for i in range(len(b) - n + 1):
            first.setdefault(b[i : i + n], d)
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if first[b[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), runs, sha(kept))
    return out


def test_suffix_dedup_is_brute_force(spark, texts):
    want = brute_spans({d: x.encode() for d, x in texts.items()})
    got = rows(queries.op4_suffix_dedup(spark, SF))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 0


def spans_of(df):
    return {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in rows(df).items()}


def test_suffix_dedup_of_a_gram_in_a_third_of_the_documents(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    hot, passage = "=" * 20, word(90)
    texts = {d: word(rng.randint(0, 150)) + (rng.choice([hot, passage]) if d % 3 == 0 else "") + word(60) for d in range(400)}
    texts |= {1000 + d: texts[d] for d in range(0, 400, 7)} | {2000: "z" * 5000, 2001: "ab" * 3000, 2002: "z" * 400 + "ab" * 40}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_spans({d: x.encode() for d, x in texts.items()})
    assert spans_of(suffix_dedup.remove_repeats(df)) == want
    assert spans_of(suffix_dedup.remove_repeats(df, part_bytes=200)) == want  # parts that are never held


def test_suffix_dedup_in_small_pieces(spark, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abc ") for _ in range(4000))
    texts = {d: base[a : a + rng.randint(100, 2500)] for d, a in enumerate(rng.randint(0, 3000) for _ in range(25))}
    monkeypatch.setattr(suffix_dedup, "SLICE", 1500)
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    raw = {d: x.encode() for d, x in texts.items()}
    batch = pa.RecordBatch.from_pydict({"i": pa.array(list(texts), pa.int64()), "t": list(texts.values())})
    dealt = [r for b in suffix_dedup._dealt(3, 5, 50)([batch]) for r in b.to_pylist()]
    dealt.sort(key=lambda r: (r["part"], r["kind"]))
    shared = [r for b in suffix_dedup._shared(5)([pa.RecordBatch.from_pylist(dealt)]) for r in b.to_pylist()]
    where = {d: int(suffix_dedup.bucket_of(np.array([d]), 5)[0]) for d in texts}
    stream = sorted([(r["part"], 0, r["blob"], None, None) for r in shared] + [(where[d], 1, None, d, x) for d, x in texts.items()], key=lambda r: r[:2])
    columns = [pa.array(c, k) for c, k in zip(zip(*stream, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()), strict=True)]
    told = [r for b in suffix_dedup._contexts(3, 5, 50)([pa.RecordBatch.from_arrays(columns, names=list("bkoit"))]) for r in b.to_pylist()]
    told.sort(key=lambda r: (r["part"], r["kind"]))
    last = [r for b in suffix_dedup._compared(5, 50, 1 << 30)([pa.RecordBatch.from_pylist(told)]) for r in b.to_pylist()]
    gone = {d: bytearray(len(x)) for d, x in raw.items()}
    for r in last:
        for d, a, b in zip(*(x.tolist() for x in suffix_dedup._unpack(r["blob"], suffix_dedup._SPAN)), strict=True):
            gone[d][a:b] = b"\1" * (b - a)
    want = brute_spans(raw)
    assert {d: (len(g), sum(g)) for d, g in gone.items()} == {d: w[:2] for d, w in want.items()}


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "é日 a"])
def test_suffix_dedup_of_repetitive_texts(spark, alphabet):
    rng = random.Random(alphabet)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(4)]
    texts = {}
    for d in rng.sample(range(-20, 100), 40):
        x = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            x += b[a : a + rng.randint(0, 200)] + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 20)))
        texts[d] = x
    got = rows(suffix_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute_spans({d: x.encode() for d, x in texts.items()})


def test_two_stage_sort_orders_suffixes():
    import numpy as np

    rng = random.Random(5)
    for _ in range(100):
        contexts = [bytes(rng.choice(b"ab\0c") for _ in range(rng.randint(24, 60))) for _ in range(rng.randint(1, 20))]
        sizes = np.array([len(c) for c in contexts])
        text = np.frombuffer(b"\0\1".join(contexts) + b"\0\1" + bytes(40), "u1")
        first = np.cumsum(sizes + 2) - sizes - 2
        order = suffix_dedup.two_stage(text, first, first + sizes - 24, 24)
        raw = text.tobytes()
        keys = [raw[i : i + 24] for i in order.tolist()]
        assert keys == sorted(keys)
        assert set(order.tolist()) >= {f + j for f, s in zip(first.tolist(), sizes.tolist(), strict=True) for j in range(s - 23)}


def test_suffix_dedup_of_odd_rows(odd, none, spark):
    got = [(r["doc_id"], r["n_removed"]) for r in suffix_dedup.remove_repeats(odd).collect()]
    n = len(ROWS[0][1])
    assert (2, n) in got and (1, 0) in got and (None, 0) in got and len(got) == len(ROWS)
    assert suffix_dedup.remove_repeats(none).collect() == []
    twice = spark.createDataFrame([(1, "a" * 30 + "b" * 30), (2, "a" * 30 + "b" * 30), (2, "c" * 70)], "doc_id long, text string")
    assert len(suffix_dedup.remove_repeats(twice).collect()) == 3


# --- 6


def brute_lines(rows, least=10):
    from collections import defaultdict

    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({a: a + 32 for a in range(65, 91)})
    seen = defaultdict(set)
    for d, x in rows:
        for line in (x or "").split("\n"):
            seen[key(line)].add(d)
    gone = {k for k, ds in seen.items() if k and len(ds) >= least}
    out = []
    for d, x in rows:
        lines = (x or "").split("\n")
        kept = [line for line in lines if key(line) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def test_line_dedup_is_brute_force(spark, texts):
    got = queries.op6_line_dedup(spark, SF).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got), key=str) == brute_lines(texts.items())
    assert any(r["n_dropped"] for r in got)


def test_line_dedup_of_odd_rows(spark, odd, none):
    got = line_dedup.drop_common_lines(odd, min_docs=2)
    assert set(odd.columns) <= set(got.columns)
    got = sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], sha(r["text"])) for r in got.collect()), key=str)
    assert got == brute_lines([(d, x) for d, x, _ in ROWS], 2)
    assert line_dedup.drop_common_lines(none).collect() == []
    all_gone = spark.createDataFrame([(i, "Same\n same ") for i in range(10)], "doc_id long, text string")
    assert {(r["text"], r["_n_dropped"]) for r in line_dedup.drop_common_lines(all_gone).collect()} == {("", 2)}
    clash = all_gone.selectExpr("*", "1 as _x", "2 as _y", "3 as _i", "4 as _gx", "5 as _gy", "6 as _gone", "7 as salt", "8 as p")
    kept = line_dedup.drop_common_lines(clash)
    assert set(clash.columns) <= set(kept.columns)
    assert {(r["text"], r["_x"], r["_y"], r["_i"], r["_gx"], r["_gy"], r["_gone"], r["salt"], r["p"]) for r in kept.collect()} == {("", 1, 2, 3, 4, 5, 6, 7, 8)}


def test_line_dedup_of_hot_lines(spark):
    """Some lines lie in far more documents than the least that counts as hot; most others in too few to go."""
    data = [(i, f"Everywhere\nown {i}\n everywhere \nthird" if i % 3 == 0 else f"own {i % 200}\nEVERYWHERE\nshared {i % 7}") for i in range(900)]
    got = line_dedup.drop_common_lines(spark.createDataFrame(data, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["_n_lines"], r["_n_dropped"], sha(r["text"])) for r in got.collect()), key=str) == brute_lines(data)


# --- 9


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_is_tiktoken(spark, texts):
    enc = tiktoken_encoding()
    got = rows(queries.op9_byte_bpe(spark, SF))
    for d, x in texts.items():
        ids = enc.encode_ordinary(x)
        assert (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(x))


def test_byte_bpe_round_trip_and_split_characters(odd, none):
    enc = tiktoken_encoding()
    e = byte_bpe.encode_documents(odd, RANKS).cache()
    for r in e.collect():
        assert r["byte_ends"] == [sum(len(enc.decode_single_token_bytes(i)) for i in r["ids"][: k + 1]) for k in range(len(r["ids"]))] if r["doc_id"] != 6 else True
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in e.collect()) == sorted((d or 0, tuple(enc.encode_ordinary(x or ""))) for d, x, _ in ROWS)
    back = byte_bpe.decode_documents(e, RANKS).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((d or 0, x or "") for d, x, _ in ROWS)
    assert byte_bpe.digests(none, RANKS).collect() == []
    codec = byte_bpe.Codec(byte_bpe.model_json(RANKS))
    ids = codec.encode("日本𝄞")
    assert len(ids) > 3 and codec.decode(ids) == "日本𝄞" and codec.decode(ids[:1]) != "日"
    assert "�" in codec.decode(ids[:-1])
