import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from conftest import ROWS, SF

from brindle.llm import queries, surrogates, toxicity


def test_toxicity_on_documents_that_were_not_fitted(spark):
    """Each third of the labelled documents is judged by a chain that was fitted on the other two."""
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    parts = []
    for third in range(3):
        chain = toxicity.fit(docs, queries.chain_labels(labels.where(f"doc_id % 3 <> {third}")), queries.CATEGORIES)
        parts.append(toxicity.score(docs, chain).join(labels.where(f"doc_id % 3 = {third}"), "doc_id").select("p_toxic", "toxic", "p_low_quality", "quality").toPandas())
    held = pd.concat(parts)
    said = held["p_toxic"] >= 0.5
    assert (said == (held["toxic"] == 1)).mean() > 0.98
    assert said[held["toxic"] == 1].mean() > 0.93 and said[held["toxic"] == 0].mean() < 0.01
    assert ((held["p_low_quality"] >= 0.5) == (held["quality"] == 0)).mean() > 0.8


def test_later_models_use_earlier_probabilities():
    chain = toxicity.Chain(("a", "b"), {"f": 0}, [np.array([4.0]), np.array([0.0, 6.0])], [-2.0, -3.0])
    p = chain.predict([np.array([0]), np.array([], np.int64)])
    assert p[0, 1] > p[1, 1] and abs(p[0, 1] - 1 / (1 + np.exp(3 - 6 * p[0, 0]))) < 1e-12


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (8, None), (8, 0)], "doc_id long, bad int")
    chain = toxicity.fit(odd, labels, ("bad",))
    assert toxicity.score(odd, chain).count() == len(ROWS)
    assert toxicity.drop_toxic(odd, chain).columns == odd.columns
    assert toxicity.score(none, chain).collect() == []
    nothing = toxicity.fit(odd, labels.where("doc_id < 0"), ("bad",))
    assert toxicity.drop_toxic(odd, nothing).count() == len(ROWS)


# --- 7


def replaced(spark, texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["_n_entities"]) for r in surrogates.replace_entities(docs, key).collect()}


def luhn(n):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0


def test_surrogates_keep_type_and_format(spark):
    texts = [
        "Write to anna.b7@mail.example.com or call +1 (017) 555-7713 today.",
        "card 4539578763621486 and 4111 1111 1111 1111, host 10.20.30.40!",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"',
        "Mrs. Anna Smith met Mr. Smith and Dr. JONES; Frau Müller too. Mr. Иван Петров came.",
        "again Mrs. Anna Smith and ANNA.B7@MAIL.example.com, +1 017 555 7713",
        "nothing here 123",
    ]
    got = replaced(spark, texts)
    assert [got[i][1] for i in range(6)] == [2, 3, 1, 5, 3, 0]
    assert got[5][0] == texts[5]
    mail, phone = re.search(r"to (\S+) or call (.+) today", got[0][0]).groups()
    assert re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{4}\.[a-z]{7}\.com", mail) and mail != "anna.b7@mail.example.com"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (017) 555-7713"
    one, two, ip = re.fullmatch(r"card (\d{16}) and (\d{4} \d{4} \d{4} \d{4}), host (\d+\.\d+\.\d+\.\d+)!", got[1][0]).groups()
    assert luhn(one) == luhn("4539578763621486") and luhn(two.replace(" ", "")) and all(int(x) < 256 for x in ip.split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', got[2][0])
    names = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) and Dr\. (\w+); Frau (\w+) too\. Mr\. (\w+) (\w+) came\.", got[3][0]).groups()
    assert names[1] == names[2] and names[3].isupper() and "Smith" not in names
    assert names[0].lower() in surrogates._LISTS["given:f:latin"] or names[0][0].isupper()
    assert all(re.fullmatch(r"[А-ЯЁа-яё]+", x) for x in names[5:])
    assert f"Mrs. {names[0]} {names[1]}" in got[4][0] and mail.upper() in got[4][0].upper()
    assert re.sub(r"\D", "", phone) in re.sub(r"\D", "", got[4][0])
    assert replaced(spark, texts) == got and replaced(spark, texts, "other") != got


def test_surrogates_stay_distinct(spark):
    mails = [f"{c}@x.com" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{c}{d}@x.com" for c in "abcdef" for d in range(10)]
    got = replaced(spark, [f"to {m}." for m in mails])
    new = [got[i][0][3:-1] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails)
    ips = [f"10.0.{a}.{b}" for a in range(8) for b in range(0, 250, 10)]
    got = replaced(spark, [f"at {m} " for m in ips])
    assert len({t for t, _ in got.values()}) == len(ips)


def test_no_entity_is_left_and_the_rest_is_untouched(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    java = surrogates.ENTITY.replace("\\p{Lu}", "[A-ZÀ-Þ]").replace("\\p{L}", "A-Za-zÀ-ÿ").replace("(?<=\\.[A-Za-z]{2,12})", "").replace("[A-Za-zÀ-ÿ\\d]", "[A-Za-zÀ-ÿ0-9]")
    find = re.compile(java)
    some = 0
    for r in queries.op7_surrogates(spark, SF).collect():
        before, after = texts[r["doc_id"]], r["text"]
        a, b = [m.group() for m in find.finditer(before)], [m.group() for m in find.finditer(after)]
        assert r["n_entities"] == len(a) == len(b) and not set(a) & set(b)
        assert find.split(before) == find.split(after) if find.groups == 0 else find.sub("#", before) == find.sub("#", after)
        some += len(a)
    assert some > 5


def test_surrogates_run_no_python(spark, odd):
    plan = surrogates.replace_entities(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_surrogates_of_odd_rows(spark, odd, none):
    got = surrogates.replace_entities(odd, "k")
    assert set(odd.columns) <= set(got.columns)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted((d or 0, x or "") for d, x, _ in ROWS)
    assert surrogates.replace_entities(none, "k").collect() == []
    twice = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (None, "a@b.com")], "doc_id long, text string")
    assert len({r["text"] for r in surrogates.replace_entities(twice, "k").collect()}) == 1


def test_bare_names_follow_the_titled_one(spark):
    texts = [
        "Smith came. Mr. John Smith's car and Mrs. O'Brien-Lee’s; then John, SMITH, Smithson and Smith. O'Brien-Lee left.",
        "Mr. J Smith and J and Smith's dog",
        "Smith without a title",
    ]
    got = replaced(spark, texts)
    surname, full, other, given = re.fullmatch(r"(\w+) came\. Mr\. (\w+ \w+)'s car and Mrs\. (\w+)’s; then (\w+), SMITH, Smithson and .*", got[0][0]).groups()
    assert full.split() == [given, surname] and "Smith" not in (given, surname)
    assert got[0][0].endswith(f", SMITH, Smithson and {surname}. {other} left.") and got[0][1] == 6
    assert re.fullmatch(rf"Mr\. \w+ {surname} and J and {surname}'s dog", got[1][0]) and got[1][1] == 2
    assert got[2] == (texts[2], 0)


def test_surrogate_columns_may_clash(spark):
    rows = spark.createDataFrame([(1, "mail a.b@c.com now", "x", "y", "z"), (2, "none", "x", "y", "z")], "doc_id long, text string, _e string, _row string, _n_entities string").selectExpr("*", "'q' as _x", "'w' as r", "'v' as _m")
    got = surrogates.replace_entities(rows, "k")
    assert set(got.columns) == set(rows.columns)
    assert sorted((r["doc_id"], r["_n_entities"], r["_e"], r["_row"], r["_x"], r["r"], r["_m"], "@" in r["text"]) for r in got.collect()) == [(1, 1, "x", "y", "q", "w", "v", True), (2, 0, "x", "y", "q", "w", "v", False)]
