import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import ROWS, SF

from brindle.llm import chosen_path, decontaminate, nn_descent, queries


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def brute_groups(rows, k, percent=80):
    sets = [(d, shingles(x, k)) for d, x in rows]
    parent = {d: d for d, _ in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for n, (a, s) in enumerate(sets):
        for b, t in sets[:n]:
            if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets}


def test_near_duplicates_are_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    want = brute_groups(list(zip(t["doc_id"], t["text"], strict=True)), 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_chosen_path(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_of_planted_groups(spark, k):
    rng = random.Random(k)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for _ in range((150, 60, 20, 5, 2, 1)[g]):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // (25 * k // 2)))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_groups(rows, k)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == want


def test_near_duplicates_within_a_template_family(spark):
    """Documents that share a base text and are no duplicates of each other, but in pairs: every pair is found, nothing else is linked."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(20000)]
    base, rows = [rng.choice(vocabulary) for _ in range(200)], []
    for _ in range(350):
        one = base[:]
        for p in rng.sample(range(200), 9):
            one[p] = rng.choice(vocabulary)
        two = one[:]
        for p in rng.sample(range(200), 7):
            two[p] = rng.choice(vocabulary)
        rows += [" ".join(one), " ".join(two)]
    rows = list(enumerate(rows))
    want = brute_groups(rows, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert sum(c != d for d, (_, c) in want.items()) >= 350 and got == want


def test_near_duplicates_of_odd_rows(odd, none, spark):
    got = chosen_path.near_duplicates(odd, 2).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r for r in got}
    assert of[2]["component_id"] == 1 and not of[2]["kept"] and of[1]["kept"]
    assert of[9]["component_id"] == 8 and of[3]["component_id"] == 3 and of[3]["n_shingles"] == 0 and of[5]["kept"]
    assert of[None]["component_id"] is None and of[None]["kept"]
    assert chosen_path.near_duplicates(none).collect() == []
    twice = spark.createDataFrame([(5, "a b c"), (5, "d e f"), (6, "d e f"), (3, "a b c")], "doc_id long, text string")
    assert {r["component_id"] for r in chosen_path.near_duplicates(twice, 2).collect()} == {3}


# --- 3


def brute_nearest(ids, v, every, k):
    s = v @ v.T
    out = {}
    for r in np.flatnonzero(ids % every == 0):
        order = np.lexsort((ids, -s[r]))
        out[int(ids[r])] = [int(ids[c]) for c in order if ids[c] != ids[r]][:k]
    return out


def recall(got, want):
    return np.mean([len(set(got.get(q, ())) & set(w)) / len(w) for q, w in want.items() if w])


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_nearest_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, v = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    df = queries.op3_nearest(spark, "/root/testdata/sf0.1").cache()
    want = brute_nearest(ids, v, 20, 20)
    got = collected(df)
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9
    row = df.first()
    a, b = (v[np.flatnonzero(ids == row[c])[0]] for c in ("query_id", "vec_id"))
    assert abs(a @ b - row["score"]) < 1e-12


def test_nearest_recall_on_more_rows(spark):
    t = pq.read_table("/root/testdata/check_s/embeddings.parquet").to_pydict()
    ids, v = np.array(t["vec_id"]), np.array(t["embedding"], np.float64)
    found = recall(collected(nn_descent.nearest(spark.read.parquet("/root/testdata/check_s/embeddings.parquet"))), brute_nearest(ids, v, 20, 20))
    print("recall", found)
    assert found >= 0.9


def test_nearest_with_unequal_norms_copies_and_bad_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8)) * rng.lognormal(0, 0.7, size=(700, 1))
    v[100:350] = v[100]
    v = v.astype(np.float32)
    rows = [(i, x.tolist(), "c") for i, x in enumerate(v)]
    bad = [(1000, None, "c"), (1020, [0.0] * 8, "c"), (1040, [float("nan")] + [1.0] * 7, "c"), (1060, [None] + [1.0] * 7, "c"), (1080, [1.0], "c"), (1100, [], "c"), (None, v[3].tolist(), "c"), (1120, [float("inf")] + [1.0] * 7, "c")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, leaf string")
    got, want = collected(nn_descent.nearest(df)), brute_nearest(np.arange(700), v.astype(np.float64), 20, 20)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    assert nn_descent.nearest(df.where("vec_id < 0")).collect() == []
    assert collected(nn_descent.nearest(df.where("vec_id < 3"))) == {0: sorted([1, 2], key=lambda c: -float(v[0].astype(float) @ v[c].astype(float)))}


# --- 10


def test_leaks_are_the_planted_passages(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    want = {(d, i) for d, x in zip(docs["doc_id"], docs["text"], strict=True) for i, y in zip(items["item_id"], items["text"], strict=True) if y in (x or "")}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op10_decontaminate(spark, SF).collect()}
    assert want and got == want


QUESTION = "A train leaves Paris at 9 and travels 120 km to reach Lyon before the sun sets behind the hills. How fast does the train from Paris move?"
ITEMS = [(1, QUESTION), (2, None), (3, ""), (4, "too short"), (5, "seven plain words make one small item")]


def leaks(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), **more).collect()}


@pytest.mark.parametrize("more", [{}, {"block_windows": 5}])
def test_reparameterised_questions_are_caught(spark, more):
    other = QUESTION.replace("Paris", "Berlin").replace("Lyon", "Bonn").replace("120", "75").replace("km", "miles").replace(" 9 ", " 11 ")
    broken = QUESTION.replace("leaves Paris", "leaves Berlin").replace("Lyon", "Berlin")
    texts = [f"Some words before. {QUESTION} And after.", other, "nothing of the kind here at all", None, "", other.upper().lower(), "Here are seven plain words make one small item."]
    got = leaks(spark, [*texts, broken], **more)
    assert {(0, 1), (1, 1), (6, 5)} <= got
    assert not {d for d, _ in got} & {2, 3, 4}


def test_slots_must_be_consistent():
    t = decontaminate.template
    iw, iv = t("we saw Anna meet Bernd and then Anna left Bernd alone there")
    w, v = t("we saw Carla meet Dora and then Carla left Dora alone there")
    assert decontaminate.runs(w, v, iw, iv, [(0, 0)])[0] == len(iw)
    w, v = t("we saw Carla meet Carla and then Dora left Dora alone there")
    assert decontaminate.runs(w, v, iw, iv, [(0, 0)])[0] < len(iw)


def test_leaks_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_leaks(odd, bench).collect() == []
    assert decontaminate.find_leaks(none, bench).collect() == []
    assert decontaminate.find_leaks(odd, none.withColumnRenamed("doc_id", "item_id")).collect() == []
