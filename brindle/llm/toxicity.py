"""Toxicity by a chain of linear models (operator 1).

Categories are predicted one after the other; the model of a later category also sees the probabilities of the earlier ones. In
training these come from out-of-fold predictions (each row's from models that did not see it), so later models learn from
probabilities as honest as those they meet in use.

Features are whether a text holds a word, a run of signs, or a five-character piece of a word, and whether two or four different
words share such a piece (a stem that many words of an abusive text share, and by chance one of a clean text). The most telling ones
of each category are chosen by the likelihood ratio of their counts. Words count once a text: repeating one changes nothing.
The chain is fitted on the driver on at most `sample_rows` labelled documents (a bound that does not grow). Scoring is one
pass over all documents with a broadcast of at most `n_features` weights a category.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import slices, text_of

_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+").findall


def features_of(word: str) -> tuple[str, ...]:
    """The word and its five-character pieces, the word's ends marked."""
    held = f"^{word}$"
    return (held, *(held[i : i + 5] for i in range(len(held) - 4))) if word[0].isalpha() and len(word) > 3 else (held,)


def words_of(text: str) -> set[str]:
    return set(_TOKEN(text.lower()))


#: A piece is a feature of its own where so many different words of the text share it.
SHARED = (2, 4)


def shared_name(piece: str, n: int) -> str:
    return f"{piece}\0{n}"


def all_features(words: Iterable[str]) -> set[str]:
    """Every feature of a text of these different words."""
    held = Counter(f for w in words for f in set(features_of(w)))
    return {*held, *(shared_name(f, n) for f, c in held.items() if c > 1 for n in SHARED if c >= n)}


@dataclass
class Chain:
    """features: name -> column. weights[j]: of the features, then of the probabilities of categories before j; bias[j]."""

    categories: tuple[str, ...]
    features: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)

    def columns(self, texts: Iterable[str], known: dict[str, tuple]) -> list[np.ndarray]:
        """The columns of each text's features. known: a cache of the pieces of each word that the chain asks for, bounded by the caller."""
        names, out = self.features, []
        if not hasattr(self, "_asked"):
            self._asked = {f.partition("\0")[0] for f in names}
        for text in texts:
            held: Counter = Counter()
            for w in words_of(text):
                got = known.get(w)
                if got is None:
                    got = known[w] = tuple(f for f in set(features_of(w)) if f in self._asked)
                if got:
                    held.update(got)
            found = [names[x] for f, c in held.items() for x in (f, *(shared_name(f, n) for n in SHARED if c >= n)) if x in names]
            out.append(np.array(sorted(found), np.int64))
        return out

    def predict(self, active: list[np.ndarray]) -> np.ndarray:
        """Probabilities, a column a category, of rows given by the columns of their features."""
        out, n = np.zeros((len(active), len(self.categories))), len(self.features)
        for j, (w, b) in enumerate(zip(self.weights, self.bias, strict=True)):
            z = np.array([w[a].sum() for a in active]) + b + out[:, :j] @ w[n:]
            out[:, j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by damped Newton steps (the bias is not penalised). One class only: a constant."""
    n, d = x.shape
    if not n or y.min() == y.max():
        return np.zeros(d), (12.0 if n and y[0] else -12.0)
    full = np.hstack([x, np.ones((n, 1))])
    w, held = np.zeros(d + 1), np.append(np.full(d, ridge), 1e-6)
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = full @ w
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (held * w * w).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        slope = full.T @ (p - y) + held * w
        curve = (full * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ full
        step, size = np.linalg.solve(curve + np.diag(held + 1e-9), slope), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-5:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 6000, n_features: int = 350, least: int = 3, telling: float = 8.0, folds: int = 5) -> Chain:
    """Chain over `categories`, columns of labels with 0 or 1, in that order.

    Sample: of the labelled ids, those of smallest hash, half with the last category and half without. Rows of labels with a null id or
    label are left out; of repeated ids the greatest labels count. Without labelled rows, or where a category has one class only, the
    model is a constant (0 where nothing is known), which rejects nothing.
    """
    spark = docs.sparkSession
    chain = Chain(tuple(categories))
    clean = labels.select(F.col(id_col).alias("i"), *(F.col(c).cast("int").alias(f"y{j}") for j, c in enumerate(categories))).dropna()
    clean = clean.groupBy("i").agg(*(F.max(f"y{j}").alias(f"y{j}") for j in range(len(categories))))
    last = f"y{len(categories) - 1}"
    odds = clean.groupBy(last).count().collect()
    odds = {r[last]: r["count"] for r in odds}
    half = [clean.where(F.col(last) == v).orderBy(F.xxhash64("i"), "i").limit(sample_rows // 2) for v in (0, 1)]
    chosen = half[0].unionAll(half[1])  # sample_rows rows at most: safe to broadcast
    texts = docs.select(F.col(id_col).alias("i"), text_of(text_col).alias("t"))
    sample = texts.join(F.broadcast(chosen), "i").select("i", "t", *(f"y{j}" for j in range(len(categories)))).coalesce(6).persist()
    k = len(categories)

    def count(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            rows = batch.to_pydict()
            for i, t in enumerate(rows["t"]):
                y = [1, *(rows[f"y{j}"][i] for j in range(k))]
                for f in all_features(words_of(t)):
                    got = seen.get(f)
                    if got is None:
                        seen[f] = y[:]
                    else:
                        for a in range(k + 1):
                            got[a] += y[a]
        names = list(seen)
        for a in range(0, len(names), 20_000):
            part = names[a : a + 20_000]
            yield pa.RecordBatch.from_pydict({"f": part, **{f"n{j}": pa.array([seen[f][j] for f in part], pa.int64()) for j in range(k + 1)}})

    schema = ", ".join(["f string", *(f"n{j} long" for j in range(k + 1))])
    sums = sample.mapInArrow(count, schema).groupBy("f").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(k + 1))).where(F.col("n0") >= least)
    totals = sample.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(f"y{j}"), F.lit(0)) for j in range(k))).first()
    total = np.array([float(x) for x in totals])
    own = most_telling(sums, total, k, n_features, telling) if total[0] else [[]] * k
    chain.features = {f: c for c, f in enumerate(sorted(set().union(*own)))}
    shared = spark.sparkContext.broadcast(Chain(chain.categories, chain.features))

    def columns(batches):
        names = shared.value
        for batch in batches:
            found = [x.tolist() for x in names.columns(batch.column("t").to_pylist(), {})]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *(batch.column(f"y{j}") for j in range(k)), batch.column("i").cast(pa.string())], names=["a", *(f"y{j}" for j in range(k)), "i"])

    rows = sample.mapInArrow(columns, ", ".join(["a array<int>", *(f"y{j} int" for j in range(k)), "i string"])).toArrow().to_pydict()
    sample.unpersist()
    order = sorted(range(len(rows["i"])), key=lambda r: (rows["i"][r], len(rows["a"][r])))
    active = [np.array(rows["a"][r], np.int64) for r in order]
    x = np.zeros((len(active), len(chain.features)))
    for r, a in enumerate(active):
        x[r, a] = 1
    fold = np.arange(len(active)) % folds
    early = np.zeros((len(active), 0))
    for j in range(k):
        y = np.array([rows[f"y{j}"][r] for r in order], np.float64)
        mine = np.array([chain.features[f] for f in own[j]], np.int64)
        full = np.hstack([x[:, mine], early])  # a model sees the features of its own category and what was said of the earlier ones
        seen, b = fit_logistic(full, y)
        w = np.zeros(x.shape[1] + early.shape[1])
        w[mine], w[x.shape[1] :] = seen[: len(mine)], seen[len(mine) :]
        if j == k - 1 and 0 < y.sum() < len(y):  # the sample holds as many rows with as without; the bias tells of all labelled rows
            b += np.log(odds[1] / odds[0]) - np.log(y.sum() / (len(y) - y.sum()))
        chain.weights.append(w)
        chain.bias.append(b)
        if j < k - 1:
            held = np.zeros(len(active))
            for f in range(folds):
                out, inn = fold == f, fold != f
                if out.any():
                    fw, fb = fit_logistic(full[inn], y[inn])
                    held[out] = 1 / (1 + np.exp(-np.clip(full[out] @ fw + fb, -40, 40)))
            early = np.hstack([early, held[:, None]])
    return chain


def most_telling(sums: DataFrame, total: np.ndarray, k: int, n_features: int, telling: float) -> list[list[str]]:
    """For each category the names of its n_features most telling features, of a log likelihood ratio of `telling` at least; ties go to the smaller name."""
    out: list[list[str]] = []
    n, t = F.col("n0").cast("double"), float(total[0])
    safe = lambda c, e: F.when((c > 0) & (e > 0), c * F.log(c / e)).otherwise(0.0)
    scored = sums
    for j in range(k):
        pos, c = float(total[1 + j]), F.col(f"n{1 + j}").cast("double")
        score = safe(c, n / t * pos) + safe(n - c, n / t * (t - pos)) + safe(pos - c, (1 - n / t) * pos) + safe(t - pos - n + c, (1 - n / t) * (t - pos))
        scored = scored.withColumn(f"s{j}", score)
    scored = scored.persist()
    for j in range(k):
        out.append(sorted(r["f"] for r in scored.where(F.col(f"s{j}") >= telling).orderBy(F.desc(f"s{j}"), "f").limit(n_features).select("f").collect()))
    scored.unpersist()
    return out


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, p_<category> double ...) of every whole text.

    Null or empty text scores as one without features. Null ids stay null; repeated rows are repeated; an empty table gives an empty
    one; other columns are ignored.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches):
        chain, known = shared.value, {}
        for batch, texts in slices(batches, 1):
            p = chain.predict(chain.columns(texts, known))
            if len(known) > 250_000:
                known = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, j], pa.float64()) for j in range(len(names)))], names=[id_col, *names])

    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"`{n}` double" for n in names)]))


def drop_toxic(docs: DataFrame, chain: Chain, category: str | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose probability of category (the last one) reaches threshold; all columns of docs, nothing else.

    The text is scored where it is read, so nothing is shuffled. A null text has no features and stays unless the bias alone rejects.
    """
    category = category or chain.categories[-1]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    j = chain.categories.index(category)
    at = docs.columns.index(text_col)

    def run(batches):
        chain, known = shared.value, {}
        for batch, texts in slices(batches, at):
            active = chain.columns(texts, known)
            if len(known) > 250_000:
                known = {}
            yield batch.filter(pa.array(chain.predict(active)[:, j] < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
