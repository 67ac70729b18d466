"""Benchmark decontamination (operator 10) by template canonicalisation.

A text becomes a sequence of template words: numbers, names (capitalised words inside a sentence) and units are replaced by typed
placeholders, other words are lower-cased. Windows of `window` template words are hashed and joined with the benchmark's. Where
windows meet, the run is extended word by word, and the replaced values are checked: one benchmark value must stand for one
document value and the other way round, so a question with other numbers is caught and a chance overlap of templates is not.

The benchmark's windows go to every task as a sorted table of at most `block_windows` hashes. A larger benchmark is taken in
blocks of that size, each a pass over the documents, so what is broadcast never grows.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import slices, text_of

_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n%$€£°]").findall
UNITS = frozenset("mm cm m km g kg mg t l ml s ms h min hz khz mhz kb mb gb tb w kw v a k c f mph kmh inch inches foot feet yard yards mile miles ounce ounces pound pounds ton tons metre metres meter meters kilometre kilometres kilometer kilometers gram grams kilogram kilograms litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars euro euros cent cents usd eur gbp % $ € £ °".split()) - {"a", "c", "f", "h", "k", "l", "m", "s", "t", "v", "w", "g"}
LITERAL, NUMBER, UNIT, CAPITAL, END = range(5)
_SLOT = {NUMBER: "\0n", UNIT: "\0u", CAPITAL: "\0c"}
_P = np.uint64(0x9E3779B97F4A7C15)


def _kind(token: str) -> tuple[int, str]:
    low = token.lower()
    if token in ".!?\n":
        return END, ""
    if token[0].isdigit():
        return NUMBER, low
    if low in UNITS:
        return UNIT, low
    return (CAPITAL, low) if token[0].isupper() else (LITERAL, low)


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def template(text: str) -> tuple[list[str], list[str]]:
    """(template words, the values behind them)."""
    words, values, begin = [], [], True
    for token in _TOKEN(text):
        kind, low = _kind(token)
        if kind == END:
            begin = True
            continue
        words.append(low if kind == LITERAL or kind == CAPITAL and begin else _SLOT[kind])
        values.append(low)
        begin = False
    return words, values


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _P + word_hashes[j : j + m]
        return out ^ (out >> np.uint64(29))


def runs(words: list[str], values: list[str], item_words: list[str], item_values: list[str], starts: list[tuple[int, int]]) -> tuple[int, int]:
    """(words, slots) of the longest run that holds one of starts (document word, item word), with templates equal and slots consistent.

    A run is extended to both sides while templates agree and each benchmark value keeps one partner. A benchmark name that
    opens a sentence in one text and not in the other agrees when the word is the same.
    """
    best, done = (0, 0), set()
    for i, j in sorted(starts):
        if (i - j, i) in done:
            continue
        there: dict = {}
        back: dict = {}

        def fits(a: int, b: int) -> bool:
            x, y = words[a], item_words[b]
            if x != y:
                return values[a] == item_values[b]
            if x[0] != "\0":
                return True
            u, v = (x, item_values[b]), (x, values[a])
            return there.setdefault(u, v) == v and back.setdefault(v, u) == u

        a, b = i, j
        while a < len(words) and b < len(item_words) and fits(a, b):
            done.add((i - j, a))
            a, b = a + 1, b + 1
        c, d = i - 1, j - 1
        while c >= 0 and d >= 0 and fits(c, d):
            c, d = c - 1, d - 1
        if a - c - 1 > best[0]:
            best = a - c - 1, sum(w[0] == "\0" for w in words[c + 1 : a])
    return best


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, enough: int = 13, share: float = 0.5, min_literal: int = 3, min_item_words: int = 4, block_windows: int = 1_000_000) -> DataFrame:
    """(id_col, item_col, matched_words long, item_words long, slots long): documents that hold a passage of a benchmark item.

    A pair is reported if a consistent run covers `enough` words, or `share` of the item's words (at least one window). Items of
    fewer than `window` words are matched whole; those of fewer than min_item_words, or windows with fewer than min_literal words
    that aren't placeholders, are too general and match nothing. Null or empty texts on either side match nothing; null ids stay
    null; repeated rows give repeated pairs; an empty table gives no pair; other columns are ignored.
    """
    kind = benchmark.select(item_col).schema[0].dataType.simpleString()
    out = None
    for rows in _blocks(benchmark, item_col, item_text_col, block_windows):
        part = _against(docs, rows, id_col, text_col, item_col, kind, window, enough, share, min_literal, min_item_words)
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 8, enough: int = 13, share: float = 0.5, min_literal: int = 3, min_item_words: int = 4, block_windows: int = 1_000_000) -> DataFrame:
    """docs without the rows in which find_leaks sees a passage; all columns of docs, nothing else.

    A row is judged where it is read, so nothing is shuffled; each block of the benchmark filters what the blocks before it left.
    Null or empty texts stay, rows are judged by their text alone, an empty table gives an empty one.
    """
    for rows in _blocks(benchmark, item_col, item_text_col, block_windows):
        docs = _against(docs, rows, None, text_col, item_col, "", window, enough, share, min_literal, min_item_words)
    return docs


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_windows: int):
    """The benchmark's rows (item, t) in blocks of about block_windows words."""
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text_col).alias("t"))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("t", r"\s+"))), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // block_windows))
    for b in range(blocks):
        yield items.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b).toArrow().to_pylist()


def _against(docs, rows, id_col, text_col, item_col, item_kind, window, enough, share, min_literal, min_item_words) -> DataFrame:
    """The leaks of one block of items, or, where id_col is None, the rows of docs that have none."""
    items, at = [], []
    for r in rows:
        words, values = template(r["t"])
        if len(words) < min_item_words:
            continue
        n = min(window, len(words))
        hashes = window_hashes(np.array([_hash(w) for w in words], np.uint64), n)
        for j, h in enumerate(hashes.tolist()):
            if sum(w[0] != "\0" for w in words[j : j + n]) >= min(min_literal, n):
                at.append((h, n, len(items), j))
        items.append((r["item"], words, values))
    at.sort()
    text_at = docs.columns.index(text_col) if id_col is None else 1
    shared = docs.sparkSession.sparkContext.broadcast((items, np.array([x[0] for x in at], np.uint64), np.array([x[1:] for x in at], np.int64).reshape(-1, 3)))

    def run(batches):
        items, hashes, places = shared.value
        lengths = sorted(set(places[:, 0].tolist()))
        maybe = np.zeros(1 << 20, bool)
        maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        number: dict[str, int] = {}
        kinds: list[int] = []
        own: list[int] = []
        slot = {k: np.uint64(_hash(w)) for k, w in _SLOT.items()}

        def learn(token: str) -> int:
            kind, low = _kind(token)
            kinds.append(kind)
            own.append(int(slot[kind]) if kind in (NUMBER, UNIT) else _hash(low))
            return number.setdefault(token, len(kinds) - 1)

        for batch, texts in slices(batches, text_at):
            ids, found = batch.column(0), defaultdict(lambda: defaultdict(list))
            if len(number) > 200_000:
                number, kinds, own = {}, [], []
            tokens = [_TOKEN(t) for t in texts]
            coded = [np.fromiter([number[x] if x in number else learn(x) for x in ts], np.int64, len(ts)) for ts in tokens]
            flat = np.concatenate([np.zeros(0, np.int64), *coded])
            owner = np.repeat(np.arange(len(texts)), [len(c) for c in coded])
            kind, word = np.array(kinds or [0], np.int8)[flat], np.array(own or [0], np.uint64)[flat]
            first = np.ones(len(flat), bool)
            first[1:] = (kind[:-1] == END) | (owner[1:] != owner[:-1])
            word = np.where((kind == CAPITAL) & ~first, slot[CAPITAL], word)
            keep = kind != END
            word, owner = word[keep], owner[keep]
            starts = np.searchsorted(owner, np.arange(len(texts)))
            for n in lengths:
                w = window_hashes(word, n)
                hit = np.flatnonzero(maybe[(w >> np.uint64(44)).astype(np.int64)])
                hit = hit[owner[hit] == owner[hit + n - 1]]
                lo, hi = np.searchsorted(hashes, w[hit], "left"), np.searchsorted(hashes, w[hit], "right")
                for i, a, z in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    d = int(owner[i])
                    for m, item, j in places[a:z].tolist():
                        if m == n:
                            found[d][item].append((i - int(starts[d]), j))
            out = []
            for d, hits in found.items():
                words, values = template(texts[d])
                for item, where in hits.items():
                    key, item_words, item_values = items[item]
                    got, slots = runs(words, values, item_words, item_values, where)
                    least = min(window, len(item_words))
                    if got >= min(enough, max(least, int(np.ceil(share * len(item_words))))):
                        out.append((d, key, got, len(item_words), slots))
            if id_col is None:
                stays = np.ones(len(texts), bool)
                stays[[x[0] for x in out]] = False
                yield batch.filter(pa.array(stays))
                continue
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in out], pa.int64())), pa.array([x[1] for x in out], _arrow(item_kind)), *(pa.array([x[k] for x in out], pa.int64()) for k in (2, 3, 4))], names=[id_col, item_col, "matched_words", "item_words", "slots"])

    if id_col is None:
        return docs.mapInArrow(run, docs.schema)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, `{item_col}` {item_kind}, matched_words long, item_words long, slots long")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}[kind]
