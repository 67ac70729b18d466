"""Removal of byte strings that an earlier document holds (operator 4), by suffix arrays over the places where texts may meet.

Every byte covered by a `length`-byte string that also starts in a document with a smaller id goes. A suffix array of the whole corpus
would shuffle a row a byte, so a filter first finds where texts can agree at all:

1. Each window of `length` bytes picks its smallest 16-byte gram (leftmost on ties), its anchor. Equal windows pick equal anchors at equal
   offsets, and one gram in about eighteen is an anchor. Hashes of anchors are packed and dealt; windows whose anchor no other document
   has are unique. A hash decides nothing but that a window is looked at: a false meeting costs work and changes no result. A gram that
   several documents of a slice share is known to be shared there and travels as two rows a slice (as none once it is known as hot).
2. The other windows, cut to runs of one anchor, are dealt by anchor with the bytes they cover. What the same task has met in a smaller
   document with equal bytes goes at once, so a passage of a third of all documents is a row a task.
3. Each part gets a suffix array by two-stage sorting: only suffixes smaller than their successors are sorted directly, the rest are
   induced by a scan of the buckets. Common prefixes of adjacent suffixes give the runs of equal windows, and all but those of the
   smallest document go. Parts are sized by bytes. A part that a hot gram blows up beyond `part_bytes` is never held: its windows become
   rows, Spark's external sort puts them in suffix order, and adjacent rows are compared in a stream, with the same result.

Spans go back to the texts packed by buckets of the id; texts and spans of a bucket meet in one stream, spans first. Everything is judged
on the input texts, and every removal by comparing bytes. Work is done in slices of about a million bytes, long texts in pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import release, stored, text_of

GRAM, SLICE, PIECE, WITNESS = 16, 1 << 20, 1 << 18, 0xFFFFFFFF
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_HOT, _MOST_HOT, _MOST_SEEN = 16, 1 << 16, 1 << 16


def picked(raw: bytes, length: int) -> np.ndarray:
    """Hash of the gram that each window of a text picks. Long texts are taken in pieces."""
    if len(raw) < length:
        return np.zeros(0, np.uint64)
    out = [_picked(raw[at : at + PIECE + length - 1], length) for at in range(0, len(raw) - length + 1, PIECE)]
    return out[0] if len(out) == 1 else np.concatenate(out)


def _picked(raw: bytes, length: int) -> np.ndarray:
    n = len(raw)
    m, wide = n - GRAM + 1, length - GRAM + 1
    with np.errstate(over="ignore"):
        eight = np.ndarray((n - 7,), "<u8", raw, strides=(1,))
        h = eight[:m] * _A
        h ^= h >> np.uint64(32)
        h += eight[8 : 8 + m]
        h *= _B
        h ^= h >> np.uint64(29)
        h *= _C
        h ^= h >> np.uint64(32)
    size = 1
    while size * 2 <= wide:
        h, size = np.minimum(h[size:], h[:-size]), size * 2
    rest = wide - size
    return np.minimum(h[rest:], h[:-rest]) if rest else h


def runs_of(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k, gram hash, first window, windows) of the runs of windows of texts[k] that pick the same gram. The texts are worked on as one;
    windows that cross from one to the next are left out."""
    h = picked(b"".join(texts), length)
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    inside = np.zeros(len(h) + 1, np.int8)
    some = sizes >= length
    inside[begin[some]] = 1
    np.subtract.at(inside, begin[some] + sizes[some] - length + 1, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, bool)
    new[begin[some]] = True
    new[1:] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(h)))
    at, n = at[inside[at]], n[inside[at]]
    k = np.searchsorted(begin, at, "right") - 1
    return k, h[at], at - begin[k], n


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, overlapping or touching ones united."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    rank = np.cumsum(np.concatenate(([False], doc[1:] != doc[:-1])))
    base = rank * (int(end.max()) + 2)  # a document's ends lie above those of the documents before it
    reach = np.maximum.accumulate(base + end)
    new = np.concatenate(([True], base[1:] + start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - base)[np.append(first[1:], len(doc)) - 1]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array by significance: high planes are nearly constant, so compressed blocks shrink."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), -1).T).tobytes()


def _unplanes(raw: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1", n * size).reshape(size, n).T).view(kind).reshape(n)


def _pack(columns: tuple[np.ndarray, ...]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(map(_planes, columns))


def _unpack(raw: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(_unplanes(raw[at : at + size], k, n))
        at += size
    return out


_SPAN, _ROW = ("<i8", "<i4", "<i4"), ("<u4", "<i8", "<i4", "<u4")


def sorted_directly(text: np.ndarray, where: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of `length` bytes from each: by eight bytes, then by eight more of those that still tie."""
    eight = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,))
    key = eight[where].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    where, key = where[order], key[order]
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(where) else key.astype(np.int64)
    for o in range(8, length, 8):
        ties = np.bincount(group, minlength=1)[group] > 1 if len(where) else np.zeros(0, bool)
        at = np.flatnonzero(ties)
        if not len(at):
            break
        key = eight[where[at] + o].astype(np.uint64)
        order = np.lexsort((key, group[at]))
        where[at] = where[at][order]
        key = key[order]
        new = np.zeros(len(where), bool)
        new[at[1:]] = key[1:] != key[:-1]
        new[1:] |= group[1:] != group[:-1]
        group = np.cumsum(new)
    return where


def two_stage(text: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Positions first[k]..last[k] of all k (and a few behind them) in the order of at least `length` bytes from each.

    text: bytes with a smaller one before a greater one somewhere after each last[k], and `length` + 16 bytes of padding. Of the two
    stages, the first sorts the positions smaller than their successor by their bytes. The second induces the rest: in a bucket (all
    positions of one first byte) those greater than their successor come first, in the order of their successors. Reading the
    order from the left, each position puts its greater predecessor on the next free place of the predecessor's bucket. A bucket is
    read in waves: what is placed while a wave is read comes behind all of it, so a whole wave is read at once.
    """
    n = len(text)
    if not len(first):
        return np.zeros(0, np.int64)
    differs = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    more = np.append(text, 0)
    small = np.repeat(more[differs] < more[differs + 1], np.diff(differs, prepend=-1))  # the last of a run of equal bytes decides for the run
    smalls = np.flatnonzero(small)
    last = smalls[np.searchsorted(smalls, last)]  # up to a position that is sorted directly, so every other has its successor here
    cover = np.zeros(n + 1, np.int8)
    cover[first] += 1
    cover[last + 1] -= 1
    asked = np.cumsum(cover[:-1], dtype=np.int8) > 0
    induced = np.append(asked & ~small, False)  # at -1: there is no predecessor
    ordered = sorted_directly(text, np.flatnonzero(asked & small), length)
    begin = np.searchsorted(text[ordered], np.arange(257))
    placed: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def place(wave: np.ndarray) -> None:
        before = wave - 1
        before = before[induced[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            byte, before = byte[order], before[order]
            cuts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1], [True])))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                placed[byte[a]].append(before[a:b])

    for c in range(256):
        while placed[c]:
            wave = placed[c][0] if len(placed[c]) == 1 else np.concatenate(placed[c])
            placed[c] = []
            if len(wave) < 8:  # a long run of one byte: waves of a few, read one by one
                line, k = wave.tolist(), 0
                while k < len(line):
                    j = line[k] - 1
                    if induced[j]:
                        if text[j] == c:
                            line.append(j)
                        else:
                            placed[text[j]].append(np.array([j]))
                    k += 1
                out.append(np.array(line))
                continue
            out.append(wave)
            place(wave)
        wave = ordered[begin[c] : begin[c + 1]]
        if len(wave):
            out.append(wave)
            place(wave)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes that each position in the order has in common with the one before it, counted up to `length`; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    eight = np.ndarray((len(text) - 7,), "<u8", text.tobytes(), strides=(1,))
    at = np.arange(1, len(order))
    for o in range(0, length, 8):
        x = eight[order[at] + o] ^ eight[order[at - 1] + o]
        same = x == 0
        y = x[~same]
        out[at[~same]] = o + np.bitwise_count((y & (~y + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
        at = at[same]
    out[at] = length
    return np.minimum(out, length)


def joined(sizes: np.ndarray, flat: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts that follow one another in flat, as one text in which each ends in a smaller and a greater byte; where each begins."""
    first = np.cumsum(sizes + 2) - sizes - 2
    text = np.zeros(len(flat) + 2 * len(sizes) + length + 16, np.uint8)
    text[np.arange(len(flat)) + np.repeat(2 * np.arange(len(sizes)), sizes)] = flat
    text[first + sizes + 1] = 1
    return text, first


def repeated(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of bytes covered by a window that a context of a smaller document holds too. Context k has sizes[k] bytes of flat, and
    begins at starts[k] of docs[k]."""
    text, first = joined(sizes, flat, length)
    order = two_stage(text, first, first + sizes - length, length)
    owner = np.searchsorted(first, order, "right") - 1
    inside = order - first[owner] <= sizes[owner] - length
    order, owner = order[inside], owner[inside]
    if not len(order):
        return merged(docs[:0], starts[:0], starts[:0])
    heads = np.flatnonzero(common_prefixes(text, order, length) < length)
    doc = docs[owner]
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(doc))))
    gone = doc > least
    owner, order = owner[gone], order[gone]
    at = starts[owner] + order - first[owner]
    return merged(doc[gone], at, at + length)


_SCHEMA = "part int, kind int, blob binary"
ANCHORS, ASKED, SPANS, CONTEXTS, ROWS = range(5)


def _rows(part: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return ((doc ^ (doc.view(np.uint64) >> np.uint64(32)).view(np.int64)) % buckets).astype(np.int32)


def _bucket(i: Column, buckets: int) -> Column:
    """bucket_of as a column."""
    return F.pmod(i.bitwiseXOR(F.shiftrightunsigned(i, 32)), F.lit(buckets)).cast("int")


def _by_bucket(kind: int, doc: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Intervals packed by the bucket of their document."""
    part = bucket_of(doc.astype(np.int64), buckets)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], (doc[order].astype("<i8"), a[order].astype("<i4"), b[order].astype("<i4"))
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
    pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return _rows(part[cuts[:-1]].tolist(), kind, [_pack(tuple(x[i:j] for x in columns)) for i, j in pairs])


def _text_slices(batches):
    """Lists of (id, bytes) of Arrow batches of (id, text), of about SLICE bytes."""
    held, size = [], 0
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                raw = text.encode()
                if held and size + len(raw) > SLICE:
                    yield held
                    held, size = [], 0
                held.append((doc, raw))
                size += len(raw)
    if held:
        yield held


def _dealt(parts: int, buckets: int, length: int):
    """Step 1 on Arrow batches of (id, text): anchors packed by part, and windows that are known to be shared, by bucket."""

    def run(batches):
        hot = np.zeros(0, np.uint64)
        for held in _text_slices(batches):
            k, h, first, n = runs_of([raw for _, raw in held], length)
            if not len(h):
                continue
            doc, last = np.array([d for d, _ in held], np.int64)[k], first + n - 1
            order = np.lexsort((doc, h))
            h, doc, first, last = h[order], doc[order], first[order], last[order]
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.append(heads[1:], len(h))
            known = np.isin(h[heads], hot) if len(hot) else np.zeros(len(heads), bool)
            shared = known | (doc[heads] < doc[ends - 1])
            inside = np.repeat(shared, ends - heads)
            if inside.any():
                d, a, b = merged(doc[inside], first[inside], last[inside] + 1)
                yield _by_bucket(ASKED, d, a, b, buckets)
            tell = np.flatnonzero(shared & ~known)  # two witnesses tell the other slices
            witness = np.concatenate((heads[tell], ends[tell] - 1))
            send = np.concatenate((np.flatnonzero(~inside), witness))
            wide = (last - first).astype("<u4")
            wide[witness] = WITNESS
            if len(hot) < _MOST_HOT:
                hot = np.union1d(hot, h[heads[tell]][(ends - heads)[tell] >= _HOT])
            part = (h[send] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            send, part = send[order], part[order]
            columns = ((h[send] // np.uint64(parts)).astype("<u4"), doc[send].astype("<i8"), first[send].astype("<i4"), wide[send])
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
            pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            yield _rows(part[cuts[:-1]].tolist(), ANCHORS, [_pack(tuple(x[i:j] for x in columns)) for i, j in pairs])

    return run


def _parts(batches):
    """(part, kind, blobs) of neighbouring rows of the same part and kind; a row that is not of anchors comes alone."""
    now, blobs = None, []
    for batch in batches:
        for p, k, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if (p, k) != now or k != ANCHORS:
                if blobs:
                    yield *now, blobs
                now, blobs = (p, k), []
            blobs.append(b)
    if blobs:
        yield *now, blobs


def _shared(buckets: int):
    """Parts of anchors to the windows of those that several documents hold, by bucket; windows known to be shared pass."""

    def run(batches):
        for part, kind, blobs in _parts(batches):
            if kind == ASKED:
                yield _rows([part], ASKED, blobs)
                continue
            h, doc, first, wide = map(np.concatenate, zip(*(_unpack(b, _ROW) for b in blobs), strict=True))
            order = np.lexsort((doc, h))
            h, doc, first, wide = h[order], doc[order], first[order], wide[order]
            heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            ends = np.append(heads[1:], len(h))
            ask = np.repeat(doc[heads] < doc[ends - 1], ends - heads) & (wide != WITNESS)
            if ask.any():
                yield _by_bucket(ASKED, doc[ask], first[ask], first[ask] + wide[ask].astype(np.int64) + 1, buckets)

    return run


def _with_texts(batches, columns: int):
    """(intervals or None, rows of texts) of batches (bucket, kind, blob, ...) sorted by bucket and kind: intervals of the bucket come first."""
    now, blobs, held = None, [], None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            some = batch.slice(i, 256)
            for row in zip(*(some.column(c).to_pylist() for c in range(columns)), strict=True):
                if row[0] != now:
                    now, blobs, held = row[0], [], None
                if row[1] == 0:
                    blobs.append(row[2])
                    continue
                if blobs:
                    doc, a, b = map(np.concatenate, zip(*(_unpack(x, _SPAN) for x in blobs), strict=True))
                    held, blobs = merged(doc, a, b), []
                yield held, row


def _of(held, doc: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of one document."""
    if held is None or doc is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = slice(*np.searchsorted(held[0], [doc, doc + 1] if doc < (1 << 63) - 1 else [doc, doc], "left").tolist())
    if doc == (1 << 63) - 1:
        at = slice(at.start, len(held[0]))
    return held[1][at], held[2][at]


def _contexts(parts: int, buckets: int, length: int):
    """Step 2 on a stream of asked windows and texts: contexts by part, and spans by bucket of what equals a context that the task has met in a
    smaller document."""

    def told(segments: list[tuple[int, int, bytes]], young: dict[bytes, int], old: dict[bytes, int]):
        docs, starts = (np.array([s[c] for s in segments], np.int64) for c in (0, 1))
        raws = [s[2] for s in segments]
        k, h, first, n = runs_of(raws, length)
        sizes, flat = np.array([len(x) for x in raws], np.int64), b"".join(raws)
        begin, size = (np.cumsum(sizes) - sizes)[k] + first, n + length - 1
        doc, start = docs[k], starts[k] + first
        gone = np.zeros(len(k), bool)
        for j, (d, a, b) in enumerate(zip(doc.tolist(), begin.tolist(), (begin + size).tolist(), strict=True)):
            if b - a < 4 * length:
                context = flat[a:b]
                least = young.get(context)
                if least is None:
                    young[context] = min(d, old.get(context, d))
                    least = young[context]
                if least < d:
                    gone[j] = True
                elif least > d:
                    young[context] = d
        if gone.any():
            yield _by_bucket(SPANS, *merged(doc[gone], start[gone], start[gone] + size[gone]), buckets)
        left = np.flatnonzero(~gone)
        part = (h[left] % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, left = part[order], left[order]
        doc, start, size, begin = doc[left], start[left], size[left], begin[left]
        ends = np.cumsum(size)
        content = np.frombuffer(flat, "u1")[np.repeat(begin - ends + size, size) + np.arange(int(size.sum()))]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
        blobs, edges = [], np.append(0, ends)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            blobs.append(_packed_contexts(doc[i:j], start[i:j], size[i:j], content[edges[i] : edges[j]].tobytes()))
        yield _rows(part[cuts[:-1]].tolist(), CONTEXTS, blobs)

    def run(batches):
        segments: list[tuple[int, int, bytes]] = []
        young: dict[bytes, int] = {}
        old: dict[bytes, int] = {}
        size = 0
        for held, (_, _, _, doc, text) in _with_texts(batches, 5):
            a, b = _of(held, doc)
            if not len(a):
                continue
            raw = text.encode()
            for first, end in zip(a.tolist(), b.tolist(), strict=True):
                for at in range(first, end, PIECE):  # windows at..end - 1
                    segment = raw[at : min(end, at + PIECE) + length - 1]
                    if size + len(segment) > SLICE and segments:
                        yield from told(segments, young, old)
                        segments, size = [], 0
                        if len(young) > _MOST_SEEN:
                            young, old = {}, young
                    segments.append((doc, at, segment))
                    size += len(segment)
        if segments:
            yield from told(segments, young, old)

    return run


def _packed_contexts(doc: np.ndarray, start: np.ndarray, size: np.ndarray, content: bytes) -> bytes:
    raw = _pack((doc.astype("<i8"), start.astype("<i4"), size.astype("<i4"))) + content
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _contexts_of(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, sizes, bytes one after the other) of packed contexts."""
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    doc, start, size = _unpack(raw, _SPAN)
    return doc, start.astype(np.int64), size.astype(np.int64), np.frombuffer(raw, "u1", offset=8 + 16 * len(doc))


def _compared(buckets: int, length: int, part_bytes: int):
    """Step 3 on parts of contexts: spans by bucket; spans that are known pass. Of a part beyond part_bytes the contexts themselves (ROWS)."""

    def compare(blobs):
        found = repeated(*map(np.concatenate, zip(*map(_contexts_of, blobs), strict=True)), length)
        if len(found[0]):
            yield _by_bucket(SPANS, *found, buckets)

    def run(batches):
        now, blobs, size, over = None, [], 0, False
        for batch in batches:
            for p, k, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if k == SPANS:
                    yield _rows([p], SPANS, [b])
                    continue
                if p != now:
                    if blobs:
                        yield from compare(blobs)
                    now, blobs, size, over = p, [], 0, False
                blobs.append(b)
                size += int.from_bytes(b[:8], "little")
                if over or size > part_bytes:
                    yield _rows([p] * len(blobs), ROWS, blobs)
                    blobs, over = [], True
        if blobs:
            yield from compare(blobs)

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                docs, starts, sizes, flat = _contexts_of(blob)
                n = sizes - length + 1
                raw = flat.tobytes()
                begin = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(begin))
                for i in range(0, len(begin), 20_000):
                    part = slice(i, i + 20_000)
                    yield pa.RecordBatch.from_arrays([pa.array([raw[o : o + length] for o in begin[part].tolist()], pa.binary()), pa.array(np.repeat(docs, n)[part], pa.int64()), pa.array(at[part], pa.int32())], names=["w", "i", "a"])

    return run


def _streamed(buckets: int, length: int):
    """Rows (w, i, a) in the order of w and i: spans of all but the smallest document of each w."""

    def run(batches):
        now = least = None
        for batch in batches:
            d: list[int] = []
            s: list[int] = []
            for w, i, a in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if w != now:
                    now, least = w, i
                elif i > least:
                    d.append(i)
                    s.append(a)
            if d:
                at = np.array(s, np.int64)
                yield _by_bucket(SPANS, *merged(np.array(d, np.int64), at, at + length), buckets)

    return run


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _met(spans: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind, blob, i, t, ...) of packed intervals (kind 0) and texts (kind 1), in a stream of buckets, intervals first."""
    rest = [c for c in texts.columns if c not in ("i", "t")]
    kinds = {f.name: f.dataType for f in texts.schema}
    packed = spans.select(F.col("part").alias("bucket"), F.lit(0).alias("kind"), "blob", *(F.lit(None).cast(kinds[c]).alias(c) for c in ("i", "t", *rest)))
    rows = texts.select(F.coalesce(_bucket(F.col("i"), buckets), F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).alias("bucket"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "i", "t", *rest)
    return packed.unionAll(rows).repartition("bucket").sortWithinPartitions("bucket", "kind")


def repeated_spans(texts: DataFrame, buckets: int, total: int, length: int = 50, part_bytes: int = 48 << 20) -> DataFrame:
    """(part, blob): intervals of bytes, packed by bucket of the id, covered by strings of `length` bytes that start in a document of
    smaller id. texts: (i long, t string), no null; total: their bytes. Intervals of a document may overlap."""
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} at least")
    parts = max(8, total // (4 << 20))
    long = texts.where(F.octet_length("t") >= length)
    dealt = long.mapInArrow(_dealt(parts, buckets, length), _SCHEMA)
    asked = dealt.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_shared(buckets), _SCHEMA).select("part", "blob")
    contexts = _met(asked, long, buckets).mapInArrow(_contexts(parts, buckets, length), _SCHEMA)
    done = stored(contexts.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_compared(buckets, length, part_bytes), _SCHEMA), "repeats")
    release(texts.sparkSession)
    rows = done.where(F.col("kind") == ROWS).select("blob").mapInArrow(_windows(length), "w binary, i long, a int")
    last = rows.repartition("w").sortWithinPartitions("w", "i").mapInArrow(_streamed(buckets, length), _SCHEMA)
    return done.where(F.col("kind") == SPANS).unionAll(last).select("part", "blob")


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = 48 << 20) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of every whole text, judged on the input.

    Ids are whole numbers. Null or empty text: no byte. Rows with a null id keep all and remove nothing elsewhere. Rows of one id don't
    remove from each other; if their texts differ, the one of smallest hash stands for the id and the others are kept whole. An empty
    table gives an empty one; other columns are ignored. part_bytes: what a task holds of one part of step 3.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    buckets = _prime(max(8, total // (4 << 20)))
    marks = rows.where("i is not null").groupBy("i").agg(F.min(F.xxhash64("t")).alias("x"), F.max(F.xxhash64("t")).alias("y")).where("x <> y").select("i", F.col("x").alias("keep"))
    if marks.limit(1).count():
        rows = rows.join(marks, "i", "left").select("i", "t", F.coalesce(F.xxhash64("t") == F.col("keep"), F.lit(True)).alias("stands"))
    else:
        rows = rows.withColumn("stands", F.lit(True))
    spans = repeated_spans(rows.where("stands and i is not null").select("i", "t"), buckets, total, length, part_bytes)

    def run(batches):
        out: list[list] = [[], [], [], [], [], []]
        size = 0

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["i", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

        for held, (_, _, _, doc, text, stands) in _with_texts(batches, 6):
            a, b = _of(held, doc if stands else None)
            raw, pieces, at = text.encode(), [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                pieces.append(raw[at:x])
                at = y
            kept = b"".join([*pieces, raw[at:]])
            for into, x in zip(out, (doc, len(raw), len(raw) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                into.append(x)
            size += len(kept)
            if size > SLICE or len(out[0]) >= 5000:
                yield flush()
                out, size = [[], [], [], [], [], []], 0
        if out[0]:
            yield flush()

    done = _met(spans, rows, buckets).mapInArrow(run, "i long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.col("i").cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
