"""Near-duplicate groups by chosen-path set similarity join (operator 5).

A document is the set of its word shingles. Documents of equal sets form a class, and classes are joined. Each class has a sketch of
`SKETCH` minwise tokens. A tree starts with all classes in one node; a node chooses one of the token places (two in a quarter of
the nodes, so 1/0.8 on average), and its members go to the children named by their tokens there. A pair of similarity 0.8 keeps
0.8 * 1.25 = 1 common child on average, so it goes on meeting however deep the tree gets, while others part. All nodes of
a level split at once; nodes of at most SMALL classes are compared exhaustively by their sketches, larger ones split again, at first
in three independent ways, without an end to the depth. Ten trees of their own random choices find a pair of similarity 0.8 with more
than 0.999 at the usual depth of three or four, and with about 0.9999 where nodes split ten levels further.

Classes with a candidate have their full sets at hand from then on, and it is counted how many of their elements no other has: pairs that
can't reach the similarity for that, or for their sizes, are left out, exactly. Candidates are confirmed on full sets, in rounds between which linked classes are one component; no round asks for pairs within a component,
or again for a pair that failed. Round one takes two trees, and large nodes dealt into blocks at random: it links near copies to one
component whatever their number, for a link a member and not all pairs. A large node of one component is done. One with few
members outside its largest component is compared exhaustively in tiles, each a block of the component with all of the others. What is
neither splits on. Round two asks of all nodes for the best spanning forest between components. In nodes where candidates are left
after that, the full sets of their members meet, and each pair is compared exactly within the node, so nothing hides behind an edge
that failed and no list of pairs is made.

Joins on nodes treat the at most HOTTEST ones that hold more than a share of all rows apart: their sizes are broadcast, the rest is shuffled.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import components, drop_stored, join_hot, more_components, slices, stored, text_of

SKETCH, TREES, FIRST, SMALL, TILE, LEAST, HOTTEST = 64, 10, 3, 48, 64, 39, 1000
TREE = (1 << 5) - 1  # the lowest bits of a path are the number of its tree
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _B
        x = (x ^ (x >> np.uint64(27))) * _C
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of k-word shingles as sorted 64-bit hashes. Words: runs of bytes other than ASCII white space, A-Z lower-cased."""

    def __init__(self, k: int, limit: int = 200_000):
        self.k, self.limit, self.words = k, limit, {}

    def __call__(self, text: str) -> np.ndarray:
        import xxhash

        words, known = text.encode().lower().split(), self.words
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > self.limit:
            known = self.words = {}
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(h) - self.k + 1
        with np.errstate(over="ignore"):
            if n <= 0:  # the whole sequence is the one shingle
                out = np.full(1, len(h), np.uint64)
                for x in h:
                    out = _mix(out * _A + x)
                return out
            out = h[:n]
            for j in range(1, self.k):
                out = _mix(out * _A + h[j : j + n])
            return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """SKETCH minwise tokens (32 bits) of each non-empty set."""
    out = np.zeros((len(sets), SKETCH), np.uint32)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets)])[:-1]
    with np.errstate(over="ignore"):
        for j in range(SKETCH):
            out[:, j] = np.minimum.reduceat((flat * _MUL[j] + _ADD[j]) >> np.uint64(32), starts)
    return out


def _sketched(k: int):
    def run(batches):
        shingle = Shingler(k)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle(t) for t in batch.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                drawn = dict(zip(full, sketches([sets[i] for i in full]), strict=True)) if full else {}
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), *(pa.array([int.from_bytes(d[a : a + 8], "little", signed=True) for d in digest], pa.int64()) for a in (0, 8)), pa.array([drawn[i].tobytes() if i in drawn else None for i in range(len(sets))], pa.binary()), pa.array([drawn[i].tobytes()[::4] if i in drawn else None for i in range(len(sets))], pa.binary())], names=["i", "n", "x", "y", "sketch", "short"])

    return run


def _children(node: np.ndarray, path: np.ndarray, sketch: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, path, row of sketch) one level down. node: ids; path: of each; sketch: rows; salts choose independently."""
    with np.errstate(over="ignore"):
        choice = _mix(path + _A * np.uint64(1 + salt))
        first = (choice & np.uint64(SKETCH - 1)).astype(np.int64)
        step = np.uint64(1) + ((choice >> np.uint64(8)) % np.uint64(SKETCH - 1))
        second = ((first.astype(np.uint64) + step) & np.uint64(SKETCH - 1)).astype(np.int64)
        twice = np.flatnonzero((choice >> np.uint64(32)) & np.uint64(3) == 0)
        rows = np.arange(len(path))
        down = lambda r, place: _mix(_mix(choice[r] + place.astype(np.uint64) * _B) + sketch[r, place].astype(np.uint64) * _A) & ~np.uint64(TREE) | path[r] & np.uint64(TREE)
        return np.concatenate((node, node[twice])), np.concatenate((down(rows, first), down(twice, second[twice]))), np.concatenate((rows, twice))


def _planted(batches):
    """Rows (i, sketch) to (path, i) of all trees at level FIRST."""
    trees = np.arange(TREES, dtype=np.uint64)
    roots = _mix((trees + np.uint64(1)) * _C) & ~np.uint64(TREE) | trees
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sketch = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
        for root in roots:
            node, path, rows = ids, np.full(len(ids), root, np.uint64), np.arange(len(ids))
            for _ in range(FIRST):
                node, path, r = _children(node, path, sketch[rows])
                rows = rows[r]
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(node)], names=["path", "i"])


def _deeper(batches):
    """Rows (path, i, sketch, ways) to (path, i) one level down, in so many independent ways."""
    for batch in batches:
        if batch.num_rows:
            node, path = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            sketch, ways = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SKETCH), batch.column(3).to_numpy(zero_copy_only=False)
            for salt in range(int(ways.max())):
                rows = np.flatnonzero(ways > salt)
                down, below, _ = _children(node[rows], path[rows], sketch[rows], salt)
                yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), pa.array(down)], names=["path", "i"])


def _whole_nodes(batches, columns: int, most: int = 1 << 18):
    """Lists of column arrays in which no node (first column, sorted) is cut, of about `most` pairs of members or one node."""

    def portions(held):
        t = pa.Table.from_batches(held).combine_chunks()
        paths = t.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], paths[1:] != paths[:-1], [True])))
        pairs = np.concatenate(([0], np.cumsum(np.diff(cuts) ** 2)))
        i = 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + most, "right")) - 1)
            yield [t.column(c).slice(cuts[i], cuts[j] - cuts[i]) for c in range(columns)]
            i = j

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        paths = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(paths, paths[-1]))
        if cut:
            held.append(batch.slice(0, cut))
            yield from portions(held)
            held = [batch.slice(cut)]
        elif held and held[-1].column(0)[-1].as_py() != int(paths[0]):
            yield from portions(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from portions(held)


def _close_pairs(path: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of one node whose sketches agree in LEAST places, and in how many they agree."""
    left, right, agree = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(1, len(path)):
        rows = np.flatnonzero(path[o:] == path[:-o])
        if not len(rows):
            break
        for at in range(0, len(rows), 50_000):
            r = rows[at : at + 50_000]
            n = (short[r] == short[r + o]).sum(1)
            r, n = r[n >= LEAST], n[n >= LEAST]
            left.append(r)
            right.append(r + o)
            agree.append(n)
    return np.concatenate(left), np.concatenate(right), np.concatenate(agree)


def _open_pairs(columns, percent: int) -> tuple[np.ndarray, ...]:
    """(path, ids, components, a, b, agreement) of whole nodes (path, i, short, component, failed, n, s): rows of the pairs worth comparing. They are
    of different components, not known to fail, and their sizes n allow the similarity if no more than s elements are in any other set."""
    path, ids, comp, size, most = (columns[c].to_numpy() for c in (0, 1, 3, 5, 6))
    short = np.frombuffer(b"".join(columns[2].to_pylist()), np.uint8).reshape(-1, SKETCH)
    a, b, n = _close_pairs(path, short)
    both = np.minimum(most[a], most[b])
    other = (ids[a] != ids[b]) & (comp[a] != comp[b]) & (100 * both >= percent * (size[a] + size[b] - both))
    a, b, n = a[other], b[other], n[other]
    lists = columns[4]
    if len(a) and lists.null_count < len(lists):
        known = {(i, j) for i, js in zip(ids.tolist(), lists.to_pylist(), strict=True) for j in js or ()}
        keep = np.array([(x, y) not in known for x, y in zip(np.minimum(ids[a], ids[b]).tolist(), np.maximum(ids[a], ids[b]).tolist(), strict=True)], bool)
        a, b, n = a[keep], b[keep], n[keep]
    return path, ids, comp, a, b, n


def _forest(path: np.ndarray, comp: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> list[int]:
    """Of the pairs, the heaviest spanning forest of each node's components."""
    order = np.lexsort((b, a, -weight, path[a]))
    kept, parent, now = [], {}, None
    for k, p, x, y in zip(order.tolist(), path[a][order].tolist(), comp[a][order].tolist(), comp[b][order].tolist(), strict=True):
        if p != now:
            parent, now = {}, p
        while x in parent:
            x = parent[x]
        while y in parent:
            y = parent[y]
        if x != y:
            parent[y] = x
            kept.append(k)
    return kept


def _asked(percent: int):
    """Nodes to the links (a, b) to confirm next: a forest between the components of each."""

    def run(batches):
        for columns in _whole_nodes(batches, 7):
            path, ids, comp, a, b, n = _open_pairs(columns, percent)
            k = _forest(path, comp, a, b, n)
            lo, hi = np.minimum(ids[a[k]], ids[b[k]]), np.maximum(ids[a[k]], ids[b[k]])
            yield pa.RecordBatch.from_arrays([pa.array(lo), pa.array(hi)], names=["a", "b"])

    return run


def _active(percent: int):
    """Nodes to their members (path, i) in pairs worth comparing."""

    def run(batches):
        for columns in _whole_nodes(batches, 7):
            path, ids, _, a, b, _ = _open_pairs(columns, percent)
            rows = np.union1d(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(path[rows]), pa.array(ids[rows])], names=["path", "i"])

    return run


def _exact(percent: int):
    """Nodes (path, i, component, set) to links (a, b): all pairs of different components compared on full sets, a forest of those that reach it."""

    def run(batches):
        for columns in _whole_nodes(batches, 4):
            path, ids, comp = (columns[c].to_numpy() for c in (0, 1, 2))
            sets = [np.frombuffer(s, np.uint64) for s in columns[3].to_pylist()]
            cuts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
            out: list[tuple[int, int]] = []
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                size = np.array([len(s) for s in sets[i:j]])
                both = _intersections(sets[i:j], size)
                close = (100 * both >= percent * (size[:, None] + size - both)) & (comp[i:j, None] != comp[i:j]) & (ids[i:j, None] < ids[i:j])
                a, b = np.nonzero(close)
                if len(a):
                    k = _forest(path[i:j], comp[i:j], a, b, both[a, b])
                    out += zip(ids[i + a[k]].tolist(), ids[i + b[k]].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _intersections(sets: list[np.ndarray], size: np.ndarray, most: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of all pairs. Elements are dealt so that no table has more than `most` cells."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    rank = np.cumsum(np.concatenate(([False], flat[1:] != flat[:-1])))
    both = np.zeros((len(sets), len(sets)), np.int64)
    wide = max(1, most // len(sets))
    for at in range(0, int(rank[-1]) + 1, wide):
        x, y = np.searchsorted(rank, [at, at + wide])
        held = np.zeros((len(sets), wide), np.float32)
        held[owner[x:y], rank[x:y] - at] = 1
        both += np.rint(held @ held.T).astype(np.int64)
    return both


def _sized(level: DataFrame) -> DataFrame:
    """(path, i, size) of the nodes of more than one member."""
    sizes = stored(level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    out = stored(join_hot(level, sizes, ["path"], "size", HOTTEST), "sized")
    drop_stored(level)
    drop_stored(sizes)
    return out


def _sets(k: int):
    def run(batches):
        shingle = Shingler(k)
        for batch in batches:
            for some, texts in slices([batch], 1):
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingle(t).tobytes() for t in texts], pa.binary())], names=["i", "set"])

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) with ok: whether the full sets reach the similarity. sets: (i, set), one row an id."""
    one = pairs.hint("merge").join(sets.select(F.col("i").alias("a"), F.col("set").alias("x")), "a")
    two = one.hint("merge").join(sets.select(F.col("i").alias("b"), F.col("set").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(_confirmed(percent), "a long, b long, ok boolean")


def _elements(batches):
    """Rows (i, set) to (e, i), a row an element."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            some = batch.slice(at, 200)
            sets = [np.frombuffer(x, np.int64) for x in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(some.column(0).to_numpy(), [len(x) for x in sets]))], names=["e", "i"])


def bounds(sets: DataFrame) -> DataFrame:
    """(i, n, s): sizes of sets, and how many of their elements are in another of these too."""
    single = sets.mapInArrow(_elements, "e long, i long").groupBy("e").agg(F.count(F.lit(1)).alias("m"), F.min("i").alias("i")).where("m = 1")
    own = single.groupBy("i").agg(F.count(F.lit(1)).alias("own"))
    size = (F.octet_length("set") / 8).cast("long")
    return sets.select("i", size.alias("n")).join(own, "i", "left").select("i", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("s"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row of docs, whole texts.

    Linked: 100 * intersection >= percent * union of the sets of k-word shingles (fewer words: the whole sequence is one shingle).
    component_id is the smallest id reachable by links, kept whether it is the own. Null, empty or wordless text: an empty set, linked
    with nothing. Rows of one id count as one document, linked among themselves. A null id has component_id null and kept true. An empty
    table gives an empty one; other columns are ignored. percent must be 80 at least, which the trees are made for.
    """
    if percent < 80:
        raise ValueError("the trees are made for similarities of 80 percent or more")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text_of(text_col).alias("t"))
    drawn = stored(rows.mapInArrow(_sketched(k), "i long, n long, x long, y long, sketch binary, short binary"), "sketches")
    full = drawn.where("n > 0 and i is not null")
    classes = stored(full.groupBy("x", "y").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short")), "classes")
    of = join_hot(full.select("i", "x", "y"), classes.select("x", "y", F.col("i").alias("r"), "rows"), ["x", "y"], "rows", HOTTEST).select("i", "r")
    # an id with several texts lies in several classes; they are one document
    twins = of.groupBy("i").agg(F.min("r").alias("a"), F.max("r").alias("z")).where("a <> z").select("i", "a")
    linked = stored(of.join(twins, "i").where("r <> a").select("a", F.col("r").alias("b")).distinct(), "twins")
    labels, failed, known = components(linked), None, None

    def met(nodes: DataFrame) -> DataFrame:
        """(path, i, short, component, failed, n, s) of nodes (path, i), whole nodes together."""
        rows = nodes.join(classes.select("i", "short", "n"), "i").join(labels.withColumnRenamed("id", "i"), "i", "left").withColumn("component", F.coalesce("component", "i"))
        rows = rows.withColumn("failed", F.lit(None).cast("array<bigint>")) if failed is None else rows.join(failed.groupBy(F.col("a").alias("i")).agg(F.collect_set("b").alias("failed")), "i", "left")
        rows = rows.withColumn("s", F.col("n")) if known is None else rows.join(known.select("i", "s"), "i", "left").withColumn("s", F.coalesce("s", "n"))
        return rows.select("path", "i", "short", "component", "failed", "n", "s").repartition("path").sortWithinPartitions("path", "i")

    def confirmed(pairs: DataFrame) -> None:
        nonlocal labels, failed
        tested = stored(confirm(stored(pairs, "pairs"), sets, percent), "tested")
        labels = more_components(labels, tested.where("ok").select("a", "b"))
        no = tested.where("not ok").select("a", "b")
        failed = no if failed is None else failed.unionAll(no)

    planted = stored(classes.select("i", "sketch").mapInArrow(_planted, "path long, i long"), "paths")
    level = _sized(planted)
    active = [stored(met(level.where(F.col("size") <= SMALL).select("path", "i")).mapInArrow(_active(percent), "path long, i long"), "active")]
    large = level.where(F.col("size") > SMALL)
    used = active[0].select("i").unionAll(large.select("i")).distinct()
    asked = rows.where("i is not null").join(used.hint("merge"), "i", "left_semi").dropDuplicates(["i"])
    sets = stored(asked.select("i", "t").mapInArrow(_sets(k), "i long, set binary"), "sets")
    known = stored(bounds(sets), "bounds")
    # round one: two trees, and blocks of large nodes, dealt twice at random
    some = F.col("path").bitwiseAND(TREE) < 2
    block = lambda salt: F.xxhash64("path", F.pmod(F.xxhash64("i", "path", F.lit(salt)), F.ceil(F.col("size") / (SMALL - 8))), F.lit(salt))
    dealt = [large.where(some & (F.col("path").bitwiseAND(TREE) <= 2 - salt)).select(block(salt).alias("path"), "i") for salt in (1, 2)]
    confirmed(met(active[0].where(some).unionAll(dealt[0]).unionAll(dealt[1])).mapInArrow(_asked(percent), "a long, b long").distinct())
    salts = 3
    while large.limit(1).count():
        of_node = large.join(known, "i").join(labels.withColumnRenamed("id", "i"), "i", "left").select("path", "i", "n", "s", F.coalesce("component", "i").alias("component"))
        of_node = stored(of_node, "large")
        # by its elements, a member can only be linked with one of at most `room` elements; where the node has none so small, it leaves
        room = F.col("s") * (100 + percent) - F.col("n") * percent
        least = of_node.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least"))
        of_node = stored(join_hot(of_node, least, ["path"], "size", HOTTEST).where(room >= F.col("least") * percent).select("path", "i", "component"), "able")
        parts = of_node.groupBy("path", "component").agg(F.count(F.lit(1)).alias("m"))
        facts = stored(parts.groupBy("path").agg(F.sum("m").alias("size"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("main")).where("size > most"), "facts")
        still = stored(join_hot(of_node, facts, ["path"], "size", HOTTEST), "open")
        outside = F.col("size") - F.col("most")
        tiles = F.ceil(F.col("most") / TILE)
        block = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("i"), tiles))).otherwise(F.sequence(F.lit(0).cast("long"), tiles - 1))
        fits = (outside <= 4 * TILE) & (F.col("most") + outside * tiles <= 4 * F.col("size"))  # tiles have at most four rows a member
        tiled = still.where(fits).select("path", "i", F.explode(block).alias("tile")).select(F.xxhash64("path", "tile").alias("path"), "i")
        # nodes of no large component split in several ways at first: a pair there has few chances to meet, a component has many
        split = still.where(~fits).withColumn("wide", F.col("most") * 2 < F.col("size")).join(classes.select("i", "sketch"), "i")
        split = split.select("path", "i", "sketch", F.when(F.col("wide"), F.lit(salts)).otherwise(F.lit(1)).alias("ways"))
        next_ = split.mapInArrow(_deeper, "path long, i long")
        deeper = stored(next_, "paths")
        level = _sized(deeper)
        active.append(stored(met(tiled.unionAll(level.where(F.col("size") <= SMALL).select("path", "i"))).mapInArrow(_active(percent), "path long, i long"), "active"))
        large, salts = level.where(F.col("size") > SMALL), 1
    nodes = reduce(DataFrame.unionAll, active)
    confirmed(met(nodes).mapInArrow(_asked(percent), "a long, b long").distinct())
    # what is still open is compared exactly, node by node
    left = stored(met(nodes).mapInArrow(_active(percent), "path long, i long"), "left")
    if left.limit(1).count():
        whole = left.join(sets, "i").join(labels.withColumnRenamed("id", "i"), "i", "left").select("path", "i", F.coalesce("component", "i").alias("component"), "set")
        more = stored(whole.repartition("path").sortWithinPartitions("path", "i").mapInArrow(_exact(percent), "a long, b long").distinct(), "links")
        labels = more_components(labels, more)
    of = of.join(labels.withColumnRenamed("id", "r"), "r", "left").select("i", F.coalesce("component", "r").alias("component")).distinct()
    out = drawn.select("i", "n").join(of, "i", "left")
    component = F.coalesce("component", "i")
    return out.select(F.col("i").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("i"), F.lit(True)).alias("kept"))
