"""Approximate nearest neighbours by largest inner product (operator 3): NN-descent graph, greedy graph search.

Equal vectors are one node (its members are kept by id, so a vector that a third of all rows share is no hub). Nodes get one more
coordinate that makes all norms equal, so the largest inner product is the nearest neighbour. The graph starts from a few
random-projection trees, fitted on a bounded sample (`sample_rows`): leaves are cut into blocks of at most `BLOCK` nodes and compared
within. NN-descent then improves it by joins: each node's pool (its neighbours and the nodes that name it, a list's width of
either) is scored pairwise, and every member keeps what beats its list. Pairs that met before are not scored again. Rounds go on
until at most SETTLED of all list places change in one, however many that takes. Search is greedy: a query starts from leaf mates,
again and again joins the best unexpanded nodes of its beam with the graph, and keeps the best; it ends when no beam holds an
unexpanded node. All steps are joins of distributed tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import drop_stored, stored

WIDTH, BLOCK, TREES, SETTLED, MORE = 32, 200, 4, 0.001, 1e-6
BEAM, EXPAND, LONGEST = 64, 16, 48


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v array<double>): rows that take part. Left out: null ids, null, empty or zero vectors, null or non-finite components, and
    vectors of another than the greatest dimension."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    fine = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.where(fine)
    size = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 0
    return rows.where(F.size("v") == size)


def grouped(batches, columns: int):
    """(key, slice) of each run of equal keys in the first column, over batch borders."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        if held and held[0].column(0)[0].as_py() != int(keys[0]):
            yield int(held[0].column(0)[0].as_py()), pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and a:
                yield int(held[0].column(0)[0].as_py()), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield int(held[0].column(0)[0].as_py()), pa.Table.from_batches(held)


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1)


class Trees:
    """Random-projection trees: hyperplanes through the middle of two sample points, to leaves of about `leaf` of all rows."""

    def __init__(self, sample: np.ndarray, rows: int, leaf: int, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        depth = max(0, min(int(np.ceil(np.log2(max(rows, 1) / leaf))), int(np.log2(max(len(sample), 8) / 8))))
        self.trees = []
        for _ in range(count):
            normals = np.zeros((2**depth - 1, sample.shape[1]), np.float32)
            cuts = np.zeros(2**depth - 1, np.float32)
            at = np.zeros(len(sample), np.int64)
            for node in range(2**depth - 1):
                mine = np.flatnonzero(at == node)
                if len(mine) >= 2:
                    a, b = sample[rng.choice(mine, 2, replace=False)]
                    normals[node] = a - b
                    cuts[node] = np.median(sample[mine] @ normals[node])
                    at[mine] = 2 * node + 1 + (sample[mine] @ normals[node] > cuts[node])
            self.trees.append((depth, normals, cuts))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.trees)), np.int64)
        for t, (depth, normals, cuts) in enumerate(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (np.einsum("ij,ij->i", x, normals[at]) > cuts[at])
            out[:, t] = at
        return out


def _best(ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `most` greatest of distinct ids, greatest first, ties to the smaller id. Of a repeated id the one that is not fresh stays."""
    held = np.lexsort((fresh, ids))
    ids, first = np.unique(ids[held], return_index=True)
    sims, fresh = sims[held][first], fresh[held][first]
    order = np.lexsort((ids, -sims))[:most]
    return ids[order], sims[order], fresh[order]


_LISTS = "id long, near array<long>, sim array<float>"
_EDGES = _LISTS + ", fresh array<boolean>"


def _lists(ids, near, sims) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float32()))], names=["id", "near", "sim"])


def _within_blocks(width: int):
    """Rows (block, id, x): each node's nearest in its block."""

    def run(batches):
        for _, t in grouped(batches, 3):
            ids, x = t.column(1).to_numpy(), _matrix(t.column(2))
            out = [[], [], []]
            for at in range(0, len(ids), 1000):
                s = x[at : at + 1000] @ x.T
                s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
                k = min(width, len(ids) - 1)
                if k <= 0:
                    continue
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                for i in range(len(s)):
                    out[0].append(int(ids[at + i]))
                    out[1].append(ids[top[i]])
                    out[2].append(s[i, top[i]])
            if out[0]:
                yield _lists(*out)

    return run


def _pooled(width: int):
    """Rows (pool, id, x, bar, fresh), an id once a pool: pairs of members, one of them fresh, that beat a member's bar; no more a member
    than its list can hold."""

    def run(batches):
        for _, t in grouped(batches, 5):
            ids = t.column(1).to_numpy()
            if len(ids) < 2:
                continue
            x, bar, fresh = _matrix(t.column(2)), t.column(3).to_numpy(), t.column(4).to_numpy()
            s = x @ x.T
            s[~(fresh[:, None] | fresh)] = -np.inf
            np.fill_diagonal(s, -np.inf)
            k = min(width, len(ids) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(s, top, 1)
            better = best > bar[:, None] + MORE  # rounding alone is no gain, so the rounds end
            rows = np.flatnonzero(better.any(1))
            if len(rows):
                yield _lists(ids[rows], [ids[top[r][better[r]]] for r in rows], [best[r][better[r]] for r in rows])

    return run


def _merged(most: int):
    """Rows (id, near, sim, whether they are fresh) sorted by id: one list of the best for each id."""

    def run(batches):
        out: list[list] = [[], [], [], []]

        def listed():
            edges = _lists(*out[:3])
            return pa.RecordBatch.from_arrays([*edges.columns, pa.array(out[3], pa.list_(pa.bool_()))], names=["id", "near", "sim", "fresh"])

        for key, t in grouped(batches, 4):
            near, sims = (t.column(c).combine_chunks().flatten().to_numpy() for c in (1, 2))
            fresh = np.repeat(t.column(3).to_numpy(), pc.list_value_length(t.column(1)).to_numpy())
            for into, v in zip(out, (key, *_best(near, sims, fresh, most)), strict=True):
                into.append(v)
            if len(out[0]) >= 2000:
                yield listed()
                out = [[], [], [], []]
        if out[0]:
            yield listed()

    return run


def _by_id(df: DataFrame, most: int) -> DataFrame:
    return df.repartition("id").sortWithinPartitions("id").mapInArrow(_merged(most), _EDGES)


class Graph:
    """nodes (id, x): one row a distinct vector, id the smallest of its members; members (id, ids): the smallest of them; edges (id, near, sim); leaves."""

    def __init__(self, vectors: DataFrame, k: int, sample_rows: int = 20_000):
        self.k, self.width, self.beam = k, max(WIDTH, k + 12), max(BEAM, 2 * k)  # a list holds all answers of a query that is a node
        spark = vectors.sparkSession
        # the k + 1 smallest ids of a vector are all a search can return; found in two steps, so a hot vector is no one task's group
        part = vectors.groupBy("v", F.pmod(F.xxhash64("id"), F.lit(256)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
        members = part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
        self.members = stored(members.select(F.get("ids", F.lit(0)).alias("id"), "ids", "v"), "members")
        norm = F.aggregate(F.transform("v", lambda a: a * a), F.lit(0.0), lambda a, b: a + b)
        first = self.members.agg(F.max(norm).alias("m"), F.count(F.lit(1)).alias("n")).first()
        self.size, top = first["n"], float(first["m"] or 0.0)

        def lifted(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.array(batch.column(1).to_pylist(), np.float64)
                scale = np.sqrt(top)
                v = v / scale  # keeps float32 in range
                more = np.sqrt(np.maximum(0.0, 1.0 - (v * v).sum(1)))
                x = np.hstack([v, more[:, None]]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

        self.scale = np.sqrt(top)
        self.nodes = stored(self.members.select("id", "v").mapInArrow(lifted, "id long, x binary"), "nodes")
        sample = self.nodes.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("x").toArrow().column(0)
        x = _matrix(sample) if len(sample) else np.zeros((0, 1), np.float32)
        self.trees = spark.sparkContext.broadcast(Trees(x, self.size, BLOCK // 2, TREES))
        self._build()

    def _leaves(self, rows: DataFrame) -> DataFrame:
        """(leaf, id, x), a row a tree."""
        trees = self.trees

        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = trees.value.leaves(_matrix(batch.column(1)))
                for t in range(at.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(at[:, t] * TREES + t), batch.column(0), batch.column(1)], names=["leaf", "id", "x"])

        return rows.mapInArrow(run, "leaf long, id long, x binary")

    def _build(self) -> None:
        self.leaves = stored(self._leaves(self.nodes), "leaves")
        # a leaf may hold any number of rows: blocks of about BLOCK / 2 keep every group bounded
        count = self.leaves.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
        block = F.xxhash64("leaf", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / BLOCK - 0.5))))
        blocks = self.leaves.join(count, "leaf").select(block.alias("block"), "id", "x")
        rows = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_within_blocks(self.width), _LISTS)
        self.edges = stored(_by_id(rows.withColumn("fresh", F.lit(True)), self.width), "edges")
        while self._changed() > SETTLED * self.size * self.width:
            self.edges = self._improved(self.edges)

    def _changed(self) -> int:
        """List places that the last round filled."""
        return self.edges.agg(F.sum(F.size(F.filter("fresh", lambda f: f))).alias("n")).first()["n"] or 0

    def _improved(self, edges: DataFrame) -> DataFrame:
        """One round: neighbours of neighbours meet in the pool of the node between them."""
        width = self.width
        listed = edges.select("id", F.posexplode(F.arrays_zip("near", "fresh")).alias("p", "e")).select("id", "p", "e.near", "e.fresh")
        forward = listed.select(F.col("id").alias("pool"), F.col("near").alias("id"), "fresh")
        named = listed.select("id", "p", F.col("near").alias("pool"), "fresh")
        # of the nodes that name a pool's node, a list's width drawn by rank and hash (a hub's list stays bounded, as in the published method)
        salted = named.groupBy("pool", F.pmod(F.xxhash64("id"), F.lit(16)).alias("s")).agg(F.slice(F.array_sort(F.collect_list(F.struct("p", F.xxhash64("id", "pool").alias("h"), "id", "fresh"))), 1, width).alias("l"))
        reverse = salted.groupBy("pool").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, width).alias("l")).select("pool", F.explode("l").alias("e")).select("pool", "e.id", "e.fresh")
        pools = forward.unionAll(reverse).groupBy("pool", "id").agg(F.max("fresh").alias("fresh"))
        pools = stored(pools.join(pools.where("fresh").select("pool").distinct(), "pool", "left_semi"), "pools")
        held = self.nodes.join(edges.select("id", F.when(F.size("sim") < width, F.lit(-9.0)).otherwise(F.element_at("sim", -1)).cast("float").alias("bar")), "id")
        found = pools.join(held, "id").select("pool", "id", "x", "bar", "fresh").repartition("pool").sortWithinPartitions("pool").mapInArrow(_pooled(width), _LISTS)
        known = edges.select("id", "near", "sim").withColumn("fresh", F.lit(False))
        out = stored(_by_id(known.unionAll(found.withColumn("fresh", F.lit(True))), width), "edges")
        drop_stored(edges)
        drop_stored(pools)
        return out

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) of queries (id, v): the k nearest found rows, never the query's own id."""
        k, scale = self.k, self.scale or 1.0

        def lifted(batches):
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column(1).to_pylist(), np.float64) / scale
                    x = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))]).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "x"])

        asked = stored(queries.select("id", "v").mapInArrow(lifted, "id long, x binary"), "queries")
        # entries: for each tree some nodes of the query's leaf, and the query's own node where it is one
        entry = self.leaves.select("leaf", F.pmod(F.xxhash64("id"), F.lit(16)).alias("s"), "id").groupBy("leaf", "s").agg(F.min_by("id", F.xxhash64("id")).alias("e")).select("leaf", "e")
        seeds = self._leaves(asked).select("leaf", F.col("id").alias("q")).join(entry, "leaf").select("q", F.col("e").alias("c"))
        own = asked.select(F.col("id").alias("q")).join(self.members.select(F.explode("ids").alias("q"), F.col("id").alias("c")), "q")
        # the longest vectors are near to every query by inner product; LONGEST ids, whatever the input
        norm = F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)
        long = [r["id"] for r in self.members.orderBy(norm.desc(), "id").limit(LONGEST).select("id").collect()]
        longest = asked.select(F.col("id").alias("q"), F.explode(F.array(*map(F.lit, long)).cast("array<bigint>")).alias("c"))
        wanted = seeds.unionAll(own).unionAll(longest).distinct()
        beams, step = None, _hop(self.beam, EXPAND)
        while True:
            near = wanted.join(self.nodes.select(F.col("id").alias("c"), F.col("x").alias("cx")), "c").join(asked.select(F.col("id").alias("q"), F.col("x").alias("qx")), "q")
            scored = near.select("q", "c", F.lit(None).cast("float").alias("s"), F.lit(False).alias("done"), "cx", "qx")
            if beams is not None:
                scored = scored.unionAll(beams.select("q", F.explode(F.arrays_zip("c", "s", "done")).alias("b")).select("q", "b.c", "b.s", "b.done", F.lit(None).cast("binary").alias("cx"), F.lit(None).cast("binary").alias("qx")))
            last, beams = beams, stored(scored.repartition("q").sortWithinPartitions("q").mapInArrow(step, "q long, c array<long>, s array<float>, done array<boolean>, next array<long>"), "beams")
            if last is not None:
                drop_stored(last)
            todo = beams.select("q", F.explode("next").alias("n"))
            if not todo.limit(1).count():
                break
            wanted = todo.join(self.edges.select(F.col("id").alias("n"), "near"), "n").select("q", F.explode("near").alias("c")).distinct()
        exact = beams.select("q", F.explode(F.slice("c", 1, k + 8)).alias("c")).join(self.members.select(F.col("id").alias("c"), "ids", F.col("v").alias("cv")), "c").join(queries.select(F.col("id").alias("q"), F.col("v").alias("qv")), "q")
        dot = F.aggregate(F.zip_with("cv", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        rows = exact.select("q", F.explode("ids").alias("m"), dot.alias("score")).where("m <> q")
        listed = rows.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), F.col("m").alias("m"), F.col("score").alias("score")))), 1, k).alias("l"))
        return listed.select(F.col("q").alias("query_id"), F.posexplode("l").alias("p", "r")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("r.m").alias("vec_id"), F.col("r.score").alias("score"))


def _hop(beam: int, expand: int):
    """One step of all searches: (q, c, s, done, cx, qx) sorted by q to beams, and the nodes to expand next."""

    def run(batches):
        for key, t in grouped(batches, 6):
            c, done = t.column(1).to_numpy(), t.column(3).to_numpy()
            s = t.column(2).to_numpy(zero_copy_only=False).astype(np.float32).copy()
            fresh = np.flatnonzero(np.isnan(s))
            if len(fresh):
                q = np.frombuffer(t.column(5)[int(fresh[0])].as_py(), np.float32)
                s[fresh] = (_matrix(t.column(4).take(pa.array(fresh))) * q).sum(1)  # a pair scores the same in every hop, so the search ends
            order = np.lexsort((c, ~done, -s))  # of a repeated node the expanded one comes first
            c, s, done = c[order], s[order], done[order]
            _, first = np.unique(c, return_index=True)
            keep = np.sort(first)[:beam]
            c, s, done = c[keep], s[keep], done[keep].copy()
            nxt = np.flatnonzero(~done)[:expand]
            done[nxt] = True
            yield pa.RecordBatch.from_pydict({"q": [key], "c": pa.array([c], pa.list_(pa.int64())), "s": pa.array([s], pa.list_(pa.float32())), "done": pa.array([done], pa.list_(pa.bool_())), "next": pa.array([c[nxt]], pa.list_(pa.int64()))})

    return run


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest rows by inner product of each row whose id is divisible by `every`: (query_id, rank int, vec_id, score double).

    Rows that take no part (see valid) are neither asked nor found. Fewer than k other rows: all found. Repeated ids are one row if
    their vectors agree; else each vector is a row of its own and the id may be found for either. An empty table gives no row.
    """
    rows = stored(valid(vectors, id_col, vector_col), "vectors")
    graph = Graph(rows, k)
    return graph.search(rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"]))
