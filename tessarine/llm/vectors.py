"""The most similar vectors of every vector, by best-bin-first search of a k-means tree.

A hierarchical k-means tree is fitted on a bounded sample, and every vector is filed under its leaf. A
query walks down the tree and visits the leaves whose borders are near enough: how near is widened, against
exact neighbours of a sample of queries, until the wanted recall is reached. So a query deep inside a leaf visits few,
and one near many borders visits many. Neighbouring leaves form groups; a query is sent once to each group that holds leaves it visits, and meets the vectors of
these leaves there. Crowded groups are cut into blocks of bounded size, so they are spread over many tasks;
exact copies are searched once and put back afterwards. Similarities are exact cosines.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessarine.session import materialise, slots, spread

#: Vectors that a leaf should hold; vectors of the sample for each leaf; vectors of the sample at most.
LEAF_ROWS, SAMPLE_PER_LEAF, SAMPLE_ROWS = 400, 24, 400_000
#: Bytes of the sample at most, in double precision.
SAMPLE_BYTES = 256_000_000
#: Children of a node, rounds of k-means, queries of the calibration, and the recall it must reach.
BRANCH, KMEANS_ROUNDS, CALIBRATION_ROWS, RECALL = 16, 12, 4_000, 0.9995
#: Vectors and queries that are compared at once, and that meet in one task; least copies of a vector to a part of a salted join.
BLOCK_ROWS, GROUP_ROWS, SALT_ROWS = 2_048, 65_536, 100_000
#: Near pairs for each wanted neighbour up to which the pairs of a block are listed one by one.
DENSE = 8
#: Part by which the nearness of borders is widened beyond what the sample asks for, as the sample does not know its own error.
WIDER = 1.25
#: Queries whose distances from all nodes are held at once.
VISIT_ROWS = 128
#: Queries that walk down the tree at once, and that walk for the counts of the groups.
WALK_ROWS, COUNTED_ROWS = 8_192, 200_000
#: Decimals to which cosines count as equal.
DECIMALS = 9


def unit_rows(raw: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length one, in double precision, from their float32 bytes."""
    x = np.frombuffer(b"".join(raw), dtype=np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@dataclass
class Tree:
    """Centroids of all nodes; children of the inner ones; the number of each leaf (-1: inner)."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row: the nearest child, from the root down."""
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            open_nodes = [n for n in np.unique(node) if self.children[n]]
            if not open_nodes:
                return self.leaf[node]
            for n in open_nodes:
                rows = np.nonzero(node == n)[0]
                own = np.array(self.children[n])
                node[rows] = own[_nearest(x[rows], self.centroids[own])]

    def visit(self, q: np.ndarray, count: int, until: set[int] | None = None) -> list[int]:
        """The first ``count`` leaves in best-bin-first order; with ``until`` no more than it takes to meet all of these."""
        heap, found, norms = [(0.0, 0)], [], self._norms
        missing = None if until is None else set(until)
        while heap and len(found) < count and (missing is None or missing):
            _, n = heapq.heappop(heap)
            if self.leaf[n] >= 0:
                found.append(int(self.leaf[n]))
                if missing is not None:
                    missing.discard(found[-1])
                continue
            own = self.children[n]
            for d, child in zip((norms[own] - 2.0 * (self.centroids[own] @ q)).tolist(), own):
                heapq.heappush(heap, (d, child))
        return found

    def visits(self, x: np.ndarray, count: int) -> list[np.ndarray]:
        """The leaves of ``visit`` for every row, in no order.

        A leaf is taken from the queue when all nodes on its way are, so leaves come in the order of the largest
        distance on their way; those behind one node come in the same order of the way below it.
        """
        if count >= self.leaves:
            return [np.arange(self.leaves)] * len(x)
        out, ways = [], self._ways
        for at in range(0, len(x), VISIT_ROWS):
            part = x[at : at + VISIT_ROWS]
            far = self._norms - 2.0 * (part @ self.centroids.T)
            top = far[:, ways[0]]
            for step in ways[1:]:
                np.maximum(top, far[:, step], out=top)
            last = np.partition(top, count - 1, axis=1)[:, count - 1]
            for one, way, end in zip(far, top, last):
                sure = np.flatnonzero(way < end)
                out.append(np.concatenate([sure, self._first(one, np.flatnonzero(way == end), 0, count - len(sure))]))
        return out

    def across(self, node: int, x: np.ndarray) -> np.ndarray:
        """How far every row lies behind the border between each child of a node and the nearest child; 0 for that one."""
        own = np.array(self.children[node])
        d = self._norms[own] - 2.0 * (x @ self.centroids[own].T)
        first = d.argmin(axis=1)
        return (d - d[np.arange(len(x)), first][:, None]) / self._gaps[node][first]

    def within(self, x: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves to which the borders on the way of a row are at most ``far`` away, by the sum of their squares.

        Borders of different levels stand nearly upright on each other, so this is about the square of the way behind them.
        """
        rows, leaves = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        waiting = [(0, np.arange(len(x)), np.zeros(len(x)))]
        while waiting:
            node, here, gone = waiting.pop()
            if self.leaf[node] >= 0:
                rows.append(here)
                leaves.append(np.full(len(here), self.leaf[node], dtype=np.int64))
                continue
            gone = gone[:, None] + self.across(node, x[here]) ** 2
            for j, child in enumerate(self.children[node]):
                near = np.flatnonzero(gone[:, j] <= far)
                if len(near):
                    waiting.append((child, here[near], gone[near, j]))
        return np.concatenate(rows), np.concatenate(leaves)

    def reach(self, x: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """For every row and its leaf the least ``far`` with which ``within`` visits it."""
        far = np.zeros(len(x))
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            node, here = waiting.pop()
            if self.leaf[node] >= 0 or not len(here):
                continue
            over = self.across(node, x[here])
            to = np.array([self._toward[node][one] for one in leaf[here].tolist()])
            far[here] += over[np.arange(len(here)), to] ** 2
            waiting += [(child, here[to == j]) for j, child in enumerate(self.children[node])]
        return far

    def _first(self, far: np.ndarray, leaves: np.ndarray, step: int, count: int) -> np.ndarray:
        """The first ``count`` of leaves that wait for the same largest distance from ``step`` of their ways on."""
        while len(leaves) > count:
            rest = far[self._ways[step:, leaves]]
            step += int(rest[:, 0].argmax()) + 1  # behind the node that they wait for
            if step >= len(self._ways):
                return leaves[:count]
            way = far[self._ways[step:, leaves]].max(axis=0)
            end = np.partition(way, count - 1)[count - 1]
            sure, same = leaves[way < end], leaves[way == end]
            return np.concatenate([sure, self._first(far, same, step, count - len(sure))])
        return leaves

    def __post_init__(self):
        self._norms = (self.centroids**2).sum(axis=1)
        way: dict[int, list[int]] = {}
        waiting = [(0, [])]
        while waiting:
            node, above = waiting.pop()
            own = [*above, node] if node else above
            if self.leaf[node] >= 0:
                way[int(self.leaf[node])] = own or [node]
            waiting += [(child, own) for child in self.children[node]]
        deep = max(map(len, way.values()))
        # One row a level, one column a leaf: the nodes on the way to it, the last one repeated.
        self._ways = np.array([way[k] + way[k][-1:] * (deep - len(way[k])) for k in sorted(way)]).T
        # Of each inner node: twice the distances between its children, and the child on the way to a leaf.
        self._gaps, self._toward = {}, {}
        for node, own in enumerate(self.children):
            if own:
                c = self.centroids[own]
                self._gaps[node] = np.maximum(2.0 * np.linalg.norm(c[:, None] - c[None], axis=2), 1e-12)
                self._toward[node] = {}
        for leaf, nodes in way.items():
            for above, child in zip([0, *nodes], nodes):
                if self.children[above]:
                    self._toward[above][leaf] = self.children[above].index(child)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1)[None, :] - 2.0 * (x @ c.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), size=k, replace=False)]
    for _ in range(KMEANS_ROUNDS):
        to = _nearest(x, c)
        sums = (np.arange(k)[:, None] == to[None, :]).astype(np.float64) @ x
        n = np.bincount(to, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, _nearest(x, c)


def fit_tree(sample: np.ndarray, leaf_sample: int, seed: int = 5) -> Tree:
    """Split the sample again and again until no node holds more than ``leaf_sample`` of it."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    centroids, children, leaf = [np.zeros(dim)], [[]], [-1]
    waiting, leaves = [(0, np.arange(len(sample)))], 0
    while waiting:
        node, rows = waiting.pop()
        k = min(BRANCH, math.ceil(len(rows) / max(1, leaf_sample)))
        parts = []
        if k > 1:
            c, to = _kmeans(sample[rows], k, rng)
            parts = [(c[j], rows[to == j]) for j in range(k) if (to == j).any()]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for centre, own in parts:
            centroids.append(centre)
            children.append([])
            leaf.append(-1)
            children[node].append(len(centroids) - 1)
            waiting.append((len(centroids) - 1, own))
    return Tree(np.array(centroids), children, np.array(leaf))


def first_k(qid: np.ndarray, ids: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query: by value, then by smaller id."""
    order = np.lexsort((ids, -value, qid))
    qid, ids, value = qid[order], ids[order], value[order]
    first = np.ones(len(qid), dtype=bool)
    first[1:] = qid[1:] != qid[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(qid)), 0)) if len(qid) else np.zeros(0, dtype=np.int64)
    keep = np.arange(len(qid)) - start < k
    return qid[keep], ids[keep], value[keep]


def block_neighbours(qid: np.ndarray, q: np.ndarray, mid: np.ndarray, m: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, neighbour, cosine): for each query its ``k`` best of the block with a cosine of ``least`` or more."""
    if least > -1.0 and len(q):
        # Single precision, with its error allowed for, tells the few pairs that may be near; their cosines are exact.
        slack = (q.shape[1] + 8) * 2.0**-23
        rows, cols = np.nonzero(q.astype(np.float32) @ m.astype(np.float32).T >= np.float32(least - slack))
        if len(rows) <= DENSE * k * len(q):
            cos = np.round(np.clip(np.einsum("ij,ij->i", q[rows], m[cols]), -1.0, 1.0), DECIMALS)
            near = (cos >= least) & (qid[rows] != mid[cols])
            return first_k(qid[rows[near]], mid[cols[near]], cos[near], k)
    cos = np.round(np.clip(q @ m.T, -1.0, 1.0), DECIMALS)
    cos[qid[:, None] == mid[None, :]] = -2.0
    if cos.shape[1] > k:
        floor = np.maximum(np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k], least)
    else:
        floor = np.full(len(q), least)
    rows, cols = np.nonzero((cos >= floor[:, None]) & (cos > -2.0))
    return first_k(qid[rows], mid[cols], cos[rows, cols], k)


def group_neighbours(qid: np.ndarray, q: np.ndarray, leaves: list[list[int]], mid: np.ndarray, m: np.ndarray, leaf: np.ndarray, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``block_neighbours`` of every query and each of the leaves that it visits."""
    row = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    to = np.array([x for own in leaves for x in own])
    order, inside = np.argsort(to, kind="stable"), np.argsort(leaf, kind="stable")
    row, to, leaf = row[order], to[order], leaf[inside]
    out = []
    for one in np.unique(leaf):
        asks = row[slice(*np.searchsorted(to, (one, one + 1)))]
        has = inside[slice(*np.searchsorted(leaf, (one, one + 1)))]
        for a in range(0, len(asks), BLOCK_ROWS):
            for b in range(0, len(has), BLOCK_ROWS):
                i, j = asks[a : a + BLOCK_ROWS], has[b : b + BLOCK_ROWS]
                out.append(block_neighbours(qid[i], q[i], mid[j], m[j], k, least))
    return out


def _best(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.col("cos").desc(), "n")
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def _filed(reps: DataFrame, tree: Tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = b.column(1).to_pylist()
                leaves = tree.assign(unit_rows(raw, len(raw[0]) // 4)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaves)], ["id", "v", "leaf"])

    return reps.select("id", "v").mapInArrow(run, "id bigint, v binary, leaf int")


def calibrate(filed: DataFrame, tree: Tree, k: int, least: float, rows: int, n: int, recall: float) -> float:
    """How near borders must be, for ``within``, so that ``recall`` of the exact neighbours of sampled queries are met."""
    share = min(1.0, 1.5 * rows / max(1, n))
    queries = filed.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).select("id", "v").orderBy(F.xxhash64("id"), "id").limit(rows).toArrow()
    if not queries.num_rows:
        return 0.0
    qid, raw = queries["id"].to_numpy(), queries["v"].to_pylist()
    q = unit_rows(raw, len(raw[0]) // 4)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                own = part.column(1).to_pylist()
                ids = part.column(0).to_numpy()
                a, c, s = block_neighbours(qid, q, ids, unit_rows(own, len(own[0]) // 4), k, least)
                leaf = dict(zip(ids.tolist(), part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c), pa.array(s), pa.array([leaf[x] for x in c.tolist()], pa.int32())], ["q", "n", "cos", "leaf"])

    truth = _best(filed.mapInArrow(exact, "q bigint, n bigint, cos double, leaf int"), k).select("q", "leaf").toArrow()
    if not truth.num_rows:  # no sampled query has a neighbour that near; what finds the nearest ones finds those as well
        return calibrate(filed, tree, k, -1.0, rows, n, recall) if least > -1.0 else 0.0
    at = {int(i): r for r, i in enumerate(qid)}
    far = np.sort(tree.reach(q[[at[i] for i in truth["q"].to_pylist()]], truth["leaf"].to_numpy()))
    return WIDER * float(far[min(len(far) - 1, math.ceil(recall * len(far)) - 1)])


def nearest(df: DataFrame, vec_id: str, embedding: str, k: int = 5, least: float = -1.0, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, queries: str | None = None) -> DataFrame:
    """The ``k`` most similar other vectors of every vector: ``vec_id``, neighbour_id, cosine.

    Neighbours are ordered by cosine (equal to nine decimals: smaller id first); only those with a
    cosine of ``least`` or more are given. ``queries``, an SQL condition on vec_id, restricts who asks;
    all vectors answer. Null vectors, vectors of zeros, vectors with null, NaN or infinite values,
    vectors of another dimension than the most frequent one and rows with a null id take no part. A row
    that is repeated counts once; one id with two vectors counts by the smaller one. Other columns are
    never read. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[vec_id]
    base = df.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("e"))
    good = "id is not null and e is not null and size(e) > 0 and exists(e, x -> x != 0) and forall(e, x -> x is not null and not isnan(x) and abs(x) < float('inf'))"
    base = base.where(good)
    dims = base.groupBy(F.size("e").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    nothing = spark.createDataFrame([], f"{vec_id} {kind}, neighbour_id {kind}, cosine double")
    if not dims:
        return nothing
    dim = dims[0].d
    base = base.where(F.size("e") == dim)
    sample_rows = min(sample_rows, max(LEAF_ROWS, SAMPLE_BYTES // (8 * dim)))

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "v"])

    every = materialise(base.mapInArrow(to_bytes, "id bigint, v binary").groupBy("id").agg(F.min("v").alias("v")))
    reps = materialise(every.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    n = reps.count()

    leaves = max(1, min(math.ceil(n / leaf_rows), math.ceil(sample_rows / SAMPLE_PER_LEAF)))
    wanted = min(sample_rows, leaves * SAMPLE_PER_LEAF)
    share = min(1.0, 1.2 * wanted / n)
    drawn = reps.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(wanted).select("v").toArrow()
    tree = fit_tree(unit_rows(drawn["v"].to_pylist(), dim), SAMPLE_PER_LEAF) if drawn.num_rows else Tree(np.zeros((1, dim)), [[]], np.array([0]))
    filed = materialise(_filed(spread(reps), tree))
    far = calibrate(filed, tree, k, least, CALIBRATION_ROWS, n, recall)

    # Leaves are numbered from the root down, so those of a group are near each other.
    groups = max(1, min(tree.leaves, max(2 * slots(spark), math.ceil(n / GROUP_ROWS))))
    of_group = lambda leaf: leaf * groups // tree.leaves

    def visited(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and group of each part of the visits of a batch, where it ends, and the leaves of all parts."""
        found = [tree.within(unit_rows(v.slice(at, WALK_ROWS).to_pylist(), dim), far) for at in range(0, len(v), WALK_ROWS)]
        row = np.concatenate([x + k_part * WALK_ROWS for k_part, (x, _) in enumerate(found)])
        leaf = np.concatenate([x for _, x in found])
        order = np.lexsort((leaf, row))
        row, leaf = row[order], leaf[order]
        group = of_group(leaf)
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (group[1:] != group[:-1])]))
        return row[first], group[first], np.append(first, len(leaf)), leaf

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, group, ends, leaf = visited(b.column(1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf, pa.int32()))
                for at in range(0, len(row), WALK_ROWS):
                    part = slice(at, at + WALK_ROWS)
                    to = pa.array(row[part], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(to), b.column(1).take(to), pa.array(group[part], pa.int32()), lists[part]], ["id", "v", "g", "leaves"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(groups, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(visited(b.column(1))[1], minlength=groups)
        g = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(n[g], pa.int64())], ["g", "n"])

    # Only those who ask: classes of copies that hold an asking vector.
    asking = every if queries is None else every.withColumnRenamed("id", vec_id).where(queries).withColumnRenamed(vec_id, "id")
    askers = reps if queries is None else reps.join(asking.select("v").distinct(), "v", "left_semi")
    askers = spread(askers.select("id", "v"))
    counted = max(1, n // COUNTED_ROWS)
    walks = askers.mapInArrow(walk, "id bigint, v binary, g int, leaves array<int>")
    filed = filed.withColumn("g", F.floor(F.col("leaf") * groups / tree.leaves).cast("int"))
    # Two counts a group decide into how many blocks its vectors and its visits are cut: that of visits from a part of the queries, as
    # only the size of blocks depends on it. The number of groups is bounded.
    held = {r.g: r["count"] for r in filed.groupBy("g").count().collect()}
    asked = {r.g: r.n for r in askers.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(counted)) == 0).mapInArrow(tally, "g int, n bigint").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame([(g, math.ceil(c / GROUP_ROWS), max(1, math.ceil(counted * asked.get(g, 0) / GROUP_ROWS))) for g, c in held.items()], "g int, ms int, qs int")
    plan = F.broadcast(plan)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    answers = filed.join(plan, "g").select("g", part("id", "ms").alias("m"), upto("qs").alias("b"), "id", "v", "leaf")
    asks = walks.join(plan, "g").select("g", upto("ms").alias("m"), part("id", "qs").alias("b"), "id", "v", "leaves")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            found += group_neighbours(left["id"].to_numpy(), unit_rows(left["v"].to_pylist(), dim), left["leaves"].to_pylist(), right["id"].to_numpy(), unit_rows(right["v"].to_pylist(), dim), right["leaf"].to_numpy(), k, least)
        a, c, s = first_k(*(np.concatenate(x) for x in zip(*found)), k)
        return pa.table({"q": pa.array(a, pa.int64()), "n": pa.array(c, pa.int64()), "cos": pa.array(s, pa.float64())})

    key = ["g", "m", "b"]
    near = asks.groupBy(*key).cogroup(answers.groupBy(*key)).applyInArrow(meet, "q bigint, n bigint, cos double")
    near = _best(near, k)

    # Copies: the first k + 1 ids of every class stand for it. The largest class decides into how many parts classes are salted.
    salts = max(2, math.ceil((reps.agg(F.max("copies")).first()[0] or 0) / SALT_ROWS))
    twins = reps.where("copies > 1").select("v", F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = every.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(twins, ["v", "salt"]).select("rep", "id")
    order = Window.partitionBy("rep").orderBy("id")
    firsts = members.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("rep", "id")
    single = reps.where("copies = 1").select(F.col("id").alias("rep"), "id")
    shown = firsts.unionByName(single)
    lists = near.join(shown.withColumnRenamed("rep", "n"), "n").select("q", F.col("id").alias("n"), "cos")
    lists = lists.unionByName(firsts.select(F.col("rep").alias("q"), F.col("id").alias("n"), F.lit(1.0).alias("cos")))
    lists = _best(lists, k + 1).groupBy("q").agg(F.sort_array(F.collect_list(F.struct((-F.col("cos")).alias("c"), "n"))).alias("l"))
    everyone = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).unionByName(single.withColumn("salt", F.lit(0)))
    if queries is not None:
        everyone = everyone.join(asking.select("id"), "id", "left_semi")
    # A class of copies may hold a third of all rows: its list is salted, so that no task gets all of them.
    copied = lists.join(reps.where("copies > 1").select(F.col("id").alias("q")), "q", "left_semi")
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(1), F.lit(salts - 1)))).unionByName(lists.withColumn("salt", F.lit(0)))
    own = everyone.join(salted.withColumnRenamed("q", "rep"), ["rep", "salt"]).select("id", F.expr(f"slice(filter(l, x -> x.n != id), 1, {k})").alias("l"))
    return own.select("id", F.explode("l").alias("x")).select(F.col("id").cast(kind).alias(vec_id), F.col("x.n").cast(kind).alias("neighbour_id"), (-F.col("x.c")).alias("cosine"))


def brute_force(frame: pd.DataFrame, vec_id: str, embedding: str, k: int, least: float) -> set[tuple[int, int]]:
    """The same neighbours by comparing every pair, for tests and for measuring recall."""
    rows = {}
    for i, e in zip(frame[vec_id], frame[embedding]):
        if isinstance(e, (list, np.ndarray)) and len(e):
            one = np.array([np.nan if v is None or v is pd.NA else v for v in e], dtype=np.float32)
            if np.isfinite(one).all() and one.any():
                rows[int(i)] = one
    ids = np.array(sorted(rows))
    x = unit_rows([rows[i].tobytes() for i in ids], len(rows[ids[0]]))
    out = set()
    for at in range(0, len(ids), BLOCK_ROWS):
        a, c, _ = block_neighbours(ids[at : at + BLOCK_ROWS], x[at : at + BLOCK_ROWS], ids, x, k, least)
        out |= set(zip(a.tolist(), c.tolist()))
    return out
