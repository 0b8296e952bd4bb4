"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: with one more coordinate sqrt(R2 - |x|^2), R2 the largest squared norm, all vectors
lie on a sphere, and the query's (with 0 there) nearest vectors are those with the largest products. Vectors are dealt
out by their nearest coarse pivot and each share becomes an M-tree of pages with pivots, covering radii and distances
to the parent's pivot; a tree is one row of a table in the shared folder. Each tree has a number; blocks of queries
are dealt to the tasks by the numbers of the trees that they are to search, so no key is hot and nothing is broadcast.

Vectors are integers held as doubles. Where products may pass 2 ** 53 they are computed with Python's integers.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, lean

#: Vectors in a tree, in a leaf page, children of a node, queries in a block, coarse pivots.
TREE, PAGE, FAN, BLOCK, PIVOTS = 16384, 128, 16, 2048, 64
#: Below it, sums of integers held as doubles are exact; what a score can be at most.
EXACT, MOST = 2.0**53, 2**63 - 1


class Tree:
    """An M-tree over integer vectors. Nodes are numbered from the root 0; a leaf holds a slice of the vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        v = vectors.astype(np.float64)
        square = (v * v).sum(axis=1)
        # vectors too long for distances to be told apart lie in one page that is always read
        self.r2 = r2 = float(square.max(initial=0.0))
        self.flat = not r2 < 1e200
        extra = np.sqrt(np.maximum(0, r2 - square)) if not self.flat else np.zeros(len(v))
        if self.flat:
            v = np.zeros_like(v)
        full = np.column_stack((v, extra))
        rng = np.random.default_rng(7)
        order, self.children = [], []
        pivot, radius, to_parent, leaf = [], [], [], []
        entry = np.zeros(len(ids))
        todo = [(np.arange(len(ids)), int(rng.integers(len(ids))), -1)]
        while todo:
            own, p, parent = todo.pop()
            node = len(pivot)
            away = np.sqrt(((full[own] - full[p]) ** 2).sum(axis=1))
            pivot.append(p)
            radius.append(float(away.max()))
            to_parent.append(float(np.sqrt(((full[p] - full[pivot[parent]]) ** 2).sum())) if parent >= 0 else 0.0)
            self.children.append([])
            leaf.append((0, 0))
            if parent >= 0:
                self.children[parent].append(node)
            if len(own) <= PAGE:
                leaf[node] = (len(order), len(order) + len(own))
                order += own.tolist()
                entry[own] = away
                continue
            seeds = rng.choice(own, min(FAN, -(-len(own) // PAGE)), replace=False)
            nearest = ((full[own][:, None, :] - full[seeds][None]) ** 2).sum(axis=2).argmin(axis=1) if len(own) < 2000 else self._nearest(full, own, seeds)
            parts = [(own[nearest == k], int(s)) for k, s in enumerate(seeds)]
            if max(len(x) for x, _ in parts) == len(own):  # equal vectors: no pivot parts them
                parts = [(x, int(x[0])) for x in np.array_split(own, len(seeds))]
            todo += [(x, s, node) for x, s in parts if len(x)]
        self.ids, self.vectors, self.entry = ids[order], vectors[order], entry[order]
        self.pivots = full[pivot]
        self.radius, self.to_parent, self.leaf = np.array(radius), np.array(to_parent), leaf
        self.children = [np.array(c, np.int64) for c in self.children]

    @staticmethod
    def _nearest(full, own, seeds):
        square = (full[seeds] ** 2).sum(axis=1)
        return (square - 2 * full[own] @ full[seeds].T).argmin(axis=1)

    def search(self, own_id: int, q: np.ndarray, k: int, least: float) -> list[tuple[float, int]]:
        """The k best (score, -id) over all vectors but those with the query's own id, of scores of `least` at least."""
        with np.errstate(over="ignore"):
            q2 = float(q @ q)
        if self.flat or not q2 < 1e200:
            return self._read(own_id, q, k)
        exact = self.r2 * q2 < EXACT**2
        slack = 1e-6 * (np.sqrt(self.r2) + np.sqrt(q2) + 1)
        base = self.r2 + q2
        found: list[tuple[float, int]] = []
        reach = np.sqrt(max(0.0, base - 2 * least)) + slack if least > -np.inf else np.inf
        q_full = np.append(q, 0.0)
        d = float(np.sqrt(((self.pivots[0] - q_full) ** 2).sum()))
        heap = [(max(0.0, d - self.radius[0]), 0, d)]
        while heap:
            bound, node, d = heapq.heappop(heap)
            if bound > reach:
                break
            a, b = self.leaf[node]
            if b > a:
                near = np.flatnonzero(np.abs(d - self.entry[a:b]) <= reach) + a  # the triangle inequality spares the rest
                scores = self.vectors[near] @ q if exact else products(self.vectors[near], q)
                for i in np.flatnonzero(scores >= least).tolist():
                    item = (float(scores[i]) if exact else scores[i], -int(self.ids[near[i]]))
                    if item[1] == -own_id:
                        continue
                    if len(found) < k:
                        heapq.heappush(found, item)
                    elif item > found[0]:
                        heapq.heapreplace(found, item)
                if len(found) == k and found[0][0] > least:
                    least = found[0][0]
                    reach = np.sqrt(max(0.0, base - 2 * least)) + slack
                continue
            kids = self.children[node]
            kids = kids[np.abs(d - self.to_parent[kids]) - self.radius[kids] <= reach]
            away = np.sqrt(((self.pivots[kids] - q_full) ** 2).sum(axis=1))
            bounds = np.maximum(0.0, away - self.radius[kids])
            for i in np.flatnonzero(bounds <= reach).tolist():
                heapq.heappush(heap, (float(bounds[i]), int(kids[i]), float(away[i])))
        return found

    def _read(self, own_id: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        others = np.flatnonzero(self.ids != own_id)
        scores = products(self.vectors[others], q)
        return heapq.nlargest(k, ((s, -int(i)) for s, i in zip(scores, self.ids[others])))


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integers held as doubles, as Python's integers: exact, or the nearest that a long can hold."""
    whole = [int(x) for x in q.tolist()]
    return np.array([max(-MOST, min(MOST, sum(int(x) * y for x, y in zip(v, whole)))) for v in vectors.tolist()], object)


def _load(blob: bytes) -> Tree:
    tree = pickle.loads(blob)
    tree.vectors = tree.vectors.astype(np.float64)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _boundless(seed: float) -> float:
    return seed if abs(seed) < EXACT else -np.inf


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector"
) -> DataFrame:
    """For each query its k largest integer inner products over all vectors but its own: query_id, rank (from 1),
    vec_id, score; ties go to the smaller id.

    vectors: id and an array of whole numbers (of any numeric type; null, infinite and NaN ones take the vector out, as
    does a null id or array); queries: ids of the vectors that are queries. Rows that repeat an id are vectors each,
    and none of them is a candidate for another; where a query's id is repeated, the products of all its rows are
    ranked together. Vectors of unlike length meet only those of their own length. Products are exact, and
    those beyond what a long can hold count as the nearest long. Other columns are ignored. Empty tables give an empty
    result."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "metric")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    wanted = queries.select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("q")).distinct()
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.join(wanted, "id", "left").select(
        "id", "v", F.coalesce("q", F.lit(False)).alias("q"), F.size("v").alias("d"), (square >= 1e30).alias("long")
    )
    rows = scratch.write(rows, "vectors")
    total = rows.count()
    pivots: dict[int, list] = {}
    for r in rows.where("not long").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).select("d", "v").collect():  # a fixed number of rows
        pivots.setdefault(r.d, []).append(r.v)
    pivots = {d: np.array(v, np.float64) for d, v in pivots.items()}

    def cells(batches):
        for batch in batches:
            size = np.asarray(batch.column(3))
            cell = np.zeros(batch.num_rows, np.int32)
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                if d in pivots and d:
                    x, p = _matrix(batch.column(1).take(pa.array(at))), pivots[d]
                    with np.errstate(all="ignore"):
                        cell[at] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    shares = max(1, -(-total // (TREE * 3 // 4)))

    def trees(batches):
        share, made = TaskContext.get().partitionId(), 0

        def grown(table):
            nonlocal made
            ids, size, ask = (np.asarray(table[c].combine_chunks()) for c in ("id", "d", "q"))
            far = np.asarray(table["long"].combine_chunks().cast(pa.int8()))
            for d, beyond in np.unique(np.column_stack((size, far)), axis=0).tolist():
                at = np.flatnonzero((size == d) & (far == beyond))
                v = _matrix(table["v"].combine_chunks().take(pa.array(at)))
                with np.errstate(over="ignore"):
                    tree = Tree(ids[at], v)
                asks = np.flatnonzero(ask[at])
                seeds = []
                for i in asks.tolist():
                    best = tree.search(int(ids[at][i]), v[i], k, -np.inf)
                    seeds.append(_boundless(float(min(best)[0])) if len(best) == k else -np.inf)
                if np.abs(v).max(initial=0) < 2**15:
                    tree.vectors = tree.vectors.astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d], pa.int32()), pa.array([share + shares * made], pa.int64()), pa.array([pickle.dumps(tree)], pa.binary()),
                        pa.array([pickle.dumps((ids[at][asks], v[asks], np.array(seeds)))], pa.binary()),
                    ],
                    ["d", "number", "tree", "asks"],
                )
                made += 1

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= 2 * TREE:
                table = pa.Table.from_batches(held)
                yield from grown(table.slice(0, TREE))
                held, n = table.slice(TREE).to_batches(), n - TREE
        if n:
            yield from grown(pa.Table.from_batches(held))

    celled = rows.mapInArrow(lean(cells), "id long, v array<double>, q boolean, d int, long boolean, cell int")
    spread = celled.repartitionByRange(shares, "long", "d", "cell", "id").sortWithinPartitions("long", "d", "cell", "id")
    forest = scratch.write(spread.mapInArrow(lean(trees), "d int, number long, tree binary, asks binary"), "forest")
    last = forest.agg(F.max("number")).first()[0]
    if last is None:
        last = -1

    def packed(batches):
        held: dict[int, list] = {}

        def out(d):
            ids, v, seeds = zip(*held.pop(d), strict=True)
            every = [np.concatenate(x) for x in (ids, v, seeds)]
            for i in range(0, len(every[0]), BLOCK):
                blob = pickle.dumps(tuple(x[i : i + BLOCK] for x in every))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([blob], pa.binary())], ["d", "block"])

        for batch in batches:
            for d, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, v, seeds = pickle.loads(blob)
                if len(ids):
                    held.setdefault(d, []).append((ids, v, seeds))
                    if sum(len(x[0]) for x in held[d]) >= BLOCK:
                        yield from out(d)
        for d in list(held):
            yield from out(d)

    asks = forest.select("d", "asks").coalesce(max(1, shares // 8))
    blocks = scratch.write(asks.mapInArrow(lean(packed), "d int, block binary"), "blocks")

    def search(batches):
        """Rows by tree number: first the tree, then the blocks of queries that are to search it."""
        tree, number, size = None, None, None
        for batch in batches:
            for n, d, own, block in zip(*(batch.column(c).to_pylist() for c in ("number", "d", "tree", "block")), strict=True):
                if own is not None:
                    tree, number, size = _load(own), n, d
                    continue
                if n != number or d != size:  # no tree has that number, or its vectors have another length
                    continue
                found = []
                for i, q, seed in zip(*pickle.loads(block), strict=True):
                    found += [(int(i), -m, int(s)) for s, m in tree.search(int(i), q, k, float(seed))]
                columns = zip(*found, strict=True) if found else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    # the stated query set, in blocks, against all rows, in trees
    none = F.lit(None).cast("binary")
    sent = blocks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("number") if last >= 0 else F.lit(0).cast("long").alias("number"), "d", none.alias("tree"), "block")
    both = forest.select("number", "d", "tree", none.alias("block")).union(sent)
    met = both.repartition(max(1, last + 1), "number").sortWithinPartitions("number", F.col("block").isNotNull())
    found = met.mapInArrow(lean(search), "query_id long, vec_id long, score long")
    ranked = found.selectExpr(
        "*", "row_number() over (partition by query_id order by score desc, vec_id) as rank"
    ).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
