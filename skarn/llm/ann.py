"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (FIT_ROWS vectors of the smallest hash of their id); every row
is then assigned to a leaf. A query walks the tree with a priority queue ordered by the greatest inner
product a bin can hold (centre product plus query norm times bin radius, radii widened to all rows),
which gives its leaves in order. How many leaves are visited is calibrated: calibration queries are
answered exactly over all rows in blocks, and visits widen until their recall reaches the target. A
query goes on beyond that until its leaves hold k rows besides its own.

Neighbouring leaves are put together in packs of about BLOCK_ROWS rows; a larger leaf is cut into blocks
of that size, and the queries that visit a pack into blocks of about QUERY_ROWS, so that neither a leaf of
very many equal vectors nor one that very many queries visit is one task's work. A block scores the
leaves that a query visits, and answers with at most k rows a query; a query's blocks are merged.
Products by matrices find what may be among the k best; these are scored again component by component
in double precision, in one order everywhere, so that equal vectors tie exactly, and ties go to the
smaller id.

Vectors that are null, empty, zero, of another length than most of the sample's, or that hold null
or non-finite components take no part. Null ids take no part. Repeated ids stay separate rows.
Fewer candidates than k: all are returned. An empty table gives no rows. Only the id and the vector
are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FIT_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 64
CALIBRATION, TARGET_RECALL = 96, 0.95
BLOCK_ROWS, QUERY_ROWS = 1 << 15, 1024  # of large blocks, few of a query's rows are not among its best
_STATE = 7


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and v, pair by pair, in double precision, summed in component order."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def k_best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows for each query, best first, ties to the smaller id.

    Rows of a query's own id are left out, and those that allowed(first query, last query) leaves out.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    norm = np.sqrt((vectors**2).sum(1)).max(initial=0)
    chunk = max(16, (1 << 21) // max(1, len(ids)))
    for a in range(0, len(queries) if len(ids) else 0, chunk):
        some = queries[a : a + chunk]
        rough = some @ vectors.T
        rough[own[a : a + chunk, None] == ids] = -np.inf
        if allowed is not None:
            rough[~allowed(a, a + len(some))] = -np.inf
        slack = 1e-15 * (queries.shape[1] + 8) * norm * np.sqrt((some**2).sum(1))  # more than rounding can differ
        edge = np.full(len(some), -np.inf)
        if len(ids) > k:
            edge = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] - slack
        q, r = np.nonzero((rough >= edge[:, None]) & (rough > -np.inf))
        scores = products(some[q], vectors[r])
        order = np.lexsort((ids[r], -scores, q))
        q, r, scores = q[order], r[order], scores[order]
        first = np.searchsorted(q, q)
        top = np.arange(len(q)) - first < k
        out.append((q[top] + a, r[top], scores[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


@dataclass
class Tree:
    """Nodes by number: centres, radii, children; leaves are numbered on their own."""

    centres: np.ndarray
    radii: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray  # leaf number or -1
    leaves: int = 0
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    rows: dict[int, int] = field(default_factory=dict)  # rows of each leaf's node
    pack: dict[int, int] = field(default_factory=dict)  # pack of each leaf's node

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child, from the root on."""
        node = np.zeros(len(vectors), np.int64)
        live = np.arange(len(vectors)) if self.leaf[0] < 0 else np.zeros(0, int)
        while len(live):
            for n in np.unique(node[live]):
                at = live[node[live] == n]
                kids = np.array(self.children[n])
                centres = self.centres[kids]
                node[at] = kids[np.argmin((centres**2).sum(1) - 2 * vectors[at] @ centres.T, axis=1)]
            live = live[self.leaf[node[live]] < 0]
        return node

    def visit(self, query: np.ndarray, limit: int, least: int = 0) -> list[int]:
        """Nodes of the first leaves, best bin first: limit of them, or as many more as hold least rows."""
        norm, found, rows = float(np.sqrt(query @ query)), [], 0
        queue = [(0.0, 0)]
        while queue and (len(found) < limit or rows < least):
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                found.append(n)
                rows += self.rows.get(n, 0)
                continue
            kids = self.children[n]
            bounds = self.centres[kids] @ query + norm * self.radii[kids]
            for kid, bound in zip(kids, bounds.tolist(), strict=True):
                if self.radii[kid] >= 0:  # a bin that holds any row
                    heapq.heappush(queue, (-bound, kid))
        return found


    def order(self) -> list[int]:
        """Nodes of the leaves that hold any row, neighbours together."""
        found, todo = [], [0]
        while todo:
            n = todo.pop()
            todo += self.children[n]
            if n in self.rows:
                found.append(n)
        return found


def fit_tree(sample: np.ndarray) -> Tree:
    """Splits by k-means until a bin is small or cannot be split."""
    rng = np.random.default_rng(_STATE)
    centres, children, leaf, parent = [sample.mean(0) if len(sample) else np.zeros(0)], [[]], [-1], [-1]
    todo, leaves = [(0, np.arange(len(sample)))], 0
    while todo:
        n, rows = todo.pop()
        own = sample[rows]
        distinct = np.unique(own, axis=0) if len(rows) > LEAF_ROWS else own[:0]
        if len(distinct) < 2:
            leaf[n] = leaves
            leaves += 1
            continue
        seeds = distinct[rng.choice(len(distinct), min(BRANCHES, len(distinct)), replace=False)]
        for _ in range(8):
            nearest = np.argmin((seeds**2).sum(1) - 2 * own @ seeds.T, axis=1)
            used = np.unique(nearest)
            seeds = np.stack([own[nearest == u].mean(0) for u in used])
        nearest = np.argmin((seeds**2).sum(1) - 2 * own @ seeds.T, axis=1)
        used = np.unique(nearest)
        if len(used) < 2:
            leaf[n] = leaves
            leaves += 1
            continue
        for u in used:
            children[n].append(len(centres))
            todo.append((len(centres), rows[nearest == u]))
            centres.append(seeds[u])
            children.append([])
            leaf.append(-1)
            parent.append(n)
    return Tree(np.array(centres), np.full(len(centres), -1.0), children, np.array(leaf), leaves, np.array(parent))


def usable(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and v (array<double>) of rows whose vector takes part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & good)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width) if len(column) else np.zeros((0, width))


def _exact(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> dict[int, list[tuple[float, int, int]]]:
    """Exact answers (score, id, node) of a stated, bounded set of queries over all rows, in blocks."""
    ids, vectors = queries

    def run(batches):
        for batch in batches:
            own, v, node = batch.column("id").to_numpy(), _matrix(batch.column("v"), vectors.shape[1]), batch.column("node").to_numpy()
            for a in range(0, len(own), BLOCK_ROWS):
                part = slice(a, a + BLOCK_ROWS)
                q, r, scores = k_best(vectors, ids, v[part], own[part], k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[q], scores, own[part][r], node[part][r].astype(np.int64))], ["q", "score", "id", "node"])

    got = rows.mapInArrow(run, "q long, score double, id long, node long")
    top = got.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k)
    answers: dict[int, list] = {}
    for r in top.collect():  # k rows for each calibration query
        answers.setdefault(r.q, []).append((r.score, r.id, r.node))
    return answers


@dataclass
class Index:
    rows: DataFrame  # id, v, node, pack, block
    tree: Tree
    width: int
    visits: int
    recall: float


def build(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, calibration=None, target: float = TARGET_RECALL) -> Index | None:
    """Fits the tree on a sample, indexes every row, and calibrates the number of leaves to visit."""
    rows = usable(table, id_col, vector)
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("id", "v").collect()  # bounded by FIT_ROWS
    if not chosen:
        return None
    lengths = np.bincount([len(r.v) for r in chosen])
    width = int(np.argmax(lengths))
    sample = np.array([r.v for r in chosen if len(r.v) == width])
    tree = fit_tree(sample)

    def assign(batches):
        for batch in batches:
            node = tree.assign(_matrix(batch.column("v"), width))
            distance = np.sqrt(((_matrix(batch.column("v"), width) - tree.centres[node]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(node), pa.array(distance)], ["id", "v", "node", "distance"])

    indexed = written(rows.filter(F.size("v") == width).mapInArrow(assign, "id long, v array<double>, node long, distance double"), "vectors")
    for r in indexed.groupBy("node").agg(F.max("distance").alias("far"), F.count("*").alias("n")).collect():  # a row for each leaf
        tree.radii[r.node], tree.rows[r.node] = r.far, r.n
    for n in range(len(tree.centres) - 1, 0, -1):  # parents come before children
        if tree.radii[n] >= 0:
            p = tree.parent[n]
            tree.radii[p] = max(tree.radii[p], float(np.linalg.norm(tree.centres[n] - tree.centres[p])) + tree.radii[n])
    packs, size = [], 0  # leaves by pack, in the order of the tree
    for n in tree.order():
        if packs and size + tree.rows[n] <= BLOCK_ROWS:
            packs[-1].append(n)
        else:
            packs.append([n])
            size = 0
        size += tree.rows[n]
    of = [(int(n), k, -(-tree.rows[n] // BLOCK_ROWS)) for k, own in enumerate(packs) for n in own]
    tree.pack = {n: k for n, k, _ in of}
    places = F.broadcast(table.sparkSession.createDataFrame(of, "node long, pack int, blocks int"))  # a row for each leaf
    indexed = indexed.join(places, "node").withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks").cast("long")).cast("int")).drop("blocks", "distance")

    asked = rows.filter((calibration if calibration is not None else F.lit(True)) & (F.size("v") == width)).orderBy(F.xxhash64("id", F.lit(3)), "id").limit(CALIBRATION).collect()
    visits, recall = tree.leaves, 1.0
    if asked:
        queries = (np.array([r.id for r in asked]), np.array([r.v for r in asked]))
        answers = _exact(indexed, queries, k)
        needed = []
        for q, v in zip(queries[0].tolist(), queries[1], strict=True):
            order = {n: i + 1 for i, n in enumerate(tree.visit(v, tree.leaves))}
            needed.append([order[node] for _, _, node in answers.get(q, [])])
        wanted = sum(map(len, needed))
        for visits in range(1, tree.leaves + 1):
            recall = sum(x <= visits for own in needed for x in own) / max(1, wanted)
            if recall >= target:
                break
    return Index(indexed, tree, width, visits, recall)


def search(index: Index | None, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (id, v), itself excepted."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast((index.tree, index.visits))  # bounded by FIT_ROWS
    width = index.width

    def visit(batches):
        tree, visits = shared.value
        for batch in batches:
            q, v = batch.column("id").to_numpy(), _matrix(batch.column("v"), width)
            for a in range(0, len(q), 256):
                out: list[tuple] = []  # query, pack, leaves
                for i, x in enumerate(v[a : a + 256], a):
                    by_pack: dict[int, list[int]] = {}
                    for n in tree.visit(x, visits, k + 1):
                        by_pack.setdefault(tree.pack[n], []).append(n)
                    out += [(i, p, own) for p, own in by_pack.items()]
                at, packs, leaves = zip(*out, strict=True)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("v").take(take), pa.array(packs, pa.int32()), pa.array(leaves, pa.list_(pa.int64()))], ["id", "v", "pack", "leaves"])

    asked = written(queries.filter(F.size("v") == width).select("id", "v").mapInArrow(visit, "id long, v array<double>, pack int, leaves array<long>"), "asked")
    # each block of a pack's queries meets each block of its rows
    of = asked.groupBy("pack").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("parts"))
    blocks = index.rows.groupBy("pack").agg((F.max("block") + 1).alias("blocks"))
    sizes = F.broadcast(written(of.join(blocks, "pack"), "packs"))  # a row for each pack
    asked = asked.join(sizes, "pack").withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts").cast("long")).cast("int"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("id", "v", "leaves", F.col("pack").alias("of"), F.col("block").alias("at"), "part")
    copies = F.broadcast(sizes.select("pack", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("copy")))
    rows = index.rows.join(copies, "pack")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, node, v = right.column("id").to_numpy(), right.column("node").to_numpy(), _matrix(right.column("v").combine_chunks(), width)
        q, x = left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks(), width)
        leaves, of_row = np.unique(node, return_inverse=True)
        lists = left.column("leaves").combine_chunks()
        visited = np.zeros((len(q), len(leaves) + 1), bool)
        if len(leaves):
            wanted = np.asarray(lists.flatten())
            at = np.minimum(np.searchsorted(leaves, wanted), len(leaves) - 1)
            visited[np.repeat(np.arange(len(q)), np.asarray(lists.value_lengths())), np.where(leaves[at] == wanted, at, len(leaves))] = True
        i, r, scores = k_best(x, q, v, ids, k, lambda a, b: visited[a:b][:, of_row])
        return pa.Table.from_arrays([pa.array(q[i]), pa.array(ids[r]), pa.array(scores)], ["query_id", "vec_id", "score"])

    near = asked.groupBy("of", "at", "part").cogroup(rows.groupBy("pack", "block", "copy")).applyInArrow(answer, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(table: DataFrame, every: int = 20, k: int = 20, target: float = TARGET_RECALL) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by every."""
    asks = F.col("id") % every == 0
    index = build(table, k=k, calibration=asks, target=target)
    return search(index, usable(table, "vec_id", "embedding").filter(asks), k)
