"""Exact top-k inner-product search with ball trees per shard of vectors.

Trees of bounded size are built once and stored; each block of queries then searches all of them.

A node of centre c and radius r has no vector whose product with q exceeds
q.c + |q| r. Nodes are visited in the order of that bound, and left out once it is below
the query's k-th best score so far, which all trees of a task share and which starts
from a bound that a few vectors have set for all tasks. Queries go through a tree together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.llm.common import stored

#: Vectors in a leaf, vectors and bytes in a tree, queries in a block on average, vectors that set the first bound.
LEAF, TREE, TREE_BYTES, BLOCK, SEED = 128, 16_384, 16_000_000, 4_096, 2_048
LOW = np.iinfo(np.int64).min + 1  # can be negated


def scaled(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), x as double. Beyond 64 bits the values are held at the ends."""
    return np.clip(np.floor(flat.astype(np.float64) * scale), -(2.0**62), 2.0**62).astype(np.int64)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products of the rows of q and x, exact; held at the ends of 64 bits."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ x.T.astype(object)
    return np.clip(exact, LOW + 1, -LOW).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far: higher scores first, then smaller ids."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.query_ids, self.k = ids, k
        self.score = np.full((len(ids), k), LOW)
        self.id = np.full((len(ids), k), -LOW - 1)
        self.floor = np.full(len(ids), LOW) if floor is None else floor

    def bound(self, rows):
        """What a score has to reach; one that equals it can still win by its id."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(self.query_ids[rows][:, None] == ids[None, :], LOW, scores)
        some = (scores >= self.bound(rows)[:, None]).any(1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        score = np.concatenate((self.score[rows], scores), 1)
        which = np.concatenate((self.id[rows], np.broadcast_to(ids, scores.shape)), 1)
        order = np.lexsort((which, -score))[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(which, order, 1)


class BallTree:
    """Vectors in the order of a tree's leaves, and its nodes: centre, radius, first and past the last vector, children (0: none)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, centre: np.ndarray, radius: np.ndarray, links: np.ndarray):
        self.ids, self.x, self.centre, self.radius, self.links = ids, x, centre, radius, links

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> "BallTree":
        order = np.arange(len(ids))
        centres, radii, links = [], [], []
        todo = [(0, len(ids), -1, 0)]
        while todo:
            low, high, parent, side = todo.pop()
            own = x[order[low:high]].astype(np.float64)
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            node = len(links)
            centres.append(centre)
            radii.append(float(away.max()))
            links.append([low, high, 0, 0])
            if parent >= 0:
                links[parent][2 + side] = node
            if high - low > LEAF and radii[-1] > 0:
                one = own[away.argmax()]
                far = own[((own - one) ** 2).sum(1).argmax()]
                middle = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(own @ (far - one), middle)]
                todo += [(low, low + middle, node, 0), (low + middle, high, node, 1)]
        return cls(ids[order], x[order], np.array(centres), np.array(radii), np.array(links, np.int64))

    def search(self, q: np.ndarray, best: Best) -> None:
        float_q = q.astype(np.float64)
        norm = np.sqrt((float_q**2).sum(1))
        slack = 1 + 1e-9 * norm * (np.abs(self.x).max(initial=0) + 1.0) * q.shape[1]  # for rounding

        def upper(node, rows):
            return float_q[rows] @ self.centre[node] + norm[rows] * self.radius[node] + slack[rows]

        def visit(node, rows, bound):
            rows = rows[bound >= best.bound(rows)]
            if not len(rows):
                return
            low, high, a, b = self.links[node]
            if not a:
                best.offer(rows, products(q[rows], self.x[low:high]), self.ids[low:high])
                return
            upper_a, upper_b = upper(a, rows), upper(b, rows)
            first = upper_a >= upper_b
            for go in (first, ~first):  # each query takes the child of the higher bound first
                one, two = (a, b) if go is first else (b, a)
                bounds = (upper_a, upper_b) if go is first else (upper_b, upper_a)
                visit(one, rows[go], bounds[0][go])
                visit(two, rows[go], bounds[1][go])

        rows = np.arange(len(q))
        visit(0, rows, upper(0, rows))


def trees(rows: DataFrame, scale: float) -> DataFrame:
    """(d, ids, x, centre, radius, links): ball trees over all vectors (vec_id, vector) of each partition, their arrays as bytes."""

    def made(batches):
        held: dict[int, list] = {}

        def flush(d):
            own, x = (np.concatenate(c) for c in zip(*held.pop(d)))
            t = BallTree.build(own, x)
            return pa.RecordBatch.from_arrays([pa.array([d]), *(pa.array([a.tobytes()], pa.binary()) for a in (t.ids, t.x, t.centre, t.radius, t.links))], ["d", "ids", "x", "centre", "radius", "links"])

        for batch in batches:
            own = batch.column("vec_id").to_numpy(zero_copy_only=False)
            for d, at, x in _matrix(batch.column("vector"), scale):
                size = max(1, min(TREE, TREE_BYTES // (8 * d)))
                for s in range(0, len(at), size):
                    held.setdefault(d, []).append((own[at[s : s + size]], x[s : s + size]))
                    if sum(len(i) for i, _ in held[d]) >= size:
                        yield flush(d)
        for d in sorted(held):
            yield flush(d)

    return rows.mapInArrow(made, "d long, ids binary, x binary, centre binary, radius binary, links binary")


def _matrix(column: pa.Array, scale: float):
    """Row numbers and scaled vectors, by the number of components."""
    size = column.value_lengths().to_numpy()
    flat, edges = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        yield int(d), rows, scaled(flat[edges[rows][:, None] + np.arange(d)], scale)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    finite = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    two = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return two.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _search_block(forest: DataFrame, queries: pa.Table, k: int, scale: float) -> DataFrame:
    ids = queries.column("vec_id").combine_chunks().to_numpy()
    by_size, floors = {}, {}
    for d, at, q in _matrix(queries.column("vector").combine_chunks(), scale):
        first = Best(ids[at], k)
        for s in range(0, min(len(at), SEED), LEAF):
            part = slice(s, min(s + LEAF, SEED, len(at)))
            first.offer(np.arange(len(at)), products(q, q[part]), ids[at][part])
        by_size[d], floors[d] = (at, q), first.score[:, -1]
    shared = forest.sparkSession.sparkContext.broadcast((ids, by_size, floors))  # one block of queries

    def search(batches):
        ids, by_size, floors = shared.value
        best = {d: Best(ids[at], k, floors[d]) for d, (at, _) in by_size.items()}
        for batch in batches:
            for row in range(len(batch)):
                d = batch.column("d")[row].as_py()
                if d not in by_size:
                    continue
                own, x, centre, radius, links = (np.frombuffer(batch.column(c)[row].as_buffer(), t) for c, t in (("ids", "<i8"), ("x", "<i8"), ("centre", "<f8"), ("radius", "<f8"), ("links", "<i8")))
                BallTree(own, x.reshape(-1, d), centre.reshape(-1, d), radius, links.reshape(-1, 4)).search(by_size[d][1], best[d])
        for d in by_size:
            b = best[d]
            q, r = np.nonzero((b.score > LOW) & (b.score >= b.floor[:, None]))
            at = by_size[d][0][q]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids[at]), pa.array(b.id[q, r]), pa.array(b.score[q, r])], ["query_row", "query_id", "vec_id", "score"])

    found = forest.mapInArrow(search, "query_row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query row.

    Components become floor(scale * x). Every row but those of the query's own id is a
    candidate; ties go to the smaller id, and fewer candidates give fewer rows.
    Vectors that are null, empty or hold null or non-finite components, and rows without an id, take no
    part; vectors of another size than the query's aren't its candidates. Repeated
    query rows are answered one by one. Queries are worked off in blocks of bounded size, each against all rows.
    """
    rows = _usable(vectors, id_col, vector_col)
    asked = _usable(vectors.where(is_query), id_col, vector_col)
    count = asked.count()
    blocks = -(-count // BLOCK)
    if not blocks:
        return rows.selectExpr("vec_id AS query_id", "1 AS rank", "vec_id", "vec_id AS score").limit(0)
    forest = stored(trees(rows, scale), "trees")
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        found = _search_block(forest, own.toArrow(), k, scale)
        if blocks > 1:
            found = stored(found, "top_k")
        out = found if out is None else out.unionAll(found)
    return out
