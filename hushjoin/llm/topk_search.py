"""Exact top-k inner-product search with ball trees.

Vectors become whole numbers (floor(1024 * x)) and are cut into shards, one ball tree each. Queries go over all shards in
blocks of fixed size, in one job: a task holds a block, and a run of shards streams through it. A node can hold no score
over q.c + |q| r, so nodes are taken in the order of that bound and left out when it is under the query's kth score so
far. That score is shared: every task starts from the kth scores within the first shard, which are found beforehand, and
carries its own from shard to shard.

Vectors that are null, empty or hold null or non-finite components take no part, as do null ids and vectors with a
component of MOST or more. Queries only meet vectors of their own length. Candidates with a query's id are left out; other
repeated ids count row by row. Where rows of one id are queries with different vectors, each vector is asked by itself and
its results carry that id; equal vectors are asked once. Scores beyond 64 bits are given as the nearest 64-bit number,
and tie. Ties go to the smaller id. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushjoin.llm.common import Scratch, bounded_batches, scratch_scope

SCALE = 1024
SHARD_ROWS = 4096
LEAF_ROWS = 128
BLOCK_QUERIES = 4096
SHARDS_PER_TASK = 32
MAX_LENGTHS = 10_000
#: Squares of components stay finite under it.
MOST = 1e150
EXACT, LONG = 1 << 53, (1 << 63) - 1
LOWEST = -LONG - 1


def usable(v: Column) -> Column:
    """Not null, not empty, all components finite and under MOST."""
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(MOST)))


def whole(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """id, dim and v (whole components, as doubles) of usable rows. Doubles hold floor(1024 * x) exactly, however large."""
    v = F.col(vec_col)
    scaled = lambda x: x.cast("double") * SCALE
    ints = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < float(EXACT), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return df.filter(usable(v) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), ints.alias("v"))


@dataclass
class BallTree:
    """Rows in leaf order; nodes as arrays: rows low..high, centre, radius, children (-1: leaf)."""

    low: list
    high: list
    centre: list
    radius: list
    left: list
    right: list
    order: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = LEAF_ROWS) -> BallTree:
        t = cls([], [], [], [], [], [], np.arange(len(x)))
        t._node(x, 0, len(x), leaf)
        return t

    def _node(self, x: np.ndarray, low: int, high: int, leaf: int) -> int:
        rows = self.order[low:high]
        part = x[rows]
        centre = part.mean(axis=0)
        gap = np.sqrt(((part - centre) ** 2).sum(axis=1))
        me = len(self.low)
        for name, value in (("low", low), ("high", high), ("centre", centre), ("radius", float(gap.max())), ("left", -1), ("right", -1)):
            getattr(self, name).append(value)
        if high - low > leaf and gap.max() > 0:
            one = part[gap.argmax()]
            other = part[((part - one) ** 2).sum(axis=1).argmax()]
            side = part @ (other - one)
            rank = np.argsort(side, kind="stable")
            self.order[low:high] = rows[rank]
            mid = (low + high) // 2
            self.left[me] = self._node(x, low, mid, leaf)
            self.right[me] = self._node(x, mid, high, leaf)
        return me


class Best:
    """The k best scores of each query so far, best first, ties by id. Of `floor` it is known that no kth score is under it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.q, self.k, self.floor = ids, q, k, floor
        self.score = np.full((len(ids), k), LOWEST, np.int64)
        self.row = np.full((len(ids), k), LONG, np.int64)
        self.norm = np.sqrt((q**2).sum(axis=1))

    def kth(self, sub: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[sub, -1], self.floor[sub])

    def bound(self, sub: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
        at, far = self.q[sub] @ centre, self.norm[sub] * radius
        return at + far + 1e-9 * (np.abs(at) + far + self.norm[sub] * np.sqrt((centre**2).sum())) + 1

    def offer(self, sub: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: (queries of sub, ids), int64."""
        free = ids[None, :] != self.ids[sub, None]
        near = free & (scores >= self.kth(sub)[:, None])
        for n in np.flatnonzero(near.any(axis=1)).tolist():
            i, hits = sub[n], np.flatnonzero(near[n])
            all_s, all_i = np.r_[self.score[i], scores[n, hits]], np.r_[self.row[i], ids[hits]]
            top = np.lexsort((all_i, ~all_s))[: self.k]  # ~ turns the order round without overflow
            self.score[i], self.row[i] = all_s[top], all_i[top]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact whole inner products as 64-bit integers: in doubles while they are exact there, else in integers of any size,
    with what is beyond 64 bits cut to the nearest."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    if most < LONG:
        return q.astype(np.int64) @ x.T.astype(np.int64)
    exact = (lambda a: np.array([[int(c) for c in row] for row in a.tolist()], object).reshape(a.shape))
    return np.clip(exact(q) @ exact(x).T, LOWEST, LONG).astype(np.int64)


def search_tree(tree: BallTree, x: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Branch and bound of all queries of best together; each subset takes the child with the higher bound first."""

    def visit(node: int, sub: np.ndarray) -> None:
        if len(sub):
            sub = sub[best.bound(sub, tree.centre[node], tree.radius[node]) >= best.kth(sub)]
        if not len(sub):
            return
        a, b = tree.left[node], tree.right[node]
        if a < 0:
            rows = tree.order[tree.low[node] : tree.high[node]]
            best.offer(sub, ids[rows], products(best.q[sub], x[rows]))
            return
        first = best.bound(sub, tree.centre[a], tree.radius[a]) >= best.bound(sub, tree.centre[b], tree.radius[b])
        visit(a, sub[first])
        visit(b, sub[first])
        visit(b, sub[~first])
        visit(a, sub[~first])

    visit(0, np.arange(len(best.ids)))


def build_shards(vectors: DataFrame) -> DataFrame:
    """One row a shard of at most SHARD_ROWS vectors of one length, with its tree and a number, the same whenever a task runs again."""
    from pyspark import TaskContext

    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("tree", pa.binary())])

    def packed(dim, number, ids, rows):
        x = np.stack(rows)
        one = {"dim": [dim], "shard": [number], "ids": [np.array(ids, np.int64).tobytes()], "v": [x.tobytes()], "tree": [pickle.dumps(BallTree.build(x))]}
        return pa.RecordBatch.from_pydict(one, schema)

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            flat, off = batch.column("v").flatten().to_numpy(zero_copy_only=False), 0
            for i, dim in zip(batch.column("id").to_pylist(), batch.column("dim").to_pylist()):
                ids, rows = held.setdefault(dim, ([], []))
                ids.append(i)
                rows.append(flat[off : off + dim])
                off += dim
                if len(ids) >= SHARD_ROWS:
                    yield packed(dim, number, *held.pop(dim))
                    number += 1
        for dim, (ids, rows) in held.items():
            yield packed(dim, number, ids, rows)
            number += 1

    return vectors.mapInArrow(run, "dim int, shard long, ids binary, v binary, tree binary")


_CELL = ("dim", "block", "run", "role", "query", "id", "floor", "ids", "v", "tree")


def _grid(asked: DataFrame, shards: DataFrame, scratch: Scratch) -> DataFrame:
    """dim, blocks and runs: one row a vector length, broadcast while there are at most MAX_LENGTHS of them."""
    size = lambda n: F.ceil(F.count("*") / n).cast("int")
    blocks = asked.groupBy("dim").agg(size(BLOCK_QUERIES).alias("blocks"))
    out = scratch.write(blocks.join(shards.groupBy("dim").agg(size(SHARDS_PER_TASK).alias("runs")), "dim"))
    return F.broadcast(out) if out.count() <= MAX_LENGTHS else out


def search(asked: DataFrame, shards: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """query, query_id, vec_id, score: the k best of each task for each query.

    asked: dim, query (a number of its own), id, v (binary) and floor. A cell of a block of queries and a run of shards is one
    task's: its queries come first, then the shards stream past them.
    """
    grid = _grid(asked, shards, scratch)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    own = lambda c, n, name: F.pmod(F.xxhash64(c), F.col(n)).cast("int").alias(name)
    none, raw = F.lit(None).cast("long"), F.lit(None).cast("binary")
    waiting = asked.join(grid, "dim").select("dim", own("query", "blocks", "block"), every("runs", "run"), F.lit(0).alias("role"), "query", "id", "floor", raw.alias("ids"), "v", raw.alias("tree"))
    passing = shards.join(grid, "dim").select("dim", every("blocks", "block"), own("shard", "runs", "run"), F.lit(1).alias("role"), none.alias("query"), none.alias("id"), none.alias("floor"), "ids", "v", "tree")
    cells = waiting.union(passing).repartition("dim", "block", "run").sortWithinPartitions("dim", "block", "run", "role")
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        cell, best, held = None, None, []

        def results():
            if best is not None:
                q, rank = np.nonzero(best.row < LONG)
                numbers = np.array([h[0] for h in held], np.int64)
                yield pa.RecordBatch.from_pydict({"query": numbers[q], "query_id": best.ids[q], "vec_id": best.row[q, rank], "score": best.score[q, rank]}, schema)

        for batch in batches:
            for dim, block, run, role, query, i, floor, ids, v, tree in zip(*(batch.column(c) for c in _CELL)):
                here = (dim.as_py(), block.as_py(), run.as_py())
                if here != cell:
                    yield from results()
                    cell, best, held = here, None, []
                if role.as_py() == 0:
                    held.append((query.as_py(), i.as_py(), floor.as_py(), np.frombuffer(v.as_py())))
                elif held:
                    if best is None:
                        _, asking, floors, vectors = zip(*held)
                        best = Best(np.array(asking, np.int64), np.stack(vectors), k, np.array(floors, np.int64))
                    own = np.frombuffer(ids.as_buffer(), np.int64)
                    search_tree(pickle.loads(tree.as_py()), np.frombuffer(v.as_buffer()).reshape(len(own), -1), own, best)
        yield from results()

    return cells.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def _queries(vectors: DataFrame, is_query: Column) -> DataFrame:
    """dim, query, id, v (binary): the distinct queries."""

    def run(batches):
        for batch in batches:
            raw = [np.array(v, np.float64).tobytes() for v in batch.column("v").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("v"), "v", pa.array(raw, pa.binary()))

    rows = vectors.filter(is_query).distinct().select("dim", F.xxhash64("id", "v").alias("query"), "id", "v")
    return rows.mapInArrow(run, "dim int, query long, id long, v binary")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that is_query (a column over `id`) picks."""
    kept = Scratch(df.sparkSession)
    bounded_batches(df.sparkSession)
    with scratch_scope():
        return kept.write(_top_k(df, is_query, k, vec_col, id_col, Scratch(df.sparkSession)))


def _top_k(df: DataFrame, is_query: Column, k: int, vec_col: str, id_col: str, scratch: Scratch) -> DataFrame:
    vectors = scratch.write(whole(df, vec_col, id_col))
    shards = scratch.write(build_shards(vectors))
    asked = scratch.write(_queries(vectors, is_query))
    # the kth score within one shard of a query's length: no kth score over all shards is less
    first = shards.join(shards.groupBy("dim").agg(F.min("shard").alias("shard")), ["dim", "shard"], "left_semi")
    seeds = _ranked(search(asked.withColumn("floor", F.lit(LOWEST)), first, k, scratch), k).filter(F.col("rank") == k)
    seeds = scratch.write(seeds.select("query", F.col("query_id").alias("id"), F.col("score").alias("floor")))
    known = asked.join(seeds, ["query", "id"], "left").withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
    return _ranked(search(known, shards, k, scratch), k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, q.w, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
