"""Nearest vectors by inner product: one vantage-point tree per shard, pruned by the triangle inequality.

The largest inner product is the least Euclidean distance once each vector gets one more component that brings it to the
largest norm of the table (and queries a zero there), so a metric tree serves. Rows are dealt by hash to shards of a
bounded size. A shard's tree picks a vantage point, sorts its other rows by their distance to it and halves them, down to
leaves; each row keeps the distances to the vantage points above it, which give every branch an interval. The index holds every row.

A search meets blocks of queries with shards, one shard at a time; what a query has found so far bounds its search of the next
shard. A branch is left out when the triangle inequality puts all of it beyond ``factor`` times the distance of the k-th best
so far. With ``factor`` 1 that loses nothing and the search is exact; less than 1 prunes more and may lose rows.

Scores that decide are summed component by component in double precision, so equal vectors have equal scores everywhere.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
an id; all others must have one length (an error says so). Repeated rows are rows of their own: each is searched for, and each can be found, its own copy too. Ties go to
the smaller id. A query with no other row gives no result. Other columns are never touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored
from graphloom.operators.blocks import BLOCK_ROWS, RACKS, Best, matrix, meet, parts

#: Rows of a leaf, which are compared as one matrix.
LEAF_ROWS = 64
#: Rows of a shard.
SHARD_ROWS = 4096
INDEX = "_tile int, _pos int, _row bigint, _id bigint, _vec array<double>, _far array<double>"


def usable(vec: str | Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


def numbered(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Stored rows (_row, _id, _vec) of the vectors that take part; ``_row`` tells repeated rows apart."""
    one = vectors.filter(F.col(id_col).isNotNull() & usable(vec_col))
    rows = stored(one.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec")), "vectors")
    sizes = rows.agg(F.min(F.size("_vec")), F.max(F.size("_vec"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    return rows


def branches(lo: int, hi: int) -> tuple[int, int, int] | None:
    """(vantage point, first and middle place) of the branch of places lo to hi, or None for a leaf: the same rule for index and search."""
    return None if hi - lo <= LEAF_ROWS else (lo, lo + 1, lo + 1 + (hi - lo - 1) // 2)


def _lifted(vec: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([vec, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vec, vec), 0))[:, None]])


def _distances(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    away = rows - point
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def index(rows: DataFrame, top: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Each row of :func:`numbered` with its shard ``_tile``, its place in the shard's tree and its distances to the vantage points above."""
    shards = parts(rows.count(), shard_rows)
    dealt = rows.withColumn("_tile", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks().sort_by("_row")
        vec = matrix(shard["_vec"])
        lifted, n = _lifted(vec, top), len(vec)
        # The first place of a branch is its vantage point; a row's path ends in its leaf.
        placed, far, open_branches = np.random.default_rng(n).permutation(n), [[] for _ in range(n)], [(0, n)]
        while open_branches:
            lo, hi = open_branches.pop()
            split = branches(lo, hi)
            if split:
                rest = placed[lo + 1 : hi]
                d = _distances(lifted[rest], lifted[placed[lo]])
                order = np.argsort(d, kind="stable")
                placed[lo + 1 : hi] = rest[order]
                for r, x in zip(rest.tolist(), d.tolist(), strict=True):
                    far[r].append(x)
                open_branches += [(split[1], split[2]), (split[2], hi)]
        taken = shard.take(pa.array(placed))
        far = pa.array([far[i] for i in placed], pa.list_(pa.float64()))
        return pa.table([taken["_tile"], pa.array(np.arange(n, dtype=np.int32)), taken["_row"], taken["_id"], taken["_vec"], far], names=["_tile", "_pos", "_row", "_id", "_vec", "_far"])

    return dealt.groupBy("_tile").applyInArrow(build, INDEX)


def search(queries: DataFrame, index: DataFrame, top: float, k: int, factor: float = 1.0, racks: int = RACKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_row, query_id, vec_id, score): the ``k`` nearest rows of each rack for queries (_row, _id, _vec), each but itself."""

    def run(block: pa.Table, shards: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        own, vec = block["_row"].to_numpy(), matrix(block["_vec"])
        lifted = np.hstack([vec, np.zeros((len(vec), 1))])
        length = np.einsum("ij,ij->i", vec, vec)
        slack = 1e-12 * np.sqrt(length * top)
        best = Best(len(own), k)

        def offer(at: np.ndarray, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
            # Scores by matrix product only choose what is summed exactly.
            rough = vec[at] @ points.T
            q, r = np.nonzero((rough >= (best.edge[at] - slack[at])[:, None]) & (own[at][:, None] != rows[None, :]))
            q, score = at[q], np.zeros(len(q))
            for c in range(points.shape[1]):
                score += vec[q, c] * points[r, c]
            best.offer(q, score, ids[r])

        for shard in shards:
            rows, ids, points = shard["_row"].to_numpy(), shard["_id"].to_numpy(), matrix(shard["_vec"])
            far, tree = shard["_far"].combine_chunks(), _lifted(points, top)
            far, start = far.flatten().to_numpy(), far.offsets.to_numpy()
            # (places, depth, queries that reach them, their least possible distance); the nearer branch is taken up first.
            todo = [(0, len(rows), 0, np.arange(len(own)), np.zeros(len(own)))]
            while todo:
                lo, hi, depth, at, least = todo.pop()
                reach = np.sqrt(np.maximum(length[at] + top - 2 * best.edge[at], 0))
                near = least <= factor * reach * (1 + 1e-9) + 1e-9
                at, least = at[near], least[near]
                if not len(at):
                    continue
                split = branches(lo, hi)
                if not split:
                    offer(at, rows[lo:hi], ids[lo:hi], points[lo:hi])
                    continue
                offer(at, rows[lo : lo + 1], ids[lo : lo + 1], points[lo : lo + 1])
                d, sides = _distances(lifted[at], tree[lo]), []
                for a, b in ((split[1], split[2]), (split[2], hi)):
                    edge = far[start[a:b] + depth]
                    low, high = edge.min(), edge.max()
                    sides.append((a, b, depth + 1, at, np.maximum(least, np.maximum(low - d, d - high))))
                inner = d <= far[start[split[1] : split[2]] + depth].max()
                for side, own_side in ((sides[0], ~inner), (sides[1], inner), (sides[1], ~inner), (sides[0], inner)):
                    if own_side.any():
                        todo.append((*side[:3], at[own_side], side[4][own_side]))
        q, score, ids = best.rows()
        yield pa.RecordBatch.from_arrays([block["_row"].combine_chunks().take(pa.array(q)), block["_id"].combine_chunks().take(pa.array(q)), pa.array(ids), pa.array(score)], names=["query_row", "query_id", "vec_id", "score"])

    return meet(queries, index, run, "query_row bigint, query_id bigint, vec_id bigint, score double", racks, block_rows, order=["_pos"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", racks: int = RACKS, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id (named ``_id`` in ``is_query``) makes it a query its ``k`` nearest other rows."""
    rows = numbered(vectors, id_col, vec_col)
    norm = F.aggregate("_vec", F.lit(0.0), lambda a, x: a + x * x)
    top = (rows.agg(F.max(norm)).first()[0] or 0.0) * (1 + 1e-12)
    if not np.isfinite(top):
        raise ValueError("squared norms must be finite")
    found = search(rows.filter(is_query), stored(index(rows, top, shard_rows), "vantage-index"), top, k, factor, racks, block_rows)
    listed = found.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("_l"))
    one = listed.select("query_id", F.posexplode("_l").alias("_p", "f"))
    return one.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.s")).alias("score"))
