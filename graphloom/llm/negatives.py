"""Hard negatives: rows of another label whose score with an anchor falls in a band below a positive's score.

Scores are integer inner products of vectors rounded down to multiples of 1/256. Each row stores its angles to some reference
directions. Two stored angles bound the angle between two vectors by the triangle inequality: it is at least their difference and at
most their sum (or what that leaves of a full turn). The cosines of these bounds, multiplied by the norms and widened for rounding, bound
the score. Rows of a tile are sorted by label, nearest reference and angle, and cut into windows; a window's ranges of angles and norms bound
all its scores, and only windows that overlap what an anchor still asks for are scored, in exact integers.

Both searches work this way: the best rows of the same label are the positives, and the best rows of other labels
within each positive's band are its negatives. The reference directions are fitted on a bounded sample (``sample_rows`` rows with the lowest
hash, picked one by one as the farthest from those before); they decide how much is skipped, never what is found.

Defined results: rows without an id or label, with a null or empty vector, or with a null or non-finite component, take no part; all others must have one length
(an error says so), and a score must fit into a long. Zero vectors take part and score 0. Repeated rows are rows of their own: each is an
anchor, and a copy can be another's positive. Ties go to the smaller id. An anchor without a positive, or a positive without a negative,
gives no row. Other columns are never touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored
from graphloom.operators.blocks import BLOCK_ROWS, RACKS, Best, matrix, meet

#: Rows of a window, which are scored together.
WINDOW_ROWS = 128
_LEAST, _MOST = -(2**63) + 1, 2**63 - 1


def quantised(vectors: DataFrame, label: Column, id_col: str, vec_col: str) -> DataFrame:
    """Stored rows (_row, _id, _label, _vec) that take part; ``_vec`` holds whole numbers as doubles."""
    finite = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    one = vectors.filter(F.col(id_col).isNotNull() & finite & (F.size(vec_col) > 0) & label.isNotNull())
    whole = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = stored(one.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"), whole.alias("_vec")), "whole-vectors")
    sizes = rows.agg(F.min(F.size("_vec")), F.max(F.size("_vec"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    return rows


def references(rows: DataFrame, count: int = 16, sample_rows: int = 2000) -> np.ndarray:
    """Up to ``count`` unit vectors, each the farthest from those before, out of a bounded sample."""
    order = F.xxhash64("_row")
    sample = matrix(rows.filter(F.exists("_vec", lambda x: x != 0)).select("_vec").orderBy(order).limit(sample_rows).toArrow()["_vec"])
    if not len(sample):
        return np.zeros((0, 0))
    sample = sample / np.linalg.norm(sample, axis=1)[:, None]
    picked, nearest = [0], sample @ sample[0]
    while len(picked) < min(count, len(sample)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[picked[-1]])
    return sample[picked]


def with_angles(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """``rows`` with their norm and their angles to the reference directions; a zero vector has angles of zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = matrix(batch.column("_vec"))
            norm = np.linalg.norm(vec, axis=1)
            cosines = vec @ directions.T / np.where(norm > 0, norm, 1)[:, None] if directions.size else np.ones((len(vec), 0))
            angles = np.where(norm[:, None] > 0, np.arccos(np.clip(cosines, -1, 1)), 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * angles.shape[1]), pa.array(angles.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norm), lists], names=[*batch.schema.names, "_norm", "_angles"])

    return rows.mapInArrow(run, "_row bigint, _id bigint, _label bigint, _vec array<double>, _norm double, _angles array<double>")


def window_bounds(angles: np.ndarray, norm: np.ndarray, row_angles: np.ndarray, row_norm: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper): bounds of the scores of each query with each window of rows, the windows beginning at ``starts``."""
    least, most = np.minimum.reduceat(row_norm, starts), np.maximum.reduceat(row_norm, starts)
    near, far = np.zeros((len(norm), len(starts))), np.full((len(norm), len(starts)), np.pi)
    for r in range(angles.shape[1]):
        low, high, own = np.minimum.reduceat(row_angles[:, r], starts), np.maximum.reduceat(row_angles[:, r], starts), angles[:, r : r + 1]
        np.maximum(near, np.maximum(low - own, own - high), out=near)
        np.minimum(far, np.minimum(own + high, 2 * np.pi - own - low), out=far)
    top, bottom = np.cos(np.minimum(near, np.pi)), np.cos(np.maximum(far, 0))
    # A zero vector has no angle of its own: with it in a window, zero must lie within the bounds, as the norms see to.
    upper = norm[:, None] * np.where(top >= 0, most * top, least * top)
    lower = norm[:, None] * np.where(bottom >= 0, least * bottom, most * bottom)
    slack = 1e-6 * norm[:, None] * most + 1
    return np.floor(lower - slack), np.ceil(upper + slack)


def banded(queries: DataFrame, rows: DataFrame, k: int, same_label: bool, racks: int = RACKS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query, row, id, score): in each rack the ``k`` highest scores within _low and _high of queries (_query, _low, _high and the columns of rows)."""

    def run(block: pa.Table, tiles: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        own, label, low, high = (block[c].to_numpy() for c in ("_row", "_label", "_low", "_high"))
        vec, norm, angles = matrix(block["_vec"]), block["_norm"].to_numpy(), matrix(block["_angles"])
        best = Best(len(own), k, np.int64)
        for tile in tiles:
            tile = tile.combine_chunks()
            labels, turned = tile["_label"].to_numpy(), matrix(tile["_angles"])
            close = turned.argmin(axis=1) if turned.shape[1] else np.zeros(len(labels), int)
            order = np.lexsort((turned[np.arange(len(close)), close] if turned.shape[1] else close, close, labels))
            labels, turned, points = labels[order], turned[order], matrix(tile["_vec"])[order]
            ids, at_row, length = (tile[c].to_numpy()[order] for c in ("_id", "_row", "_norm"))
            starts = np.arange(0, len(order), WINDOW_ROWS)
            lower, upper = window_bounds(angles, norm, turned, length, starts)
            exact = float if norm.max() * length.max() < 2**53 else np.int64  # doubles add whole numbers exactly that far
            for w, a in enumerate(starts.tolist()):
                z = min(a + WINDOW_ROWS, len(order))
                fits = (label >= labels[a]) & (label <= labels[z - 1]) if same_label else (label != labels[a]) | (label != labels[z - 1])
                asked = np.flatnonzero(fits & (upper[:, w] >= np.maximum(low, best.edge)) & (lower[:, w] <= high))
                if not len(asked):
                    continue
                anchors, anchor = np.unique(own[asked], return_index=True)
                place = np.searchsorted(anchors, own[asked])
                score = (vec[asked[anchor]].astype(exact) @ points[a:z].T.astype(exact)).astype(np.int64)[place]
                agrees = (label[asked][:, None] == labels[a:z]) == same_label
                q, r = np.nonzero(agrees & (score >= np.maximum(low, best.edge)[asked][:, None]) & (score <= high[asked][:, None]) & (own[asked][:, None] != at_row[a:z]))
                best.offer(asked[q], score[q, r], ids[a:z][r], at_row[a:z][r])
        q, score, ids, *at_row = best.rows()
        yield pa.RecordBatch.from_arrays([block["_query"].combine_chunks().take(pa.array(q)), pa.array(at_row[0] if at_row else ids), pa.array(ids), pa.array(score)], names=["query", "row", "id", "score"])

    return meet(queries, rows, run, "query bigint, row bigint, id bigint, score bigint", racks, block_rows)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """(query, rank, row, id, score) of the ``k`` best over all racks; each rack has sent ``k`` at most."""
    listed = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "row"))), 1, k).alias("_l"))
    one = listed.select("query", F.posexplode("_l").alias("_p", "f"))
    return one.select("query", (F.col("_p") + 1).cast("int").alias("rank"), F.col("f.row").alias("row"), F.col("f.id").alias("id"), (-F.col("f.s")).alias("score"))


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10,
    least_percent: int = 30, most_percent: int = 90, racks: int = RACKS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose id (named ``_id`` in ``is_anchor``) makes
    it an anchor and each of its ``positives`` best rows of its label, the ``negatives`` best rows of other labels whose score
    is within the two percentages of the positive's."""
    rows = quantised(vectors, F.col(label) if isinstance(label, str) else label, id_col, vec_col)
    rows = stored(with_angles(rows, references(rows)), "angles")
    anchors = rows.filter(is_anchor)
    open_band = anchors.withColumns({"_query": F.col("_row"), "_low": F.lit(_LEAST), "_high": F.lit(_MOST)})
    pairs = first_of(banded(open_band, rows, positives, True, racks, block_rows), positives)
    # Whole numbers n with least * p <= 100 * n <= most * p, without leaving the range of a long.
    low, high = (F.ceil(F.col("score").cast("decimal(38,0)") * least_percent / 100), F.floor(F.col("score").cast("decimal(38,0)") * most_percent / 100))
    pairs = pairs.select(F.monotonically_increasing_id().alias("_query"), F.col("query").alias("_row"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.cast("long").alias("_low"), high.cast("long").alias("_high"))
    pairs = stored(pairs.filter("_low <= _high").join(anchors, "_row"), "positives")
    found = first_of(banded(pairs.drop("positive_id", "positive_score"), rows, negatives, False, racks, block_rows), negatives)
    named = found.join(pairs.select(F.col("_query").alias("query"), F.col("_id").alias("anchor_id"), "positive_id", "positive_score"), "query")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
