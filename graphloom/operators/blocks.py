"""Two tables met block by block: queries in blocks, rows in tiles, neither of them on the driver.

Rows are dealt by hash to a fixed number of racks, and within a rack to tiles of a bounded size; queries are dealt to
blocks of a bounded size. Each pair of a rack and a block is one group of a shuffle, in which the block comes first and the
tiles follow one by one, so a task holds one block and one tile, whatever the sizes of the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that rows are dealt to; each keeps the best of a query, so this many times k rows a query leave the tasks.
RACKS = 16
#: Queries in a block, and rows in a tile.
BLOCK_ROWS, TILE_ROWS = 4096, 4096
#: Partitions of one exchange at most; beyond it several groups share a task, one after the other.
MOST_PARTITIONS = 20_000
_PLACE = ["_rack", "_block", "_side", "_tile"]

Runner = Callable[[pa.Table, Iterator[pa.Table]], Iterator[pa.RecordBatch]]


def parts(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """(values of ``keys``, rows) for each run of equal integer keys in sorted batches, across their borders."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(int(c[lo]) for c in columns)
            if key != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


def meet(queries: DataFrame, rows: DataFrame, run: Runner, schema: str, racks: int = RACKS, block_rows: int = BLOCK_ROWS, tile_rows: int = TILE_ROWS, order: list[str] | None = None) -> DataFrame:
    """What ``run(block of queries, tiles of rows)`` yields for every block and rack.

    Columns of one name have one type in both tables; a column that one side lacks is null there. Rows with a column ``_tile`` keep
    their tiles, others get tiles of about ``tile_rows`` rows; within a tile rows come in the order of the columns ``order``.
    Where the queries are many, every rack meets every block: that is the whole comparison, cut into bounded tasks."""
    blocks = parts(queries.count(), block_rows)
    if "_tile" not in rows.columns:
        rows = rows.withColumn("_tile", F.pmod(F.xxhash64(*rows.columns), F.lit(racks * parts(rows.count(), racks * tile_rows))).cast("int"))
    asked = queries.withColumns({"_side": F.lit(0), "_tile": F.lit(-1), "_block": F.pmod(F.xxhash64(F.lit(7), *queries.columns), F.lit(blocks)).cast("int")})
    asked = asked.withColumn("_rack", F.explode(F.sequence(F.lit(0), F.lit(racks - 1))))
    given = rows.withColumns({"_side": F.lit(1), "_rack": F.pmod("_tile", F.lit(racks)).cast("int")}).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return streamed(asked.unionByName(given, allowMissingColumns=True), F.col("_block") * racks + F.col("_rack"), racks * blocks, run, schema, order)


def streamed(both: DataFrame, group: Column, groups: int, run: Runner, schema: str, order: list[str] | None = None) -> DataFrame:
    """What ``run`` yields for each group (_rack, _block) of rows with _side (0: queries, 1: rows) and _tile; ``group`` numbers
    the ``groups`` groups from 0 on."""
    tasks = max(1, min(groups, MOST_PARTITIONS))
    dealt = both.repartitionById(tasks, F.pmod(group, F.lit(tasks)).cast("int"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(pieces(batches, _PLACE), key=lambda x: x[0][:2]):
            key, block = next(group)
            if key[2] == 0:
                yield from run(block, (tile for _, tile in group))
            else:
                for _ in group:
                    pass

    return dealt.sortWithinPartitions(*_PLACE, *(order or [])).mapInArrow(task, schema)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column of numbers that all have one length, as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def first_k(group: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of the first ``k`` of each group; ``order`` names the sort keys, the most important last, as lexsort takes them."""
    placed = np.lexsort((*order, group))
    first = np.append(True, group[placed][1:] != group[placed][:-1]) if len(placed) else np.zeros(0, bool)
    at = np.arange(len(placed))
    return placed[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


class Best:
    """The ``k`` highest scores of each of ``n`` queries so far, equal ones by the smaller tag, and what else goes with them.

    Offers wait in a bounded list until they are cut to what can still be among the best."""

    def __init__(self, n: int, k: int, dtype: type = float, pending: int = 500_000):
        self.k, self.most = k, pending
        self.least = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self._top = np.full((n, k), self.least, dtype)
        #: The score that an offer must reach: the k-th best so far.
        self.edge = np.full(n, self.least, dtype)
        self._kept: list[tuple] = []
        self._size = 0

    def offer(self, query: np.ndarray, score: np.ndarray, tag: np.ndarray, *others: np.ndarray) -> None:
        """Rows for the queries at ``query``, a row at most once for each; those below the edge are left out."""
        high = score >= self.edge[query]
        query, score = query[high], score[high]
        if not len(query):
            return
        met = np.unique(query)
        first = first_k(query, (-score,), self.k)
        place = np.searchsorted(met, query[first])
        start = np.searchsorted(query[first], met)
        top = np.concatenate([np.full((len(met), self.k), self.least, self._top.dtype), self._top[met]], axis=1)
        top[place, np.arange(len(first)) - start[place]] = score[first]
        self._top[met] = np.partition(top, self.k, axis=1)[:, self.k :]
        self.edge[met] = self._top[met].min(axis=1)
        self._kept.append((query, score, tag[high], *(x[high] for x in others)))
        self._size += len(query)
        if self._size > self.most:
            self._size = len(self.rows()[0])

    def handles(self) -> tuple[np.ndarray, ...]:
        """As :meth:`rows`, whose last column is then numbered anew in their order."""
        found = self.rows()
        if self._kept:
            self._kept = [(*found[:-1], np.arange(len(found[0])))]
            self._size = len(found[0])
        return found

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, score, tag, others) of the best, by query and from the best on."""
        if not self._kept:
            return (np.zeros(0, int), np.zeros(0, self._top.dtype), np.zeros(0, int))
        columns = [np.concatenate(c) for c in zip(*self._kept, strict=True)]
        keep = first_k(columns[0], (columns[2], -columns[1]), self.k)
        self._kept = [tuple(c[keep] for c in columns)]
        return self._kept[0]
