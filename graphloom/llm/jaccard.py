"""N-gram Jaccard join: near copies by exact set similarity, without losing a link.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets are one
*set* from then on. The join runs in four steps:

1. *Shared shingles.* The shingles of one half of all hashes are dealt to buckets (a few bytes each); a bucket tells
   which of them two or more sets hold. A set with a link lacks partners for at most ``1 - threshold`` of its
   shingles, wherever these fall; a set for which the half alone shows more leaves here. Dealing uses shortened
   hashes, and a set's place in its slice of texts stands for its id: a clash can only keep a set that might have left.
2. *Clusters.* Let a set's *missing* number be ``1 - threshold`` of its shingles. Two linked sets share at least ``k`` of their
   first *missing + k* shingles, in any order that holds for all sets; here frequent shingles come last, the most frequent
   at the very end. Pairs of sets with enough rare shingles in common there are joined, and so are sets that share a
   frequent one among their first *missing + 1*; the components of these joins are the clusters: no link leaves a cluster,
   and a shingle that two texts share by chance ties nothing.
3. *Tiles.* A small cluster is one tile. A larger one is cut into bands of set size, and bands into blocks of bounded content; only
   blocks of equal or neighbouring bands meet, each pair of blocks as one tile. In a tile, bit counts of
   hashed bitmaps bound every overlap from above, and pairs that may reach the threshold and are not yet
   connected are compared by intersecting their sorted arrays. A tile returns a spanning forest.
4. *Components* of all forests give the class of each document.

Rows are known by a hash of id and text throughout, so rows without an id link like all others.

Defined results: null texts, empty texts and texts without words have an empty set and are linked with
nothing; texts of fewer words than a shingle have one shingle of the whole sequence; repeated rows
are in one class; the component of a class is its least id that is not null, and null only if no row of it has an id;
ties never matter, as every pair at the threshold is a link; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.hashing import Batch, mixed, per_text_sets
from graphloom.llm.shared import Scratch, stored
from graphloom.operators.graph import components, stars

BITS = 1024
#: Characters and shingles that a task works on at once: a few arrays of some MB.
SLICE_CHARS, SLICE_SHINGLES = 300_000, 250_000
#: Sets up to which all that share a rare shingle make pairs; more are joined to the least of them.
PAIRED_SETS = 16
#: Rows up to which a table of ids is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def text_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted shingle hashes of all texts in one flat array, their number by text, and an id of each whole set."""
    b = Batch(texts)
    value, doc, _ = b.shingles(n, short=True)
    flat, sizes = per_text_sets(value.view(np.int64), doc, len(texts))
    ends = np.append(np.uint64(0), np.cumsum(mixed(flat.view(np.uint64)), dtype=np.uint64))
    at = np.append(0, np.cumsum(sizes))
    sums = ends[at[1:]] - ends[at[:-1]]
    return flat, sizes, mixed(sums ^ mixed(sizes.astype(np.uint64))).view(np.int64)


def text_parts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of rows of about ``SLICE_CHARS`` bytes each with their texts, so that the texts of a batch are never all held as a list."""
    ends, lo = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = min(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_CHARS)) + 1, len(ends))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows of different id or text apart; never null."""
    return F.xxhash64(F.col(id_col), F.coalesce(text_col, F.lit("")))


def dealt_half(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Which hashes are dealt: half of them, where the other half can hide no more than a linked set may lack; else all."""
    return hashes >= 0 if percent >= 75 else np.ones(len(hashes), bool)


def set_table(docs: DataFrame, n: int, id_col: str, text_col: str, percent: int = 75) -> DataFrame:
    """(doc_id, row, set_id, n_shingles, n_dealt) of every row; n_dealt: those of its shingles that are dealt."""
    given = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_parts(b.column(2)):
                flat, sizes, ids = text_sets(texts, n)
                dealt = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[dealt_half(flat, percent)], minlength=len(sizes))
                here = [b.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*here, pa.array(ids), pa.array(sizes), pa.array(dealt)], names=["doc_id", "row", "set_id", "n_shingles", "n_dealt"])

    return given.mapInArrow(run, f"doc_id {kind}, row bigint, set_id bigint, n_shingles bigint, n_dealt bigint")


def dealt_shingles(docs: DataFrame, n: int, text_col: str, buckets: int, percent: int = 75) -> DataFrame:
    """(bucket, slice, h, of): shortened hashes of a bucket, and whose they are, as steps from place to place in a slice of sets.

    A slice has one more row, whose ``bucket`` its hash decides: ``of`` is null there and ``h`` holds the ids of its sets."""
    given = docs.select(F.coalesce(text_col, F.lit("")).alias("_t"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes, owners, held = [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            h, o = np.concatenate(hashes).view(np.uint64), np.repeat(np.arange(len(ids)), np.concatenate(owners))
            name = int((mixed(ids.view(np.uint64)) * (2 * np.arange(len(ids), dtype=np.uint64) + np.uint64(1))).sum(dtype=np.uint64) >> np.uint64(1))
            bucket = (((h >> np.uint64(31)) & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")  # stable: within a bucket, places in the slice still rise
            h, o, bucket = h[order].astype(np.uint32), o[order], bucket[order]
            edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
            rows = [(name % buckets, ids.tobytes(), None)]
            for a, e in zip(edge, np.append(edge[1:], len(h)), strict=True):
                steps = np.diff(o[a:e], prepend=0)
                rows.append((int(bucket[a]), h[a:e].tobytes(), steps.astype(np.uint8 if steps.max() < 256 else np.uint32).tobytes()))
            for x in (hashes, owners, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([name] * len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))], names=["bucket", "slice", "h", "of"])

        total = 0
        for b in batches:
            for _, _, texts in text_parts(b.column(0)):
                flat, sizes, ids = text_sets(texts, n)
                fresh = np.array([s > 0 and i not in seen and not seen.add(i) for i, s in zip(ids.tolist(), sizes.tolist(), strict=True)], bool)
                keep, owner = np.repeat(fresh, sizes) & dealt_half(flat, percent), np.repeat(np.arange(len(sizes)), sizes)
                hashes.append(flat[keep])
                owners.append(np.bincount(owner[keep], minlength=len(sizes))[fresh])
                held.append(ids[fresh])
                total += int(keep.sum())
                if total > SLICE_SHINGLES:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    return given.mapInArrow(deal, "bucket int, slice bigint, h binary, of binary")


def shared_counts(docs: DataFrame, n: int, text_col: str, buckets: int, percent: int = 75) -> DataFrame:
    """(set_id, shared): how many of the dealt shingles of the set another set also holds, for sets that have any.

    Where rows of different tasks have equal sets, their shingles count as shared too."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for bucket, name, h, of in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of is None:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name], pa.int64()), pa.array([h], pa.binary()), pa.array([None], pa.binary())], names=["goal", "slice", "at", "c"])
                else:
                    h = np.frombuffer(h, np.uint32)
                    parts.setdefault(bucket, []).append((name, h, np.cumsum(np.frombuffer(of, np.uint8 if len(of) == len(h) else np.uint32), dtype=np.int64)))
        while parts:
            _, rows = parts.popitem()
            h, o = np.concatenate([r[1] for r in rows]), np.concatenate([(i << 32) + r[2] for i, r in enumerate(rows)])
            order = np.argsort(h, kind="stable")
            h, o = h[order], o[order]
            near = h[1:] == h[:-1]
            many = np.append(near, False) | np.append(False, near)
            h, o = h[many], o[many]  # what stands alone is gone; of the rest, a set counts once for a hash
            order = np.lexsort((o, h))
            h, o = h[order], o[order]
            once = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
            h, o = h[once], o[once]
            near = h[1:] == h[:-1]
            found, c = np.unique(o[np.append(near, False) | np.append(False, near)], return_counts=True) if len(h) else (o, o)
            if len(found):
                part, at = found >> 32, (found & 0xFFFFFFFF).astype(np.uint32)
                edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                out = [(rows[part[x]][0], at[x:y], c[x:y]) for x, y in zip(edge, np.append(edge[1:], len(part)), strict=True)]
                at = [x.astype(np.uint16) if x[-1] < 65536 else x for _, x, _ in out]
                c = [x.astype(np.uint8 if x.max() < 256 else np.uint32) for _, _, x in out]
                names = [r[0] for r in out]
                yield pa.RecordBatch.from_arrays([pa.array([x % buckets for x in names], pa.int32()), pa.array(names, pa.int64()), pa.array([bytes([x.itemsize]) + x.tobytes() for x in at], pa.binary()), pa.array([bytes([x.itemsize]) + x.tobytes() for x in c], pa.binary())], names=["goal", "slice", "at", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}
        held: dict[int, np.ndarray] = {}
        total: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for name, at, c in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if c is None:
                    held[name] = np.frombuffer(at, np.int64)
                else:
                    total.setdefault(name, []).append((np.frombuffer(at, kind[at[0]], offset=1), np.frombuffer(c, kind[c[0]], offset=1)))
        for name, rows in total.items():
            ids = held[name]
            c = np.bincount(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), len(ids)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[c > 0]), pa.array(c[c > 0])], names=["set_id", "shared"])

    dealt = dealt_shingles(docs, n, text_col, buckets, percent).repartition(buckets, "bucket")
    counted = dealt.mapInArrow(count, "goal int, slice bigint, at binary, c binary").repartition(buckets, "goal")
    return counted.mapInArrow(add, "set_id bigint, shared bigint").groupBy("set_id").agg(F.max("shared").alias("shared"))


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words for each set: bit ``hash mod BITS`` is set for each of its shingles."""
    out = np.zeros((len(sets), BITS), np.uint8)
    for i, s in enumerate(sets):
        out[i, s.view(np.uint64) % np.uint64(BITS)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


class Forest:
    """Union-find over places in a list."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def tile_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Spanning links of a tile: places in ``left`` followed by ``right``; without ``right``, within ``left``."""
    sets = left if right is None else left + right
    size, bits = np.array([len(s) for s in sets]), _bitmaps(sets)
    ones = np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    start, forest, out = (0 if right is None else len(left)), Forest(len(sets)), []
    for i in range(len(left)):
        first = i + 1 if right is None else start
        if first >= len(sets):
            break
        common = np.bitwise_count(bits[first:] & bits[i]).sum(axis=1).astype(np.int64)
        # each bit that only one side has stands for at least one shingle that the other side lacks
        most = np.minimum(size[i] - (ones[i] - common), size[first:] - (ones[first:] - common))
        may = np.flatnonzero(100 * most >= percent * (size[i] + size[first:] - most)) + first
        for j in may[np.argsort(-most[may - first], kind="stable")].tolist():
            if forest.root(i) == forest.root(j):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (size[i] + size[j] - both):
                forest.join(i, j)
                out.append((i, j))
    return out


def prefix_keys(sets: DataFrame, percent: int, common: int = 500_000) -> DataFrame:
    """(set_id, n, key, often, need) of the first shingles of each set, in an order that puts frequent shingles last.

    Any order is exact. The ``common`` most frequent shingles, of those in more than 8 sets, go to the executors to
    make up the order, so that a passage of many documents does not tie them into one cluster. Two linked sets share one that is
    ``often`` here, or at least ``need`` (the smaller of theirs) that are not."""
    top = sets.select(F.explode("hashes").alias("key")).groupBy("key").count().filter("count > 8").orderBy(F.desc("count"), "key").limit(common)
    found = top.toArrow()["key"].to_numpy()
    at = np.argsort(found)
    last = sets.sparkSession.sparkContext.broadcast((found[at], (len(found) - at).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, place = last.value
        for b in batches:
            n = b.column(1).to_numpy()
            part = (np.cumsum(n) - n) // SLICE_SHINGLES
            for rows in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1):
                sizes = n[rows]
                flat = b.column(2).slice(rows[0], len(rows)).flatten().to_numpy() if len(rows) else np.zeros(0, np.int64)
                late = np.zeros(len(flat), np.int32)
                if len(often):
                    near = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                    late = np.where(often[near] == flat, place[near], 0)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((late, owner))  # stable: hashes that are not frequent stay sorted
                flat, late = flat[order], late[order] > 0
                rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                least = -(-sizes * percent // 100)
                missing, more = sizes - least, np.minimum(1 + sizes // 16, least)
                first = rank < (missing + more)[owner]
                need = np.maximum(more - np.bincount(owner[first & late], minlength=len(sizes)), 1)
                keep = first & ~(late & (rank > missing[owner]))
                of = owner[keep]
                yield pa.RecordBatch.from_arrays([pa.array(b.column(0).to_numpy()[rows][of]), pa.array(sizes[of]), pa.array(flat[keep]), pa.array(late[keep]), pa.array(need[of])], names=["set_id", "n", "key", "often", "need"])

    return sets.select("set_id", "n", "hashes").mapInArrow(run, "set_id bigint, n bigint, key bigint, often boolean, need bigint")


def near_pairs(prefixes: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b): pairs of sets that share enough rare shingles of a table :func:`prefix_keys`, and sizes that may link.

    A shingle of more than ``PAIRED_SETS`` sets joins each of them to the least instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(c.to_numpy() for c in b.columns) for b in batches]
        if not rows:
            return
        key, ids, n, need = (np.concatenate([r[i] for r in rows]) for i in range(4))
        order = np.lexsort((ids, key))
        key, ids, n, need = key[order], ids[order], n[order], need[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        start, size = np.repeat(edge, size), np.repeat(size, size)
        wide = np.flatnonzero((size > PAIRED_SETS) & (start != np.arange(len(key))))
        found = [np.stack([ids[start[wide]], ids[wide], np.zeros(len(wide), np.int64)])]
        for step in range(1, PAIRED_SETS):
            i = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= PAIRED_SETS)) if len(key) > step else np.zeros(0, np.int64)
            i = i[100 * np.minimum(n[i], n[i + step]) >= percent * np.maximum(n[i], n[i + step])]
            found.append(np.stack([ids[i], ids[i + step], np.minimum(need[i], need[i + step])]))
        a, b, need = np.concatenate(found, axis=1)
        order = np.lexsort((need, b, a))
        a, b, need = a[order], b[order], need[order]
        edge = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        c = np.diff(np.append(edge, len(a)))
        yield pa.RecordBatch.from_arrays([pa.array(a[edge]), pa.array(b[edge]), pa.array(need[edge]), pa.array(c)], names=["a", "b", "need", "c"])

    rare = prefixes.filter("not often").select("key", "set_id", "n", "need").repartition(parts, "key")
    pairs = rare.mapInArrow(run, "a bigint, b bigint, need bigint, c bigint")
    return pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("need").alias("need")).filter("c >= need").select("a", "b")


def links(sets: DataFrame, scratch: Scratch, percent: int = 75, tile_shingles: int = 400_000, tile_sets: int = 4096) -> DataFrame:
    """Spanning links (a, b) between sets of a table (set_id, n, hashes: sorted array)."""
    prefixes = scratch.stored(prefix_keys(sets, percent), "prefixes")
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), prefixes.count() // 500_000 + 1)
    clusters = scratch.stored(components(near_pairs(prefixes, percent, parts).unionByName(stars(prefixes.filter("often"), "key", "set_id"))), "clusters")
    sized = sets.select("set_id", "n").join(clusters, F.col("set_id") == F.col("node")).select("set_id", "n", F.col("root").alias("cluster"))
    small = sized.groupBy(F.col("cluster").alias("_of")).agg(((F.sum("n") <= tile_shingles) & (F.count("n") <= tile_sets)).alias("_small"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    placed = sized.join(small, F.col("cluster") == F.col("_of")).select("set_id", "n", "cluster", F.when(F.col("_small"), 0).otherwise(band).alias("band"))
    placed = scratch.stored(placed, "placed")
    blocks = placed.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.sum("n") / tile_shingles), F.ceil(F.count("n") / tile_sets)).cast("int").alias("blocks"))
    here = blocks.select(F.col("cluster").alias("_c"), F.col("band").alias("_b"), F.col("blocks").alias("_own"))
    above = blocks.select(F.col("cluster").alias("_c2"), (F.col("band") - 1).alias("_b2"), F.col("blocks").alias("_up"))
    below = blocks.select(F.col("cluster").alias("_c3"), (F.col("band") + 1).alias("_b3"), F.col("blocks").alias("_down"))
    sized = here.join(above, (F.col("_c") == F.col("_c2")) & (F.col("_b") == F.col("_b2")), "left").join(below, (F.col("_c") == F.col("_c3")) & (F.col("_b") == F.col("_b3")), "left")
    sized = scratch.stored(sized.select("_c", "_b", "_own", F.coalesce("_up", F.lit(0)).alias("_up"), F.coalesce("_down", F.lit(0)).alias("_down")), "blocks")
    if sized.count() <= BROADCAST_ROWS:  # few rows: the sets of a large cluster then need not meet in one task
        sized = F.broadcast(sized)
    placed = placed.drop("n").join(sized, (F.col("cluster") == F.col("_c")) & (F.col("band") == F.col("_b")))
    placed = scratch.stored(placed.drop("_c", "_b"), "dealt")
    if placed.count() <= BROADCAST_ROWS:  # else the sets are dealt once more to meet their tiles
        placed = F.broadcast(placed)
    rows = sets.select("set_id", "hashes").join(placed, "set_id")
    rows = rows.withColumn("_s", F.pmod(F.xxhash64("set_id"), F.col("_own")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda low, s, t, side, step: F.struct(low.alias("low"), s.alias("s"), t.alias("t"), F.lit(side).alias("side"), F.lit(step).alias("step"))
    mine, b = F.col("_s"), F.col("band")
    tiles = F.concat(
        F.transform(upto(F.col("_own")), lambda o: tile(b, F.least(mine, o), F.greatest(mine, o), 0, 0)),
        F.transform(upto(F.col("_up")), lambda o: tile(b, mine, o, 0, 1)),
        F.transform(upto(F.col("_down")), lambda o: tile(b - 1, o, mine, 1, 1)),
    )
    given = rows.select("set_id", "hashes", "cluster", "_s", F.explode(tiles).alias("_tile"))
    given = given.select("cluster", "_tile.low", "_tile.step", "_tile.s", "_tile.t", F.when(F.col("_tile.step") == 1, F.col("_tile.side")).otherwise((mine != F.col("_tile.s")).cast("int")).alias("side"), "set_id", "hashes")

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by([("side", "ascending"), ("set_id", "ascending")])
        ids, sets = tile["set_id"].to_numpy(), [x.values.to_numpy() for x in tile["hashes"]]
        cut = int((tile["side"].to_numpy() == 0).sum())
        one = tile["step"][0].as_py() == 0 and tile["s"][0].as_py() == tile["t"][0].as_py()
        found = tile_links(sets[:cut], None if one else sets[cut:], percent) if cut else []
        return pa.table({"a": pa.array([int(ids[i]) for i, _ in found], pa.int64()), "b": pa.array([int(ids[j]) for _, j in found], pa.int64())})

    return given.groupBy("cluster", "low", "step", "s", "t").applyInArrow(run, "a bigint, b bigint")


def classes(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, set_id, n_shingles) of every row, and (set_id, root, component_id) of every set with shingles.

    Two sets are in one class if their ``root`` is the same; ``component_id`` is the least id of the class."""
    spark = docs.sparkSession
    table = stored(set_table(docs, words, id_col, text_col, percent), "sets")
    with Scratch(spark, "jaccard") as scratch:
        held = table.filter("n_shingles > 0")
        reps = held.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.first("n_shingles").alias("n"), F.first("n_dealt").alias("n_dealt"))
        copies = scratch.stored(held.select("row").distinct().join(reps.select("row"), "row", "left_anti"), "copies")
        total = table.agg(F.coalesce(F.sum("n_dealt"), F.lit(0))).first()[0]
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // 1_500_000 + 1)
        given = docs.select(row_key(id_col, text_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("text"))
        once = given.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "row", "left_anti")  # one row of each set
        shared = shared_counts(once, words, "text", buckets, percent)
        lacks = F.col("n_dealt") - F.coalesce("shared", F.lit(0))
        may = scratch.stored(reps.join(shared, "set_id", "left").filter(100 * lacks <= (100 - percent) * F.col("n")).select("set_id", "row"), "may")
        chosen = may.select("row").distinct()
        few = may.count() <= BROADCAST_ROWS
        left = given.join(F.broadcast(chosen) if few else chosen, "row", "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, texts in text_parts(b.column(0)):
                    flat, sizes, ids = text_sets(texts, words)
                    rows = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), rows], names=["set_id", "n", "hashes"])

        sets = left.select("text").mapInArrow(run, "set_id bigint, n bigint, hashes array<bigint>").filter("n > 0")
        wanted = may.select("set_id")
        sets = sets.join(F.broadcast(wanted) if few else wanted, "set_id", "left_semi")
        again = held.groupBy("row").count().filter("count > 1").join(chosen, "row", "left_semi")
        sets = scratch.stored(sets if again.isEmpty() else sets.dropDuplicates(["set_id"]), "may-sets")  # only repeated rows give a set twice
        found = scratch.stored(components(links(sets, scratch, percent)), "found")
        first = reps.join(found, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", F.coalesce("root", "set_id").alias("root"))
        # only a class of several sets needs the least of their ids; those are few, and met in a counted broadcast where they can be
        many = scratch.stored(first.join(found.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("rep").alias("least")), "least")
        if many.count() <= BROADCAST_ROWS:
            many = F.broadcast(many)
        alone, joined = F.col("least").isNull(), first.join(many, "root", "left")
        return table, stored(joined.select("set_id", "root", F.when(alone, F.col("rep")).otherwise(F.col("least")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id that links reach from the document."""
    table, known = classes(docs, words, percent, id_col, text_col)
    joined = table.join(known, "set_id", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, with all its columns: the one with the least id, ids before nulls, then with the least hash.
    Of rows that repeat id and text any one stays; texts without words are all kept."""
    spark = docs.sparkSession
    table, known = classes(docs.select(id_col, text_col), words, percent, id_col, text_col)
    rows = table.filter("n_shingles > 0").join(known.select("set_id", "root"), "set_id")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"))
    best = rows.groupBy("root").agg(F.min(order)["c"].alias("row"))
    gone = stored(rows.select("row").distinct().join(best, "row", "left_anti"), "gone")
    again = stored(rows.groupBy("row").count().filter("count > 1").select("row").join(best, "row", "left_semi"), "again")

    def small(keys: DataFrame) -> DataFrame:
        return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys

    keyed = docs.select(F.struct("*").alias("_row"), row_key(id_col, text_col).alias("row")).join(small(gone), "row", "left_anti")
    if not again.isEmpty():
        once = small(again)
        keyed = keyed.join(once, "row", "left_anti").unionByName(keyed.join(once, "row", "left_semi").dropDuplicates(["row"]))
    return keyed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
