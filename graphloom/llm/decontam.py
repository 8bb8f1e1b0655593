"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word trigrams. A trigram is a seed if its words make it rare (the product of
their shares of the corpus is at most ``rarity``); the ``least_seeds`` rarest of every item are seeds in any
case. Rarity comes from single words, so an item that the corpus holds many times keeps its seeds. A seed that is not rare
is in many documents by chance: if the item has more than ``least_seeds`` trigrams, a second seed at a matching
place must confirm it, so common phrases do not set off alignments. Where a
document holds an item's seeds, the passage around them is aligned with the item word by word, and the best local
alignment's score, over that of a perfect copy, tells copies and edited copies from chance.

The items are sent to the executors in blocks of at most ``block_words`` words; a larger benchmark takes
more passes over the documents instead of more memory, and each block's finds are stored before the next one is read.

Defined results: texts are compared in lower case, without ASCII punctuation; null and empty texts and items
match nothing, and neither do items of fewer than three words; repeated rows of documents or items each
give their rows, rows with a null id among them; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.llm.bpe import text_slices
from graphloom.llm.hashing import Batch
from graphloom.llm.shared import stored, whole

GAPS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEED = 3
#: Characters that a task works on at once.
SLICE_CHARS = 300_000
#: Up to so many leaking rows, their keys are broadcast.
BROADCAST_ROWS = 500_000


def words_of(texts: list[str]) -> Batch:
    return Batch([t.lower() for t in texts], gaps=GAPS)


def align(items: np.ndarray, windows: np.ndarray, gap: int = 1, match: int = 2, mismatch: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``items`` with the same row of ``windows`` (word hashes; 0 and 1 pad the two):
    score, and the place in the window where it ends. A row of the score matrix is computed at once for all pairs; gaps
    along it follow from a running maximum."""
    n, width = windows.shape
    steps = gap * np.arange(width)
    above, best, end = np.zeros((n, width), np.int32), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        same = np.where(windows == items[:, i : i + 1], match, -mismatch).astype(np.int32)
        here = np.maximum(above - gap, 0)
        here[:, 0] = np.maximum(here[:, 0], same[:, 0])
        here[:, 1:] = np.maximum(here[:, 1:], above[:, :-1] + same[:, 1:])
        here = (np.maximum.accumulate(here + steps, axis=1) - steps).astype(np.int32)
        here = np.maximum(here, 0)
        at = here.argmax(axis=1)
        top = here[np.arange(n), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above = here
    return best, end


class Items:
    """A block of test items with their seeds, as arrays that a task searches."""

    def __init__(self, ids: list, texts: list[str], share: dict[int, float], rarity: float, least_seeds: int):
        b = words_of(texts)
        self.ids, self.sizes = ids, b.words
        self.first = np.append(0, np.cumsum(b.words))[:-1]
        self.hash = b.hash
        value, doc, at = b.shingles(SEED)
        p = np.array([share.get(h, 0.0) for h in b.hash.tolist()])
        chance = np.prod([p[at + i] for i in range(SEED)], axis=0) if len(at) else np.zeros(0)
        order = np.lexsort((at, chance, doc))
        rank = np.zeros(len(at), np.int64)
        if len(at):
            start = np.append(True, np.diff(doc[order]) != 0)
            rank[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
        sure = (chance <= rarity) | (b.words[doc] - SEED < least_seeds)
        keep = sure | (rank < least_seeds)
        order = np.argsort(value[keep], kind="stable")
        self.seed, self.of, self.offset, self.sure = (x[keep][order] for x in (value, doc, at - self.first[doc], sure))

    def hits(self, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, where the item would begin in the batch's words, place in the item, is it sure) for every seed found."""
        value, doc, at = b.shingles(SEED)
        lo, hi = np.searchsorted(self.seed, value, "left"), np.searchsorted(self.seed, value, "right")
        found = np.flatnonzero(hi > lo)
        many = hi[found] - lo[found]
        which = np.arange(many.sum()) + np.repeat(lo[found] - np.cumsum(many) + many, many)
        return np.repeat(doc[found], many), self.of[which], np.repeat(at[found], many) - self.offset[which], self.offset[which], self.sure[which]

    def confirmed(self, doc: np.ndarray, item: np.ndarray, begin: np.ndarray, offset: np.ndarray, sure: np.ndarray) -> np.ndarray:
        """Sure hits, and others with a hit of another place of the item within half the item's length of the same diagonal."""
        order = np.lexsort((begin, item, doc))
        reach = np.maximum(self.sizes[item[order]] // 2, 4)
        next_to = (np.diff(doc[order]) == 0) & (np.diff(item[order]) == 0) & (np.diff(begin[order]) <= reach[1:]) & (np.diff(offset[order]) != 0)
        ok = np.zeros(len(doc), bool)
        ok[order] = np.append(next_to, False) | np.append(False, next_to)
        return ok | sure

    def leaks(self, texts: list[str], least: float) -> list[tuple[int, int, float, int]]:
        """(text, item, score, last aligned word) of each pair that reaches the score ``least``."""
        b = words_of(texts)
        doc, item, begin, offset, sure = self.hits(b)
        ok = self.confirmed(doc, item, begin, offset, sure)
        doc, item, begin = doc[ok], item[ok], begin[ok]
        if not len(doc):
            return []
        # hits on about the same diagonal are one passage; begins are rounded to half an item's length
        step = np.maximum(self.sizes[item] // 2, 4)
        cells = np.unique(np.stack([doc, item, begin // step]), axis=1)
        doc, item = cells[0], cells[1]
        step = np.maximum(self.sizes[item] // 2, 4)
        begin = cells[2] * step
        first = np.append(0, np.cumsum(b.words))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        order = np.argsort(self.sizes[item], kind="stable")
        lo = 0
        while lo < len(order):
            longest = int(self.sizes[item[order[lo]]])
            hi = lo
            while hi < len(order) and self.sizes[item[order[hi]]] <= 1.25 * longest and hi - lo < 4000:
                hi += 1
            rows, length = order[lo:hi], int(self.sizes[item[order[hi - 1]]])
            width = length + int(step[rows].max()) + 2 * (slack := length // 3 + 4)
            k, left = np.arange(length), begin[rows] - slack
            mine = self.first[item[rows]][:, None] + k
            a = np.where(k < self.sizes[item[rows]][:, None], self.hash[np.minimum(mine, len(self.hash) - 1)], np.uint64(0))
            place = left[:, None] + np.arange(width)
            inside = (place >= first[doc[rows]][:, None]) & (place < first[doc[rows] + 1][:, None])
            w = np.where(inside, b.hash[np.clip(place, 0, len(b.hash) - 1)], np.uint64(1))
            score, end = align(a, w)
            for r, s, e in zip(rows.tolist(), score.tolist(), (left + end).tolist(), strict=True):
                share, key = s / (2 * int(self.sizes[item[r]])), (int(doc[r]), int(item[r]))
                if share >= least and share > best.get(key, (0.0, 0))[0]:
                    best[key] = (share, e - int(first[doc[r]]))
            lo = hi
        return [(d, i, s, e) for (d, i), (s, e) in sorted(best.items())]


def word_shares(docs: DataFrame, vocabulary: np.ndarray, text_col: str) -> dict[int, float]:
    """Share of all corpus words that each word of a bounded, sorted vocabulary of hashes has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in text_slices(texts, SLICE_CHARS):
                h = words_of(texts[lo:hi]).hash
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
                total += len(h)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], total))], names=["k", "n"])

    rows = docs.select(whole(text_col).alias("_t")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    counted = {r["k"]: r["n"] for r in rows}
    total = max(counted.pop(-1, 0), 1)
    return {int(vocabulary[k]): n / total for k, n in counted.items()}


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least: float = 0.4, rarity: float = 1e-8, least_seeds: int = 12, block_words: int = 1_000_000,
) -> DataFrame:
    """(doc_id, item_id, score, last_word): documents that hold a copy or an edited copy of a test item."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("_t"))
    items = benchmark.select(F.col(item_col).alias("item_id"), whole(item_text_col).alias("_t"))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("_t", r"\s+"))), F.lit(0))).first()[0]
    blocks = int(size) // block_words + 1

    def block_leaks(k: int) -> DataFrame:
        rows = items.filter(F.pmod(F.xxhash64("item_id", "_t"), F.lit(blocks)) == k).collect()
        ids, texts = [r["item_id"] for r in rows], [r["_t"] for r in rows]
        vocabulary = np.unique(words_of(texts).hash)
        shares = word_shares(docs, vocabulary, text_col) if len(vocabulary) else {}
        held = Items(ids, texts, shares, rarity, least_seeds)
        item_type = to_arrow_type(items.schema["item_id"].dataType)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                for lo, hi in text_slices(texts, SLICE_CHARS):
                    found = held.leaks(texts[lo:hi], least) if len(held.seed) else []
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).take(pa.array([lo + f[0] for f in found])), pa.array([held.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found]), pa.array([f[3] for f in found], pa.int64())],
                            names=["doc_id", "item_id", "score", "last_word"],
                        )

        return given.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, last_word bigint")

    if blocks == 1:
        return block_leaks(0)
    return reduce(DataFrame.unionByName, [stored(block_leaks(k), "leaks") for k in range(blocks)])


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that hold no test item, with all their columns. Rows are judged by id and text each, whatever their ids."""
    key = F.xxhash64(F.col(id_col), whole(text_col))
    leaks = find_leaks(docs.select(key.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text", **how)
    keyed = docs.select(F.struct("*").alias("_row"), key.alias("key"))
    gone = stored(leaks.select(F.col("doc_id").alias("key")).distinct(), "leaking")
    left = keyed.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "key", "left_anti")
    return left.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
