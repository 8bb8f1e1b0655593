"""Language-model scores by subword lattices.

The pieces of an existing vocabulary span a lattice over every word; no segmentation is chosen, all of
them are weighted. A log-space forward recursion sums the lattice, and a document's probability is the
product over its words and one end. The vocabulary's own scores rank its pieces; piece probabilities
start from those ranks and are then re-estimated once from the expected piece counts of the whole training
part (forward-backward over its words, counts weighted), so that what is gathered grows with the corpus.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. The base score is an add-one word unigram over the same
training part; words are told apart by a 64-bit hash. Counts of the ``common`` most frequent words are sent
to all executors, every other word meets its count in a join.

Defined results: a null or empty text is the end alone; without training documents every count is zero and the
pieces keep their ranked start; bytes outside the vocabulary's pieces use its byte pieces; repeated rows each get
a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import _ranges, text_slices
from graphloom.llm.hashing import Batch, _power, mixed
from graphloom.llm.shared import stored


class Pieces:
    """Pieces of a sentencepiece model as byte strings, a hash table over them, and their log-probabilities."""

    def __init__(self, model_path: str, weights: np.ndarray | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        text, rank = [], []
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        last = max(-model.get_score(i) for i in ids if model.get_score(i) > -1e8)
        for i in ids:
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                text.append(bytes([int(piece[1:-1], 16)]))
                rank.append(10 * last)
            elif " " not in piece.replace("▁", " ")[1:] and model.get_score(i) > -1e8:
                text.append(piece.replace("▁", " ").encode())
                rank.append(-model.get_score(i))
        best: dict[bytes, float] = {}
        for t, r in zip(text, rank, strict=True):  # a byte piece may spell the same as a one-letter piece
            best[t] = min(r, best.get(t, r))
        self.text = sorted(best)
        start = 1 / (np.array([best[t] for t in self.text]) + 10)
        self.start = np.append(start, np.median(start))  # the end comes last
        self.start /= self.start.sum()
        self.size = len(self.text)
        self.lengths = sorted({len(t) for t in self.text})
        up, _ = _power(max(self.lengths) + 1)
        keys = np.array([np.sum((np.frombuffer(t, np.uint8).astype(np.uint64) + np.uint64(1)) * up[: len(t)], dtype=np.uint64) for t in self.text], np.uint64)
        self.slots = np.uint64(1 << 18)
        self.key, self.id = np.zeros(int(self.slots) + 64, np.uint64), np.full(int(self.slots) + 64, -1, np.int32)
        for i, k in enumerate(mixed(keys).tolist()):
            at = k % int(self.slots)
            while self.id[at] >= 0:
                at += 1
            self.key[at], self.id[at] = k, i
        runs = np.flatnonzero(np.append(self.id, -1) < 0)
        self.longest_probe = int(np.max(np.diff(np.append(-1, runs)))) - 1
        self.log = np.log(self.start if weights is None else weights)

    def estimated(self, counts: np.ndarray, prior: float = 1000.0) -> np.ndarray:
        """Probabilities from expected counts (the end's last) with ``prior`` counts of the start."""
        total = counts + prior * self.start
        return total / total.sum()

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        at = (key & (self.slots - np.uint64(1))).astype(np.int64)
        out = np.where(self.key[at] == key, self.id[at], -1)
        todo = np.flatnonzero((out < 0) & (self.id[at] >= 0))
        for step in range(1, self.longest_probe):
            if not len(todo):
                break
            k = at[todo] + step
            same = self.key[k] == key[todo]
            out[todo[same]] = self.id[k[same]]
            todo = todo[~same & (self.id[k] >= 0)]
        return out


class Lattice:
    """All pieces inside many words: edges with start, end and piece, in order of their end's place in its word."""

    def __init__(self, pieces: Pieces, data: np.ndarray, sizes: np.ndarray):
        """``data``: the bytes of all words, each led by a blank; ``sizes``: bytes of each."""
        self.pieces, n = pieces, len(data)
        self.ends = np.cumsum(sizes)
        self.first = self.ends - sizes
        up, down = _power(n + 1)
        total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64))
        reach = np.repeat(self.ends, sizes)
        place = np.arange(n)
        begin, piece, size = [], [], []
        for k in pieces.lengths:
            if k > n:
                break
            at = place[: n - k + 1][reach[: n - k + 1] - place[: n - k + 1] >= k]
            if not len(at):
                break
            got = pieces.find(mixed((total[at + k] - total[at]) * down[at]))
            hit = got >= 0
            begin.append(at[hit])
            piece.append(got[hit])
            size.append(np.full(int(hit.sum()), k))
        begin, self.piece, size = np.concatenate(begin), np.concatenate(piece), np.concatenate(size)
        # nodes: one more than bytes in each word
        word = np.repeat(np.arange(len(sizes)), sizes)[begin]
        self.a, self.b = begin + word, begin + word + size
        self.root, self.goal = self.first + np.arange(len(sizes)), self.ends + np.arange(len(sizes))
        self.nodes = n + len(sizes)
        self.offset = self.a - self.root[word]
        self.word, self.far = word, self.offset + size

    def _waves(self, key: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges in groups of equal ``key``, each group with the firsts of its runs of equal ``node``."""
        order = np.lexsort((node, key))
        cut = np.append(np.flatnonzero(np.append(True, np.diff(key[order]) != 0)), len(order))
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            edges = order[x:y]
            yield edges, np.flatnonzero(np.append(True, np.diff(node[edges]) != 0))

    @staticmethod
    def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
        top = np.maximum.reduceat(values, first)
        sizes = np.diff(np.append(first, len(values)))
        return top + np.log(np.add.reduceat(np.exp(values - np.repeat(top, sizes)), first))

    def forward(self) -> np.ndarray:
        alpha, score = np.full(self.nodes, -np.inf), self.pieces.log[self.piece]
        alpha[self.root] = 0
        for edges, first in self._waves(self.far, self.b):
            alpha[self.b[edges[first]]] = self._sum(alpha[self.a[edges]] + score[edges], first)
        return alpha

    def log_totals(self) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        return self.forward()[self.goal]

    def expected(self, weight: np.ndarray) -> np.ndarray:
        """Expected count of every piece, words counted ``weight`` times; the end's place is left at zero."""
        alpha, score = self.forward(), self.pieces.log[self.piece]
        beta = np.full(self.nodes, -np.inf)
        beta[self.goal] = 0
        length = (self.goal - self.root)[self.word]
        for edges, first in self._waves(length - self.offset, self.a):
            beta[self.a[edges[first]]] = self._sum(beta[self.b[edges]] + score[edges], first)
        share = np.exp(alpha[self.a] + score + beta[self.b] - alpha[self.goal][self.word]) * weight[self.word]
        return np.bincount(self.piece, share, self.pieces.size + 1)


def word_bytes(b: Batch, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of chosen words of a batch, each led by a blank, and their sizes."""
    sizes = b.end[which] - b.begin[which] + 1
    data = b.data[np.maximum(_ranges(b.begin[which] - 1, sizes), 0)].copy()
    data[np.cumsum(sizes) - sizes] = 32
    return data, sizes


class WordCounts:
    """Counts of distinct words with their bytes, for one task."""

    def __init__(self):
        self.hash, self.at, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.data, self.sizes = [], []

    def add(self, b: Batch) -> None:
        h, which, n = np.unique(b.hash, return_index=True, return_counts=True)
        if not len(h):
            return
        place = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        old = self.hash[place] == h if len(self.hash) else np.zeros(len(h), bool)
        self.count[self.at[place[old]]] += n[old]
        data, sizes = word_bytes(b, which[~old])
        self.data.append(data)
        self.sizes.append(sizes)
        new = np.arange(len(self.count), len(self.count) + len(sizes))
        self.count = np.append(self.count, n[~old])
        hashes, at = np.append(self.hash, h[~old]), np.append(self.at, new)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.at = hashes[order], at[order]

    def rows(self, pieces: Pieces, chunk: int = 60_000) -> Iterator[pa.RecordBatch]:
        """Word counts (kind 0) and expected piece counts (kind 1)."""
        if not len(self.hash):
            return
        data, sizes, expected = np.concatenate(self.data), np.concatenate(self.sizes), np.zeros(pieces.size + 1)
        ends = np.append(0, np.cumsum(sizes))
        for i in range(0, len(sizes), chunk):
            j = min(i + chunk, len(sizes))
            expected += Lattice(pieces, data[ends[i] : ends[j]], sizes[i:j]).expected(self.count[i:j])
        yield _rows(0, self.hash.view(np.int64), self.count[self.at])
        some = np.flatnonzero(expected)
        yield _rows(1, some, expected[some])


def _rows(kind: int, key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(value.astype(float))], names=["kind", "key", "value"])


_made: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The worker's pieces with their ranked start."""
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def gather(train: DataFrame, model_path: str, text_col: str = "text", most_words: int = 1_500_000) -> DataFrame:
    """(kind, key, value) over all training documents: kind 0 words by hash, 1 pieces by place, 2 documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, words, docs = pieces_of(model_path), WordCounts(), 0
        for b in batches:
            texts = b.column(0).to_pylist()
            docs += len(texts)
            for lo, hi in text_slices(texts):
                words.add(Batch(texts[lo:hi]))
                if len(words.hash) > most_words:
                    yield from words.rows(pieces)
                    words = WordCounts()
        yield from words.rows(pieces)
        if docs:
            yield _rows(2, np.zeros(1), np.full(1, docs))

    rows = train.select(F.coalesce(text_col, F.lit("")).alias("_t")).mapInArrow(run, "kind int, key bigint, value double")
    return stored(rows.groupBy("kind", "key").agg(F.sum("value").alias("value")), "gathered")


def lattice_scores(docs: DataFrame, held_out: Column, model_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = 300_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Learns from rows that are not ``held_out``."""
    spark = docs.sparkSession
    gathered = gather(docs.filter(~held_out), model_path, text_col)
    words, parts = gathered.filter("kind = 0"), gathered.filter("kind = 1")
    train_docs = int(gathered.filter("kind = 2").agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0])
    total, distinct = words.agg(F.coalesce(F.sum("value"), F.lit(0.0)), F.count(F.lit(1))).first()
    n, v = int(total) + train_docs, distinct + (train_docs > 0)
    pieces = Pieces(model_path)
    expected = np.zeros(pieces.size + 1)
    for r in parts.select("key", "value").collect():  # one row for each piece of the vocabulary at most
        expected[r["key"]] = r["value"]
    expected[-1] = train_docs
    top = words.orderBy(F.desc("value"), "key").limit(common).select("key", "value").toArrow()
    key, value = top["key"].to_numpy(), top["value"].to_numpy()
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], np.log10(value[order] + 1), pieces.estimated(expected)))
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.coalesce(text_col, F.lit("")).alias("_t"))
    end = np.log10(train_docs + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, logs, weights = sent.value
        model = Pieces(model_path, weights)
        known_hash, known_log = np.zeros(0, np.uint64), np.zeros(0)
        row = TaskContext.get().partitionId() << 36  # rows of a task follow each other, up to 2**36 of them
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in text_slices(texts):
                b = Batch(texts[lo:hi])
                h, which, back = np.unique(b.hash, return_index=True, return_inverse=True)
                place = np.minimum(np.searchsorted(known_hash, h), max(len(known_hash) - 1, 0))
                old = known_hash[place] == h if len(known_hash) else np.zeros(len(h), bool)
                of_word = np.zeros(len(h))
                of_word[old] = known_log[place[old]]
                if (~old).any():
                    data, sizes = word_bytes(b, which[~old])
                    ends, logp = np.append(0, np.cumsum(sizes)), []
                    for i in range(0, len(sizes), 60_000):
                        j = min(i + 60_000, len(sizes))
                        logp.append(Lattice(model, data[ends[i] : ends[j]], sizes[i:j]).log_totals())
                    of_word[~old] = np.concatenate(logp)
                    if len(known_hash) > 600_000:
                        known_hash, known_log = known_hash[:0], known_log[:0]
                    hashes = np.append(known_hash, h[~old])
                    order = np.argsort(hashes, kind="stable")
                    known_hash, known_log = hashes[order], np.append(known_log, of_word[~old])[order]
                docs_here = hi - lo
                score = np.bincount(b.doc, of_word[back], docs_here) / np.log(10) + model.log[-1] / np.log(10)
                at = np.minimum(np.searchsorted(key, h.view(np.int64)), max(len(key) - 1, 0))
                have = key[at] == h.view(np.int64) if len(key) else np.zeros(len(h), bool)
                gain = np.where(have, logs[at] if len(key) else 0.0, 0.0)[back]
                seen = have[back]
                rare = ~seen
                offsets = np.append(0, np.cumsum(np.bincount(b.doc[rare], minlength=docs_here)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(docs_here)), batch.column(0).slice(lo, docs_here), batch.column(1).slice(lo, docs_here), pa.array(b.words + 1),
                        pa.array(np.bincount(b.doc[seen], minlength=docs_here) + int(train_docs > 0)), pa.array(np.bincount(b.doc, gain, docs_here) + end), pa.array(score),
                        pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(b.hash[rare].view(np.int64))),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "gain", "score", "rare"],
                )
                row += docs_here

    rows = stored(given.mapInArrow(run, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, gain double, score double, rare array<bigint>"), "scored")
    rare = rows.select("row", F.explode("rare").alias("_word")).join(words.select("key", F.log10(F.col("value") + 1).alias("_gain")), F.col("_word") == F.col("key"))
    more = rare.groupBy(F.col("row").alias("_row")).agg(F.sum("_gain").alias("_more"), F.count(F.lit(1)).alias("_seen"))
    joined = rows.drop("rare").join(more, F.col("row") == F.col("_row"), "left")
    base = F.col("gain") + F.coalesce("_more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_seen", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
