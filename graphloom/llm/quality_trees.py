"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed in batches on the executors. Trees are grown on the driver
from a bounded sample of labelled rows (``sample_rows``, by lowest hash of the id), by histograms of
binned statistics; they are then flattened into arrays of equal shape, and scoring walks all trees of
all rows of a batch together.

Defined results: null and empty texts have zero statistics and get a score like any other row; without
any label every score is 0.5; with one label value only, every score is near that value; repeated rows
each get a row; labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import text_slices
from graphloom.llm.hashing import Batch, per_text_sets

_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": [32, 9, 11, 12, 13], "newline": [10], "stop": [46],
    "comma": [44, 59, 58], "shout": [33], "ask": [63], "symbol": list(b"#*$%&|<>"), "quote": list(b"\"'`"), "bracket": list(b"()[]{}"),
    "other": list(b"+-/=@\\^_~"), "high": range(128, 256),
}
_CLASS = np.zeros(256, np.int64)
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
STATISTICS = (
    *(f"share_{c}" for c in _CLASSES), "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "long_words", "short_words", "distinct_words", "top_word",
    "distinct_pairs", "words_a_line", "distinct_lines", "marked_ends", "capital_words", "shouted_words", "words_a_stop",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(texts)
    b = Batch(texts, keep_case=True)
    out = np.zeros((n, len(STATISTICS)))
    place = np.repeat(np.arange(n), b.sizes + 1)[: len(b.data)]
    counts = np.bincount(place * len(_CLASSES) + _CLASS[b.data], minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    lines = counts[:, list(_CLASSES).index("newline")]
    lines[:] = np.maximum(lines - 1, 0)  # one newline ends each text of a batch
    size, words = np.maximum(b.sizes, 1), np.maximum(b.words, 1)
    out[:, : len(_CLASSES)] = counts / size[:, None]
    length = (b.end - b.begin).astype(float)
    per = lambda x: np.bincount(b.doc, weights=x, minlength=n)
    mean = per(length) / words
    first, last = b.data[b.begin], b.data[b.end - 1]
    caps = (first >= 65) & (first <= 90)
    upper = np.append(0, np.cumsum((b.data >= 65) & (b.data <= 90)))
    lower = np.append(0, np.cumsum((b.data >= 97) & (b.data <= 122)))
    shouted = (upper[b.end] - upper[b.begin] > 1) & (lower[b.end] == lower[b.begin])
    plain = ((last >= 97) & (last <= 122)) | ((last >= 65) & (last <= 90)) | (last >= 128)
    hashed, sets = per_text_sets(b.hash, b.doc, n)
    order = np.lexsort((b.hash, b.doc))
    run_edge = np.append(True, (b.hash[order][1:] != b.hash[order][:-1]) | (b.doc[order][1:] != b.doc[order][:-1])) if len(order) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(run_edge), len(order)))
    top = np.zeros(n)
    if len(order):
        np.maximum.at(top, b.doc[order][run_edge], runs)
    pair, pair_doc, _ = b.shingles(2)
    pairs = per_text_sets(pair, pair_doc, n)[1]
    kinds = np.array([len(set(t.split("\n"))) for t in texts], float)
    rest = (
        np.log1p(b.sizes), np.log1p(b.words), mean, np.sqrt(np.maximum(per(length**2) / words - mean**2, 0)), per(length > 12) / words, per(length < 3) / words,
        sets / words, top / words, pairs / np.maximum(b.words - 1, 1), b.words / (lines + 1), kinds / (lines + 1), per(~plain) / words, per(caps) / words,
        per(shouted) / words, b.words / np.maximum(counts[:, list(_CLASSES).index("stop")], 1),
    )
    for i, x in enumerate(rest, len(_CLASSES)):
        out[:, i] = x
    return out


class Trees:
    """Boosted trees as arrays: split statistic, threshold and value of every node, trees in rows, nodes in heap order."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, start: float):
        self.feature, self.threshold, self.value, self.start = feature, threshold, value, start

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, nodes = self.feature.shape
        rows, offset = np.arange(len(x))[:, None], np.arange(trees)[None, :] * nodes
        at = np.zeros((len(x), trees), np.int64)
        feature, threshold = self.feature.ravel(), self.threshold.ravel()
        for _ in range(int(np.log2(nodes + 1)) - 1):
            k = at + offset
            at = 2 * at + 1 + (x[rows, feature[k]] > threshold[k])
        total = self.start + self.value.ravel()[at + offset].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boost ``trees`` trees of the logistic loss; every split is chosen from gradient histograms of binned statistics."""
    n, m, nodes = *x.shape, 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(feature, threshold, value, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, start)
    shift = np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (m * bins) + shift + binned).ravel()
            hist = lambda w, key=key, width=width: np.bincount(key, np.repeat(w, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2)
            gl, hl, nl = hist(g), hist(h), hist(np.ones(n))
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + k], threshold[t, first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > threshold[t][node])
        leaf = slice(2**depth - 1, nodes)
        gs, hs = np.bincount(node, g, nodes)[leaf], np.bincount(node, h, nodes)[leaf]
        value[t, leaf] = rate * gs / (hs + ridge)
        total += value[t][node]
    return Trees(feature, threshold, value, start)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and the statistics of the whole text as an array."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                rows = pa.array(list(statistics(texts[lo:hi])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), rows], names=["doc_id", "x"])

    return given.mapInArrow(run, f"doc_id {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000, **shape) -> Trees:
    """Grow trees from at most ``sample_rows`` rows of ``labels`` that have a label, those with the least hash of the id.
    Of rows that repeat an id, the text with the least hash counts."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    picked = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"), "left_semi")
    once = picked.groupBy("_doc").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))["t"].alias("_text"))
    rows = with_statistics(once, "_doc", "_text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("doc_id", "x", "_y").toPandas()
    rows = rows.sort_values("doc_id")
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(STATISTICS)))
    return grow(x, rows["_y"].to_numpy(float), **shape)


def score(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and score of every row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_t"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                s = trees.score(statistics(texts[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(s)], names=["doc_id", "score"])

    return given.mapInArrow(run, f"doc_id {kind}, score double")
