"""Language identification in two levels: family first, then language within the family.

Both levels are one-versus-one linear support vector machines over hashed byte trigrams of the
lower-cased text. The machines are trained on the driver from a bounded sample: for every language the
``sample_docs`` documents with the lowest text hash. Scoring adds up the weights of all trigrams of a
whole text, so it needs no count vectors.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any labelled
text everything is ``und``; with one language that language is always predicted; null language
values are never learned from; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.bpe import text_slices

BITS = 16
#: Language codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu", "baltic": "lt lv", "celtic": "ga cy gd br", "turkic": "tr az kk uz",
    "indic": "hi ur bn mr gu pa ne", "semitic": "ar he mt am", "sinitic": "zh yue",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram of every byte place, and how many each text has. A blank stands before and after each text."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b" " + b"  ".join(raw) + b" ", np.uint8).copy()
    data[(data < 33)] = 32
    d = data.astype(np.uint32)
    h = (((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    start = np.append(0, np.cumsum(sizes + 2))[:-1]
    keep = np.ones(len(h), bool)
    keep[(start[1:] - 1)] = False  # the place between two texts
    keep[(start[1:] - 2)] = False
    return h[keep], sizes


class Machines:
    """One-versus-one machines of both levels: ``weights`` has a row for each pair in ``pairs``."""

    def __init__(self, langs: list[str], pairs: list[tuple[str, str, str]], weights: np.ndarray, bias: np.ndarray, slope: np.ndarray):
        self.langs, self.pairs, self.weights, self.bias, self.slope = langs, pairs, weights, bias, slope
        self.families = sorted({family(x) for x in langs})

    def margins(self, texts: list[str]) -> np.ndarray:
        h, sizes = trigrams(texts)
        out = np.zeros((len(texts), len(self.pairs)))
        ends = np.cumsum(sizes)
        for k, w in enumerate(self.weights):
            total = np.append(0, np.cumsum(w[h], dtype=np.float64))
            out[:, k] = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1) * 100 + self.bias[k]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text: the family's times the language's, each the mean over its machines."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        p = 1 / (1 + np.exp(-np.clip(self.margins(texts) * self.slope, -40, 40)))

        def winner(names: list[str], level: str) -> tuple[np.ndarray, np.ndarray]:
            votes, sure = np.zeros((len(texts), len(names))), np.zeros((len(texts), len(names)))
            for k, (of, a, b) in enumerate(self.pairs):
                if of == level and a in names and b in names:
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += p[:, k] >= 0.5
                    votes[:, j] += p[:, k] < 0.5
                    sure[:, i] += p[:, k] / (len(names) - 1)
                    sure[:, j] += (1 - p[:, k]) / (len(names) - 1)
            best = (votes + sure / 2).argmax(axis=1)
            return best, np.ones(len(texts)) if len(names) == 1 else sure[np.arange(len(texts)), best]

        top, sure = winner(self.families, "family")
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for i, f in enumerate(self.families):
            names = [x for x in self.langs if family(x) == f]
            best, inner = winner(names, f)
            mine = top == i
            lang[mine] = np.array(names, object)[best[mine]]
            score[mine] = (sure * inner)[mine]
        return lang.tolist(), score


def _machine(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, passes: int = 6, strength: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Linear machine by averaged subgradient steps on the hinge loss; also the slope that makes margins probabilities."""
    w, total, bias, total_bias, scale = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, 1.0
    rng, step = np.random.default_rng(7), 0
    for _ in range(passes):
        for i in rng.permutation(len(x)):
            step += 1
            rate = 1 / (1 + strength * 100 * step)
            scale *= 1 - rate * strength
            at, v = x[i]
            if y[i] * (scale * (w[at] @ v) + bias) < 1:
                w[at] += rate * y[i] * v / scale
                total[at] += step * rate * y[i] * v / scale
                bias += 0.1 * rate * y[i]
            total_bias += bias
    n = max(step, 1)
    mean = scale * (w - total / n)
    bias = total_bias / n
    m = np.array([mean[at] @ v for at, v in x]) + bias
    typical = np.median(np.abs(m)) if len(m) else 1.0
    return mean, bias, 3 / max(typical, 1e-9)


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Machines:
    """Machines from (language, trigram ids, trigram counts) of sampled texts."""
    langs = sorted({s[0] for s in samples})
    families = sorted({family(x) for x in langs})
    x = [(at.astype(np.int64), n / max(n.sum(), 1) * 100) for _, at, n in samples]
    tag = np.array([s[0] for s in samples], object)
    group = np.array([family(s[0]) for s in samples], object)
    tasks = [("family", a, b, group) for a, b in combinations(families, 2)]
    tasks += [(f, a, b, tag) for f in families for a, b in combinations([z for z in langs if family(z) == f], 2)]
    made = []
    for _, a, b, of in tasks:
        rows = np.flatnonzero((of == a) | (of == b))
        made.append(_machine([x[i] for i in rows], np.where(of[rows] == a, 1.0, -1.0)))
    weights = np.array([m[0] for m in made], np.float32).reshape(len(made), 1 << BITS)
    return Machines(langs, [t[:3] for t in tasks], weights, np.array([m[1] for m in made]), np.array([m[2] for m in made]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = 1500) -> Machines:
    """Train on at most about ``sample_docs`` documents of each language, those with the least text hash.

    An estimate of a language's distinct texts bounds their hashes first, so the task that ranks a language gets about twice as many rows as
    it keeps, whatever the language's share."""
    known = docs.select(F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_t"), F.xxhash64(text_col).alias("_h")).filter("_lang is not null and _t is not null")
    sizes = known.groupBy("_lang").agg(F.approx_count_distinct("_h").alias("n")).collect()
    bounds = [(r["_lang"], -(1 << 63) + int(min(1.0, 2 * sample_docs / max(r["n"], 1)) * ((1 << 64) - 2048))) for r in sizes]
    low = F.coalesce(*[F.when((F.col("_lang") == x) & (F.col("_h") <= most), True) for x, most in bounds], F.lit(False))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy("_h"))
    edge = known.select("_lang", "_h").filter(low).distinct().withColumn("_n", rank).filter(F.col("_n") <= sample_docs).groupBy("_lang").agg(F.max("_h").alias("_edge"))
    edges = edge.collect()
    if not edges:
        return fit([])
    reach = F.coalesce(*[F.when((F.col("_lang") == r["_lang"]) & (F.col("_h") <= r["_edge"]), True) for r in edges], F.lit(False))
    chosen = known.filter(reach).dropDuplicates(["_lang", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            pairs = [np.unique(trigrams([t])[0], return_counts=True) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array([p[0].astype(np.int32) for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.int32) for p in pairs], pa.list_(pa.int32()))],
                names=["lang", "h", "at", "n"],
            )

    rows = chosen.mapInArrow(run, "lang string, h bigint, at array<int>, n array<int>").toArrow().sort_by([("lang", "ascending"), ("h", "ascending")])
    langs, at, n = rows["lang"].to_pylist(), rows["at"].combine_chunks(), rows["n"].combine_chunks()
    return fit([(langs[i], at[i].values.to_numpy(), n[i].values.to_numpy()) for i in range(len(langs))])


def predict(docs: DataFrame, machines: Machines, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, predicted language and score of every row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("_t"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_has"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, has = b.column(1).to_pylist(), b.column(2).to_pylist()
            for lo, hi in text_slices(texts):
                lang, score = machines.predict(texts[lo:hi])
                lang = [x if h else "und" for x, h in zip(lang, has[lo:hi], strict=True)]
                score = [x if h else 0.0 for x, h in zip(score.tolist(), has[lo:hi], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return given.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
