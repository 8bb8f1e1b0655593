"""The steps of the Jaccard join: what is dealt, and which sets meet."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import jaccard
from graphloom.llm.shared import Scratch
from graphloom.operators.graph import components, stars

SETS = "set_id bigint, n bigint, hashes array<bigint>"


def words(seed, n):
    return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 1 << 40, n)]


def table(spark, sets):
    return spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, s in enumerate(sets)], SETS)


def watched(monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "components", lambda edges: seen.append(edges.collect()) or components(edges))
    return seen


def test_dealt_shingles_stay_small_in_many_buckets(spark):
    shared = words(999, 60)
    texts = [" ".join(words(i, 200) + (shared[i % 7 :] if i % 3 == 0 else [])) for i in range(200)] + ["a b", "", "a  B", "one"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3).cache()
    dealt = jaccard.dealt_shingles(d, 5, "text", 1000)
    size = dealt.agg(F.sum(F.length("h") + F.coalesce(F.length("of"), F.lit(0)))).first()[0]
    flat, sizes, ids = jaccard.text_sets(texts, 5)
    assert size < 3 * len(flat)
    for percent in (75, 50):
        of = np.repeat(ids, sizes)
        pairs = {(h, s) for h, s in zip(flat.tolist(), of.tolist(), strict=True) if percent < 75 or h >= 0}
        many = Counter(h for h, _ in pairs)
        want = Counter(s for h, s in pairs if many[h] > 1)
        once = d.filter("text <> 'a  B'")  # a copy in another task would count as another set
        assert {r["set_id"]: r["shared"] for r in jaccard.shared_counts(once, 5, "text", 1000, percent).collect()} == want
        assert {r["set_id"]: r["shared"] for r in jaccard.shared_counts(once, 5, "text", 2, percent).collect()} == want


def test_chance_shingles_tie_no_cluster(spark, monkeypatch):
    sets = []
    for f in range(30):
        own = np.sort(np.random.default_rng(f).integers(1 << 40, 1 << 60, 95))
        sets += [np.sort(np.append([f, f + 1], np.delete(own, [k, 40 + k]))) for k in range(3)]
    seen = watched(monkeypatch)
    with Scratch(spark, "chance") as scratch:
        got = {r["node"]: r["root"] for r in components(jaccard.links(table(spark, sets), scratch)).collect()}
        assert got == {i: i - i % 3 for i in range(90)}
        assert {(r["a"] // 3, r["b"] // 3) for r in seen[0]} == {(f, f) for f in range(30)}


def test_no_link_leaves_a_cluster(spark):
    rng, sets = np.random.default_rng(5), []
    passage = rng.integers(0, 1 << 60, 30)
    for f in range(24):
        base = rng.integers(0, 1 << 60, int(rng.integers(1, 90)))
        for _ in range([1, 2, 3, 7, 12, 30][f % 6]):
            s = base.copy()
            for _ in range(int(rng.integers(0, 1 + len(s) // 6))):
                s[rng.integers(len(s))] = rng.integers(1 << 60)
            sets.append(np.unique(np.append(s, passage) if rng.random() < 0.3 else s))
    d = table(spark, sets)
    for percent, common in ((75, 500_000), (75, 3), (50, 40)):
        prefixes = jaccard.prefix_keys(d, percent, common).cache()
        edges = jaccard.near_pairs(prefixes, percent, 3).unionByName(stars(prefixes.filter("often"), "key", "set_id"))
        root = {r["node"]: r["root"] for r in components(edges).collect()}
        linked = 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both):
                    linked += 1
                    assert root[i] == root[j]
        assert linked > 500


def test_pipeline_stage_ties_no_texts_by_a_phrase(spark, monkeypatch):
    rows, family = [], {}
    for f in range(30):
        base = words(1000 + f, 90) + words(5000 + f, 5) + words(2000 + f, 20) + words(5001 + f, 5)
        rows += [(3 * f + k, " ".join([*base, f"end{f}-{k}"])) for k in range(3)]
    for i, x in enumerate(jaccard.text_sets([t for _, t in rows], 5)[2].tolist()):
        family[x] = i // 3
    seen = watched(monkeypatch)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 90, 3))
    assert {(family[r["a"]], family[r["b"]]) for r in seen[0]} == {(f, f) for f in range(30)}
