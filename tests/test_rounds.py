"""Operators that go in rounds: how many they need, what they look at, and results against brute force."""

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph, sums, taxonomy, traces


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def reach(edges):
    """{(src, dst): steps} by breadth-first search."""
    out, step = {}, {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for start in step:
        front, dist = [start], {start: 0}
        while front:
            front = [b for a in front for b in sorted(step.get(a, ())) if b not in dist and not dist.update({b: dist[a] + 1})]
        out.update({(start, b): d for b, d in dist.items() if b != start})
    return out


@pytest.fixture
def checkpoints(spark, monkeypatch):
    """Counts the checkpoints that are taken."""
    kind, taken = type(spark.range(1)), []
    real = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *a, **k: taken.append(1) or real(self, *a, **k))
    return taken


def test_closure_doubles(spark, checkpoints):
    chain = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst")
    got = graph.closure(chain)
    assert len(checkpoints) - 1 <= 12
    assert got.agg(F.count(F.lit(1)), F.count_if(F.col("hops") != F.col("dst") - F.col("src"))).first()[:] == (1000 * 1001 // 2, 0)


def test_closure_against_search(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(40), draw.randrange(40)) for _ in range(60)]
    got = graph.closure(spark.createDataFrame(edges + edges[:5], "src int, dst int"))
    assert {(r["src"], r["dst"]): r["hops"] for r in got.collect()} == reach(edges) and got.count() == len(reach(edges))
    assert graph.closure(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_reached_pairs_and_relaxing(spark):
    draw = random.Random(4)
    edges = [(draw.randrange(40), draw.randrange(40)) for _ in range(50)]
    pairs = [(draw.randrange(42), draw.randrange(42)) for _ in range(60)] + [(1, 1)]
    far, e = reach(edges), spark.createDataFrame(edges, "src int, dst int")
    p = spark.createDataFrame(pairs + pairs[:3], "a int, b int")
    assert rows(graph.reached_pairs(p, e), "a", "b") == sorted({q for q in pairs if q in far}, key=repr)
    relaxed = taxonomy.relax_disjointness(p, e)
    assert relaxed.count() == 64 and all(r["relaxed"] == ((r["a"], r["b"]) in far or (r["b"], r["a"]) in far) for r in relaxed.collect())


def test_only_what_is_asked_for_is_searched(spark):
    chain = spark.range(20).selectExpr("id AS src", "id + 1 AS dst")
    assert rows(graph.reached_pairs(spark.createDataFrame([(2, 15), (15, 2)], "a long, b long"), chain), "a", "b") == [(2, 15)]


def test_depth_of_long_chains_takes_few_rounds(spark, checkpoints):
    chain = spark.range(600).selectExpr("id AS src", "id + 1 AS dst")
    fork = spark.createDataFrame([(1000, 0), (1000, 300), (1001, 1000)], "src long, dst long")
    got = {r["node"]: r["depth"] for r in graph.longest_depth(chain.union(fork)).collect()}
    assert len(checkpoints) <= 24
    assert got == {**{i: 600 - i for i in range(601)}, 1000: 601, 1001: 602}


def test_depth_against_search(spark):
    draw = random.Random(5)
    edges = sorted({(a, draw.randrange(a)) for a in [draw.randrange(1, 50) for _ in range(90)]})
    depth = {}
    for node in range(50):
        up = [b for a, b in edges if a == node]
        if up or any(b == node for _, b in edges):
            depth[node] = max((depth[b] + 1 for b in up), default=0)
    loose = [(100, 101), (101, 100), (102, 100), (103, 102), (103, 0)]  # a loop that hangs under no root; 103 hangs under both
    got = {r["node"]: r["depth"] for r in graph.longest_depth(spark.createDataFrame(edges + loose, "src int, dst int")).collect()}
    assert got == {**depth, 103: depth.get(0, 0) + 1}


def test_cuts_look_at_live_knots_only(spark, monkeypatch):
    """A knot of 503 edges: three layers of complete links and three weak ways back; beside it 2,000 edges on no cycle."""
    layer = [range(i * 13, i * 13 + 13) for i in range(4)]
    down = [(a, b, 0.9) for x, y in zip(layer, layer[1:]) for a in x for b in y][:500]
    back = [(39 + i, i, 0.1 * (i + 1)) for i in range(3)]
    tree = [(10_000 + i, 10_000 + i // 2 if i else 0, 0.5) for i in range(1, 2001)]
    seen, real = [], graph.cyclic_edges
    monkeypatch.setattr(graph, "cyclic_edges", lambda edges: seen.append(edges.count()) or real(edges))
    kept, gone = graph.break_cycles(spark.createDataFrame(down + back + tree, "src int, dst int, confidence double"))
    assert rows(gone, "src", "dst") == sorted([(a, b) for a, b, _ in back], key=repr) and kept.count() == len(down) + len(tree)
    assert isinstance(kept, DataFrame) and len(seen) == 4 and seen[0] == len(down + back + tree) and all(n < 503 for n in seen[1:])


def test_parallel_edges_and_loops_go_together(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.9), (2, 1, 0.7), (3, 3, 1.0), (2, 4, 0.1)], "src int, dst int, confidence double")
    kept, gone = graph.break_cycles(e)
    assert rows(gone, "src", "dst", "confidence") == [(1, 2, 0.5), (1, 2, 0.9), (3, 3, 1.0)] and rows(kept, "src", "dst") == [(2, 1), (2, 4)]


@pytest.mark.parametrize("bits", [2, 4, 12])
def test_sums_in_levels(spark, bits):
    draw = random.Random(6)
    data = [(draw.choice(["a", "a", "b", None]), draw.randrange(-300, 900), draw.choice([None, 1, 5])) for _ in range(400)] + [("a", None, 7)]
    got = sums.sum_before(spark.createDataFrame(data, "k string, at int, v int"), "k", "at", "v", "s", bits)
    want = [(k, at, v, 0 if at is None else sum(w or 0 for k2, at2, w in data if k2 == k and at2 is not None and at2 < at)) for k, at, v in data]
    assert rows(got, "k", "at", "v", "s") == sorted(want, key=repr)


def test_one_run_is_audited_in_many_tasks(spark):
    spans = spark.range(20_000).selectExpr("'r' AS run_id", "id AS seq", "1 AS tokens")
    got = traces.budget_audit(spans, 15_000)
    assert got.agg(F.count_if("blocked"), F.count_if(F.col("spent") != F.col("seq"))).first()[:] == (5000, 0)
    assert "windowspecdefinition(run_id" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_few_predicates_do_not_bring_all_rows_together(spark):
    from graphloom.operators import verify

    ranked = spark.range(60).select(
        F.col("id").alias("seq"), (F.col("id") % 20).cast("string").alias("subject_iri"), F.when(F.col("id") % 3 == 0, "p").otherwise("q").alias("predicate_iri"), F.struct(F.col("id").alias("seq")).alias("rank")
    )
    limits = spark.createDataFrame([("p", 1)], "predicate_iri string, max_cardinality int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = verify.cardinality(ranked, limits)
        assert "hashpartitioning(predicate_iri" not in done._jdf.queryExecution().toString()
        assert done.filter("reason is not null").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
