"""The stored graph of coded triples answers as the walks over plain edges do."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import coded, context, graph


def triples_of(spark, rows):
    return spark.createDataFrame([(*r, "iri") if len(r) == 3 else r for r in rows], "s string, p string, o string, o_kind string")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(60):02d}", rng.choice(["sees", "holds"]), f"n{rng.randrange(60):02d}") for _ in range(90)]
    rows += [("hub", "holds", f"n{i:02d}") for i in range(40)] + rows[:5]
    rows += [(f"n{i:02d}", "rdf:type", "Camera" if i % 3 else "Light") for i in range(50)] + [("n00", "rdf:type", "Zebra"), ("alone", "rdf:type", "Light")]
    rows += [(None, "sees", "n01"), ("n01", "sees", None), ("n01", None, "n02"), ("n01", "name", "a text", "literal")]
    plain = triples_of(spark, rows)
    return plain, coded.store_graph(plain, str(tmp_path_factory.mktemp("kept") / "graph"))


def ends(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "focal string")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_numbers_follow_the_names(kept):
    by_name = kept[1].terms.orderBy("term").collect()
    assert [r["id"] for r in by_name] == sorted(r["id"] for r in by_name) and len({r["id"] for r in by_name}) == len(by_name)
    assert "a text" not in {r["term"] for r in by_name} and "alone" in {r["term"] for r in by_name}


@pytest.mark.parametrize("most", [0, 3, 1_000])
def test_hops_agree_however_the_frontier_meets_the_edges(spark, kept, monkeypatch, most):
    monkeypatch.setattr(coded, "FILTER_IDS", most)
    plain, g = kept
    focal = ends(spark, "hub", "n03", "n59")
    want = graph.hops_from(context.entity_edges(plain).dropna(), focal, 3)
    got = coded.named(g, coded.coded_hops(g, focal, 3), ["focal", "node"])
    known = {r["term"] for r in g.terms.collect()}
    assert rows(got, "focal", "node", "hop") == [r for r in rows(want, "focal", "node", "hop") if r[0] in known]


def test_context_graph_has_the_same_rows(spark, kept):
    plain, g = kept
    ages = spark.createDataFrame([("n05", 9.0), ("n07", 1.0), ("nowhere", 2.0)], "node string, age_min double")
    cols = ("focal", "node", "type", "hop", "relevance", "rank")
    want = context.context_graph(context.entity_edges(plain).dropna(), context.node_types(plain), ages, ends(spark, "hub", "n03"), ["Light"], 2, 12)
    assert rows(coded.coded_context_graph(g, ages, ends(spark, "hub", "n03"), ["Light"], 2, 12), *cols) == rows(want, *cols)


def test_relations_neighbourhood_and_unknown_terms(spark, kept):
    plain, g = kept
    sees = coded.named(g, coded.coded_hops(g, ends(spark, "hub"), 2, ["sees"]), ["node"])
    assert rows(sees, "node") == [("hub",)]
    want = graph.neighborhood(context.entity_edges(plain).dropna(), context.node_types(plain), spark.createDataFrame([("n03",)], "id string"), 2, "Light")
    assert rows(coded.coded_neighborhood(g, spark.createDataFrame([("n03",)], "id string"), 2, "Light"), "node") == rows(want, "node")
    assert coded.coded_hops(g, ends(spark, "nowhere", None), 2).count() == 0


def test_paths(spark, kept):
    plain, g = kept
    edges = context.entity_edges(plain).dropna()
    for a, b in [("hub", "n59"), ("n03", "n41"), ("n03", "n03"), ("alone", "n03"), ("nowhere", "n03"), ("nowhere", "nowhere")]:
        assert rows(coded.coded_path(g, a, b), "path") == rows(graph.shortest_path(edges, a, b), "path")


def test_kept_graph_is_stored_once_and_a_torn_one_again(spark, tmp_path):
    path = str(tmp_path / "g")
    first = coded.kept_graph(triples_of(spark, [("a", "r", "b"), ("b", "rdf:type", "T")]), path)
    again = coded.kept_graph(triples_of(spark, [("x", "r", "y")]), path)  # a whole graph lies there: it stays
    assert rows(again.terms, "term") == rows(first.terms, "term") == [("a",), ("b",)]
    (tmp_path / "g" / "types" / "_SUCCESS").unlink()
    assert rows(coded.kept_graph(triples_of(spark, [("x", "r", "y")]), path).terms, "term") == [("x",), ("y",)]


def test_empty_graph(spark, tmp_path):
    g = coded.store_graph(triples_of(spark, []), str(tmp_path / "g"))
    ages = spark.createDataFrame([], "node string, age_min double")
    assert g.edges.count() == 0 and coded.coded_context_graph(g, ages, ends(spark, "a"), ["T"]).count() == 0
    assert coded.coded_path(g, "a", "b").count() == 0 and g.edges.filter(F.col("rel") == "r").count() == 0
