"""Further operators against small fixtures and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import context, graph, mapping, ontology, retrieval, surface, taxonomy, verify, vocabulary
from graphloom.sources import io
from graphloom.streaming import feed
from tests.test_ontology import graph as small_ontology
from tests.test_operators import rows


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_radius_round_the_globe(spark):
    rng = np.random.default_rng(1)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150), strict=True)]
    spots += [(0.0, 179.999), (0.0, -179.999), (89.99, 10.0), (89.99, -170.0), (-89.995, 5.0), (90.0, 0.0), (-90.0, 3.0), (60.0, 180.0), (60.0, -180.0)]
    d = spark.createDataFrame([(i, *p, "A" if i % 2 else "B") for i, p in enumerate(spots)], "id int, lat double, lon double, type string")

    def metres(p, q):
        (a, b), (c, e) = [[math.radians(v) for v in x] for x in (p, q)]
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((e - b) / 2) ** 2
        return 2 * context.EARTH_M * math.asin(math.sqrt(min(1, h)))

    for r in (5_000.0, 900_000.0, 9_000_000.0):
        want = sorted((i, j) for i, p in enumerate(spots) for j, q in enumerate(spots) if metres(p, q) < r)
        assert rows(context.within_radius(d, d, r), "centre", "point") == sorted(want, key=repr)
    got = context.within_radius(d.filter("id = 150"), d, 900_000.0, "A").orderBy("rank").collect()
    assert all(r["point"] % 2 for r in got) and [r["metres"] for r in got] == sorted(r["metres"] for r in got)
    scene = io.incident_scene(spark)
    at = scene.groupBy(F.col("s").alias("id")).pivot("p", ["rdf:type", "hasLatitude", "hasLongitude"]).agg(F.first("o")).select("id", F.col("`rdf:type`").alias("type"), F.col("hasLatitude").cast("double").alias("lat"), F.col("hasLongitude").cast("double").alias("lon"))
    near = context.within_radius(at.filter("type = 'Incident'"), at, 500.0, "TrafficLight").orderBy("rank")
    assert [r["point"] for r in near.collect()] == ["TL_90", "TL_88", "TL_91"]


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[7] = 0
    v[20] = v[21]
    d = spark.createDataFrame([(i, f"n{i}", [float(x) for x in r]) for i, r in enumerate(v)], "seq long, id string, vec array<double>").repartition(3)
    q = d.filter("seq % 3 = 0").select(F.col("seq").alias("query_id"), "vec")
    norm = np.linalg.norm(v, axis=1)
    u = v / np.where(norm > 0, norm, 1)[:, None]
    want = []
    for i in range(0, 300, 3):
        s = np.round(u @ u[i], 6)
        want += [(i, f"n{j}", k + 1) for k, j in enumerate(sorted(range(300), key=lambda j: (-s[j], j))[:5])]  # noqa: B023
    for block in (20_000, 40):
        assert rows(retrieval.top_k(q, d, 5, block), "query_id", "id", "rank") == sorted(want, key=repr)
    labels = d.filter("seq < 50").select("id", F.col("seq").cast("int").alias("idx"), "vec")
    for block in (20_000, 20):
        best = {r["query_id"]: r["id"] for r in mapping.top_match(q, labels, block).collect()}
        for i in range(0, 300, 3):
            s = np.round(u[:50] @ u[i], 9)
            assert best[i] == f"n{s.argmax()}" or s[int(best[i][1:])] == s.max()


def test_memory_and_hybrid_recall(spark, tmp_path):
    path = str(tmp_path / "mem")
    assert io.read_vectors(spark, path).count() == 0
    notes = table(spark, "id string, text string", ("P1", "graph neural networks for molecules"), ("P2", "retrieval with dense vectors"), ("P3", "cooking pasta at home"))
    assert retrieval.remember(notes, path).count() == 3
    memory = retrieval.remember(table(spark, "id string, text string", ("P4", "graph search")), path)
    assert memory.count() == 4
    asked = table(spark, "query_id int, text string", (1, "graph neural networks"))
    found = retrieval.recall(asked, memory, 3).first()["notes"]
    assert found[0]["id"] == "P1" and found[0]["note"].startswith("graph neural") and found[-1]["id"] == "P4" and len(found) == 3
    seq = memory.withColumn("seq", F.xxhash64("id", "chunk"))
    q = retrieval.embedded(asked.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    edges = table(spark, "src string, rel string, dst string", ("P1", "CITES", "P9"), ("P9", "CITES", "P8"), ("A1", "WROTE", "P1"))
    types = table(spark, "node string, type string", *[(p, "Paper") for p in ("P1", "P8", "P9")], ("A1", "Author"))
    seeds, near = retrieval.hybrid_recall(q, seq, edges, types, 1)
    assert rows(seeds, "id") == [("P1",)] and rows(near, "node") == [("P1",), ("P9",)]


def test_semantic_links_in_tiles(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 5))
    v = [(base[i % 6] + rng.normal(size=5) * 0.15).tolist() for i in range(60)]
    tokens = [["common", f"t{i % 4}"] if i % 5 else ["EMS"] for i in range(60)]
    d = spark.createDataFrame([(i, tokens[i], v[i]) for i in range(60)], "id int, tokens array<string>, vec array<double>").repartition(3)
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = sorted(((i, j) for i in range(60) for j in range(i + 1, 60) if i % 5 and j % 5 and cos(v[i], v[j]) >= 0.93), key=repr)
    whole = rows(graph.components(table(spark, "a int, b int", *want)), "node", "root")
    for block in (2000, 7):
        links = vocabulary.semantic_links(d, block_rows=block)
        got = rows(links, "a", "b")
        assert set(got) <= set(want) and len(got) < len(want) and rows(graph.components(links), "node", "root") == whole
    stop = table(spark, "id int, tokens array<string>, vec array<double>", (1, ["number", "of", "12"], [1.0, 0.0]), (2, ["number", "of", "12"], [1.0, 0.0]), (3, ["zero"], [0.0, 0.0]), (4, ["zero"], [0.0, 0.0]))
    assert vocabulary.semantic_links(stop).count() == 0


def test_vector_index_probes_cells(spark, tmp_path):
    """Clustered vectors, one cluster a third of them: recall of a few cells, and all cells exactly."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    v = base[np.where(rng.random(4000) < 0.33, 0, rng.integers(40, size=4000))] + rng.normal(size=(4000, 12)) * 0.3
    d = spark.createDataFrame([(i, f"n{i}", x.tolist()) for i, x in enumerate(v)] + [(4001, "none", None)], "seq long, id string, vec array<double>")
    q = d.filter("seq % 40 = 0").select(F.col("seq").alias("query_id"), "vec")
    exact = set(rows(retrieval.top_k(q, d, 10), "query_id", "id"))
    path = str(tmp_path / "index")
    retrieval.index_vectors(d, path, retrieval.fit_cells(d, cells=32, sample_rows=1000))
    assert spark.read.parquet(f"{path}/lists").count() == 4000  # every vector, whatever the sample was
    share = {n: len(exact & set(rows(retrieval.top_k(q, path, 10, block_rows=40, probes=n), "query_id", "id"))) / len(exact) for n in (1, 6, 32)}
    assert share[32] == 1 and share[6] >= 0.9 and share[1] <= share[6]
    assert retrieval.fit_cells(d.limit(0)).size == 0


def test_vocabulary_rules(spark):
    schema = "text string, kind string, mention_count long, llm_only boolean, literal_span boolean, sources array<string>"
    given = [("--", "concept", 1, False, True, ["ner"]), ("12", "concept", 1, False, True, ["ner"]), ("Step", "concept", 1, False, True, ["ner"]), ("step", "relation", 1, False, True, ["ner"]), ("a b c d e f g h", "concept", 1, False, True, ["ner"]), ("CrisisManager", "concept", 1, True, False, ["llm"]), ("Crew", "concept", 2, True, False, ["llm"])]
    got = [r["x"] for r in table(spark, schema, *given).select(vocabulary.rejection_reason(*[F.col(c) for c in ("text", "kind", "mention_count", "llm_only", "literal_span", "sources")]).alias("x")).collect()]
    assert got == ["empty or symbol-only surface", "numeric or symbolic value, not a concept", "document boilerplate, not a domain concept", None, "sentence fragment (8 tokens)", "one-off ungrounded LLM proposal (appears nowhere in text)", None]
    scored = table(spark, "id string, kind string, scope_match double, mention_count long, salience double", ("a", "concept", 1.0, 1, 0.9), ("b", "concept", 0.0, 3, 0.5), ("c", "concept", 0.0, 1, 0.1), ("r", "relation", 0.0, 2, 0.0), ("s", "relation", 0.0, 1, 0.0))
    assert rows(vocabulary.keep_or_park(scored), "id", "kept", "reason") == [("a", True, None), ("b", True, None), ("c", False, "not in scope; mention_count < 3"), ("r", True, None), ("s", False, "mention_count < 2")]
    assert rows(vocabulary.keep_or_park(scored, 1).filter("id = 'b'"), "kept", "reason") == [(False, "not in scope; below top-1")]
    named = table(spark, "id string, surface string, label string, representative string, alt_labels array<string>", ("a", "x", "PrimeFactor", "Prime  Factors", []), ("b", "y", "Y", "y", ["boxes"]), ("c", "z", "Z", "z", None), ("d", "class", "Class", "class", []))
    assert rows(vocabulary.scope_hits(named, table(spark, "term string", ("prime factor",), ("Box",), (" ",), ("clas",))), "id") == [("a",), ("b",), ("d",)]
    assert rows(vocabulary.spread(table(spark, "id string, start int", ("a", 0), ("a", 6), ("a", 200), ("b", 3)), 119), "id", "spread") == [("a", 1.0), ("b", 1.0)]
    assert rows(vocabulary.spread(table(spark, "id string, start int", ("a", 0), ("a", 1)), 7), "id", "spread") == [("a", 1.0)]
    many = vocabulary.simple_salience(table(spark, "label string, grounded boolean", ("Fire-Unit", True), ("Pasta", False)), table(spark, "topic string", *[(f"topic {i}",) for i in range(30)], ("unit",)), block_topics=7)
    assert rows(many, "label", "scope_hit") == [("Fire-Unit", True), ("Pasta", False)]
    simple = vocabulary.simple_salience(table(spark, "label string, grounded boolean", ("Fire-Unit", True), ("unit", False), ("Pasta", False)), table(spark, "topic string", ("fire unit",)))
    assert rows(simple, "label", "salience", "kept") == [("Fire-Unit", 1.0, True), ("Pasta", 0.2, True), ("unit", 0.7, True)]
    assert rows(vocabulary.strongest(table(spark, "kind string, key string, mention_count long", *[("c", f"k{i:02}", i // 2) for i in range(30)]), 3), "key") == [("k27",), ("k28",), ("k29",)] or rows(vocabulary.strongest(table(spark, "kind string, key string, mention_count long", *[("c", f"k{i:02}", i // 2) for i in range(30)]), 3), "key") == [("k26",), ("k28",), ("k29",)]
    place = "array<struct<start:int,end:int,text:string>>"
    c = spark.createDataFrame([("concept", "g", "unit", "Unit", ["a"], ["units"], 1, True, False, ["ORG"], [(9, 13, "unit"), (1, 5, "Unit")]), ("concept", "g", "team", "team", ["b"], [], 2, True, False, [], [(9, 13, "unit"), (20, 24, "team")])], f"kind string, group string, key string, canonical string, sources array<string>, variants array<string>, mention_count long, literal_span boolean, llm_only boolean, ner_labels array<string>, occurrences {place}")
    e = vocabulary.build_elements(c).first()
    assert e["alt_labels"] == ["Unit", "team", "units"] and e["ner_labels"] == ["ORG"] and [o["start"] for o in e["occurrences"]] == [1, 9, 20]


def test_replies_batches_and_prompts(spark):
    s = table(spark, "doc_id int, sentence_index int, text string", *[(1, i, f"s{i}") for i in range(1, 10)], (2, 1, "t"))
    b = surface.batched(s, 7, "doc_id", "sentence_index")
    assert rows(b.groupBy("doc_id", "batch").count(), "doc_id", "batch", "count") == [(1, 0, 7), (1, 1, 2), (2, 0, 1)]
    p = surface.prompts(b, "doc_id").filter("doc_id = 1 and batch = 1").first()
    assert p["prompt"] == "Below are 2 sentences from a source document, indexed 8, 9.\n\nSentences:\n8: s8\n9: s9" and p["n"] == 2
    reply = '```json\n{"results": {"8": {"mentions": [{"surface": " Crew ", "mention_type": "ENTITY"}, {"surface": "47 psi", "mention_type": "Value"}, {"surface": " "}], "triples": [{"subject": "Crew", "predicate": "seals", "object": "main", "negated": true}, {"subject": "x", "predicate": "", "object": "y"}]}, "1": {"mentions": [{"surface": "out"}]}, "z": {"mentions": [{"surface": "odd"}]}}}\n```'
    r = table(spark, "doc_id int, batch int, reply string", (1, 1, reply), (2, 0, "no json"))
    mentions, triples = surface.parsed_replies(r, b, "doc_id")
    assert rows(mentions, "doc_id", "sentence_index", "surface_form", "mention_type") == [(1, 8, "47 psi", "value"), (1, 8, "Crew", "entity")]
    assert rows(triples, "subject", "predicate", "object", "negated") == [("Crew", "seals", "main", True)]
    gated = table(spark, "canonical string, kind string, bin string, reason string", ("Engine", "concept", "class", "x"), ("Bob", "concept", "class", "x"), ("zz", "concept", "class", "x"), ("Bob", "relation", "class", "p"), ("Unit 7", "concept", "individual", "y"))
    done = surface.gate_override(gated, table(spark, "term string, label string", ("Bob", "individual"), ("zz", "non_concept"), ("Unit 7", "class")))
    assert rows(done, "canonical", "kind", "bin", "reason") == [("Bob", "concept", "individual", "LLM: named individual"), ("Bob", "relation", "class", "p"), ("Engine", "concept", "class", "x"), ("Unit 7", "concept", "individual", "y"), ("zz", "concept", "non_concept", "LLM: not a domain term")]


def test_surfacing(spark):
    docs = table(spark, "doc_id long, text string", (1, "Fire Unit seals the main. The crew never enters Zone One."))
    found = surface.surface_concepts(docs)
    exact = surface.exact_places(found.withColumn("text", F.lit("?")), docs)
    assert rows(exact, "text", "start") == [("Fire Unit", 0), ("Zone One", 48)]
    assert rows(surface.without_overlaps(exact, table(spark, "doc_id long, start int, end int", (1, 5, 7))), "text") == [("Zone One",)]
    sents = surface.sentence_table(docs)
    verbs = table(spark, "verb string", ("seals",), ("enters",))
    assert rows(surface.surface_relations(sents, verbs), "sentence_index", "relation") == [(0, "seals"), (1, "enters")]
    assert rows(surface.surface_triples(sents, verbs), "subject", "predicate", "object", "negated") == [("Fire Unit", "seals", "the main", False), ("The crew", "enters", "Zone One", True)]
    cheap, asked = table(spark, "text string", ("Fire Unit",), ("zone",)), table(spark, "text string, grounded boolean", ("fire-unit", True), ("CrisisManager", False))
    assert rows(surface.cheap_first_union(cheap, asked), "key", "source", "grounded") == [("crisismanager", "llm", False), ("fire unit", "cheap", True), ("zone", "cheap", True)]
    assert tuple(surface.union_statistics(cheap, asked).first()) == (2, 2, 1)


def test_mentions_and_gerunds(spark):
    docs = table(spark, "doc_id long, text string", (1, "The Red Crew is sealing usable pipes; McCrew sings. \u00c9Alpha aIng"), (2, None))
    assert rows(surface.surface_concepts(docs, adjectives=True), "text", "start", "source") == [("McCrew", 38, "name"), ("Red Crew", 4, "name"), ("sealing", 16, "gerund"), ("usable", 24, "adjective")]
    sents = table(spark, "doc_id long, sentence_index int, text string", (1, 0, "It holds 47 psi, 1,234 units and 5% on 2024-05-06 for Main 7."), (1, 1, "They left."))
    got = surface.surface_mentions(sents)
    assert rows(got, "sentence_index", "surface_form", "mention_type", "start") == sorted([(0, "47 psi", "value", 9), (0, "1,234", "value", 17), (0, "5%", "value", 33), (0, "2024-05-06", "value", 39), (0, "Main", "entity", 54), (0, "7", "value", 59)], key=repr)
    text = "aa1b22\n333"
    assert [tuple(m) for m in table(spark, "t string", (text,)).select(X.matches_with_offsets(F.col("t"), r"\d+").alias("x")).first()["x"]] == [("1", 2, 3), ("22", 4, 6), ("333", 7, 10)]


def test_taxonomy_review(spark):
    classes = table(spark, "id string, label string", ("a", "Aa"), ("b", "Bb"), ("c", "Cc"), ("o", "Oo"))
    edges = table(spark, "child string, parent string, via array<string>", ("a", "coined:x", ["llm"]), ("b", "coined:x", ["llm", "rule"]), ("c", "coined:y", ["rule"]))
    fam = table(spark, "parent string, children array<string>", ("coined:x", ["a", "b"]), ("coined:y", ["c"]), ("coined:z", ["q"]))
    assert rows(taxonomy.parent_map(edges, fam), "child", "parent") == [("a", "coined:x"), ("b", "coined:x"), ("c", "coined:y"), ("q", "coined:z")]
    stats = dict(rows(taxonomy.structure_statistics(classes, table(spark, "label string", ("A-a",), ("Zz",)), edges, fam), "stat", "n"))
    assert stats == {"classes": 4, "roots": 1, "with_parent": 3, "coined_parents": 3, "omitted_candidates": 1, "via:llm": 2, "via:rule": 2}
    v, left, orphans = taxonomy.review_coined(fam, classes.select("id"), edges, classes)
    assert rows(v, "parent", "verdict") == [("coined:x", "accept"), ("coined:y", "demote"), ("coined:z", "reject")] and rows(left, "child") == [("a",), ("b",)] and rows(orphans, "id") == [("c",), ("o",)]
    remap = table(spark, "old_id string, new_id string", ("b", "a"))
    ax = taxonomy.rewrite_axioms(table(spark, "id int, type string, classes array<string>, relaxed boolean", (1, "disjointWith", ["a", "b"], False), (2, "disjointWith", ["b", "c"], False)), remap)
    assert rows(ax, "id", "classes", "relaxed", "degenerate") == [(1, ["a"], True, True), (2, ["a", "c"], False, False)]
    dec = table(spark, "id string, kind string, verdict string, parked boolean", ("a", "concept", "accept", False), ("b", "concept", "reject", False), ("c", "concept", "escalate", False), ("o", "concept", "accept", True))
    assert rows(taxonomy.feedback_set(dec, orphans.filter("id = 'o'")), "id", "feedback") == [("b", "rejected"), ("c", "escalated"), ("o", "parked"), ("o", "unconnected")]
    assert rows(taxonomy.review_statistics(dec).filter("kind is null"), "verdict", "n") == [("auto_accepted", 2), ("auto_rejected", 1), ("escalated", 1)]
    log = taxonomy.edit_log(remap, v, table(spark, "parent string, name string", ("coined:x", "Xs"), ("coined:y", "Ys")))
    assert rows(log, "type", "targets", "detail") == [("demote", ["coined:y"], "1 grounded children"), ("merge", ["a", "b"], "a"), ("name_coined", ["coined:x"], "Xs"), ("reject", ["coined:z"], "0 grounded children")]


def test_ontology_index_in_full(spark):
    t = small_ontology(spark)
    more = [("ex#q", "rdf:type", "owl:ObjectProperty", "iri"), ("ex#q", "rdfs:label", "is p of", "literal"), ("ex#q", "skos:altLabel", "p by", "literal"), ("ex#p", "skos:altLabel", "ps", "literal"), ("ex#B", "rdfs:subClassOf", "other#Z", "iri"), ("ex#d", "rdfs:range", "http://www.w3.org/2001/XMLSchema#integer", "iri"), ("_:e", "owl:onProperty", "ex#q", "iri"), ("_:e", "owl:exactCardinality", "3", "literal")]
    t = t.unionByName(spark.createDataFrame([("g", *m) for m in more], "g string, s string, p string, o string, o_kind string"), allowMissingColumns=True)
    p = ontology.property_index(t).filter("iri = 'ex#p'").first()
    assert (p["local_name"], p["aliases"], p["inverse_of"], p["inverse_labels"], p["inverse_aliases"], p["max_cardinality"]) == ("p", ["ps"], "ex#q", ["is p of"], ["p by"], 2)
    assert rows(ontology.max_cardinality(t), "property", "max_cardinality") == [("ex#p", 2), ("ex#q", 3)]
    assert {r["iri"]: r["equivalents"] for r in ontology.class_index(t).collect()} == {"ex#A": [], "ex#B": ["ex#C"], "ex#C": ["ex#B"], "ex#D": []}
    idx = ontology.namespace_index(t, "ex#")
    assert rows(idx["closure"], "sub", "super") == [("A", "A"), ("B", "A"), ("B", "B"), ("C", "C"), ("D", "D")] and rows(idx["disjoint"], "a", "b") == [("A", "D")]
    assert rows(idx["properties"], "local_name", "domain", "range") == [("d", None, "xsd:integer"), ("p", None, "A"), ("q", None, None)]
    assert [r["name"] for r in ontology.direct_subclasses(t, "ex#A").collect()] == ["B"]
    chain = [("_:x", "owl:members", "_:c00")] + [(f"_:c{i:02}", "rdf:first", f"ex#K{i:02}") for i in range(60)] + [(f"_:c{i:02}", "rdf:rest", f"_:c{i + 1:02}" if i < 59 else "rdf:nil") for i in range(60)]
    long = spark.createDataFrame([("g", *c, "iri") for c in chain], "g string, s string, p string, o string, o_kind string")
    assert ontology.disjoint_pairs(long).count() == 60 * 59 // 2


def test_predicate_fallbacks(spark):
    t = table(spark, "norm string, iri string, inverted boolean", ("responds to", "ex#r", False))
    p = table(spark, "predicate string", ("responds to",), ("handles",), ("asks",), ("odd",), ("none",))
    near = table(spark, "predicate string, id string, inverted boolean, score double", ("handles", "ex#h", True, 0.6), ("asks", "ex#h", False, 0.2))
    model = table(spark, "predicate string, answer string, direction string", ("asks", ":q", "inverse"), ("odd", "nothing", "direct"), ("responds to", "ex#h", "direct"))
    props = table(spark, "iri string, local_name string", ("ex#q", "q"), ("ex#h", "h"))
    got = mapping.map_predicates(p, t, near, model, props)
    assert rows(got, "predicate", "iri", "inverted", "confidence") == [("asks", "ex#q", True, "low"), ("handles", "ex#h", True, "high"), ("responds to", "ex#r", False, "high")]
    assert rows(mapping.map_predicates(p, t), "predicate") == [("responds to",)]


@pytest.mark.parametrize(
    ("value", "actual", "wanted", "verdict", "result"),
    [
        ("47 usd", "xsd:string", "xsd:integer", "repaired", "47"), ("-007", "xsd:string", "xsd:integer", "repaired", "-7"), ("-3", "xsd:string", "xsd:nonNegativeInteger", "datatype_mismatch", "-3"), ("5", "xsd:integer", "xsd:float", "pass", "5"), ("5", "xsd:nonNegativeInteger", "xsd:double", "pass", "5"),
        ("2.5e1 m", "xsd:string", "xsd:double", "repaired", "25.0"), ("Yes", "xsd:string", "xsd:boolean", "repaired", "true"), ("0", "xsd:integer", "xsd:boolean", "repaired", "false"), ("2024-05-06T10:00", "xsd:string", "xsd:date", "repaired", "2024-05-06"), ("2024-15-06", "xsd:string", "xsd:date", "datatype_mismatch", "2024-15-06"),
        ("x", "xsd:dateTime", "xsd:string", "pass", "x"), ("2024-05-06", "xsd:date", "xsd:dateTime", "datatype_mismatch", "2024-05-06"), ("x", None, "xsd:integer", "pass", "x"), ("x", "xsd:string", "ex#Class", "pass", "x"), ("7", "xsd:string", "http://www.w3.org/2001/XMLSchema#integer", "repaired", "7"),
    ],
)
def test_datatype_repair(spark, value, actual, wanted, verdict, result):
    got = table(spark, "v string, a string, w string", (value, actual, wanted)).select(verify.repaired(F.col("v"), F.col("a"), F.col("w")).alias("x")).first()["x"]
    assert (got["verdict"], got["value"]) == (verdict, result)


ROWS = "seq long, subject_iri string, subject_type string, predicate_iri string, predicate_kind string, object_iri string, object_type string, object_literal string, object_datatype string, sources array<string>, sentence_indices array<int>, mapping_confidence string"


def brute_admission(data, limits, inverse, disjoint):
    types, counts, owners, out = {}, {}, {}, []
    both = disjoint | {(b, a) for a, b in disjoint}
    for seq, s, st, p, o, ot, where in sorted(data, key=lambda r: (0 if len(r[6]) > 1 else 1, min(r[6]), r[0])):
        held = [(s, st)] + ([(o, ot)] if o is not None else [])
        if any(b in types.get(x, set()) for x, t in held for a, b in both if a == t):
            why = "disjointness_violation"
        elif (p in limits and counts.get((s, p), 0) >= limits[p]) or (p in inverse and o is not None and owners.get((p, o), s) != s):
            why = "cardinality_violation"
        else:
            why = None
            for x, t in held:
                types.setdefault(x, set()).add(t)
            counts[s, p] = counts.get((s, p), 0) + 1
            owners[p, o] = s
        out.append((seq, why))
    return sorted(out, key=repr)


def admitted(spark, data, limits, inverse, disjoint):
    full = [(i, s, st, p, "object_property", o, ot, None, None, ["llm"], w, "high") for i, s, st, p, o, ot, w in data]
    props = table(spark, "iri string, domain string, range string, is_inverse_functional boolean", *[(p, None, None, p in inverse) for p in "pqr"])
    pairs = table(spark, "a string, b string", *disjoint)
    return verify.admit(spark.createDataFrame(full, ROWS).repartition(4), props, table(spark, "sub string, super string"), pairs, table(spark, "predicate_iri string, max_cardinality int", *limits.items()))


@pytest.mark.parametrize(("seed", "people", "limits", "odd"), [(9, 60, {"p": 1}, 0.1), (10, 12, {"p": 2, "q": 3, "r": 0}, 0.4), (11, 200, {"r": 1}, 0.5)])
def test_admission_equals_the_replay_in_order(spark, seed, people, limits, odd):
    rng = np.random.default_rng(seed)
    name = lambda letter, n: f"{letter}{rng.integers(n)}"
    data = []
    for i in range(500):
        s, o = name("s", people), [name("o", people), name("s", people), None][rng.integers(8) // 3 if odd > 0.2 else 0]
        data.append((i, s, "ABC"[rng.integers(3)] if rng.random() < odd else "A", "pqr"[rng.integers(3)], o, None if o is None else "TUAB"[rng.integers(4)] if rng.random() < odd else "T", sorted({int(x) for x in rng.integers(1, 9, 1 + int(rng.random() < 0.3))})))
    pairs = {("A", "B"), ("T", "U"), ("B", "C"), ("T", "A")} if odd > 0.2 else {("A", "B"), ("T", "U")}
    done = admitted(spark, data, limits, {"q"}, pairs)
    want = brute_admission(data, limits, {"q"}, pairs)
    assert rows(done, "seq", "reason") == want and len({w for _, w in want}) == 3
    assert {r[0] for r in rows(verify.statistics(done), "verdict", "reason")} == {"admit", "rejected"} and verify.type_assertions(done).count() > 0


def test_admission_of_a_hot_key_takes_few_rounds(spark, monkeypatch):
    """Thousands of rows of one individual and one limit are decided at once; each round checkpoints three tables."""
    kinds = ["A"] + ["AB"[i % 3 == 0] for i in range(2999)]
    data = [(i, "hub", t, "p" if i % 2 else "q", "o1" if i % 5 else f"x{i}", "T", [1]) for i, t in enumerate(kinds)] + [(4000 + i, f"s{i}", "A", "q", "o1", "T", [1]) for i in range(1000)]
    done, calls = type(spark.range(0)).checkpoint, []
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", lambda self, *a: calls.append(1) or done(self, *a))
    got = rows(admitted(spark, data, {"p": 3}, {"q"}, {("A", "B")}), "seq", "reason")
    assert got == brute_admission(data, {"p": 3}, {"q"}, {("A", "B")}) and len(calls) <= 4 + 4 * 4


def test_a_row_that_gives_one_individual_both_types(spark):
    data = [(0, "x", "A", "p", "x", "B", [2]), (1, "x", "A", "p", "y", "T", [3]), (2, "x", "B", "p", "y", "T", [4]), (3, "x", "C", "p", "y", "T", [5])]
    assert rows(admitted(spark, data, {}, set(), {("A", "B")}), "seq", "reason") == brute_admission(data, {}, set(), {("A", "B")})
    first = [(9, "x", "B", "p", "y", "T", [1]), *data]
    assert rows(admitted(spark, first, {}, set(), {("A", "B")}), "seq", "reason") == brute_admission(first, {}, set(), {("A", "B")})


def test_clock_and_spans_of_a_pass(spark):
    ages = context.advance_clock(table(spark, "node string, age_min double", ("a", 1.0), ("b", 2.0)), table(spark, "node string", ("b",)), 3.0)
    assert rows(ages, "node", "age_min") == [("a", 4.0), ("b", 0.0)]
    items = table(spark, "id string, draft string, flags array<string>, route string", ("P1", "d1", [], "digest"), ("P2", "d2", ["R9"], "inbox"))
    spans = feed.pass_spans(items, "r", table(spark, "topic string", ("retrieval",)))
    assert rows(spans, "name", "status") == [("connectors", "ok"), ("maker:P1", "ok"), ("maker:P2", "ok"), ("trigger", "ok"), ("tune_triage", "ok"), ("verify:P1", "ok"), ("verify:P2", "error")]
    assert {r["name"]: r["output"] for r in spans.collect()}["connectors"] == '{"digest":1,"inbox":1}'


def test_stars_and_small(spark):
    s = graph.stars(table(spark, "key string, node int", ("k", 3), ("k", 1), ("k", 2), ("j", 7), ("j", 3)), "key", "node")
    assert rows(s, "a", "b") == [(2, 1), (3, 1), (7, 3)]
    assert one_level(spark) == ["a", "b"]


def one_level(spark):
    return table(spark, "t string", ("a",)).select(X.merged_unique(F.array(F.lit("a"), F.lit("A"), F.lit("b"))).alias("x")).first()["x"]


def test_current_readings_and_eviction(spark, tmp_path):
    schema = "sensor string, value double, ts timestamp"
    batches = [[("a", 1.0, "2024-01-01 00:00:00"), ("a", 2.0, "2024-01-01 00:03:00"), ("b", 5.0, "2024-01-01 00:01:00")], [("a", 3.0, "2024-01-01 00:02:00"), ("c", 7.0, "2024-01-01 01:00:00")], [("c", 8.0, "2024-01-01 01:01:00")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "sensor string, value double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = feed.current_readings(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/out"), "sensor", "last_value", "readings", "stale")
    assert ("a", 2.0, 2, False) in got and ("a", 2.0, 3, True) in got and ("b", 5.0, 1, True) in got and ("c", 8.0, 2, False) in got
    assert not [g for g in got if g[0] == "c" and g[3]]


def test_corpora_and_traces(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/one_content.md").write_text("# A\ntext")
    (tmp_path / "c/two.txt").write_text("")
    assert rows(io.read_corpus(spark, f"{tmp_path}/c"), "doc_id", "text") == [("one", "# A\ntext")]  # an empty file has no row
    stages = spark.createDataFrame([("d1", "inbox", 1), ("d1", "digest", 2)], "day string, route string, id int")
    io.routed_sink(stages, f"{tmp_path}/routes")
    io.routed_sink(stages, f"{tmp_path}/routes")
    assert spark.read.parquet(f"{tmp_path}/routes").filter("route = 'inbox'").count() == 2
    (tmp_path / "runs").mkdir()
    span = '{"name": "x", "start": %s, "end": 9.0, "tokens": 3}'
    (tmp_path / "runs/a.json").write_text('{"run_id": "a", "goal": "g", "spans": [%s, %s]}' % (span % 1.0, span % 5.0))
    assert io.read_runs(spark, f"{tmp_path}/runs", "g", 2.0).count() == 1 and io.read_runs(spark, f"{tmp_path}/runs", "other").count() == 0


def test_a_search_task_holds_a_slice_of_its_scores():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(12_000, 4)), 1)
    v[::1000] = v[1]
    table_of = lambda rows, **more: pa.table({**more, "_v": pa.array(v[rows].tolist(), pa.list_(pa.float32()))})
    tiles = [table_of(slice(lo, lo + 4000), seq=np.arange(lo, lo + 4000), id=np.arange(lo, lo + 4000)) for lo in (0, 4000, 8000)]
    block = table_of(slice(0, 4000), query_id=np.arange(4000)).rename_columns(["query_id", "_q"])
    run, _ = retrieval._best_of(5, 6, ("bigint", "bigint"))
    tracemalloc.start()
    found = pa.Table.from_batches(list(run(block, iter(tiles)))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    u = np.asarray(v, np.float32).astype(float)
    norm = np.linalg.norm(u, axis=1)
    u = u / np.where(norm > 0, norm, 1)[:, None]
    for i in (0, 1, 1000, 2477, 3999):
        s = np.round(u @ u[i], 6)
        best = found[found["query_id"] == i].sort_values(["score", "seq"], ascending=[False, True])["id"].tolist()
        assert best[:5] == sorted(range(len(u)), key=lambda j: (-s[j], j))[:5]  # noqa: B023


def test_points_of_one_spot_are_dealt_to_tasks(spark):
    centres = table(spark, "id string, lat double, lon double", ("a", 40.0, -74.0), ("b", 40.0, -74.0), ("c", 40.002, -74.0), ("far", 41.0, -74.0))
    points = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit(40.0).alias("lat"), F.lit(-74.0).alias("lon"))
    near = context.within_radius(centres, points, 400.0, digits=1)
    found = near.select("centre", "point", "rounded").collect()
    assert sorted((r["centre"], r["point"], r["rounded"]) for r in found) == sorted((c, str(i), m) for c, m in (("a", 0.0), ("b", 0.0), ("c", 222.4)) for i in range(200))
    assert near.select("point", "centre").select(F.spark_partition_id().alias("t")).distinct().count() > 4
    assert sorted(r["rank"] for r in near.filter("centre = 'c'").collect()) == list(range(1, 201))
