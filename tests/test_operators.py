"""Operators against small fixtures whose results are known."""

import pytest
from pyspark.sql import functions as F

from graphloom.operators import context, graph, mapping, retrieval, surface, taxonomy, traces, verify, vocabulary
from graphloom.sources import io
from graphloom.streaming import feed


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_closure_is_safe_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.closure(e), "src", "dst", "hops") == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "a", 2), ("b", "c", 1), ("b", "d", 2), ("c", "a", 1), ("c", "b", 2), ("c", "d", 1)]
    kept, gone = graph.break_cycles(e.withColumn("confidence", F.when(F.col("src") == "b", 0.1).otherwise(0.9)))
    assert rows(gone, "src", "dst") == [("b", "c")] and kept.count() == 3


def test_paths_and_depth(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "c")], "src string, dst string")
    assert graph.shortest_path(e, "a", "c").first()["path"] == ["a", "b", "c"]
    assert graph.shortest_path(e, "a", "a").first()["path"] == ["a"] and graph.shortest_path(e, "c", "a").count() == 0
    assert dict(rows(graph.longest_depth(e), "node", "depth")) == {"c": 0, "b": 1, "y": 1, "x": 2, "a": 3}
    assert rows(graph.hops_from(e, spark.createDataFrame([("b",)], "focal string"), 1), "node", "hop") == [("a", 1), ("b", 0), ("c", 1)]


def test_radius(spark):
    lights = spark.createDataFrame([(f"TL_{n}", 40.75 + m / 111_195.0, -73.99) for n, m in ((90, 60), (88, 210), (91, 430), (97, 700))], "id string, lat double, lon double")
    centre = spark.createDataFrame([("I", 40.75, -73.99)], "id string, lat double, lon double")
    near = context.within_radius(centre, lights, 500.0).orderBy("metres").collect()
    assert [r["point"] for r in near] == ["TL_90", "TL_88", "TL_91"] and abs(near[1]["metres"] - 210) < 2


def test_context_graph_keeps_the_focal_node(spark):
    e = spark.createDataFrame([("hub", f"n{i}") for i in range(20)], "src string, dst string")
    t = spark.createDataFrame([(f"n{i}", "Camera" if i % 2 else "Light") for i in range(20)], "node string, type string")
    age = spark.createDataFrame([("n3", 9.0)], "node string, age_min double")
    got = context.context_graph(e, t, age, spark.createDataFrame([("hub",)], "focal string"), ["Light"], 2, 5).orderBy("rank").collect()
    assert got[0]["node"] == "hub" and len(got) == 5 and all(r["type"] == "Light" for r in got[1:])


def test_gate_and_write_back(spark):
    req = spark.createDataFrame([(1, "v", "i"), (2, "v", "i"), (3, "w", "gone")], "seq int, vehicle string, incident string")
    g = context.dispatch(context.ask_gate(req, spark.createDataFrame([("i",)], "incident string"), spark.createDataFrame([("v",), ("w",)], "vehicle string")))
    assert rows(g, "seq", "holds", "granted") == [(1, True, True), (2, True, False), (3, False, False)]
    t = spark.createDataFrame([("v", "hasAvailability", "available"), ("w", "hasAvailability", "available")], "s string, p string, o string")
    assert rows(context.write_back(t, g), "s", "p", "o") == [("v", "assignedTo", "i"), ("v", "hasAvailability", "busy"), ("w", "hasAvailability", "available")]


def test_six_sentence_admission(spark):
    schema = "seq long, subject_iri string, subject_type string, predicate_iri string, predicate_kind string, object_iri string, object_type string, object_literal string, object_datatype string, sources array<string>, sentence_indices array<int>, mapping_confidence string"
    both = ["dep_parse", "llm"]
    data = [
        (1, "Engine_7", "FireEngine", "dispatchedTo", "object_property", "Spill_1", "HazMatSpill", None, None, both, [1], "high"), (2, "Main_12", "WaterMain", "dispatchedTo", "object_property", "Spill_1", "HazMatSpill", None, None, both, [2], "high"),
        (3, "Main_12", "WaterMain", "hasPressure", "datatype_property", None, None, "47", "xsd:string", both, [3], "high"), (4, "Chief_A", "Commander", "commands", "object_property", "Spill_1", "HazMatSpill", None, None, both, [4], "high"),
        (5, "Chief_A", "Commander", "commands", "object_property", "Fire_2", "Fire", None, None, both, [5], "high"),
    ]
    props = spark.createDataFrame([("dispatchedTo", "Vehicle", "Incident", False), ("hasPressure", "WaterMain", "xsd:integer", False), ("commands", "Commander", "Incident", False)], "iri string, domain string, range string, is_inverse_functional boolean")
    up = spark.createDataFrame([(a, a) for a in ("WaterMain", "Commander")] + [("FireEngine", "Vehicle"), ("HazMatSpill", "Incident"), ("Fire", "Incident")], "sub string, super string")
    limits = spark.createDataFrame([("commands", 1)], "predicate_iri string, max_cardinality int")
    disjoint = spark.createDataFrame([("Vehicle", "Incident")], "a string, b string")
    done = verify.admit(spark.createDataFrame(data, schema), props, up, disjoint, limits)
    assert rows(done, "seq", "verdict", "reason") == [(1, "admit", None), (2, "rejected", "domain_violation"), (3, "repaired", None), (4, "admit", None), (5, "rejected", "cardinality_violation")]
    assert rows(verify.type_assertions(done), "individual", "class") == [("Chief_A", "Commander"), ("Engine_7", "FireEngine"), ("Main_12", "WaterMain"), ("Spill_1", "HazMatSpill")]


def test_disjoint_types_and_inverse_functional_keys(spark):
    schema = "seq long, subject_iri string, subject_type string, predicate_iri string, predicate_kind string, object_iri string, object_type string, object_literal string, object_datatype string, sources array<string>, sentence_indices array<int>, mapping_confidence string"
    row = lambda i, s, st, o: (i, s, st, "p", "object_property", o, "T", None, None, ["llm"], [i], "high")
    data = [row(1, "x", "A", "o1"), row(2, "x", "B", "o2"), row(3, "y", "A", "o1"), row(4, "z", "A", "o3")]
    props = spark.createDataFrame([("p", None, None, True)], "iri string, domain string, range string, is_inverse_functional boolean")
    done = verify.admit(spark.createDataFrame(data, schema).repartition(3), props, spark.createDataFrame([("A", "A")], "sub string, super string"), spark.createDataFrame([("A", "B")], "a string, b string"), spark.createDataFrame([], "predicate_iri string, max_cardinality int"))
    assert rows(done, "seq", "reason") == [(1, None), (2, "disjointness_violation"), (3, "cardinality_violation"), (4, None)]


def test_triple_merge(spark):
    raw = spark.createDataFrame([("Engine 7", "sprays", "foam", 1, "dep_parse", False, 1), ("engine  7", "spray", "Foam", 1, "llm", False, 2), ("Crew", "enters", "zone", 2, "llm", True, 3)], "subject string, predicate string, object string, sentence_index int, source string, negated boolean, seq long")
    m = surface.merge_triples(raw, spark.createDataFrame([("FOAM", "value")], "surface_form string, mention_type string"))
    assert rows(m, "subject", "negated", "object_type") == [("Crew", True, None), ("Engine 7", False, "value")]
    assert tuple(surface.triple_statistics(m).first()) == (1, 1, 0, 1)


def places_of(text, term, most, bounded):
    import re

    edge = ("(?<![0-9A-Za-z])", "(?![0-9A-Za-z])") if bounded else ("", "")
    return [m.span() for m in re.finditer(edge[0] + re.escape(term) + edge[1], text, re.I)][:most]


def test_phrases_are_found_as_one_by_one(spark):
    import random

    rng = random.Random(4)
    words = ["fire", "Fire", "water main", "a", "a a", "_x", "x", "é", "ΣΑΣ", "İ", "c++", "\\E", "main", "1", "a1", "-"]
    texts = ["".join(rng.choice([w, w.upper(), " ", " ", "_", ".", "\n"]) for w in rng.choices(words, k=40)) for _ in range(60)] + ["", None, "fire " * 3000]
    terms = [*[w for w in words if w != "İ"], "fire fire", "none", "a a a", "A A"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    given = spark.createDataFrame([(t,) for t in [*terms, "fire", ""]], "term string")
    for most, bounded in ((50, True), (3, False)):
        want = sorted((i, t, *span) for i, x in enumerate(texts) for t in terms for span in places_of(x or "", t, most, bounded))
        for block in (50_000, 4):
            assert rows(surface.find_phrases(docs, given, most, bounded, block), "doc_id", "term", "start", "end") == sorted(want, key=repr)
    nowhere = rows(surface.resolved_terms(docs, given).filter("start is null"), "doc_id", "term")
    assert nowhere == [(None, t) for t in ("", "a a a", "none")] and surface.find_phrases(docs, given.limit(0)).count() == 0


def test_many_phrases_in_one_pass(spark):
    terms = [f"term {i}" for i in range(10_000)]
    docs = spark.createDataFrame([(i, f"Term {i}, xterm {i + 1} and TERM {i * 7}; term {i}0") for i in range(1, 300)], "doc_id int, text string")
    got = rows(surface.find_phrases(docs, spark.createDataFrame([(t,) for t in terms], "term string")), "doc_id", "term", "start")
    want = [(i, f"term {j}", at) for i in range(1, 300) for j, at in ((i, 0), (i * 7, len(f"Term {i}, xterm {i + 1} and ")), (i * 10, len(f"Term {i}, xterm {i + 1} and TERM {i * 7}; ")))]
    assert got == sorted(want, key=repr)


def test_terms_are_grounded_as_phrases_or_by_tokens(spark):
    docs = spark.createDataFrame([("The water-main\nburst at noon",), ("a fire crew",)], "text string")
    terms = ["Water Main", "noon burst", "at fire", "ire cre", "crew the", "the", "the an", "Crew left", "-"]
    got = surface.grounded_in(spark.createDataFrame([(t,) for t in terms], "term string"), docs, ["the", "an"])
    assert {r["term"] for r in got.filter("grounded").collect()} == {"Water Main", "noon burst", "at fire", "ire cre", "crew the", "the"}
    assert got.count() == len(terms)


def test_acronyms_and_elements(spark):
    c = spark.createDataFrame([("concept", "ems", "EMS", ["llm"], ["EMS"], 1, True, False), ("concept", "emergency medical service", "emergency medical service", ["ner"], ["emergency medical services"], 3, True, False)], "kind string, key string, canonical string, sources array<string>, variants array<string>, mention_count long, literal_span boolean, llm_only boolean")
    links = vocabulary.acronym_links(c)
    e = vocabulary.build_elements(vocabulary.group_candidates(c, links.select("a", "b"))).collect()
    assert len(e) == 1 and e[0]["label"] == "EmergencyMedicalService" and e[0]["mention_count"] == 4 and e[0]["id"] == "concept:emergencymedicalservice"


def test_taxonomy(spark):
    fam = spark.createDataFrame([("coined:x", ["a", "b"]), ("coined:y", ["a"]), ("coined:z", ["q"])], "parent string, children array<string>")
    v = taxonomy.coined_verdicts(fam, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert rows(v, "parent", "verdict") == [("coined:x", "accept"), ("coined:y", "demote"), ("coined:z", "reject")]
    ax = taxonomy.relax_disjointness(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"), spark.createDataFrame([("b", "a")], "src string, dst string"))
    assert rows(ax, "a", "b", "relaxed") == [("a", "b", True), ("a", "c", False)]
    names = taxonomy.family_names(fam.limit(1), spark.createDataFrame([("a", "FireUnit"), ("b", "RescueUnit")], "id string, label string"))
    assert names.first()["name"] == "Unit"


def test_mapping(spark):
    t = spark.createDataFrame([(1, "E7", "responds to", "Spill"), (2, "Spill", "is handled by", "E7"), (3, "E7", "likes", "Spill"), (4, "Nobody", "responds to", "Spill")], "seq int, subject string, predicate string, object string")
    props = spark.createDataFrame([(1, "respondsTo", "responds to", [], ["is handled-by"])], "seq int, iri string, label string, aliases array<string>, inverse_labels array<string>")
    preds = mapping.map_predicates(t.select("predicate"), mapping.predicate_table(props))
    ents = spark.createDataFrame([("e7", "FireEngine", "high"), ("spill", "Incident", "low")], "key string, class string, confidence string")
    m = mapping.map_triples(t, ents, preds, spark.createDataFrame([("respondsTo", "object_property")], "iri string, kind string"))
    assert rows(m, "seq", "drop_reason", "subject") == [(1, None, "E7"), (2, None, "E7"), (3, "predicate_unmapped", "E7"), (4, "subject_untyped", "Nobody")]
    assert {r["mapping_confidence"] for r in m.filter("drop_reason is null").collect()} == {"low"}
    i = spark.createDataFrame([("C", "A b", 1), ("C", "a-b", 2), ("C", "A B", 3), ("C", "a b 2", 4)], "class string, surface string, seq int")
    assert rows(mapping.mint_iris(i), "key", "iri") == [("a b 2", "C_a_b_2"), ("a b", "C_a_b"), ("a-b", "C_a_b_3")]


def test_retrieval(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["graph neural networks", "retrieval with vectors", "graph search", "cooking pasta", ""])], "id long, text string")
    vec = retrieval.dense(retrieval.hashed_terms(d), d)
    assert abs(sum(x * x for x in vec.filter("id = 0").first()["vec"]) - 1) < 1e-9 and sum(vec.filter("id = 4").first()["vec"]) == 0
    q = vec.filter("id = 2").select(F.col("id").alias("query_id"), "vec")
    top = retrieval.top_k(q, vec.withColumn("seq", F.col("id")), 2)
    assert rows(top, "rank", "id") == [(1, 2), (2, 0)]
    assert retrieval.recall_at_k(top, spark.createDataFrame([(2, 0), (2, 3)], "query_id long, id long"), 2).first()["recall"] == 0.5


def spans_of(spark):
    schema = "run_id string, seq long, name string, status string, input string, output string, start double, end double, tokens int"
    save = lambda c, f="n.md": '{"filename": "%s", "content": "%s"}' % (f, c)
    empty, some = '{"hits": 0, "status": "empty"}', '{"papers": [{"id": "a1"}, {"id": "b2"}]}'
    rows = [
        ("bad", 1, "tool:search_papers", "empty", None, empty, 10), ("bad", 2, "tool:save_to_file", "ok", save("x [S2:fake1234]"), "saved", 5), ("good", 1, "tool:search_papers", "error", None, '{"error": "limit"}', 10), ("good", 2, "tool:save_to_file", "ok", save("text"), "saved", 5),
        ("quiet", 1, "tool:search_papers", "empty", None, empty, 1), ("quiet", 2, "tool:save_to_file", "ok", save("Omitted: no sources"), "", 1), ("bold", 1, "tool:search_papers", "empty", None, empty, 1), ("bold", 2, "tool:save_to_file", "ok", save("A section"), "", 1),
        ("none", 1, "worker", "empty", '{"subgoal": "gnn"}', None, 1), ("out", 1, "tool:save_to_file", "ok", save("x", "../n.md"), "", 1), ("form", 1, "tool:save_to_file", "ok", save("[S2:a-b]"), "", 1),
        ("cites", 1, "tool:search_papers", "ok", None, some, 1), ("cites", 2, "tool:fetch_paper", "ok", None, '{"id": "c3"}', 1), ("cites", 3, "tool:save_to_file", "ok", save("[S2:a1] [S2:c3]"), "", 1), ("cites", 4, "synthesize", "ok", None, None, 1),
    ]
    return spark.createDataFrame([(*r[:6], 1.0 * r[1], 1.0 * r[1] + 0.041, r[6]) for r in rows], schema)


def test_replayed_traces(spark):
    s = spans_of(spark)
    runs = s.select("run_id").distinct()
    want = {"bad": "invented citation", "good": None, "quiet": None, "bold": "improvised a section with zero sources", "none": "no file saved to output/", "out": "no file saved to output/", "form": "malformed citation", "cites": None}
    assert {r["run_id"]: r["reason"] for r in traces.grade_runs(runs, s).collect()} == want
    gold = spark.createDataFrame([("cites", x) for x in ("a1", "b2", "zz")] + [("good", "q")], "run_id string, id string")
    judged = spark.createDataFrame([("quiet", {"depth": 0}, '{"depth": "thin"}')], "run_id string, scores map<string,int>, evidence string")
    got = {r["run_id"]: r["reason"] for r in traces.grade_runs(runs, s, gold, judged).collect()}
    assert got == want | {"cites": "missed required papers", "good": "missed required papers", "quiet": '{"depth": "thin"}'}
    cases = spark.createDataFrame([("w", r, "abstain") for r in ("bad", "good", "quiet", "bold")] + [("f", "out", "full")], "case string, run_id string, kind string")
    assert rows(traces.replay_cases(cases, runs, s), "run_id", "passed") == [("bad", False), ("bold", False), ("good", True), ("out", False), ("quiet", True)]
    assert {r["run_id"]: (r["tokens"], r["has_anomaly"]) for r in traces.run_totals(s).collect()}["bad"] == (15, True)
    lines = {r["run_id"]: r["line"] for r in traces.summary_lines(s).collect()}
    assert lines["cites"] == "Surveying 1 subtopics \u00b7 1 papers retrieved \u00b7 synthesizing now" and lines["none"].endswith("0 papers retrieved \u00b7 gathering sources")
    plans = {r["run_id"]: r["lines"] for r in traces.plan_view(s).collect()}
    assert plans["none"] == ["  [!] gnn 0 papers"] and plans["bad"] == ["  [ ] (no plan recorded)"]
    assert [r["line"] for r in traces.waterfall(s).filter("run_id = 'bad'").orderBy("step").collect()] == ["  tool:search_papers           40ms  <empty>", "  tool:save_to_file            40ms"]
    fed = traces.with_feedback(s, spark.createDataFrame([("cites", "P1", "kept"), ("cites", "P2", "deleted")], "run_id string, item string, verdict string"))
    assert rows(fed.filter("name like 'feedback:%'"), "run_id", "seq", "name", "output") == [("cites", 5, "feedback:P1", "kept"), ("cites", 6, "feedback:P2", "deleted")]


def test_claims_and_policies(spark):
    claims = spark.createDataFrame([("P1", "CITES", "P2", False), ("P1", "CITES", "P3", False), ("P1", "CITES", "P4", False), ("P1", "CITES", "P5", True)], "src string, rel string, dst string, ambiguous boolean")
    edges = spark.createDataFrame([("P1", "CITES", "P2")], "src string, rel string, dst string")
    gate = traces.claim_gate(claims, edges, spark.createDataFrame([("P1", "CITES", "P4")], "src string, rel string, dst string"))
    assert rows(gate, "dst", "action", "verified", "text") == [
        ("P2", "state", True, "P1 cites P2  [source: graph, verified]"), ("P3", "abstain", False, "P1 may cite P3  [unverified: no supporting graph record]"),
        ("P4", "resolve", True, "P1 cites P4  [source: tool:semantic_scholar, verified]"), ("P5", "ask", False, "Which paper do you mean by 'P1' / 'P5'?"),
    ]
    assert rows(traces.resolved_edges(edges, gate), "dst") == [("P2",), ("P4",)]
    b = [True, False]
    grid = spark.createDataFrame([(r, a, o, h) for r in b for a in b for o in b for h in b], "r boolean, a boolean, o boolean, h boolean")
    for x in grid.withColumn("x", traces.response_policy(F.col("r"), F.col("a"), F.col("o"), F.col("h"))).collect():
        assert x["x"] == (("resolve" if x["a"] else "ask") if x["r"] else "hedge" if x["o"] and not x["h"] else "abstain")
    year = spark.range(1).select(F.year(F.current_date()).alias("y")).first()["y"]
    cases = [("since", "since 2024", 2024, year), ("single", "2024", 2024, 2024), ("range", "2019-2023", 2019, 2023), ("none", None, None, None), ("before", "before 2020", 1900, 2020), ("wrong", "2024", 2024, 2025)]
    assert rows(traces.parser_regression(spark.createDataFrame(cases, "name string, spec string, low int, high int")).filter("not passed"), "name") == [("wrong",)]
    flow = traces.screening(spark.createDataFrame([("A b", "1", None), ("a  B ", "1", "off topic"), ("C", "2", None), ("D", "3", "old"), ("D", "4", "old")], "title string, doi string, excluded_by string")).first()
    assert (flow["identified"], flow["screened"], flow["excluded"], flow["included"], flow["by_reason"]) == (5, 4, 3, 1, {"off topic": 1, "old": 2})


def test_feed(spark, tmp_path):
    items = [("P1", "t1", 2025, ["gnn"], ["R1"]), ("P2", "t2", 2025, ["retrieval"], ["R1", "R9"]), ("P3", "t3", 2010, ["gnn"], []), ("P4", "t4", 2025, ["bio"], [])]
    schema = "id string, title string, year int, topics array<string>, references array<string>"
    spark.createDataFrame(items, schema).write.parquet(f"{tmp_path}/in")
    edges = spark.createDataFrame([("P1", "R1"), ("P2", "R1")], "src string, dst string")
    go = lambda cp: feed.run_feed(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), edges, ["gnn", "retrieval"], 2020, f"{tmp_path}/out", f"{tmp_path}/seen", f"{tmp_path}/{cp}", "d1").awaitTermination()
    go("cp")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert rows(out, "id", "route", "flags") == [("P1", "digest", []), ("P2", "inbox", ["R9"])]
    go("cp")  # nothing new
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    fb = spark.createDataFrame([("P1", "kept", 1), ("P2", "kept", 1), ("P2", "deleted", 2)], "item string, verdict string, ts int")
    assert rows(feed.tune_triage(fb, spark.createDataFrame(items, schema), ["gnn", "retrieval"]), "topic") == [("retrieval",)]
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    feed.run_feed(stream, edges, ["gnn", "retrieval"], 2020, f"{tmp_path}/out2", f"{tmp_path}/seen2", f"{tmp_path}/cp2", "d1", f"{tmp_path}/spans", fb).awaitTermination()
    spans = spark.read.parquet(f"{tmp_path}/spans")
    assert rows(spans.filter("name in ('tune_triage', 'connectors', 'verify:P2')"), "name", "status", "output") == [("connectors", "ok", '{"digest":1,"inbox":1}'), ("tune_triage", "ok", "retrieval"), ("verify:P2", "error", '{"grounded":false,"flags":["R9"]}')]


def test_freshness_closes_stale_sessions(spark, tmp_path):
    e = spark.createDataFrame([("a", 1.0, "2024-01-01 00:00:00"), ("a", 2.0, "2024-01-01 00:03:00"), ("b", 5.0, "2024-01-01 00:01:00"), ("a", 9.0, "2024-01-01 01:00:00")], "sensor string, value double, ts string")
    e.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/r")
    q = feed.freshness(spark.readStream.schema("sensor string, value double, ts timestamp").parquet(f"{tmp_path}/r")).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(spark.read.parquet(f"{tmp_path}/o"), "sensor", "last_value", "readings")
    assert ("a", 2.0, 2) in got and ("b", 5.0, 1) in got and all(v != 9.0 for _, v, _ in got)


def test_sources(spark, tmp_path):
    feed_rows = io.sensor_feed(spark, 200)
    stats = context.graph_statistics(feed_rows, "SensorReading").first()
    assert stats["named_graphs"] == 1 and stats["sensor_nodes"] == 200 and feed_rows.filter("p = 'hasValue' and int(o) > 0").count() == 200
    t = spark.createDataFrame([("d", "http://a", "http://p", 'say "hi"\\\nx', "literal", None, "en"), ("d", "http://a", "http://q", "http://b", "iri", None, None), ("d", "http://a", "http://r", "4", "literal", "http://int", None)], "g string, s string, p string, o string, o_kind string, datatype string, lang string")
    back = io.parse_triples(io.triple_lines(t), "d")
    assert rows(back, *t.columns) == rows(t, *t.columns)
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text('{"run_id": "a", "goal": "g", "spans": [{"name": "x", "start": 1.0, "end": 2.0, "tokens": 3}]}')
    (tmp_path / "runs/b.json").write_text("not json")
    assert rows(io.read_runs(spark, str(tmp_path / "runs"), "g"), "run_id", "name", "tokens") == [("a", "x", 3)]
    assert io.write_stage(t, str(tmp_path / "st"), "one").first()["rows"] == 3 and io.read_stage(spark, str(tmp_path / "st"), "one").count() == 3
    texts = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, text string")

    def embed(batches):
        for b in batches:
            yield b.assign(vec=[[1.0, 2.0]] * len(b))[["key", "vec"]]

    cache = str(tmp_path / "vec")
    assert {tuple(r["vec"]) for r in io.embed_with_cache(texts, cache, embed, "m", 2).collect()} == {(1.0, 2.0)} and spark.read.parquet(cache).count() == 2

    def never(batches):
        for b in batches:
            assert not len(b)
            yield b.assign(vec=[])[["key", "vec"]]

    again = io.embed_with_cache(texts, cache, never, "m", 2)
    assert rows(again, "id", "vec") == [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, 2.0])] and spark.read.parquet(cache).count() == 2


def test_graph_rounds_have_no_cap(spark):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(55)], "src string, dst string")
    assert graph.closure(chain).count() == 55 * 56 // 2
    assert {r["node"]: r["depth"] for r in graph.longest_depth(chain).collect()} == {f"n{i:03}": 55 - i for i in range(56)}
    assert len(graph.shortest_path(chain, "n000", "n040").first()["path"]) == 41
    with pytest.raises(ValueError):
        graph.longest_depth(spark.createDataFrame([(1, 2), (2, 1), (1, 3)], "src int, dst int"))


def test_edges_of_long_and_knotted_cycles(spark):
    ring = {(i, (i + 1) % 60) for i in range(60)}  # the way back has 59 steps
    knot = {(100, 101), (101, 102), (102, 100), (101, 103), (103, 101), (110, 111), (111, 110)}
    other = {(5, 100), (102, 110), (111, 200), (200, 201), (201, 202), (300, 301), (301, 0)}
    edges = spark.createDataFrame(sorted(ring | knot | other) + [(7, 7)], "src int, dst int")
    got = graph.cyclic_edges(edges).collect()
    assert len(got) == len(ring | knot) + 1 and {tuple(r) for r in got} == ring | knot | {(7, 7)}


def test_places_of_single_documents_are_counted_with_their_forms(spark):
    raws = [("c", w, s, d, i, i + 1) for s, d, t in [("a", 1, "Dogs dog cat"), ("b", 2, "dog Cats x x"), ("b", 2, "dog Cats y"), ("a", None, "cat dog"), ("c", None, "cat owl"), ("llm", 3, "owl")] for i, w in enumerate(t.split())]
    raws = spark.createDataFrame(raws + [("c", "elk", "llm", None, None, None), ("c", "owls", "llm", None, None, None)], "kind string, text string, source string, doc_id long, start int, end int")
    again = spark.createDataFrame([(2,), (None,), (None,)], "doc_id long")
    names = ("key", "canonical", "sources", "variants", "mention_count", "literal_span", "llm_only")
    every, some = surface.dedup_mentions(raws), surface.dedup_mentions(raws, again)
    assert rows(every, *names) == rows(some, *names) and {r["key"]: r["mention_count"] for r in some.collect()} == {"dog": 4, "cat": 3, "x": 2, "y": 1, "owl": 2, "elk": 1}
    single = surface.dedup_mentions(raws.filter("doc_id in (1, 3) or start is null"), again.limit(0))
    assert {r["key"]: r["mention_count"] for r in single.collect()} == {"dog": 2, "cat": 1, "owl": 1, "elk": 1}


def test_grading_reads_the_spans_twice(spark, tmp_path):
    row = "struct<run_id:long,seq:long,name:string,status:string,input:string,output:string>"
    given = [
        (1, 1, "tool:search_papers", "ok", None, '{"papers": [{"id": "a"}, {"id": "b"}]}'), (1, 2, "tool:save_file", "ok", '{"filename": "n.md", "content": "[S2:a] [S2:b] [S2:a]"}', None),
        (2, 1, "tool:save_file", "ok", '{"filename": "n.md", "content": "[S2:a]"}', None), (None, 1, "tool:save_file", "ok", '{"filename": "n.md", "content": "x"}', None), (4, 1, "tool:search_papers", "ok", None, '{"hits": 0}'),
        (4, 2, "tool:save_file", "ok", '{"filename": "n.md"}', None),
    ]
    spark.createDataFrame(given, row).write.parquet(f"{tmp_path}/spans")
    spans = spark.read.parquet(f"{tmp_path}/spans")
    runs = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,), (4,)], "run_id long")
    gold = spark.createDataFrame([(1, "a"), (1, "c"), (1, "c"), (2, "a")], "run_id long, id string")
    graded = traces.grade_runs(runs, spans, gold)
    nothing, bold = "no file saved to output/", "improvised a section with zero sources"
    assert rows(graded, "run_id", "reason") == sorted([(1, "missed required papers"), (2, "invented citation"), (3, nothing), (None, nothing), (4, bold)], key=repr)
    assert graded._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    cases = spark.createDataFrame([("c", i, k) for i in (1, 2, 3, 4, 5) for k in ("full", "abstain")], "case string, run_id long, kind string")
    assert rows(traces.replay_cases(cases, runs, spans).filter("passed"), "run_id") == [(1,), (1,), (3,), (5,)]


def test_term_places_reads_texts_once_for_places(spark):
    from graphloom.plans.operator_queries import term_places

    plan = term_places(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
