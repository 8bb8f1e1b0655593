"""Queries over the knowledge graph of the driver tables."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators import coded, context, graph, ontology, verify
from graphloom.sources import bindings
from graphloom.sources.bindings import kg_triples, node, ontology_triples, table
from graphloom.storage import shared_base

KG = """kg AS (
 SELECT 'Order_' || o_orderkey AS s, 'placedBy' AS p, 'Customer_' || o_custkey AS o, 'iri' AS k FROM orders UNION ALL
 SELECT 'Order_' || o_orderkey, 'hasStatus', o_orderstatus, 'literal' FROM orders UNION ALL SELECT 'Order_' || o_orderkey, 'rdf:type', 'Order', 'iri' FROM orders UNION ALL
 SELECT DISTINCT 'Order_' || l_orderkey, 'contains', 'Part_' || l_partkey, 'iri' FROM lineitem UNION ALL SELECT DISTINCT 'Order_' || l_orderkey, 'suppliedBy', 'Supplier_' || l_suppkey, 'iri' FROM lineitem UNION ALL
 SELECT 'Customer_' || c_custkey, 'locatedIn', 'Nation_' || c_nationkey, 'iri' FROM customer UNION ALL SELECT 'Customer_' || c_custkey, 'rdf:type', 'Customer', 'iri' FROM customer UNION ALL
 SELECT 'Supplier_' || s_suppkey, 'locatedIn', 'Nation_' || s_nationkey, 'iri' FROM supplier UNION ALL SELECT 'Supplier_' || s_suppkey, 'rdf:type', 'Supplier', 'iri' FROM supplier UNION ALL
 SELECT 'Nation_' || n_nationkey, 'partOf', 'Region_' || n_regionkey, 'iri' FROM nation UNION ALL SELECT 'Nation_' || n_nationkey, 'rdf:type', 'Nation', 'iri' FROM nation UNION ALL
 SELECT 'Region_' || r_regionkey, 'rdf:type', 'Region', 'iri' FROM region UNION ALL SELECT 'Part_' || p_partkey, 'rdf:type', 'Part', 'iri' FROM part)"""
UP = "up(sub, super) AS (VALUES ('Customer','Party'),('Supplier','Party'),('Nation','Place'),('Region','Place'),('Order','Document'),('Part','Item'))"


def context_graph_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 most relevant nodes within 3 hops of the customers 1 and 2."""
    t = kg_triples(spark, sf_dir)
    focal = spark.createDataFrame([("Customer_1",), ("Customer_2",)], "focal string")
    ages = t.filter("1 = 0").select(F.col("s").alias("node"), F.lit(0.0).alias("age_min"))
    return context.context_graph(context.entity_edges(t, unique=False), context.node_types(t), ages, focal, ["Supplier", "Part"], 3, 30)


def _kept_graph(spark: SparkSession, sf_dir: str) -> coded.CodedGraph:
    return coded.store_graph(kg_triples(spark, sf_dir), f"{shared_base(spark)}/graph-{uuid4().hex}")


def kept_graph_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a stored graph of coded triples, one call a customer: the triples are read once, for both."""
    kept = _kept_graph(spark, sf_dir)
    ages = kept.terms.filter("1 = 0").select(F.col("term").alias("node"), F.lit(0.0).alias("age_min"))
    call = lambda name: coded.coded_context_graph(kept, ages, spark.createDataFrame([(name,)], "focal string"), ["Supplier", "Part"], 3, 30)
    return call("Customer_1").unionByName(call("Customer_2"))


def kept_graph_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one stored graph: how many suppliers are within three hops of customer 1, and the nodes and ends of the path from an order to a region."""
    kept = _kept_graph(spark, sf_dir)
    near = coded.coded_neighborhood(kept, spark.createDataFrame([("Customer_1",)], "id string"), 3, "Supplier")
    stated = kept.edges.filter("way = 'out' and rel in ('placedBy', 'partOf')")
    ends = stated.agg(F.min(F.when(F.col("rel") == "placedBy", F.col("src"))).alias("a"), F.max(F.when(F.col("rel") == "partOf", F.col("dst"))).alias("b"))
    ends = coded.named(kept, ends, ["a", "b"]).first()
    path = coded.coded_path(kept, ends["a"], ends["b"])
    counted = near.agg(F.lit("near").alias("call"), F.count(F.lit(1)).alias("n"), F.min("node").alias("first"), F.max("node").alias("last"))
    return counted.unionByName(path.select(F.lit("path").alias("call"), F.size("path").cast("long").alias("n"), F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last")))


def kg_pattern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by nation of their customer and status: a pattern with an aggregate."""
    t = context.union_graph(kg_triples(spark, sf_dir))
    found = context.bgp(t, [("?order", "placedBy", "?customer"), ("?order", "hasStatus", "?status"), ("?customer", "locatedIn", "?nation")], "status <> 'P'")
    return found.groupBy("nation", "status").agg(F.count_distinct("order").alias("orders"))


def kg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.graph_statistics(kg_triples(spark, sf_dir), "Supplier")


def _places(df: DataFrame, key: str, kind: str) -> DataFrame:
    return df.select(node(kind, key).alias("id"), (40.0 + (F.col(key) * 37 % 1000) / 10000.0).alias("lat"), (-74.0 + (F.col(key) * 91 % 1000) / 10000.0).alias("lon"))


def geo_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 400 m of each supplier."""
    near = context.within_radius(_places(table(spark, sf_dir, "supplier"), "s_suppkey", "Supplier"), _places(table(spark, sf_dir, "customer"), "c_custkey", "Customer"), 400.0, digits=3)
    return near.select("centre", "point", F.col("rounded").alias("metres"))


def ask_gate_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as vehicles, orders as incidents: which requests hold, and which are granted."""
    li, o, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "supplier"))
    requests = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("vehicle"), F.col("l_orderkey").alias("incident")).dropDuplicates(["seq", "vehicle"])
    gated = context.ask_gate(requests, o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("incident")), s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("vehicle")))
    return context.dispatch(gated).filter("granted").groupBy("vehicle").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


def turn_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in each hour of events: added and evicted against the hour before."""
    e = table(spark, sf_dir, "events")
    hours = e.select((F.unix_timestamp("ts") / 3600).cast("long").alias("h"), F.col("user_id").alias("node"))
    start = hours.agg(F.min("h").alias("_h0"))
    members = hours.join(F.broadcast(start)).select((F.col("h") - F.col("_h0")).alias("turn"), "node").distinct()
    return context.turn_changes(members).groupBy("turn", "change").agg(F.count(F.lit(1)).alias("n"))


def stale_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sensors of (segment, type): stale ones that a fresh one replaces."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy(F.col("user_id").alias("node")).agg(F.max("ts").alias("ts"), F.max_by("event_type", F.struct("ts", "event_id")).alias("type"))
    now = e.agg(F.max("ts").alias("_now"))
    nodes = last.join(F.broadcast(now)).select("node", "type", (F.col("node") % 5).alias("target"), F.round((F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 60e6, 6).alias("age_min"))
    return context.stale_evictions(nodes, 60.0)


def closure_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that customers and suppliers are located in, with the hops, by target."""
    t = kg_triples(spark, sf_dir).filter("p in ('locatedIn', 'partOf')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return graph.closure(t).groupBy("dst", "hops").agg(F.count(F.lit(1)).alias("n"))


def depth_and_lca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair of neighbouring nation keys, the lowest place above both."""
    n = table(spark, sf_dir, "nation")
    edges = n.select(node("Nation", "n_nationkey").alias("src"), node("Region", "n_regionkey").alias("dst")).unionByName(table(spark, sf_dir, "region").select(node("Region", "r_regionkey").alias("src"), F.lit("World").alias("dst")))
    pair = n.select(F.col("n_nationkey").alias("set_id"), F.explode(F.array(node("Nation", "n_nationkey"), node("Nation", F.col("n_nationkey") + 1))).alias("node")).filter("set_id < 24")
    return graph.lowest_common_ancestors(pair, edges)


def cycles_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every part to another by key arithmetic make cycles of some length with trees on them; edges that lie on one."""
    p = table(spark, sf_dir, "part")
    many = p.agg(F.count(F.lit(1)).alias("n"))
    edges = p.join(F.broadcast(many)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("n")).alias("dst"))
    return graph.cyclic_edges(edges)


def cycles_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links, each with its size as confidence: of every cycle the weakest edge goes."""
    p = table(spark, sf_dir, "part")
    many = p.agg(F.count(F.lit(1)).alias("n"))
    edges = p.join(F.broadcast(many)).select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("n")).alias("dst"), F.col("p_size").alias("confidence"))
    return graph.break_cycles(edges)[1].select("src", "dst", "confidence")


def citing_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that hold parts of both most ordered parts, newest year first."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    targets = li.groupBy(F.col("dst").alias("id")).count().orderBy(F.desc("count"), "id").limit(2).select("id")
    years = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.max(F.year("l_shipdate")).alias("year"))
    return graph.citing_all(li, targets, years, limit=20)


def bridging_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with lines of both Brand#2 and Brand#17, the first twenty by key."""
    topics = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("id"), F.col("p_brand").alias("topic")).distinct()
    return graph.bridging(topics, "Brand#2", "Brand#17", 20)


def edge_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that order k holds part k mod 2000, checked against the edges."""
    o = table(spark, sf_dir, "orders")
    claims = o.select(node("Order", "o_orderkey").alias("src"), F.lit("contains").alias("rel"), node("Part", F.col("o_orderkey") % 2000).alias("dst"))
    edges = context.entity_edges(kg_triples(spark, sf_dir))
    return graph.edge_exists(claims, edges).groupBy("exists").agg(F.count(F.lit(1)).alias("n"))


def shortest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the shortest path from an order to a region, and its ends."""
    edges = context.entity_edges(kg_triples(spark, sf_dir))
    far = edges.filter("rel = 'placedBy'").agg(F.min("src")).first()[0]
    goal = edges.filter("rel = 'partOf'").agg(F.max("dst")).first()[0]
    return graph.shortest_path(edges, far, goal).select(F.size("path").alias("nodes"), F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("target"))


def neighborhood_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers within three hops of customer 1."""
    t = kg_triples(spark, sf_dir)
    return graph.neighborhood(context.entity_edges(t), context.node_types(t), spark.createDataFrame([("Customer_1",)], "id string"), 3, "Supplier")


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by the same text or by the same first line of eight words or more: components by their least id."""
    d = table(spark, sf_dir, "documents")
    line = F.substring_index("text", "\n", 1)
    shared = d.select(F.xxhash64("text").alias("key"), "doc_id").unionByName(d.filter(F.size(F.split(line, " ")) >= 8).select(F.xxhash64(line).alias("key"), "doc_id"))
    return graph.components(graph.stars(shared, "key", "doc_id")).groupBy("root").agg(F.count(F.lit(1)).alias("n"))


def ontology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the schema, beside the instances of each class in the data."""
    data = context.node_types(kg_triples(spark, sf_dir)).groupBy(F.col("type").alias("class")).agg(F.count(F.lit(1)).alias("instances"))
    up = ontology.subclass_closure(ontology_triples(spark), reflexive=True)
    return data.join(up, F.col("class") == F.col("sub")).groupBy(F.col("super").alias("class")).agg(F.sum("instances").alias("instances"))


def property_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of properties with the triples that use them."""
    used = kg_triples(spark, sf_dir).groupBy(F.col("p").alias("iri")).agg(F.count(F.lit(1)).alias("n"))
    return ontology.property_index(ontology_triples(spark)).join(used, "iri").select("iri", "kind", "domain", "range", "is_functional", "n")


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the graph as mapped rows, with bad ones made from the data: orders placed by parts, and second buyers."""
    o = table(spark, sf_dir, "orders")
    row = lambda df, seq, st, s, p, k, ot, obj, lit, dt: df.select(
        seq.cast("long").alias("seq"), s.alias("subject_iri"), F.lit(st).alias("subject_type"), F.lit(p).alias("predicate_iri"), F.lit(k).alias("predicate_kind"), obj.alias("object_iri"),
        F.lit(ot).cast("string").alias("object_type"), lit.alias("object_literal"), F.lit(dt).cast("string").alias("object_datatype"), F.array(F.lit("dep_parse")).alias("sources"),
        F.array((F.col("o_orderkey") % 10).cast("int")).alias("sentence_indices"), F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("low").alias("mapping_confidence"),
    )
    none, order = F.lit(None).cast("string"), node("Order", "o_orderkey")
    good = row(o, F.col("o_orderkey") * 4, "Order", order, "placedBy", "object_property", "Customer", node("Customer", "o_custkey"), none, None)
    price = row(o, F.col("o_orderkey") * 4 + 1, "Order", order, "hasPrice", "datatype_property", None, none, F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(" usd"))).otherwise("n/a"), "xsd:string")
    wrong = row(o.filter("o_orderkey % 5 = 0"), F.col("o_orderkey") * 4 + 2, "Part", node("Part", "o_custkey"), "placedBy", "object_property", "Customer", node("Customer", "o_custkey"), none, None)
    second = row(o.filter("o_orderkey % 7 = 0"), F.col("o_orderkey") * 4 + 3, "Order", order, "placedBy", "object_property", "Supplier", node("Supplier", F.col("o_custkey") % 100), none, None)
    return good.unionByName(price).unionByName(wrong).unionByName(second)


def _limits(t: DataFrame) -> DataFrame:
    return ontology.property_index(t).filter("is_functional").select(F.col("iri").alias("predicate_iri"), F.lit(1).alias("max_cardinality"))


def verify_stateless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, range and datatype checks: rows by predicate, reason and repair."""
    t = ontology_triples(spark)
    checked = verify.stateless(_mapped(spark, sf_dir), ontology.property_index(t), ontology.subclass_closure(t, True))
    return checked.groupBy("predicate_iri", "reason", "repaired").agg(F.count(F.lit(1)).alias("n"))


def verify_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functional predicates by confidence order, no other check: rejected rows."""
    ranked = verify.confidence_rank(_mapped(spark, sf_dir))
    return verify.cardinality(ranked, _limits(ontology_triples(spark))).filter("reason is not null").select("seq", "subject_iri", "reason")


def verify_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered admission over all checks: counts by predicate, verdict and reason."""
    t = ontology_triples(spark)
    done = verify.admit(_mapped(spark, sf_dir), ontology.property_index(t), ontology.subclass_closure(t, True), ontology.disjoint_pairs(t), _limits(t))
    return done.groupBy("predicate_iri", "verdict", "reason").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    context_graph_customer, kg_pattern_count, kg_statistics, geo_radius, ask_gate_dispatch, turn_evolution, stale_evict, closure_places, depth_and_lca, cycles_broken, cycles_removed, citing_all, bridging_topics,
    kept_graph_contexts, kept_graph_walks, edge_check, shortest_route, neighborhood_suppliers, component_sizes, ontology_summary, property_usage, verify_stateless, verify_cardinality, verify_admission,
)}

_M = """m AS (
 SELECT o_orderkey * 4 AS seq, 'Order_' || o_orderkey AS s, 'Order' AS st, 'placedBy' AS p, 'Customer' AS ot, NULL AS lit, o_orderkey AS k FROM orders UNION ALL
 SELECT o_orderkey * 4 + 1, 'Order_' || o_orderkey, 'Order', 'hasPrice', NULL, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || ' usd' ELSE 'n/a' END, o_orderkey FROM orders UNION ALL
 SELECT o_orderkey * 4 + 2, 'Part_' || o_custkey, 'Part', 'placedBy', 'Customer', NULL, o_orderkey FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
 SELECT o_orderkey * 4 + 3, 'Order_' || o_orderkey, 'Order', 'placedBy', 'Supplier', NULL, o_orderkey FROM orders WHERE o_orderkey % 7 = 0),
c AS (SELECT *, CASE WHEN st = 'Part' THEN 'domain_violation' WHEN lit = 'n/a' THEN 'datatype_mismatch' END AS reason, coalesce(lit <> 'n/a', false) AS repaired,
 row_number() OVER (PARTITION BY s, p ORDER BY CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END, k % 10, seq) AS r0 FROM m)"""
_SPHERE = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"

ORACLE_SQL = {
    "context_graph_customer": f"""WITH RECURSIVE {KG},
e AS (SELECT DISTINCT s AS a, o AS b FROM kg WHERE p <> 'rdf:type' AND k = 'iri'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), t AS (SELECT s AS node, min(o) AS type FROM kg WHERE p = 'rdf:type' GROUP BY 1),
h0 AS (SELECT focal, focal AS node, 0 AS hop FROM (VALUES ('Customer_1'), ('Customer_2')) x(focal)),
h1 AS (SELECT DISTINCT focal, b AS node, 1 AS hop FROM h0 JOIN u ON a = node), h2 AS (SELECT DISTINCT focal, b AS node, 2 AS hop FROM h1 JOIN u ON a = node), h3 AS (SELECT DISTINCT focal, b AS node, 3 AS hop FROM h2 JOIN u ON a = node),
h AS (SELECT focal, node, min(hop) AS hop FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY 1, 2),
sc AS (SELECT focal, h.node, coalesce(type, 'Thing') AS type, hop, round(0.4::DOUBLE / (hop + 1) + 0.4::DOUBLE * (CASE WHEN type IN ('Supplier', 'Part') THEN 1.0::DOUBLE ELSE 0.2::DOUBLE END) + 0.2::DOUBLE, 9) AS relevance FROM h LEFT JOIN t ON t.node = h.node)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY focal ORDER BY (hop = 0) DESC, relevance DESC, node)::INT AS rank FROM sc) WHERE rank <= 30""",
    "kg_pattern_count": "SELECT 'Nation_' || c_nationkey AS nation, o_orderstatus AS status, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2",
    "kg_statistics": f"WITH {KG} SELECT count(*) AS triples, 1::BIGINT AS named_graphs, count(DISTINCT CASE WHEN p = 'rdf:type' AND o = 'Supplier' THEN s END) AS sensor_nodes FROM kg",
    "geo_radius": f"""WITH a AS (SELECT 'Supplier_' || s_suppkey AS id, 40.0::DOUBLE + (s_suppkey * 37 % 1000) / 10000.0::DOUBLE AS lat, -74.0::DOUBLE + (s_suppkey * 91 % 1000) / 10000.0::DOUBLE AS lon FROM supplier),
b AS (SELECT 'Customer_' || c_custkey AS id, 40.0::DOUBLE + (c_custkey * 37 % 1000) / 10000.0::DOUBLE AS lat, -74.0::DOUBLE + (c_custkey * 91 % 1000) / 10000.0::DOUBLE AS lon FROM customer)
SELECT a.id AS centre, b.id AS point, round({_SPHERE}, 3) AS metres FROM a, b WHERE {_SPHERE} < 400""",
    "ask_gate_dispatch": """WITH r AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS seq, l_suppkey AS vehicle, l_orderkey AS incident FROM lineitem),
g AS (SELECT r.* FROM r JOIN orders ON o_orderkey = incident AND o_orderstatus = 'O' JOIN supplier ON s_suppkey = vehicle AND s_acctbal > 0)
SELECT vehicle, min(seq) AS seq, 1::BIGINT AS n FROM g GROUP BY 1""",
    "turn_evolution": """WITH m AS (SELECT DISTINCT epoch(ts)::BIGINT // 3600 - (SELECT min(floor(epoch(ts))::BIGINT // 3600) FROM events) AS turn, user_id AS node FROM (SELECT to_timestamp(floor(epoch(ts))) AS ts, user_id FROM events)),
l AS (SELECT max(turn) AS t FROM m)
SELECT turn, 'added' AS change, count(*) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.turn = m.turn - 1 AND b.node = m.node) GROUP BY 1 UNION ALL
SELECT turn + 1, 'evicted', count(*) FROM m, l WHERE turn + 1 <= t AND NOT EXISTS (SELECT 1 FROM m b WHERE b.turn = m.turn + 1 AND b.node = m.node) GROUP BY 1""",
    "stale_evict": """WITH n AS (SELECT user_id AS node, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS type, user_id % 5 AS target, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000.0::DOUBLE, 6) AS age_min FROM events GROUP BY user_id)
SELECT * FROM n WHERE age_min > 60 AND EXISTS (SELECT 1 FROM n f WHERE f.type = n.type AND f.target = n.target AND f.age_min <= 60)""",
    "closure_places": """WITH e AS (SELECT 'c' || c_custkey AS a, 'Nation_' || c_nationkey AS b FROM customer UNION ALL SELECT 's' || s_suppkey, 'Nation_' || s_nationkey FROM supplier), r AS (SELECT 'Nation_' || n_nationkey AS a, 'Region_' || n_regionkey AS b FROM nation)
SELECT dst, hops, count(*) AS n FROM (SELECT b AS dst, 1 AS hops FROM e UNION ALL SELECT b, 1 FROM r UNION ALL SELECT r.b, 2 FROM e JOIN r ON e.b = r.a) GROUP BY 1, 2""",
    "depth_and_lca": "SELECT a.n_nationkey AS set_id, CASE WHEN a.n_regionkey = b.n_regionkey THEN 'Region_' || a.n_regionkey ELSE 'World' END AS lca FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey < 24",
    "cycles_broken": """WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst FROM part), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT e.src, e.dst FROM e WHERE e.src = e.dst OR EXISTS (SELECT 1 FROM r WHERE r.src = e.dst AND r.dst = e.src)""",
    "citing_all": """WITH t AS (SELECT l_partkey AS id FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2), h AS (SELECT l_suppkey AS id FROM lineitem JOIN t ON l_partkey = t.id GROUP BY 1 HAVING count(DISTINCT l_partkey) = 2)
SELECT h.id, max(year(l_shipdate))::INT AS year FROM h JOIN lineitem ON l_suppkey = h.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "bridging_topics": "SELECT l_suppkey AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#2', 'Brand#17') GROUP BY 1 HAVING count(DISTINCT p_brand) = 2 ORDER BY 1 LIMIT 20",
    "edge_check": "WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT e.l_orderkey IS NOT NULL AS \"exists\", count(*) AS n FROM orders LEFT JOIN e ON l_orderkey = o_orderkey AND l_partkey = o_orderkey % 2000 GROUP BY 1",
    "shortest_route": f"""WITH RECURSIVE {KG}, e AS (SELECT DISTINCT s AS a, o AS b FROM kg WHERE p <> 'rdf:type' AND k = 'iri'), x AS (SELECT min(s) AS src, (SELECT max(o) FROM kg WHERE p = 'partOf') AS goal FROM kg WHERE p = 'placedBy'),
r AS (SELECT src AS node, 1 AS n FROM x UNION SELECT b, n + 1 FROM r JOIN e ON a = node WHERE n < 8)
SELECT min(n)::INT AS nodes, any_value(src) AS source, any_value(goal) AS target FROM r JOIN x ON node = goal HAVING count(*) > 0""",
    "neighborhood_suppliers": f"""WITH {KG}, e AS (SELECT DISTINCT s AS a, o AS b FROM kg WHERE p <> 'rdf:type' AND k = 'iri'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
h1 AS (SELECT DISTINCT b AS n FROM u WHERE a = 'Customer_1'), h2 AS (SELECT DISTINCT b AS n FROM h1 JOIN u ON a = n), h3 AS (SELECT DISTINCT b AS n FROM h2 JOIN u ON a = n)
SELECT n AS node FROM (FROM h1 UNION FROM h2 UNION FROM h3) WHERE n LIKE 'Supplier%'""",
    "cycles_removed": """WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS dst, p_size AS confidence FROM part), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT e.*, (SELECT min(r.dst) FROM r WHERE r.src = e.src AND EXISTS (SELECT 1 FROM r b WHERE b.src = r.dst AND b.dst = e.src)) AS knot FROM e WHERE EXISTS (SELECT 1 FROM r WHERE r.src = e.src AND r.dst = e.src))
SELECT src, dst, confidence FROM (SELECT *, row_number() OVER (PARTITION BY knot ORDER BY confidence, src, dst) AS i FROM c) WHERE i = 1""",
    "component_sizes": """WITH RECURSIVE k AS (SELECT md5(text) AS key, doc_id FROM documents UNION SELECT 'l' || split_part(text, chr(10), 1), doc_id FROM documents WHERE len(string_split(split_part(text, chr(10), 1), ' ')) >= 8),
u AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM k x JOIN k y USING (key) WHERE x.doc_id <> y.doc_id), r AS (SELECT a, a AS b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT root, count(*) AS n FROM (SELECT a, min(b) AS root FROM r GROUP BY 1) GROUP BY 1""",
    "ontology_summary": f"WITH {KG}, {UP}, c AS (SELECT o AS class, count(DISTINCT s) AS n FROM kg WHERE p = 'rdf:type' GROUP BY 1) SELECT class, sum(n)::BIGINT AS instances FROM (SELECT * FROM c UNION ALL SELECT super, n FROM c JOIN up ON class = sub) GROUP BY 1",
    "property_usage": f"""WITH {KG}, pr(iri, kind, domain, "range", is_functional) AS (VALUES ('placedBy','object_property','Order','Party',true),('contains','object_property','Order','Item',false),('suppliedBy','object_property','Order','Supplier',false),('locatedIn','object_property','Party','Place',true),('hasStatus','datatype_property','Order','xsd:string',true))
SELECT pr.*, count(*) AS n FROM pr JOIN kg ON p = iri GROUP BY ALL""",
    "verify_stateless": f"WITH {_M} SELECT p AS predicate_iri, reason, repaired, count(*) AS n FROM c GROUP BY ALL",
    "verify_cardinality": f"WITH {_M} SELECT seq, s AS subject_iri, 'cardinality_violation' AS reason FROM c WHERE r0 > 1",
    "verify_admission": f"""WITH {_M}, d AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY s, p, reason IS NULL ORDER BY CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END, k % 10, seq) > 1 THEN 'cardinality_violation' ELSE reason END AS why FROM c)
SELECT p AS predicate_iri, CASE WHEN why IS NOT NULL THEN 'rejected' WHEN repaired THEN 'repaired' ELSE 'admit' END AS verdict, why AS reason, count(*) AS n FROM d GROUP BY ALL""",
}

ORACLE_SQL["kept_graph_contexts"] = ORACLE_SQL["context_graph_customer"]
ORACLE_SQL["kept_graph_walks"] = f"""SELECT 'near' AS call, count(*) AS n, min(node) AS first, max(node) AS last FROM ({ORACLE_SQL["neighborhood_suppliers"]})
UNION ALL SELECT 'path', nodes::BIGINT, source, target FROM ({ORACLE_SQL["shortest_route"]})"""
