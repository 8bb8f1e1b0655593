"""Queries that run single operators over whole tables: mapping, taxonomy, ontology, surfacing, vocabulary, memory, sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import context, graph, mapping, ontology, retrieval, surface, taxonomy, verify, vocabulary
from graphloom.sources import io
from graphloom.sources.bindings import node, table
from graphloom.storage import shared_base


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def _text_column(c) -> str:
    return F.col(c).cast("string")


# -- mapping


def mapped_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw triples, half of them said from the customer's side: typed, matched, inverted, or dropped with a reason."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    order, buyer = F.concat(F.lit("Order "), _text_column("o_orderkey")), F.concat(F.lit("Customer "), _text_column("o_custkey"))
    said = F.when(k % 7 == 0, "likes").when(k % 2 == 0, "Placed-By").otherwise("is buyer  of")
    triples = o.select(k.alias("seq"), F.when(k % 11 == 0, "Nobody").when(k % 2 == 0, order).otherwise(buyer).alias("subject"), said.alias("predicate"), F.when(k % 13 == 0, "Nothing").when(k % 2 == 0, buyer).otherwise(order).alias("object"))
    name = lambda c, low: F.when(F.col(c) % 3 == 0, "low").otherwise("high") if low else F.lit("high")
    entities = o.select(F.lower(order).alias("key"), F.lit("Order").alias("class"), name("o_orderkey", True).alias("confidence")).unionByName(table(spark, sf_dir, "customer").select(F.concat(F.lit("customer "), _text_column("c_custkey")).alias("key"), F.lit("Customer").alias("class"), F.lit("high").alias("confidence")))
    props = spark.createDataFrame([(1, "ex#placedBy", "placed by", [], ["is buyer of"])], "seq int, iri string, label string, aliases array<string>, inverse_labels array<string>")
    found = mapping.map_predicates(triples.select("predicate"), mapping.predicate_table(props))
    m = mapping.map_triples(triples, entities, found, props.select("iri", F.lit("object_property").alias("kind")))
    return m.groupBy("drop_reason", "subject_type", "predicate_iri", "object_type", "mapping_confidence").agg(F.count(F.lit(1)).alias("n"))


def nearest_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector the nearest of the first vectors of each label."""
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    labels = e.join(first, ["label", "vec_id"]).select(F.col("label").alias("id"), F.col("label").alias("idx"), "vec")
    return mapping.top_match(e.select(F.col("vec_id").alias("query_id"), "vec"), labels).select("query_id", "id", F.round("score", 6).alias("score"))


def typed_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as surfaces, typed by the match of their first part's size; a model's answer stands in below the threshold."""
    p = table(spark, sf_dir, "part")
    surfaces = p.select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("surface"), F.col("p_partkey").alias("query_id"), F.col("p_partkey").alias("seq"))
    matches = p.select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("id"), (F.col("p_size") / 50).alias("score"))
    model = p.groupBy(F.lower("p_name").alias("key")).agg(F.min("p_brand").alias("class")).filter("key like '%a%'")
    return mapping.type_entities(surfaces, matches, model, 0.5)


# -- taxonomy


def _taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, edges, families): suppliers as classes, under the coined family of their nation where they have means."""
    s = table(spark, sf_dir, "supplier")
    classes = s.select(_text_column("s_suppkey").alias("id"), F.concat(F.lit("Fire Unit "), (F.col("s_suppkey") % 40).cast("string")).alias("label"), F.col("s_acctbal").cast("bigint").alias("mention_count"), F.array("s_name").alias("alt_labels"))
    family = F.concat(F.lit("coined:"), _text_column("s_nationkey"))
    edges = s.filter("s_acctbal > 0").select(_text_column("s_suppkey").alias("child"), family.alias("parent"), F.when(F.col("s_suppkey") % 2 == 0, F.array(F.lit("llm"))).otherwise(F.array(F.lit("llm"), F.lit("rule"))).alias("via"))
    families = edges.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))
    return classes, edges, families


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, edges, families = _taxonomy(spark, sf_dir)
    concepts = table(spark, sf_dir, "part").select(F.concat(F.lit("fire-unit "), (F.col("p_partkey") % 60).cast("string")).alias("label"))
    return taxonomy.structure_statistics(classes, concepts, edges, families)


def reviewed_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coined families by their children of even key: verdicts, what is left under them, and the names of those accepted."""
    classes, edges, families = _taxonomy(spark, sf_dir)
    verdicts, left, orphans = taxonomy.review_coined(families, classes.filter("int(id) % 3 = 0").select("id"), edges, classes)
    names = taxonomy.family_names(families, classes.select("id", "label"))
    under = left.groupBy("parent").agg(F.count(F.lit(1)).alias("edges"))
    rows = verdicts.join(under, "parent", "left").join(names, "parent").select("parent", "n", "verdict", F.coalesce("edges", F.lit(0)).alias("edges"), "name")
    lost = orphans.agg(F.lit("orphans").alias("parent"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("string").alias("verdict"), F.lit(0).cast("long").alias("edges"), F.lit(None).cast("string").alias("name"))
    return rows.unionByName(lost)


def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as concepts under review: verdicts, feedback for the next pass, and how many needed no person."""
    classes, edges, _ = _taxonomy(spark, sf_dir)
    k = F.col("id").cast("int")
    v = taxonomy.concept_verdict(k % 5 != 0, k % 7 == 0, k % 11 == 0, k % 3 == 0)
    decisions = classes.select("id", F.lit("concept").alias("kind"), v["verdict"].alias("verdict"), v["parked"].alias("parked"))
    loose = taxonomy.unconnected(classes, edges, edges.limit(0).select(F.col("child").alias("domain_id"), F.col("parent").alias("range_id")))
    counts = taxonomy.feedback_set(decisions, loose).groupBy(F.concat(F.lit("feedback:"), "feedback").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    stats = taxonomy.review_statistics(decisions).select(F.concat_ws(":", F.coalesce("kind", F.lit("all")), "verdict").alias("what"), "n")
    return counts.unionByName(stats)


def rewritten_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with one label are merged; disjointness axioms between neighbours follow, those within a merged class are degenerate."""
    classes, _, _ = _taxonomy(spark, sf_dir)
    _, remap = taxonomy.merge_duplicate_labels(classes)
    k = F.col("id").cast("int")
    axioms = classes.select(k.alias("id"), F.lit("disjointWith").alias("type"), F.array("id", F.when(k % 2 == 0, (k + 40) % 100).otherwise((k + 1) % 100).cast("string")).alias("classes"), F.lit(False).alias("relaxed"))
    return taxonomy.rewrite_axioms(axioms, remap).select("id", F.array_join("classes", ",").alias("classes"), "relaxed", "degenerate")


def review_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _, families = _taxonomy(spark, sf_dir)
    _, remap = taxonomy.merge_duplicate_labels(classes)
    verdicts = taxonomy.coined_verdicts(families, classes.filter("int(id) % 3 = 0").select("id"))
    log = taxonomy.edit_log(remap, verdicts, taxonomy.family_names(families, classes.select("id", "label")))
    return log.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("targets")).alias("targets"))


def resolved_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as relations of supplier to part labels: resolved to class ids, first of each id, or dropped; then judged."""
    li = table(spark, sf_dir, "lineitem")
    index = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier "), _text_column("s_suppkey")).alias("label"), node("S", "s_suppkey").alias("id")).unionByName(table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("Part-"), _text_column("p_partkey")).alias("label"), node("P", "p_partkey").alias("id")))
    relations = li.select(F.concat_ws("-", _text_column("l_suppkey"), _text_column("l_partkey")).alias("id"), F.concat(F.lit("supplier "), _text_column("l_suppkey")).alias("domain"), F.concat(F.lit("part "), _text_column("l_partkey")).alias("range"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    kept, dropped = taxonomy.resolve_relations(relations, index)
    judged = taxonomy.relationship_verdicts(kept, index.filter("int(substring(id, 3)) % 2 = 0").select("id"))
    return judged.groupBy(F.col("verdict").alias("what")).agg(F.count(F.lit(1)).alias("n")).unionByName(dropped.agg(F.lit("dropped").alias("what"), F.count(F.lit(1)).alias("n")))


def grounded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type names as labels against part names and brands as concepts."""
    p = table(spark, sf_dir, "part")
    labels = p.select(F.regexp_replace("p_brand", "#", "-").alias("label")).unionByName(p.select(F.col("p_type").alias("label"))).distinct()
    concepts = p.select(F.col("p_partkey").alias("seq"), node("c", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("representative"), F.array().cast("array<string>").alias("alt_labels"))
    return taxonomy.ground_labels(labels, concepts)


def stated_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as concepts: a stated parent for some, a cluster's for others; reviewed by scope and grounding."""
    n = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    concept = n.select(_text_column("s_suppkey").alias("concept"))
    isa = n.filter(k % 2 == 0).select(_text_column("s_suppkey").alias("child"), _text_column("s_nationkey").alias("parent"))
    clusters = n.filter(k % 3 == 0).select(_text_column("s_suppkey").alias("concept"), F.lit("Coined").alias("coined"))
    done = taxonomy.review_in_scope(taxonomy.attach_stated(concept, isa, clusters), n.filter(k % 7 == 0).select(_text_column("s_suppkey").alias("concept")), n.filter(k % 5 != 0).select(_text_column("s_suppkey").alias("concept")))
    return done.groupBy("coined", "orphan", "verdict").agg(F.count(F.lit(1)).alias("n"))


def relaxed_axioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, nations and regions as a hierarchy: a disjointness between a place and what lies in it is relaxed."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    edges = c.select(node("C", "c_custkey").alias("src"), node("N", "c_nationkey").alias("dst")).unionByName(n.select(node("N", "n_nationkey").alias("src"), node("R", "n_regionkey").alias("dst")))
    axioms = c.select(node("C", "c_custkey").alias("a"), node("R", F.col("c_custkey") % 5).alias("b"))
    judged = taxonomy.axiom_verdicts(taxonomy.relax_disjointness(axioms, edges), axioms.select(F.col("a").alias("id")).unionByName(axioms.filter("b <> 'R_0'").select(F.col("b").alias("id"))))
    return judged.groupBy("relaxed", "verdict").agg(F.count(F.lit(1)).alias("n"))


# -- ontology


def _part_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an ontology: types and brands as classes, names as properties with restrictions, types disjoint."""
    p = table(spark, sf_dir, "part")
    iri = lambda c: F.concat(F.lit("ex#"), F.regexp_replace(c, "[ #]", "_"))
    t = lambda s, rel, o, kind="iri": p.select(F.lit("g").alias("g"), s.alias("s"), F.lit(rel).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    brand, kind, name, rest = iri("p_brand"), iri("p_type"), iri("p_name"), F.concat(F.lit("_:r"), _text_column("p_partkey"))
    rows = [
        t(brand, "rdf:type", F.lit("owl:Class")), t(kind, "rdf:type", F.lit("owl:Class")), t(brand, "rdfs:subClassOf", kind), t(brand, "rdfs:label", F.col("p_brand"), "literal"), t(brand, "skos:altLabel", F.lower("p_brand"), "literal"),
        t(name, "rdf:type", F.lit("owl:ObjectProperty")), t(name, "rdfs:domain", F.lit("owl:Thing")), t(name, "rdfs:range", F.lit("ex#ECONOMY")), t(name, "rdfs:label", F.col("p_name"), "literal"),
        t(name, "owl:inverseOf", F.concat(name, F.lit("_of"))), t(F.concat(name, F.lit("_of")), "rdfs:label", F.concat("p_name", F.lit(" of")), "literal"), t(rest, "owl:onProperty", name), t(rest, "owl:maxCardinality", _text_column("p_size"), "literal"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)

    disjoint = p.filter("p_type <> 'PROMO'").select(F.lit("g").alias("g"), iri("p_type").alias("s"), F.lit("owl:disjointWith").alias("p"), F.lit("ex#PROMO").alias("o"), F.lit("iri").alias("o_kind"))
    return out.unionByName(disjoint).distinct()


def ontology_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ontology.class_index(_part_ontology(spark, sf_dir))
    return c.select("iri", "local_name", "label", F.array_join("aliases", ",").alias("aliases"), F.array_join("superclasses", ",").alias("superclasses"))


def ontology_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ontology.property_index(_part_ontology(spark, sf_dir))
    return p.select("iri", "kind", "domain", "range", "label", "inverse_of", F.array_join("inverse_labels", ",").alias("inverse_labels"), "max_cardinality")


def ontology_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ontology of all parts and of those of one type as two versions, written and read again: counts, and classes the second lost."""
    t, path = _part_ontology(spark, sf_dir), _path(spark, "ontology")
    part = t.filter("p <> 'rdf:type' or o <> 'owl:Class' or s like 'ex#Brand%' or s in ('ex#PROMO', 'ex#SMALL')")
    t.withColumn("version", F.lit("0.1")).unionByName(part.withColumn("version", F.lit("0.2"))).write.partitionBy("version").parquet(path)
    both = spark.read.parquet(path).withColumn("version", F.col("version").cast("string"))
    lost = ontology.lost_classes(io.read_version(spark, path, "0.1"), io.read_version(spark, path, "0.2")).agg(F.count(F.lit(1)).alias("lost"))
    return ontology.summary(both).join(lost)


def ontology_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index over the one namespace: closure by name, disjoint pairs and names of both kinds, as one list."""
    t = _part_ontology(spark, sf_dir)
    idx = ontology.namespace_index(t, "ex#")
    rows = idx["closure"].select(F.lit("closure").alias("what"), F.concat_ws(">", "sub", "super").alias("name"))
    rows = rows.unionByName(idx["disjoint"].select(F.lit("disjoint").alias("what"), F.concat_ws("|", "a", "b").alias("name"))).unionByName(idx["properties"].select(F.lit("property").alias("what"), F.concat_ws(":", "local_name", F.coalesce("range", F.lit("-"))).alias("name")))
    rows = rows.unionByName(ontology.direct_subclasses(t, "ex#PROMO").select(F.lit("below").alias("what"), "name")).unionByName(ontology.members_of(t, "owl:Class").select(F.lit("class").alias("what"), "name"))
    return rows.unionByName(ontology.disjoint_pairs(t).select(F.lit("pair").alias("what"), F.concat_ws("|", "a", "b").alias("name"))).unionByName(ontology.namespace(t).select(F.lit("namespace").alias("what"), F.col("namespace").alias("name")))


# -- verification


def verify_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows that clash in all ways at once: the two halves of an order as subjects of two disjoint types, three slots of it as
    objects of two disjoint types and a third, in one property that is inverse-functional and allows a subject two rows. Returns every rejected row."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")).alias("l"))
    part = lambda c, n: F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col(c) % n).cast("string"))
    kept = {"A": "Kept", "R": "Returned", "N": "Fresh"}
    rows = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), node("Half", part("l.l_suppkey", 2)).alias("subject_iri"), F.when(F.col("l_linenumber") % 4 == 0, "Late").otherwise("Early").alias("subject_type"),
        F.lit("holds").alias("predicate_iri"), F.lit("object_property").alias("predicate_kind"), node("Slot", part("l.l_partkey", 3)).alias("object_iri"),
        F.coalesce(*[F.when(F.col("l.l_returnflag") == k, v) for k, v in kept.items()]).alias("object_type"), F.lit(None).cast("string").alias("object_literal"), F.lit(None).cast("string").alias("object_datatype"),
        F.array(F.lit("llm")).alias("sources"), F.array(F.col("l.l_quantity").cast("int")).alias("sentence_indices"), F.lit("high").alias("mapping_confidence"),
    )
    props = spark.createDataFrame([("holds", "Half", "Slot", True)], "iri string, domain string, range string, is_inverse_functional boolean")
    up = spark.createDataFrame([("Late", "Half"), ("Early", "Half"), ("Kept", "Slot"), ("Returned", "Slot")], "sub string, super string")
    disjoint = spark.createDataFrame([("Late", "Early"), ("Returned", "Kept")], "a string, b string")
    done = verify.admit(rows.filter("object_type <> 'Fresh' or seq % 3 > 0"), props, up, disjoint, spark.createDataFrame([("holds", 2)], "predicate_iri string, max_cardinality int"))
    return done.filter("verdict = 'rejected'").select("seq", "subject_iri", "object_iri", "reason")


def asserted_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of what admitted order rows name."""
    o = table(spark, sf_dir, "orders")
    done = o.select(node("Order", "o_orderkey").alias("subject_iri"), F.lit("Order").alias("subject_type"), node("Customer", "o_custkey").alias("object_iri"), F.lit("Customer").alias("object_type"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("admit").alias("verdict"))
    return verify.type_assertions(done).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


# -- surfacing and vocabulary


def surfaced_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark items as a lexicon of verbs, found in the documents' sentences with their particles."""
    verbs = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("verb")).filter("length(verb) > 3").distinct()
    found = surface.surface_relations(surface.sentence_table(table(spark, sf_dir, "documents")), verbs)
    return found.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def term_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of every word of the benchmark items and of the pairs of words that begin them in all documents, at most 50 a document and term, each
    with its exact slice: how many, where the first is, and the terms that are nowhere."""
    d, words = table(spark, sf_dir, "documents"), F.split(F.lower("text"), "[^a-z]+")
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.concat(words, F.array(F.concat_ws(" ", F.slice(words, 1, 2))))).alias("term")).filter("length(term) > 3").distinct()
    found = surface.resolved_terms(d, terms)
    exact = surface.exact_places(found.filter("start is not null"), d).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("text") == F.col("term")).alias("exact"), F.count_distinct("doc_id").alias("docs"), F.sum("start").alias("starts"))
    return terms.join(exact, "term", "left").select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "exact", "docs", "starts")])


def cheap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as cheap mentions, part types and upper-case names as proposed ones: the union by source, and the counts."""
    p = table(spark, sf_dir, "part")
    cheap = p.select(F.col("p_name").alias("text")).distinct()
    proposed = p.select(F.upper(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).alias("text"), F.lit(True).alias("grounded")).unionByName(p.select(F.col("p_type").alias("text"), F.lit(False).alias("grounded"))).distinct()
    by = surface.cheap_first_union(cheap, proposed).groupBy("source", "grounded").agg(F.count(F.lit(1)).alias("n"))
    return by.join(F.broadcast(surface.union_statistics(cheap, proposed)))


def gate_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types through the kind gate and a model's labels by size."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 4 == 0, "relation").otherwise("concept")
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat("p_name", F.lit(" 7"))).otherwise(F.col("p_name"))
    gate = X.kind_gate(name, kind)
    gated = p.select(name.alias("canonical"), kind.alias("kind"), gate["bin"].alias("bin"), gate["reason"].alias("reason"))
    labels = p.groupBy(F.col("p_name").alias("term")).agg(F.when(F.min("p_partkey") % 3 == 0, "individual").when(F.min("p_partkey") % 3 == 1, "non_concept").alias("label"))
    return surface.gate_override(gated, labels).groupBy("kind", "bin", "reason").agg(F.count(F.lit(1)).alias("n"))


def rejected_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct words of the documents as elements, by the reason they are dropped for."""
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("w")).filter("w <> ''")
    e = d.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    reason = vocabulary.rejection_reason(F.col("w"), F.lit("concept"), F.col("n"), F.length("w") % 2 == 0, F.lit(False), F.array(F.lit("llm")))
    return e.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def parked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as scored terms, kept or parked, of the 40 most salient concepts."""
    p = table(spark, sf_dir, "part")
    e = p.groupBy(F.col("p_name").alias("id")).agg(F.count(F.lit(1)).alias("mention_count"), F.max(F.when(F.col("p_size") > 49, 1.0).otherwise(0.0)).alias("scope_match"), F.sum("p_size").cast("double").alias("salience"))
    e = e.withColumn("kind", F.when(F.col("id").like("%ring"), "relation").otherwise("concept"))
    return vocabulary.keep_or_park(e, 40, 33, 30).select("id", "kept", "reason")


def simple_saliences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as concepts, brands' first names as topics."""
    p = table(spark, sf_dir, "part")
    topics = p.filter("p_size = 50").select(F.upper("p_name").alias("topic")).unionByName(p.select(F.element_at(F.split("p_name", " "), 2).alias("topic")).filter("topic like '%o%'"))
    concepts = p.groupBy(F.col("p_name").alias("label")).agg((F.max("p_size") > 48).alias("grounded"))
    return vocabulary.simple_salience(concepts, topics).select("label", "scope_hit", "salience", "kept")


def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label in groups of such as are near each other, each with the least id of its group."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(F.concat(F.lit("label"), _text_column("label"))).alias("tokens"), F.col("embedding").alias("vec"))
    roots = graph.components(vocabulary.semantic_links(e, 0.7))
    return e.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def acronym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of part names as acronyms of them."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    letters = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.substring(w, 1, 1)), ""))
    c = p.select(F.lit("concept").alias("kind"), F.col("p_name").alias("key"), F.col("p_name").alias("canonical")).unionByName(p.select(F.lit("concept").alias("kind"), F.lower(letters).alias("key"), letters.alias("canonical")).distinct())
    return vocabulary.acronym_links(c)


# -- memory and sources


def recalled_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items remembered in chunks, every one asked for again: it comes first among at most five notes."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    memory = retrieval.remember(b, _path(spark, "memory"))
    asked = b.select(F.col("id").alias("query_id"), F.substring("text", 1, 800).alias("text"))
    found = retrieval.recall(asked, memory)
    return found.select("query_id", F.size("notes").alias("n"), F.element_at("notes", 1)["id"].alias("first"))


def hybrid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nearest vectors of each whose id is divisible by 20, and the vectors one step from any of them in a chain of ids."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("seq"), _text_column("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.filter("seq % 20 = 0").select(F.col("seq").alias("query_id"), "vec")
    edges = e.select(F.col("id").alias("src"), F.lit("NEXT").alias("rel"), (F.col("seq") + 1).cast("string").alias("dst"))
    types = e.select(F.col("id").alias("node"), F.lit("Paper").alias("type"))
    return retrieval.hybrid_recall(q, e, edges, types, 3)[1]


def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names embedded through a cache, twice: each distinct name once."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))

    def embed(batches):
        for b in batches:
            yield b.assign(vec=[[float(len(t)), float(t.count("e"))] for t in b["text"]])[["key", "vec"]]

    path = _path(spark, "vectors")
    io.embed_with_cache(p, path, embed, "m", 2)
    out = io.embed_with_cache(p, path, embed, "m", 2)
    stored = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored"))
    return out.groupBy(F.element_at("vec", 1).alias("length"), F.element_at("vec", 2).alias("es")).agg(F.count(F.lit(1)).alias("n")).join(stored)


def sensor_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed with one camera for each customer, with the incident scene: triples by predicate."""
    many = table(spark, sf_dir, "customer").count()
    t = io.sensor_feed(spark, many).unionByName(io.incident_scene(spark))
    return t.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def stage_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a stage with its statistics, read again."""
    path = _path(spark, "stage")
    stats = io.write_stage(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, "one")
    return io.read_stage(spark, path, "one").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).join(stats)


def emitted_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as classes, emitted onto a base with a version: triples by predicate, and the new version."""
    classes, edges, _ = _taxonomy(spark, sf_dir)
    base = table(spark, sf_dir, "nation").select(F.lit("ontology").alias("g"), node("N", "n_nationkey").alias("s"), F.lit("rdf:type").alias("p"), F.lit("owl:Class").alias("o"), F.lit("iri").alias("o_kind"))
    base = base.unionByName(base.limit(1).select("g", F.lit("ex").alias("s"), F.lit("owl:versionInfo").alias("p"), F.lit("0.1").alias("o"), F.lit("literal").alias("o_kind")))
    relations = table(spark, sf_dir, "nation").select(node("r", "n_nationkey").alias("id"), node("N", "n_nationkey").alias("domain_id"), node("R", "n_regionkey").alias("range_id"))
    delta = io.emit_classes(classes.withColumn("parked", F.col("mention_count") < 0), edges, relations, edges.limit(0).select(F.col("child").alias("a"), F.col("parent").alias("b")))
    new = io.cumulative(base, delta, "0.2")
    return new.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("p") == "owl:versionInfo", F.col("o"))).alias("version"))


def clock_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' ages after two minutes in which those with a click in the last minute of events were refreshed."""
    e = table(spark, sf_dir, "events")
    ages = e.groupBy(F.col("user_id").alias("node")).agg(F.sum("value").alias("age_min"))
    fresh = e.filter("event_type = 'click' and event_id % 10 = 0").select(F.col("user_id").alias("node"))
    return context.advance_clock(ages, fresh, 2.0).select("node", F.round("age_min", 4).alias("age_min"))


def dispatched_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders grant the supplier of their first line; availability and assignments after the write-back."""
    li = table(spark, sf_dir, "lineitem")
    granted = li.groupBy(node("Supplier", "l_suppkey").alias("vehicle")).agg(node("Order", F.min("l_orderkey")).alias("incident")).withColumn("granted", F.col("vehicle").rlike("[02468]$"))
    t = table(spark, sf_dir, "supplier").select(node("Supplier", "s_suppkey").alias("s"), F.lit("hasAvailability").alias("p"), F.lit("available").alias("o"))
    return context.write_back(t, granted).groupBy("p", F.when(F.col("p") == "hasAvailability", F.col("o")).alias("o")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    mapped_triples, nearest_label, typed_surfaces, structure_counts, reviewed_families, review_feedback, rewritten_references, review_edits, resolved_relations, grounded_labels, stated_parents, relaxed_axioms,
    ontology_classes, ontology_properties, ontology_versions, ontology_namespace, verify_conflicts, asserted_types, surfaced_relations, term_places, cheap_first, gate_overrides, rejected_elements, parked_terms, simple_saliences,
    semantic_pairs, acronym_pairs, recalled_notes, hybrid_neighbours, cached_embeddings, sensor_triples, stage_tables, emitted_ontology, clock_ages, dispatched_triples,
)}

_TAX = """c AS (SELECT s_suppkey AS k, s_suppkey::VARCHAR AS id, 'Fire Unit ' || (s_suppkey % 40) AS label, trunc(s_acctbal)::BIGINT AS m, s_nationkey AS nat, s_acctbal > 0 AS has FROM supplier)"""
_REMAP = """w AS (SELECT label, arg_min(id, struct_pack(a := -m, b := id)) AS new_id FROM c GROUP BY 1), remap AS (SELECT id AS old_id, new_id FROM c JOIN w USING (label) WHERE id <> new_id)"""
_FAM = """f AS (SELECT nat, count(*) AS kids, count(*) FILTER (k % 3 = 0) AS n FROM c WHERE has GROUP BY 1), v AS (SELECT *, CASE WHEN n >= 2 THEN 'accept' WHEN n = 1 THEN 'demote' ELSE 'reject' END AS verdict FROM f)"""
_ONTO = """p AS (SELECT *, 'ex#' || regexp_replace(p_brand, '[ #]', '_', 'g') AS brand, 'ex#' || p_type AS kind, 'ex#' || replace(p_name, ' ', '_') AS name FROM part)"""
_DOT = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"

ORACLE_SQL = {
    "mapped_triples": """WITH m AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Order' ELSE 'Customer' END AS st, CASE WHEN o_orderkey % 7 <> 0 THEN 'ex#placedBy' END AS p, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Customer' ELSE 'Order' END AS ot FROM orders),
d AS (SELECT *, CASE WHEN st IS NULL THEN 'subject_untyped' WHEN p IS NULL THEN 'predicate_unmapped' WHEN p IS NOT NULL AND ot IS NULL THEN 'object_unmapped' END AS drop_reason, p IS NOT NULL AND k % 2 = 1 AS swap FROM m)
SELECT drop_reason, CASE WHEN swap THEN ot ELSE st END AS subject_type, p AS predicate_iri, CASE WHEN p IS NULL THEN NULL WHEN swap THEN st ELSE ot END AS object_type,
CASE WHEN k % 3 = 0 AND (st = 'Order' OR (ot = 'Order' AND p IS NOT NULL)) THEN 'low' ELSE 'high' END AS mapping_confidence, count(*) AS n FROM d GROUP BY ALL""",
    "nearest_label": f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), l AS (SELECT label, arg_min(v, vec_id) AS w FROM e GROUP BY 1), s AS (SELECT vec_id, l.label, round({_DOT.format('v', 'w')}, 9) AS score FROM e, l) SELECT vec_id AS query_id, arg_max(label, struct_pack(a := score, b := -label)) AS id, round(max(score), 6) AS score FROM s GROUP BY 1",
    "typed_surfaces": """WITH f AS (SELECT p_name AS key, min(p_partkey) AS q, min(p_brand) AS brand FROM part GROUP BY 1), j AS (SELECT key, brand, p_type, p_size / 50.0::DOUBLE >= 0.5 AS near FROM f JOIN part ON p_partkey = q)
SELECT key, CASE WHEN near THEN p_type ELSE brand END AS class, CASE WHEN near THEN 'high' ELSE 'low' END AS confidence FROM j WHERE near OR key LIKE '%a%'""",
    "structure_counts": f"""WITH {_TAX}, x AS (SELECT 'fireunit' || (p_partkey % 60) AS key FROM part) SELECT 'classes' AS stat, count(*) AS n FROM c UNION ALL SELECT 'roots', count(*) FILTER (NOT has) FROM c UNION ALL SELECT 'with_parent', count(*) FILTER (has) FROM c UNION ALL SELECT 'coined_parents', count(DISTINCT nat) FILTER (has) FROM c
UNION ALL SELECT 'omitted_candidates', count(*) FROM x WHERE key NOT IN (SELECT 'fireunit' || (k % 40) FROM c) UNION ALL SELECT 'via:llm', count(*) FROM c WHERE has UNION ALL SELECT 'via:rule', count(*) FROM c WHERE has AND k % 2 = 1""",
    "reviewed_families": f"""WITH {_TAX}, {_FAM} SELECT 'coined:' || nat AS parent, n, verdict, CASE WHEN verdict = 'accept' THEN kids ELSE 0 END AS edges, 'Unit' AS name FROM v
UNION ALL SELECT 'orphans', (SELECT count(*) FROM c WHERE NOT has OR nat NOT IN (SELECT nat FROM v WHERE verdict = 'accept')), NULL, 0, NULL""",
    "review_feedback": f"""WITH {_TAX}, d AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'reject' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'escalate' ELSE 'accept' END AS verdict, k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 3 = 0 AS parked FROM c),
r AS (SELECT 'feedback:' || CASE verdict WHEN 'reject' THEN 'rejected' WHEN 'escalate' THEN 'escalated' ELSE 'parked' END AS what FROM d WHERE verdict <> 'accept' OR parked UNION ALL SELECT 'feedback:unconnected' FROM d WHERE NOT has UNION ALL SELECT 'concept:' || verdict FROM d
UNION ALL SELECT CASE verdict WHEN 'accept' THEN 'all:auto_accepted' WHEN 'reject' THEN 'all:auto_rejected' ELSE 'all:escalated' END FROM d) SELECT what, count(*) AS n FROM r GROUP BY 1""",
    "rewritten_references": f"""WITH {_TAX}, {_REMAP}, a AS (SELECT k AS id, id AS x, (CASE WHEN k % 2 = 0 THEN (k + 40) % 100 ELSE (k + 1) % 100 END)::VARCHAR AS y FROM c), b AS (SELECT a.id, coalesce(r.new_id, x) AS x, coalesce(q.new_id, y) AS y FROM a LEFT JOIN remap r ON r.old_id = x LEFT JOIN remap q ON q.old_id = y)
SELECT id::INT AS id, CASE WHEN x = y THEN x ELSE x || ',' || y END AS classes, x = y AS relaxed, x = y AS degenerate FROM b""",
    "review_edits": f"""WITH {_TAX}, {_REMAP}, {_FAM}, e AS (SELECT 'merge' AS type, 1 + count(*) AS t FROM remap GROUP BY new_id UNION ALL SELECT verdict, 1 FROM v WHERE verdict <> 'accept' UNION ALL SELECT 'name_coined', 1 FROM v WHERE verdict = 'accept') SELECT type, count(*) AS n, sum(t)::BIGINT AS targets FROM e GROUP BY 1""",
    "resolved_relations": """WITH l AS (SELECT l_suppkey AS s, l_partkey AS p, p_size > 10 AS ok FROM lineitem JOIN part ON p_partkey = l_partkey), k AS (SELECT DISTINCT s, p FROM l WHERE ok)
SELECT CASE WHEN s % 2 = 0 AND p % 2 = 0 THEN 'accept' ELSE 'escalate' END AS what, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'dropped', count(*) FROM l WHERE NOT ok""",
    "grounded_labels": "WITH l AS (SELECT replace(p_brand, '#', '-') AS label, min(p_partkey) AS k FROM part GROUP BY 1 UNION ALL SELECT DISTINCT p_type, NULL FROM part) SELECT label, 'c_' || k AS concept_id, k IS NULL AS llm_introduced FROM l",
    "stated_parents": """WITH s AS (SELECT s_suppkey % 2 <> 0 AND s_suppkey % 3 = 0 AS coined, s_suppkey % 2 <> 0 AND s_suppkey % 3 <> 0 AS orphan, s_suppkey AS k FROM supplier)
SELECT coined, orphan, CASE WHEN k % 5 = 0 THEN 'reject' WHEN orphan AND k % 7 <> 0 THEN 'park' ELSE 'accept' END AS verdict, count(*) AS n FROM s GROUP BY ALL""",
    "relaxed_axioms": """WITH a AS (SELECT n_regionkey = c_custkey % 5 AS relaxed, c_custkey % 5 <> 0 AS known FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT relaxed, CASE WHEN relaxed THEN 'reject' WHEN known THEN 'accept' ELSE 'escalate' END AS verdict, count(*) AS n FROM a GROUP BY ALL""",
    "ontology_classes": f"""WITH {_ONTO} SELECT brand AS iri, brand[4:] AS local_name, p_brand AS label, lower(p_brand) AS aliases, string_agg(DISTINCT kind, ',' ORDER BY kind) AS superclasses FROM p GROUP BY brand, p_brand UNION ALL SELECT DISTINCT kind, p_type, p_type, '', '' FROM p""",
    "ontology_properties": f"""WITH {_ONTO} SELECT name AS iri, 'object_property' AS kind, NULL AS domain, 'ex#ECONOMY' AS "range", p_name AS label, name || '_of' AS inverse_of, p_name || ' of' AS inverse_labels, min(p_size)::INT AS max_cardinality FROM p GROUP BY name, p_name""",
    "ontology_versions": f"""WITH {_ONTO}, n AS (SELECT count(DISTINCT brand) AS b, count(DISTINCT kind) AS t, count(DISTINCT name) AS o, count(DISTINCT kind) FILTER (p_type <> 'PROMO') AS d FROM p)
SELECT v.version, CASE WHEN v.version = '0.1' THEN b + t ELSE b + 2 END AS classes, o AS object_properties, 0::BIGINT AS datatype_properties, d AS axioms, t - 2 AS lost FROM n, (VALUES ('0.1'), ('0.2')) v(version)""",
    "ontology_namespace": f"""WITH {_ONTO}, u AS (SELECT brand, max(kind) AS kind FROM p GROUP BY 1), r AS (
 SELECT 'closure' AS what, brand[4:] || '>' || brand[4:] AS name FROM u UNION ALL SELECT 'closure', brand[4:] || '>' || kind[4:] FROM u UNION ALL SELECT DISTINCT 'closure', p_type || '>' || p_type FROM p
 UNION ALL SELECT DISTINCT 'disjoint', p_type || '|PROMO' FROM p WHERE p_type <> 'PROMO' UNION ALL SELECT DISTINCT 'property', name[4:] || ':ECONOMY' FROM p UNION ALL SELECT DISTINCT 'below', brand[4:] FROM p WHERE p_type = 'PROMO'
 UNION ALL SELECT DISTINCT 'class', brand[4:] FROM p UNION ALL SELECT DISTINCT 'class', p_type FROM p UNION ALL SELECT DISTINCT 'pair', least(kind, 'ex#PROMO') || '|' || greatest(kind, 'ex#PROMO') FROM p WHERE p_type <> 'PROMO' UNION ALL SELECT 'namespace', 'ex#') SELECT * FROM r""",
    "verify_conflicts": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(struct_pack(p := l_partkey, s := l_suppkey, f := l_returnflag, o := l_linestatus, q := l_quantity)) AS l FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, k * 10 + n AS seq, 'Half_' || k || '-' || (l.s % 2) AS s, CASE WHEN n % 4 = 0 THEN 'Late' ELSE 'Early' END AS st, 'Slot_' || k || '-' || (l.p % 3) AS o,
 CASE l.f WHEN 'A' THEN 'Kept' WHEN 'R' THEN 'Returned' ELSE 'Fresh' END AS ot, trunc(l.q)::INT AS q FROM l),
g AS (SELECT k, list([struct_pack(q, seq, s, st, o, ot, ok := '')] ORDER BY q, seq) AS rows FROM r WHERE ot = 'Kept' OR ot = 'Returned' GROUP BY k),
d AS (SELECT list_reduce([[NULL]] || rows, lambda a, x: a || [struct_pack(q := x[1].q, seq := x[1].seq, s := x[1].s, st := x[1].st, o := x[1].o, ot := x[1].ot, ok :=
  CASE WHEN len(list_filter(a, lambda y: y.ok = 'admit' AND (y.s = x[1].s AND y.st <> x[1].st OR y.o = x[1].o AND y.ot <> x[1].ot))) > 0 THEN 'disjointness_violation'
  WHEN len(list_filter(a, lambda y: y.ok = 'admit' AND y.s = x[1].s)) >= 2 OR len(list_filter(a, lambda y: y.ok = 'admit' AND y.o = x[1].o AND y.s <> x[1].s)) > 0 THEN 'cardinality_violation' ELSE 'admit' END)]) AS done FROM g),
u AS (SELECT unnest(done) AS x FROM d)
SELECT x.seq AS seq, x.s AS subject_iri, x.o AS object_iri, x.ok AS reason FROM u WHERE x.ok <> 'admit'
UNION ALL SELECT seq, s, o, 'range_violation' FROM r WHERE ot = 'Fresh' AND seq % 3 > 0""",
    "asserted_types": "SELECT 'Order' AS class, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'Customer', count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus <> 'F'",
    "surfaced_relations": r"""WITH v AS (SELECT DISTINCT v FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS v FROM benchmark) WHERE len(v) > 3), s AS (SELECT unnest([x for x in string_split_regex(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) if x <> '']) AS s FROM documents),
w AS (SELECT string_split_regex(lower(s), '[^a-z]+') AS w FROM s), x AS (SELECT unnest(w) AS a, unnest(w[2:] || [NULL]) AS b FROM w)
SELECT CASE WHEN b IN ('in', 'on', 'at', 'to', 'by', 'of', 'with', 'from', 'for', 'up', 'out', 'off', 'over') THEN a || ' ' || b ELSE a END AS relation, count(*) AS n FROM x JOIN v ON a = v GROUP BY 1""",
    "term_places": r"""WITH w AS (SELECT string_split_regex(lower(text), '[^a-z]+') AS w FROM benchmark), t AS (SELECT DISTINCT t FROM (SELECT unnest(w || [array_to_string(w[1:2], ' ')]) AS t FROM w) WHERE len(t) > 3),
c AS (SELECT doc_id, t, string_split(lower(text), t) AS p, lower(text) AS x FROM documents JOIN t ON contains(lower(text), t)),
u AS (SELECT doc_id, t, x, list_sum(list_transform(p[1:i], lambda y: len(y))) + (i - 1) * len(t) AS pos FROM (SELECT *, unnest(range(1, len(p))) AS i FROM c)),
f AS (SELECT doc_id, t, pos, row_number() OVER (PARTITION BY doc_id, t ORDER BY pos) AS r FROM u WHERE NOT regexp_matches(x[pos:pos], '[0-9a-z]') AND NOT regexp_matches(x[pos + len(t) + 1:pos + len(t) + 1], '[0-9a-z]')),
g AS (SELECT t, count(*) AS n, count(DISTINCT doc_id) AS docs, sum(pos)::BIGINT AS starts FROM f WHERE r <= 50 GROUP BY 1)
SELECT t.t AS term, coalesce(n, 0) AS n, coalesce(n, 0) AS exact, coalesce(docs, 0) AS docs, coalesce(starts, 0) AS starts FROM t LEFT JOIN g USING (t)""",
    "cheap_first": """WITH a AS (SELECT DISTINCT p_name AS x FROM part), t AS (SELECT DISTINCT p_type AS x FROM part), k AS (SELECT (SELECT count(*) FROM a) AS cheap, (SELECT count(*) FROM a) + (SELECT count(*) FROM t) AS llm, (SELECT count(*) FROM a) AS merged)
SELECT 'cheap' AS source, true AS grounded, (SELECT count(*) FROM a) AS n, k.* FROM k UNION ALL SELECT 'llm', false, (SELECT count(*) FROM t), k.* FROM k""",
    "gate_overrides": """WITH l AS (SELECT p_name, min(p_partkey) % 3 AS m FROM part GROUP BY 1), g AS (SELECT p_partkey % 4 = 0 AS rel, p_partkey % 5 = 0 AS dig, m FROM part JOIN l USING (p_name)),
r AS (SELECT CASE WHEN rel THEN 'relation' ELSE 'concept' END AS kind, CASE WHEN rel AND dig THEN 'non_concept' WHEN rel THEN 'class' WHEN dig THEN 'individual' WHEN m = 0 THEN 'individual' WHEN m = 1 THEN 'non_concept' ELSE 'class' END AS bin,
CASE WHEN rel AND dig THEN 'numeric (not a relation)' WHEN rel THEN 'predicate' WHEN dig THEN 'contains a numeric value (a particular)' WHEN m = 0 THEN 'LLM: named individual' WHEN m = 1 THEN 'LLM: not a domain term' ELSE 'common-noun phrase' END AS reason FROM g) SELECT *, count(*) AS n FROM r GROUP BY ALL""",
    "rejected_elements": r"""WITH w AS (SELECT w, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS w FROM documents) WHERE w <> '' GROUP BY 1), t AS (SELECT *, regexp_extract_all(w, '[A-Za-z0-9]+') AS t FROM w)
SELECT CASE WHEN len(t) = 0 THEN 'empty or symbol-only surface' WHEN NOT regexp_matches(w, '\p{L}') THEN 'numeric or symbolic value, not a concept'
 WHEN len(t) = 1 AND lower(t[1]) IN ('page', 'step', 'figure', 'fig', 'table', 'example', 'exercise', 'chapter', 'section', 'note', 'answer', 'solution', 'problem', 'part', 'item', 'row', 'column', 'appendix', 'outline', 'objective', 'introduction', 'summary') THEN 'document boilerplate, not a domain concept'
 WHEN len(t) > 7 THEN 'sentence fragment (' || len(t) || ' tokens)' WHEN n <= 1 AND len(w) % 2 = 0 THEN 'one-off ungrounded LLM proposal (appears nowhere in text)' END AS reason, count(*) AS n FROM t GROUP BY 1""",
    "parked_terms": """WITH e AS (SELECT p_name AS id, count(*) AS m, bool_or(p_size > 49) AS hit, sum(p_size) AS s, p_name LIKE '%ring' AS rel FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY s DESC, id) AS r FROM e),
k AS (SELECT *, CASE WHEN rel THEN m >= 30 ELSE (hit OR m >= 33) AND r <= 40 END AS kept FROM r)
SELECT id, kept, CASE WHEN kept THEN NULL WHEN rel THEN 'mention_count < 30' ELSE array_to_string([x for x in [CASE WHEN NOT hit THEN 'not in scope' END, CASE WHEN m < 33 THEN 'mention_count < 33' END, CASE WHEN r > 40 THEN 'below top-40' END] if x IS NOT NULL], '; ') END AS reason FROM k""",
    "simple_saliences": """WITH t AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_size = 50 UNION SELECT string_split(p_name, ' ')[2] FROM part WHERE string_split(p_name, ' ')[2] LIKE '%o%'), c AS (SELECT p_name AS label, max(p_size) > 48 AS g FROM part GROUP BY 1), h AS (SELECT label, g, EXISTS (SELECT 1 FROM t WHERE contains(label, t) OR contains(t, label)) AS scope_hit FROM c)
SELECT label, scope_hit, round((CASE WHEN scope_hit THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN g THEN 0.3::DOUBLE ELSE 0 END) + 0.2::DOUBLE, 3) AS salience, true AS kept FROM h""",
    "semantic_pairs": f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE {_DOT.format('x.v', 'y.v')} >= 0.3::DOUBLE),
r AS (SELECT vec_id AS id, vec_id AS b FROM e UNION SELECT r.id, p.b FROM r JOIN p ON r.b = p.a) SELECT id, min(b) AS root FROM r GROUP BY 1""",
    "acronym_pairs": "SELECT DISTINCT 'concept' AS kind, lower(p_name[1] || split_part(p_name, ' ', 2)[1]) AS a, p_name AS b FROM part",
    "recalled_notes": "SELECT item_id::VARCHAR AS query_id, least(5, (SELECT sum(ceil(len(text) / 650.0)) FROM benchmark))::INT AS n, item_id::VARCHAR AS first FROM benchmark",
    "hybrid_neighbours": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT.format('a.v', 'b.v')}, 6) DESC, b.vec_id) AS r FROM e a, e b WHERE a.vec_id % 20 = 0)
SELECT DISTINCT vec_id::VARCHAR AS node FROM e JOIN r ON abs(vec_id - id) <= 1 AND r <= 3""",
    "cached_embeddings": "SELECT len(p_name)::FLOAT AS length, (len(p_name) - len(replace(p_name, 'e', '')))::FLOAT AS es, count(*) AS n, (SELECT count(DISTINCT p_name) FROM part) AS stored FROM part GROUP BY 1, 2",
    "sensor_triples": """WITH n AS (SELECT count(*) AS c, (count(*) + 24) // 25 AS r FROM customer) SELECT unnest(['rdf:type', 'locatedOn', 'hasStatus', 'observedBy', 'hasValue', 'hasConfidence', 'hasTime', 'hasName', 'partOf', 'hasLatitude', 'hasLongitude', 'hasIdentifier', 'hasSpeedLimit']) AS p,
unnest([2 * c + r + 6, c + 4, c + 1, c, c, c, c, r, r, 5, 5, 1, 1])::BIGINT AS n FROM n""",
    "stage_tables": "SELECT lang, count(*) AS n, 'one' AS stage, (SELECT count(*) FROM documents) AS rows FROM documents GROUP BY 1",
    "emitted_ontology": f"""WITH {_TAX}, s AS (SELECT count(*) AS c, count(*) FILTER (has) AS h, count(*) FILTER (m < 0) AS parked FROM c), n AS (SELECT count(*) AS n FROM nation)
SELECT unnest(['rdf:type', 'rdfs:label', 'skos:altLabel', 'rdfs:subClassOf', 'rdfs:domain', 'rdfs:range', 'owl:versionInfo']) AS p, unnest([c + 2 * n, c, c, h + parked, n, n, 1])::BIGINT AS n, unnest([NULL, NULL, NULL, NULL, NULL, NULL, '0.2']) AS version FROM s, n""",
    "clock_ages": "SELECT user_id AS node, round(CASE WHEN bool_or(event_type = 'click' AND event_id % 10 = 0) THEN 0 ELSE sum(value) + 2.0 END, 4)::DOUBLE AS age_min FROM events GROUP BY 1",
    "dispatched_triples": """WITH g AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_suppkey % 2 = 0), s AS (SELECT s_suppkey AS k FROM supplier)
SELECT 'assignedTo' AS p, NULL AS o, count(*) AS n FROM g UNION ALL SELECT 'hasAvailability', 'busy', count(*) FROM g UNION ALL SELECT 'hasAvailability', 'available', count(*) FROM s WHERE k NOT IN (SELECT k FROM g)""",
}
