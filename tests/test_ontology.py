"""The ontology index on a small graph with inverses, restrictions, lists and equivalents."""

from pyspark.sql import functions as F

from graphloom.operators import ontology, taxonomy
from graphloom.sources import io
from tests.test_operators import rows

IRI = [
    ("ex#A", "rdf:type", "owl:Class"), ("ex#B", "rdf:type", "owl:Class"), ("ex#C", "rdf:type", "owl:Class"), ("ex#D", "rdf:type", "owl:Class"), ("ex#B", "rdfs:subClassOf", "ex#A"), ("ex#C", "owl:equivalentClass", "ex#B"),
    ("ex#p", "rdf:type", "owl:ObjectProperty"), ("ex#p", "rdf:type", "owl:FunctionalProperty"), ("ex#p", "rdfs:domain", "owl:Thing"), ("ex#p", "rdfs:range", "ex#A"), ("ex#p", "owl:inverseOf", "ex#q"), ("ex#d", "rdf:type", "owl:DatatypeProperty"),
    ("_:r", "owl:onProperty", "ex#p"), ("ex#A", "owl:disjointWith", "ex#D"), ("_:x", "owl:members", "_:l1"), ("_:l1", "rdf:first", "ex#B"), ("_:l1", "rdf:rest", "_:l2"), ("_:l2", "rdf:first", "ex#D"), ("_:l2", "rdf:rest", "rdf:nil"),
]
TEXT = [("ex#A", "rdfs:label", "Alpha"), ("ex#A", "skos:altLabel", "First"), ("_:r", "owl:maxCardinality", "2"), ("_:s", "owl:maxCardinality", "9"), ("ex#A", "rdfs:comment", "note")]


def graph(spark):
    data = [("g", s, p, o, "iri", None, None) for s, p, o in IRI] + [("g", s, p, o, "literal", None, None) for s, p, o in TEXT]
    return spark.createDataFrame(data, "g string, s string, p string, o string, o_kind string, datatype string, lang string")


def test_index(spark):
    t = graph(spark)
    a = ontology.class_index(t).filter("iri = 'ex#A'").first()
    assert (a["local_name"], a["label"], a["aliases"], a["comment"]) == ("A", "Alpha", ["First"], "note")
    p = ontology.property_index(t).filter("iri = 'ex#p'").first()
    assert (p["kind"], p["domain"], p["range"], p["is_functional"], p["is_inverse_functional"], p["label"]) == ("object_property", None, "ex#A", True, False, "p")
    assert rows(ontology.inverse_map(t), "property", "inverse") == [("ex#p", "ex#q"), ("ex#q", "ex#p")]
    assert rows(ontology.max_cardinality(t), "property", "max_cardinality") == [("ex#p", 2)]
    assert rows(ontology.subclass_closure(t), "sub", "super") == [("ex#B", "ex#A"), ("ex#B", "ex#C"), ("ex#C", "ex#A"), ("ex#C", "ex#B")]
    assert rows(ontology.disjoint_pairs(t), "a", "b") == [("ex#A", "ex#D"), ("ex#B", "ex#D")]
    assert ontology.namespace(t).first()["namespace"] == "ex#"
    assert [r["name"] for r in ontology.members_of(t, "owl:Class").collect()] == ["A", "B", "C", "D"]
    assert tuple(ontology.summary(t.withColumn("version", F.lit("v1"))).first()) == ("v1", 4, 1, 1, 2)
    assert rows(ontology.lost_classes(t, t.filter("s <> 'ex#D'")), "s") == [("ex#D",)] and ontology.lost_classes(t, t).count() == 0


def test_versions_and_emission(spark, tmp_path):
    base = graph(spark).select("g", "s", "p", "o", "o_kind").unionByName(spark.createDataFrame([("g", "ex", "owl:versionInfo", "0.1", "literal")], "g string, s string, p string, o string, o_kind string"))
    c = spark.createDataFrame([("K", "Kind", ["k1"], True)], "id string, label string, alt_labels array<string>, parked boolean")
    none = lambda s: spark.createDataFrame([], s)
    delta = io.emit_classes(c, none("child string, parent string"), none("id string, domain_id string, range_id string"), none("a string, b string"))
    assert ("K", "rdfs:subClassOf", "DomainEntity") in rows(delta, "s", "p", "o")
    new = io.cumulative(base, delta, "0.2")
    assert rows(new.filter("p = 'owl:versionInfo'"), "o") == [("0.2",)] and ontology.lost_classes(base, new).count() == 0
    new.withColumn("version", F.lit("0.2")).write.partitionBy("version").parquet(f"{tmp_path}/t")
    assert io.read_version(spark, f"{tmp_path}/t", "0.2").count() == new.count()
    try:
        io.read_version(spark, f"{tmp_path}/t", "9")
        raise AssertionError
    except ValueError:
        pass


def test_review_variants(spark):
    c = spark.createDataFrame([("a",), ("b",), ("o",), ("u",)], "concept string")
    placed = taxonomy.attach_stated(c, spark.createDataFrame([("a", "Top")], "child string, parent string"), spark.createDataFrame([("b", "Coined")], "concept string, coined string"))
    assert rows(placed, "concept", "parent", "coined", "orphan") == [("a", "Top", False, False), ("b", "Coined", True, False), ("o", None, False, True), ("u", None, False, True)]
    done = taxonomy.review_in_scope(placed, c.filter("concept = 'a'"), c.filter("concept <> 'u'"))
    assert rows(done, "concept", "verdict") == [("a", "accept"), ("b", "accept"), ("o", "park"), ("u", "reject")]
    merged, remap = taxonomy.merge_duplicate_labels(spark.createDataFrame([("i1", "Fire Unit", 2, ["x"]), ("i2", "FireUnit", 5, ["y"])], "id string, label string, mention_count long, alt_labels array<string>"))
    assert rows(merged, "id", "mention_count", "alt_labels") == [("i2", 7, ["x", "y"])] and rows(remap, "old_id", "new_id") == [("i1", "i2")]
    assert rows(taxonomy.rewrite(spark.createDataFrame([("i1",), ("z",)], "domain_id string"), "domain_id", remap), "domain_id") == [("i2",), ("z",)]
