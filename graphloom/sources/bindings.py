"""Views over the driver tables: a knowledge graph, a small ontology, spans, papers and terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind + "_"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _rows(df: DataFrame, s: Column, p: str, o: Column, kind: str = "iri") -> DataFrame:
    return df.select(F.lit("data").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))


def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, customers, parts, suppliers, nations and regions as triples."""
    t = lambda n: table(spark, sf_dir, n)
    o, li, c, s, n, r, p = t("orders"), t("lineitem"), t("customer"), t("supplier"), t("nation"), t("region"), t("part")
    order, keys = node("Order", "o_orderkey"), lambda key: li.select("l_orderkey", key).distinct()  # numbers are dealt, not the names made of them
    parts = [
        _rows(o, order, "placedBy", node("Customer", "o_custkey")), _rows(o, order, "hasStatus", F.col("o_orderstatus"), "literal"), _rows(o, order, "rdf:type", F.lit("Order")),
        _rows(keys("l_partkey"), node("Order", "l_orderkey"), "contains", node("Part", "l_partkey")), _rows(keys("l_suppkey"), node("Order", "l_orderkey"), "suppliedBy", node("Supplier", "l_suppkey")),
        _rows(c, node("Customer", "c_custkey"), "locatedIn", node("Nation", "c_nationkey")), _rows(c, node("Customer", "c_custkey"), "rdf:type", F.lit("Customer")),
        _rows(s, node("Supplier", "s_suppkey"), "locatedIn", node("Nation", "s_nationkey")), _rows(s, node("Supplier", "s_suppkey"), "rdf:type", F.lit("Supplier")),
        _rows(n, node("Nation", "n_nationkey"), "partOf", node("Region", "n_regionkey")), _rows(n, node("Nation", "n_nationkey"), "rdf:type", F.lit("Nation")),
        _rows(r, node("Region", "r_regionkey"), "rdf:type", F.lit("Region")), _rows(p, node("Part", "p_partkey"), "rdf:type", F.lit("Part")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


#: The small ontology over the driver tables.
SUBCLASS = [("Customer", "Party"), ("Supplier", "Party"), ("Nation", "Place"), ("Region", "Place"), ("Order", "Document"), ("Part", "Item")]
PROPERTIES = [("placedBy", "object_property", "Order", "Party", 1), ("contains", "object_property", "Order", "Item", None), ("suppliedBy", "object_property", "Order", "Supplier", None), ("locatedIn", "object_property", "Party", "Place", 1), ("hasPrice", "datatype_property", "Order", "xsd:decimal", 1), ("hasStatus", "datatype_property", "Order", "xsd:string", 1)]
DISJOINT = [("Party", "Place")]


def ontology_triples(spark: SparkSession) -> DataFrame:
    classes = sorted({c for pair in SUBCLASS for c in pair})
    rows = [(c, "rdf:type", "owl:Class", "iri") for c in classes] + [(a, "rdfs:subClassOf", b, "iri") for a, b in SUBCLASS]
    for iri, kind, domain, ran, most in PROPERTIES:
        rows += [(iri, "rdf:type", "owl:ObjectProperty" if kind == "object_property" else "owl:DatatypeProperty", "iri"), (iri, "rdfs:domain", domain, "iri"), (iri, "rdfs:range", ran, "iri")]
        rows += [(iri, "rdf:type", "owl:FunctionalProperty", "iri")] * (most == 1)
    rows += [(a, "owl:disjointWith", b, "iri") for a, b in DISJOINT]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string").withColumn("g", F.lit("schema"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: a user's events are a run in order of time."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("props").alias("output"), F.floor("value").cast("bigint").alias("tokens"), F.col("ts"),
    )
