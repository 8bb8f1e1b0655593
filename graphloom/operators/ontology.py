"""Ontology index from triples: classes, properties, closure, disjointness, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import closure
from graphloom.operators.verify import short_datatype

CHARACTERISTICS = ["Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive"]
_TYPES = [f"owl:{c}Property" for c in CHARACTERISTICS]


def local_name(iri):
    return F.regexp_extract(iri, r"([^#/:]+)$", 1)


def class_index(t: DataFrame) -> DataFrame:
    """iri, local_name, label, aliases, comment, superclasses and equivalents (either way) of each class."""
    classes = t.filter("p = 'rdf:type' and o = 'owl:Class'").select("s").distinct()
    pick = lambda p: F.when(F.col("p") == p, F.col("o"))
    turned = t.filter("p = 'owl:equivalentClass' and o_kind = 'iri'").select(F.col("o").alias("s"), "p", F.col("s").alias("o"))
    facts = t.select("s", "p", "o").unionByName(turned).groupBy("s").agg(
        F.min(pick("rdfs:label")).alias("label"), F.array_sort(F.collect_set(pick("skos:altLabel"))).alias("aliases"), F.min(pick("rdfs:comment")).alias("comment"),
        F.array_sort(F.collect_set(pick("rdfs:subClassOf"))).alias("superclasses"), F.array_sort(F.collect_set(pick("owl:equivalentClass"))).alias("equivalents"),
    )
    return classes.join(facts, "s").select(F.col("s").alias("iri"), local_name("s").alias("local_name"), F.coalesce("label", local_name("s")).alias("label"), "aliases", "comment", "superclasses", "equivalents")


def property_index(t: DataFrame) -> DataFrame:
    """iri, local_name, kind, label, aliases, comment, domain, range, flags, inverse with its labels and aliases, and the least maximum
    of each property; owl:Thing counts as no domain."""
    first = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    typed = lambda o: F.coalesce(F.bool_or((F.col("p") == "rdf:type") & (F.col("o") == o)), F.lit(False))
    several = lambda p: F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))
    facts = t.groupBy(F.col("s").alias("iri")).agg(
        typed("owl:ObjectProperty").alias("_object"), typed("owl:DatatypeProperty").alias("_data"), first("rdfs:domain").alias("domain"), first("rdfs:range").alias("range"),
        typed("owl:FunctionalProperty").alias("is_functional"), typed("owl:InverseFunctionalProperty").alias("is_inverse_functional"), first("rdfs:label").alias("label"),
        several("rdfs:label").alias("_labels"), several("skos:altLabel").alias("aliases"), first("rdfs:comment").alias("comment"),
    )
    kind = F.when(F.col("_object"), "object_property").otherwise("datatype_property")
    domain = F.when(F.col("domain") != "owl:Thing", F.col("domain"))
    own = facts.filter("_object or _data").select(
        "iri", local_name("iri").alias("local_name"), kind.alias("kind"), domain.alias("domain"), "range", "is_functional", "is_inverse_functional", F.coalesce("label", local_name("iri")).alias("label"), "aliases", "comment"
    )
    other = inverse_map(t).join(facts.select(F.col("iri").alias("inverse"), "_labels", F.col("aliases").alias("_aliases")), "inverse", "left")
    pooled = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    other = other.groupBy(F.col("property").alias("iri")).agg(F.min("inverse").alias("inverse_of"), pooled("_labels").alias("inverse_labels"), pooled("_aliases").alias("inverse_aliases"))
    most = max_cardinality(t).withColumnRenamed("property", "iri")
    none = F.array().cast("array<string>")
    return own.join(other, "iri", "left").join(most, "iri", "left").withColumns({c: F.coalesce(c, none) for c in ("inverse_labels", "inverse_aliases")})


def namespace_index(t: DataFrame, prefix: str) -> dict[str, DataFrame]:
    """Index over one namespace, by local names: classes, properties, closure with every class itself, disjoint pairs.

    Only one parent of a class is kept, the last by name; domains and ranges outside the namespace are null, datatypes are ``xsd:`` names."""
    inside = lambda c: F.col(c).startswith(prefix)
    classes = class_index(t).filter(inside("iri")).select("local_name", "iri", "label")
    parents = t.filter(F.col("p") == "rdfs:subClassOf").filter(inside("s") & inside("o")).groupBy(F.col("s").alias("src")).agg(F.max("o").alias("dst"))
    up = closure(parents).select(local_name("src").alias("sub"), local_name("dst").alias("super")).unionByName(classes.select(F.col("local_name").alias("sub"), F.col("local_name").alias("super"))).distinct()
    within = lambda c: F.when(inside(c), local_name(c))
    known = property_index(t).filter(inside("iri"))
    kept = known.select("local_name", "iri", "label", "kind", within("domain").alias("domain"), F.coalesce(within("range"), short_datatype(F.col("range"))).alias("range"), "is_functional", "is_inverse_functional")
    pairs = t.filter(F.col("p") == "owl:disjointWith").filter(inside("s") & inside("o")).select(local_name("s").alias("a"), local_name("o").alias("b")).distinct()
    return {"classes": classes, "properties": kept, "closure": up, "disjoint": pairs}


def direct_subclasses(t: DataFrame, parent: str) -> DataFrame:
    """Names of the classes right below one."""
    return t.filter((F.col("p") == "rdfs:subClassOf") & (F.col("o") == parent)).select(local_name("s").alias("name")).distinct().orderBy("name")


def inverse_map(t: DataFrame) -> DataFrame:
    pairs = t.filter("p = 'owl:inverseOf'").select(F.col("s").alias("property"), F.col("o").alias("inverse"))
    return pairs.unionByName(pairs.select(F.col("inverse").alias("property"), F.col("property").alias("inverse"))).distinct()


def max_cardinality(t: DataFrame) -> DataFrame:
    on = t.filter("p = 'owl:onProperty'").select("s", F.col("o").alias("property"))
    limit = t.filter("p in ('owl:maxCardinality', 'owl:exactCardinality', 'owl:cardinality')").select("s", F.col("o").try_cast("int").alias("n"))
    return on.join(limit, "s").groupBy("property").agg(F.min("n").alias("max_cardinality"))


def subclass_closure(t: DataFrame, reflexive: bool = False) -> DataFrame:
    """(sub, super); equivalent classes are subclasses of each other."""
    down = t.filter("p = 'rdfs:subClassOf' and o_kind = 'iri'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    same = t.filter("p = 'owl:equivalentClass'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    edges = down.unionByName(same).unionByName(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    out = closure(edges).select(F.col("src").alias("sub"), F.col("dst").alias("super"))
    if reflexive:
        selves = t.filter("p = 'rdf:type' and o = 'owl:Class'").select(F.col("s").alias("sub"), F.col("s").alias("super"))
        out = out.unionByName(selves).distinct()
    return out


def disjoint_pairs(t: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) from disjointWith, and from the members of AllDisjointClasses lists."""
    direct = t.filter("p = 'owl:disjointWith'").select("s", "o")
    heads = t.filter("p = 'owl:members'").select(F.col("s").alias("list"), F.col("o").alias("head"))
    rest = closure(t.filter("p = 'rdf:rest' and o <> 'rdf:nil'").select(F.col("s").alias("src"), F.col("o").alias("dst")))
    cells = heads.select("list", F.col("head").alias("cell")).unionByName(heads.join(rest, F.col("head") == F.col("src")).select("list", F.col("dst").alias("cell")))
    members = cells.join(t.filter("p = 'rdf:first'").select(F.col("s").alias("cell"), F.col("o").alias("m")), "cell").select("list", "m").distinct()
    pairs = members.alias("x").join(members.alias("y"), "list").filter("x.m < y.m").select(F.col("x.m").alias("s"), F.col("y.m").alias("o"))
    both = direct.unionByName(pairs)
    return both.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def namespace(t: DataFrame) -> DataFrame:
    """The ontology's iri if stated, else the most frequent prefix of its named subjects."""
    stated = t.filter("p = 'rdf:type' and o = 'owl:Ontology'").agg(F.min("s").alias("stated"))
    common = t.filter(~F.col("s").startswith("_:")).select(F.regexp_extract("s", r"^(.*[#/:])", 1).alias("ns")).filter("ns <> ''").groupBy("ns").count().orderBy(F.desc("count"), "ns").limit(1)
    return stated.join(common.select("ns"), how="left").select(F.coalesce("stated", "ns").alias("namespace"))


def summary(versions: DataFrame) -> DataFrame:
    """Per version: classes, object and datatype properties, axioms (disjointness and property characteristics)."""
    typed = lambda o: F.count_distinct(F.when((F.col("p") == "rdf:type") & (F.col("o") == o), F.col("s")))
    return versions.groupBy("version").agg(
        typed("owl:Class").alias("classes"), typed("owl:ObjectProperty").alias("object_properties"), typed("owl:DatatypeProperty").alias("datatype_properties"),
        F.count_if((F.col("p") == "owl:disjointWith") | ((F.col("p") == "rdf:type") & F.col("o").isin(_TYPES))).alias("axioms"),
    )


def members_of(t: DataFrame, kind: str) -> DataFrame:
    return t.filter((F.col("p") == "rdf:type") & (F.col("o") == kind)).select(local_name("s").alias("name")).distinct().orderBy("name")


def lost_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Classes of the old version that the new one lacks; empty if it is compatible."""
    named = lambda t: t.filter("p = 'rdf:type' and o = 'owl:Class'").select("s").distinct()
    return named(old).exceptAll(named(new))
