"""Taxonomy structure and review: grounding, parents, families, duplicate labels, verdict tests, feedback."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import alnum_key
from graphloom.operators.graph import reached_pairs


def ground_labels(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """``labels`` (label) with the id of the first concept (seq, id, label, representative, alt_labels) that has the key; else null and ``llm_introduced``."""
    forms = concepts.select("seq", "id", F.explode(F.array_union(F.array("label", "representative"), "alt_labels")).alias("form")).withColumn("_k", alnum_key(F.col("form")))
    index = forms.filter("_k <> ''").groupBy("_k").agg(F.min_by("id", F.struct("seq", "id")).alias("concept_id"))
    return labels.withColumn("_k", alnum_key(F.col("label"))).join(index, "_k", "left").withColumn("llm_introduced", F.col("concept_id").isNull()).drop("_k")


def assemble(proposed: DataFrame, index: DataFrame) -> DataFrame:
    """Parent edges (child, parent, confidence, flagged) from (label, parent, coined) over an index (label, id)."""
    look = lambda c, out: index.select(F.col("label").alias(c), F.col("id").alias(out))
    joined = proposed.join(look("label", "_child"), "label", "left").join(look("parent", "_parent"), "parent", "left")
    child, parent = F.coalesce("_child", F.concat(F.lit("class:"), alnum_key(F.col("label")))), F.coalesce("_parent", F.concat(F.lit("coined:"), alnum_key(F.col("parent"))))
    edges = joined.filter("parent is not null").select(child.alias("child"), parent.alias("parent"), F.lit(0.7).alias("confidence"), (F.col("coined") | F.col("_child").isNull()).alias("flagged"))
    return edges.groupBy("child", "parent", "confidence").agg(F.bool_or("flagged").alias("flagged"))


def coined_families(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("parent").startswith("coined:")).groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children"))


def resolve_relations(relations: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, dropped) relations (id, domain, range, seq): both ends must be classes; the first row of an id stays."""
    end = lambda c: index.groupBy(alnum_key(F.col("label")).alias(f"_{c}")).agg(F.min("id").alias(f"{c}_id"))
    keyed = relations.withColumn("_domain", alnum_key(F.col("domain"))).withColumn("_range", alnum_key(F.col("range")))
    joined = keyed.join(end("domain"), "_domain", "left").join(end("range"), "_range", "left").drop("_domain", "_range")
    ok = joined.filter("domain_id is not null and range_id is not null").withColumn("_r", F.row_number().over(W.partitionBy("id").orderBy("seq"))).filter("_r = 1").drop("_r")
    return ok, joined.filter("domain_id is null or range_id is null")


def family_disjointness(families: DataFrame, cap: int = 6) -> DataFrame:
    """(a, b) for all pairs of children of families of 2 to ``cap``: bounded by the cap."""
    small = families.filter(F.size("children").between(2, cap)).select("parent", F.explode("children").alias("c"))
    return small.alias("x").join(small.alias("y"), "parent").filter("x.c < y.c").select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()


def relax_disjointness(axioms: DataFrame, edges: DataFrame) -> DataFrame:
    """``axioms`` (a, b) with ``relaxed``: one class is an ancestor of the other. Only what is above the classes asked for is searched."""
    swapped = lambda pairs: pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    asked = axioms.select("a", "b")
    up = reached_pairs(asked.unionByName(swapped(asked)), edges)
    both = up.unionByName(swapped(up)).distinct().withColumn("_hit", F.lit(True))
    return axioms.join(both, ["a", "b"], "left").withColumn("relaxed", F.coalesce("_hit", F.lit(False))).drop("_hit")


def parent_map(edges: DataFrame, families: DataFrame) -> DataFrame:
    """(child, parent): parent edges, and the membership of coined families (parent, children)."""
    return edges.select("child", "parent").unionByName(families.select(F.explode("children").alias("child"), "parent")).distinct()


def roots(classes: DataFrame, edges: DataFrame) -> DataFrame:
    return classes.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_anti").select("id")


def structure_statistics(classes: DataFrame, concepts: DataFrame, edges: DataFrame, families: DataFrame) -> DataFrame:
    """(stat, n): classes (id, label), those with a parent, roots, coined families, vocabulary labels (label) that no class took up, and the
    edges (child, parent, via) by each of their origins."""
    count = lambda df, name: df.agg(F.lit(name).alias("stat"), F.count(F.lit(1)).alias("n"))
    taken = classes.select(alnum_key(F.col("label")).alias("_k")).distinct()
    omitted = concepts.withColumn("_k", alnum_key(F.col("label"))).join(taken, "_k", "left_anti")
    parts = [count(classes, "classes"), count(roots(classes, edges), "roots"), count(classes.join(edges.select(F.col("child").alias("id")).distinct(), "id", "left_semi"), "with_parent")]
    parts += [count(families, "coined_parents"), count(omitted, "omitted_candidates")]
    via = edges.select(F.explode("via").alias("via")).groupBy(F.concat(F.lit("via:"), "via").alias("stat")).agg(F.count(F.lit(1)).alias("n"))
    return reduce(DataFrame.unionByName, [*parts, via])


def merge_duplicate_labels(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, remap): of classes (id, label, mention_count, alt_labels) with one label the most mentioned stays."""
    keyed = classes.withColumn("_k", alnum_key(F.col("label")))
    merged = keyed.groupBy("_k").agg(
        F.min_by("id", F.struct(-F.col("mention_count"), "id")).alias("id"), F.min_by("label", F.struct(-F.col("mention_count"), "id")).alias("label"),
        F.sum("mention_count").alias("mention_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("alt_labels")))).alias("alt_labels"),
    )
    remap = keyed.select(F.col("id").alias("old_id"), "_k").join(merged.select("_k", F.col("id").alias("new_id")), "_k").filter("old_id <> new_id").select("old_id", "new_id")
    return merged.drop("_k"), remap


def rewrite(df: DataFrame, column: str, remap: DataFrame) -> DataFrame:
    """``column`` through the remap table."""
    return df.join(remap, F.col(column) == F.col("old_id"), "left").withColumn(column, F.coalesce("new_id", column)).drop("old_id", "new_id")


def rewrite_axioms(axioms: DataFrame, remap: DataFrame) -> DataFrame:
    """``axioms`` (id, type, classes, relaxed) through the remap, every class once; a disjointness left with fewer than two is relaxed and degenerate."""
    cells = axioms.select("id", F.posexplode("classes").alias("_p", "_c")).join(remap, F.col("_c") == F.col("old_id"), "left")
    lists = cells.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("new_id", "_c").alias("c")))).alias("_l"))
    rows = axioms.drop("classes").join(lists, "id", "left").withColumn("classes", F.array_distinct(F.transform("_l", lambda x: x["c"]))).drop("_l")
    bare = (F.col("type") == "disjointWith") & (F.coalesce(F.size("classes"), F.lit(0)) < 2)
    return rows.withColumn("degenerate", bare).withColumn("relaxed", F.col("relaxed") | bare)


def concept_verdict(grounded, multi_parent, text_only, orphan):
    """struct(verdict, parked) of a concept."""
    out = lambda v, p=False: F.struct(F.lit(v).alias("verdict"), F.lit(p).alias("parked"))
    return F.when(~grounded, out("reject")).when(multi_parent, out("escalate")).when(text_only, out("escalate")).when(orphan, out("accept", True)).otherwise(out("accept"))


def coined_verdicts(families: DataFrame, grounded: DataFrame) -> DataFrame:
    """(parent, n, verdict): two grounded children accept, one demotes, none rejects."""
    rows = families.select("parent", F.explode_outer("children").alias("id")).join(grounded.select("id").distinct().withColumn("_g", F.lit(1)), "id", "left")
    counted = rows.groupBy("parent").agg(F.count("_g").alias("n"))
    return counted.withColumn("verdict", F.when(F.col("n") >= 2, "accept").when(F.col("n") == 1, "demote").otherwise("reject"))


def review_coined(families: DataFrame, grounded: DataFrame, edges: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verdicts, edges, orphans): coined parents tested, edges (child, parent) to those not accepted gone, and the classes (id) that have no parent then."""
    verdicts = coined_verdicts(families, grounded)
    left = edges.join(verdicts.filter("verdict <> 'accept'").select("parent"), "parent", "left_anti").select(*edges.columns)
    return verdicts, left, roots(classes, left)


def relationship_verdicts(relations: DataFrame, admitted: DataFrame) -> DataFrame:
    ids = admitted.select("id").distinct()
    joined = relations.join(ids.select(F.col("id").alias("domain_id"), F.lit(True).alias("_a")), "domain_id", "left").join(ids.select(F.col("id").alias("range_id"), F.lit(True).alias("_b")), "range_id", "left")
    return joined.withColumn("verdict", F.when(F.col("_a") & F.col("_b"), "accept").otherwise("escalate")).drop("_a", "_b")


def axiom_verdicts(axioms: DataFrame, admitted: DataFrame) -> DataFrame:
    ids = admitted.select("id").distinct()
    joined = axioms.join(ids.select(F.col("id").alias("a"), F.lit(True).alias("_a")), "a", "left").join(ids.select(F.col("id").alias("b"), F.lit(True).alias("_b")), "b", "left")
    return joined.withColumn("verdict", F.when(F.col("relaxed"), "reject").when(F.col("_a") & F.col("_b"), "accept").otherwise("escalate")).drop("_a", "_b")


def unconnected(classes: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """Classes with no relation, child or parent."""
    used = edges.select(F.col("child").alias("id")).unionByName(edges.select(F.col("parent").alias("id"))).unionByName(relations.select(F.col("domain_id").alias("id"))).unionByName(relations.select(F.col("range_id").alias("id")))
    return classes.join(used.distinct(), "id", "left_anti").select("id")


def feedback_set(decisions: DataFrame, unconnected_ids: DataFrame) -> DataFrame:
    """(id, kind, feedback) for the next pass, from decisions (id, kind, verdict, parked) and unconnected classes (id)."""
    said = F.when(F.col("verdict") == "reject", "rejected").when(F.col("verdict") == "escalate", "escalated").when(F.col("parked"), "parked")
    rows = decisions.select("id", "kind", said.alias("feedback")).filter("feedback is not null")
    return rows.unionByName(unconnected_ids.select("id", F.lit("concept").alias("kind"), F.lit("unconnected").alias("feedback"))).distinct()


def edit_log(remap: DataFrame, verdicts: DataFrame, names: DataFrame) -> DataFrame:
    """(type, targets, detail) of a review's edits: merged labels, demoted or rejected coined parents, and coined parents that got a name."""
    none = F.array().cast("array<string>")
    merges = remap.groupBy("new_id").agg(F.array_sort(F.collect_set("old_id")).alias("_o")).select(F.lit("merge").alias("type"), F.concat(F.array("new_id"), F.coalesce("_o", none)).alias("targets"), F.col("new_id").alias("detail"))
    gone = verdicts.filter("verdict <> 'accept'").select(F.col("verdict").alias("type"), F.array("parent").alias("targets"), F.concat(F.col("n").cast("string"), F.lit(" grounded children")).alias("detail"))
    named = names.join(verdicts.filter("verdict = 'accept'").select("parent"), "parent", "left_semi").select(F.lit("name_coined").alias("type"), F.array("parent").alias("targets"), F.col("name").alias("detail"))
    return merges.unionByName(gone).unionByName(named)


def review_statistics(decisions: DataFrame) -> DataFrame:
    """(kind, verdict, n), and over all kinds (kind null) how many were decided without a person: accepted, rejected, escalated."""
    by = decisions.groupBy("kind", "verdict").agg(F.count(F.lit(1)).alias("n"))
    auto = by.groupBy(F.concat(F.lit("auto_"), "verdict").alias("verdict")).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("kind"), F.when(F.col("verdict") == "auto_escalate", "escalated").otherwise(F.concat("verdict", F.lit("ed"))).alias("verdict"), "n")
    return by.unionByName(auto)


def family_names(families: DataFrame, labels: DataFrame) -> DataFrame:
    """(parent, name): the longest word that all children's labels share, else the parent's own name."""
    words = families.select("parent", F.size("children").alias("n"), F.explode("children").alias("id")).join(labels, "id")
    tokens = words.select("parent", "n", "id", F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit("[A-Z]?[a-z]+"), F.lit(0)))).alias("w"))
    shared = tokens.groupBy("parent", "n", "w").agg(F.count_distinct("id").alias("k")).filter("k = n")
    best = shared.groupBy("parent").agg(F.max_by("w", F.struct(F.length("w"), "w")).alias("name"))
    return families.select("parent").join(best, "parent", "left").withColumn("name", F.coalesce("name", F.regexp_replace("parent", "^coined:", "")))


def attach_stated(concepts: DataFrame, isa: DataFrame, clusters: DataFrame) -> DataFrame:
    """``concepts`` (concept) with their parent: a stated one from (child, parent), else their cluster's coined one from
    (concept, coined); what has neither is an orphan."""
    joined = concepts.join(isa.select(F.col("child").alias("concept"), F.col("parent").alias("_stated")), "concept", "left").join(clusters, "concept", "left")
    parent = F.coalesce("_stated", "coined")
    return joined.select("concept", parent.alias("parent"), (F.col("_stated").isNull() & F.col("coined").isNotNull()).alias("coined"), parent.isNull().alias("orphan"))


def review_in_scope(placed: DataFrame, scope: DataFrame, grounded: DataFrame) -> DataFrame:
    """Verdicts of placed concepts: ungrounded are rejected; orphans outside ``scope`` (concept) are parked for later; the rest is accepted."""
    inside = scope.select("concept").distinct().withColumn("_in", F.lit(True))
    ground = grounded.select("concept").distinct().withColumn("_g", F.lit(True))
    joined = placed.join(inside, "concept", "left").join(ground, "concept", "left")
    verdict = F.when(F.col("_g").isNull(), "reject").when(F.col("orphan") & F.col("_in").isNull(), "park").otherwise("accept")
    return joined.withColumn("verdict", verdict).drop("_in", "_g")
