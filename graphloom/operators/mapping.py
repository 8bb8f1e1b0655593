"""Mapping of triples onto an ontology: typing, predicate match, inversion, confidence, minting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import fold_key, literal_type, slug
from graphloom.operators.blocks import BLOCK_ROWS
from graphloom.operators.retrieval import nearest


def top_match(queries: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, id, score): best label (id, idx, vec) of each query (query_id, vec); the first label wins ties. Neither side passes the driver."""
    found = nearest(queries, labels.withColumnRenamed("idx", "seq"), 1, block_rows, digits=9)
    best = found.groupBy("query_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return best.select("query_id", "b.id", "b.score")


def type_entities(surfaces: DataFrame, matches: DataFrame, model: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(key, class, confidence) once for each lower-cased surface, by its first sentence; below ``least`` a model's answer counts as low."""
    first = surfaces.groupBy(F.lower("surface").alias("key")).agg(F.min_by("query_id", "seq").alias("query_id"))
    joined = first.join(matches, "query_id", "left")
    near = F.coalesce(F.col("score") >= least, F.lit(False))
    if model is None:
        return joined.filter(near).select("key", F.col("id").alias("class"), F.lit("high").alias("confidence"))
    joined = joined.join(model.select("key", F.col("class").alias("_m")), "key", "left")
    return joined.select("key", F.when(near, F.col("id")).otherwise(F.col("_m")).alias("class"), F.when(near, "high").otherwise("low").alias("confidence")).filter("class is not null")


def predicate_table(properties: DataFrame) -> DataFrame:
    """(norm, iri, inverted) from properties (seq, iri, label, aliases, inverse_labels): direct labels before inverse ones, then the first property."""
    direct = properties.select("seq", "iri", F.explode(F.array_union(F.array("label"), "aliases")).alias("l"), F.lit(False).alias("inverted"))
    inverse = properties.select("seq", "iri", F.explode("inverse_labels").alias("l"), F.lit(True).alias("inverted"))
    rows = direct.unionByName(inverse).withColumn("norm", fold_key(F.col("l")))
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("norm").orderBy("inverted", "seq"))).filter("_r = 1").select("norm", "iri", "inverted")


def map_predicates(predicates: DataFrame, table: DataFrame, near: DataFrame | None = None, model: DataFrame | None = None, properties: DataFrame | None = None, least: float = 0.45) -> DataFrame:
    """(predicate, iri, inverted, confidence): string match, else the nearest label of ``near`` (predicate, id, inverted, score), both
    high; else a model's answer (predicate, answer, direction), low, if it is an iri or local name of ``properties`` (iri, local_name)."""
    keyed = predicates.select("predicate").distinct().withColumn("norm", fold_key(F.col("predicate"))).join(table, "norm", "left").withColumn("confidence", F.lit("high"))
    if near is not None:
        turned = F.col("inverted") if "inverted" in near.columns else F.lit(False)
        keyed = keyed.join(near.filter(F.col("score") >= least).select("predicate", F.col("id").alias("_n"), turned.alias("_i")), "predicate", "left")
        keyed = keyed.withColumn("inverted", F.when(F.col("iri").isNull(), F.col("_i")).otherwise(F.col("inverted"))).withColumn("iri", F.coalesce("iri", "_n")).drop("_n", "_i")
    if model is not None:
        names = properties.select(F.col("iri").alias("_a"), "iri").unionByName(properties.select(F.col("local_name").alias("_a"), "iri")).groupBy("_a").agg(F.min("iri").alias("_m"))
        said = model.withColumn("_a", F.regexp_replace("answer", "^:+", "")).join(names, "_a").select("predicate", "_m", (F.col("direction") == "inverse").alias("_i"))
        keyed = keyed.join(said, "predicate", "left").withColumn("confidence", F.when(F.col("iri").isNull(), "low").otherwise(F.col("confidence")))
        keyed = keyed.withColumn("inverted", F.when(F.col("iri").isNull(), F.col("_i")).otherwise(F.col("inverted"))).withColumn("iri", F.coalesce("iri", "_m"))
    return keyed.filter("iri is not null").select("predicate", "iri", F.coalesce("inverted", F.lit(False)).alias("inverted"), "confidence")


def least_confidence(*parts: Column) -> Column:
    return F.when(F.array_contains(F.array(*parts), "low"), "low").otherwise("high")


def map_triples(triples: DataFrame, entities: DataFrame, predicates: DataFrame, kinds: DataFrame) -> DataFrame:
    """``triples`` with typed ends, inverted where the predicate's inverse matched, or with the reason of the drop.

    entities (key, class, confidence); predicates (predicate, iri, inverted, confidence); kinds (iri, kind)."""
    e = lambda side: entities.select(F.col("key").alias(f"_{side}"), F.col("class").alias(f"{side}_type"), F.col("confidence").alias(f"_{side}_conf"))
    p = predicates.select("predicate", "iri", "inverted", F.col("confidence").alias("_p_conf")).join(kinds, "iri", "left")
    rows = triples.withColumn("_subject", F.lower("subject")).withColumn("_object", F.lower("object")).join(e("subject"), "_subject", "left").join(p, "predicate", "left").join(e("object"), "_object", "left")
    data = F.col("kind") == "datatype_property"
    literal = F.when(data, literal_type(F.col("object")))
    reason = F.when(F.col("subject_type").isNull(), "subject_untyped").when(F.col("iri").isNull(), "predicate_unmapped").when(F.when(data, literal.isNull()).otherwise(F.col("object_type").isNull()), "object_unmapped")
    swap = F.coalesce(F.col("inverted") & ~data, F.lit(False))
    flip = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return rows.select(
        "seq", reason.alias("drop_reason"), flip("subject", "object").alias("subject"), flip("subject_type", "object_type").alias("subject_type"), F.col("iri").alias("predicate_iri"), F.col("kind").alias("predicate_kind"),
        F.when(~data, flip("object", "subject")).alias("object"), F.when(~data, flip("object_type", "subject_type")).alias("object_type"), literal["value"].alias("object_literal"), literal["datatype"].alias("object_datatype"),
        least_confidence("_subject_conf", "_p_conf", F.when(~data, F.col("_object_conf"))).alias("mapping_confidence"),
    )


def mint_iris(individuals: DataFrame) -> DataFrame:
    """(class, key, iri) of (class, surface, seq): one iri a surface; other surfaces at a slug get _2, _3 in order of arrival.

    A number that another surface's own slug already ends in is passed over."""
    first = individuals.groupBy("class", F.lower(F.trim("surface")).alias("key")).agg(F.min("seq").alias("seq")).withColumn("slug", slug(F.col("key")))
    ranked = first.withColumn("_r", F.row_number().over(W.partitionBy("class", "slug").orderBy("seq")))
    own = ranked.filter("_r = 1").select("class", F.col("slug").alias("_taken"))
    later = ranked.filter("_r > 1").withColumn("_try", F.concat_ws("_", "slug", F.col("_r").cast("string")))
    hit = later.join(own, (later["class"] == own["class"]) & (F.col("_try") == F.col("_taken")), "left_semi").groupBy("class", "slug").agg(F.collect_set("_r").alias("_hits"))
    shifted = later.join(hit, ["class", "slug"], "left").withColumn("_r", F.col("_r") + F.coalesce(F.size(F.filter("_hits", lambda h: h <= F.col("_r"))), F.lit(0)))
    named = ranked.filter("_r = 1").select("class", "key", "slug", "_r").unionByName(shifted.select("class", "key", "slug", "_r"))
    return named.select("class", "key", F.concat(F.col("class"), F.lit("_"), "slug", F.when(F.col("_r") > 1, F.concat(F.lit("_"), F.col("_r").cast("string"))).otherwise("")).alias("iri"))
