"""Vocabulary: grouping of candidates, elements, selection and salience."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import canonical_label, fold_key, slug
from graphloom.operators.blocks import parts
from graphloom.operators.graph import components, use_checkpoints
from graphloom.operators.retrieval import unit_rows

#: Single words that name parts of documents and no concept.
BOILERPLATE = [
    "page", "step", "figure", "fig", "table", "example", "exercise", "chapter", "section", "note", "answer", "solution", "problem", "part", "item", "row", "column", "appendix", "outline", "objective",
    "introduction", "summary",
]
#: Tokens too common to count as shared evidence.
STOP_TOKENS = ["of", "the", "a", "an", "and", "or", "to", "in", "for", "by", "with", "is", "are", "be", "on", "as", "at", "number", "numbers"]
#: Parts that the rows of a kind are cut into before they are ranked.
PARTS = 64


def acronym_links(candidates: DataFrame) -> DataFrame:
    """(kind, a, b): an acronym of 2 to 6 capitals and a key of several words with those initials."""
    words = F.filter(F.split("key", " "), lambda w: w != "")
    long = candidates.filter(F.size(words) > 1).select("kind", F.col("key").alias("b"), F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).alias("letters"))
    short = candidates.filter(F.col("canonical").rlike("^[A-Z]{2,6}$")).select("kind", F.col("key").alias("a"), F.col("canonical").alias("letters"))
    return short.join(long, ["kind", "letters"]).select("kind", "a", "b").distinct()


def semantic_links(items: DataFrame, distance: float = 0.07, block_rows: int = 2000) -> DataFrame:
    """(a, b) of items (id, tokens, vec): links whose components are those of all near pairs that share a content token.

    A token's items are dealt to blocks of about ``block_rows`` rows; each pair of blocks is one task's matrix product, of which a spanning
    forest leaves: fewer links than rows, however many pairs are near. So a common token is many bounded tasks. Stop
    tokens, tokens without a letter and acronyms (2 to 6 capitals) link nothing by themselves, nor does a zero vector."""
    one = items.select("id", "vec", F.explode(F.array_distinct("tokens")).alias("token")).filter(~F.col("token").rlike("^[A-Z]{2,6}$") & F.col("token").rlike(r"\p{L}") & ~F.col("token").isin(STOP_TOKENS))
    sizes = one.groupBy(F.struct("token").alias("_t")).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_n"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    dealt = one.join(sizes, F.col("token") == F.col("_t.token")).withColumn("_s", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    dealt = dealt.select("token", "id", "vec", "_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_o"))
    tiles = dealt.select("token", F.least("_s", "_o").alias("s"), F.greatest("_s", "_o").alias("t"), "id", "vec")
    kind = items.schema["id"].dataType.simpleString()

    def run(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks().sort_by("id")
        vec = unit_rows(tile["vec"])
        ids = tile["id"].combine_chunks()
        parent = spanning_forest(vec, 1 - distance - 1e-12)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        low, high = np.minimum(child, parent[child]), np.maximum(child, parent[child])
        return pa.table({"a": ids.take(pa.array(low)), "b": ids.take(pa.array(high))})

    return tiles.groupBy("token", "s", "t").applyInArrow(run, f"a {kind}, b {kind}").distinct()


def spanning_forest(vec: np.ndarray, least: float) -> np.ndarray:
    """Parent of each unit vector in a forest of the pairs with a product of ``least`` or more; a root is its own parent."""
    parent, fresh = np.arange(len(vec)), np.ones(len(vec), bool)
    for root in range(len(vec)):
        if not fresh[root]:
            continue
        fresh[root], front = False, np.array([root])
        while len(front):
            rest = np.flatnonzero(fresh)
            near = vec[rest] @ vec[front].T >= least
            met = near.any(axis=1)
            parent[rest[met]] = front[near[met].argmax(axis=1)]
            fresh[rest[met]] = False
            front = rest[met]
    return parent


def group_candidates(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """``candidates`` with ``group``: the least key of their component of (a, b) edges, or their own key."""
    roots = components(edges)
    return candidates.join(roots, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("root", "key")).drop("node", "root")


def build_elements(grouped: DataFrame, most_places: int = 50) -> DataFrame:
    """One element per kind and group: representative, label, pooled forms, members, sources, entity labels and places, summed mentions.

    ``ner_labels`` and ``occurrences`` (start, end, text) are pooled where the candidates have them; of the places the first ``most_places`` stay."""
    for name, kind in (("ner_labels", "array<string>"), ("occurrences", "array<struct<start:int,end:int,text:string>>")):
        if name not in grouped.columns:
            grouped = grouped.withColumn(name, F.array().cast(kind))
    acronym = F.col("canonical").rlike("^[A-Z]{2,6}$")
    best = F.max_by("canonical", F.struct(F.col("literal_span").alias("a"), (~acronym).alias("b"), F.col("mention_count").alias("c"), F.length("canonical").alias("d"), F.col("canonical").alias("e")))
    pooled = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    forms = F.array_union("variants", F.array("canonical"))
    out = grouped.groupBy("kind", "group").agg(
        best.alias("representative"), pooled(forms).alias("alt_labels"), F.array_sort(F.collect_set("key")).alias("members"), pooled("sources").alias("sources"), pooled("ner_labels").alias("ner_labels"),
        F.slice(pooled(F.slice(F.array_sort("occurrences"), 1, most_places)), 1, most_places).alias("occurrences"), F.sum("mention_count").alias("mention_count"),
        F.bool_or("literal_span").alias("literal_span"), F.bool_and("llm_only").alias("llm_only"),
    )
    label = canonical_label(F.col("representative"), F.col("kind"))
    return out.select(F.concat(F.col("kind"), F.lit(":"), slug(label, "-")).alias("id"), label.alias("label"), "*")


def rejection_reason(text: Column, kind: Column, mention_count: Column, llm_only: Column, literal_span: Column, sources: Column) -> Column:
    """Why an element is near certainly none, or null to keep it. The reasons are fixed values."""
    surface = F.trim(text)
    words = F.regexp_extract_all(surface, F.lit("[A-Za-z0-9]+"), F.lit(0))
    concept = kind == "concept"
    return (
        F.when(F.coalesce(F.size(words), F.lit(0)) < 1, "empty or symbol-only surface")
        .when(~surface.rlike(r"\p{L}"), "numeric or symbolic value, not a concept")
        .when(concept & (F.size(words) == 1) & F.lower(F.get(words, F.lit(0))).isin(BOILERPLATE), "document boilerplate, not a domain concept")
        .when(concept & (F.size(words) > 7), F.concat(F.lit("sentence fragment ("), F.size(words).cast("string"), F.lit(" tokens)")))
        .when((mention_count <= 1) & ~literal_span & (F.size(sources) <= 1) & llm_only, "one-off ungrounded LLM proposal (appears nowhere in text)")
    )


def strongest(candidates: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` most mentioned of each kind; parts of a kind are cut first, so no task ranks a whole kind."""
    order, left = (F.desc("mention_count"), "key"), candidates.withColumn("_part", F.pmod(F.hash("key"), F.lit(PARTS)))
    for by in (["kind", "_part"], ["kind"]):
        left = left.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= cap).drop("_r")
    return left.drop("_part")


def synonym_groups(mentions: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Concepts from (text, grounded) by a synonym table (surface, canonical); what it lacks is its own concept."""
    joined = mentions.withColumn("surface", F.lower("text")).join(synonyms, "surface", "left")
    name = F.coalesce("canonical", canonical_label(F.col("text"), F.lit("concept")))
    return joined.groupBy(name.alias("concept")).agg(F.bool_or("grounded").alias("grounded"), F.array_sort(F.collect_set("text")).alias("surfaces"))


def spread(occurrences: DataFrame, doc_len: int, buckets: int = 20) -> DataFrame:
    """(id, spread): share of the document's segments, of those that so many places could touch, that an element's places touch."""
    place = F.least(F.lit(buckets - 1), F.floor(F.col("start") / max(1, doc_len // buckets)))
    share = F.count_distinct(place) / F.least(F.lit(buckets), F.count(F.lit(1)))
    return occurrences.groupBy("id").agg((share if doc_len > 0 else F.lit(0.0)).alias("spread"))


def scope_hits(elements: DataFrame, scope: DataFrame) -> DataFrame:
    """(id) of elements (id, surface; label, representative and alt_labels where there are such columns) of which any surface equals a
    scope term (term), both in lower case with single blanks, as they are or without a plural ending."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    forms = lambda c: F.explode(F.array_distinct(F.array(norm(c), F.regexp_replace(norm(c), "(es|s)$", ""))))
    given = [F.col(c) for c in ("surface", "label", "representative") if c in elements.columns]
    surfaces = F.array_compact(F.concat(F.array(*given), F.coalesce("alt_labels", F.array().cast("array<string>"))) if "alt_labels" in elements.columns else F.array(*given))
    terms = scope.filter(norm(F.col("term")) != "").select(forms(F.col("term")).alias("_term")).distinct()
    asked = elements.select("id", F.explode(surfaces).alias("_s")).filter(norm(F.col("_s")) != "").select("id", forms(F.col("_s")).alias("_term"))
    return asked.join(terms, "_term").select("id").distinct()


def salience(elements: DataFrame, scope: DataFrame) -> DataFrame:
    """``elements`` (id, surface, mention_count, spread, grounded, and what :func:`scope_hits` reads) with the weighted salience and its parts; ``scope`` (term)."""
    top = elements.agg(F.max(F.log1p(F.col("mention_count").cast("double"))).alias("_top"))
    joined = elements.join(scope_hits(elements, scope).withColumn("_hit", F.lit(1.0)), "id", "left").join(F.broadcast(top))
    scope_match, freq = F.coalesce("_hit", F.lit(0.0)), F.coalesce(F.log1p(F.col("mention_count").cast("double")) / F.nullif("_top", F.lit(0.0)), F.lit(0.0))
    ground = F.when(F.col("grounded"), 1.0).otherwise(0.0)
    total = 0.35 * scope_match + 0.30 * freq + 0.20 * F.col("spread") + 0.15 * ground
    return joined.select("id", "surface", "mention_count", scope_match.alias("scope_match"), F.round(freq, 6).alias("freq"), "spread", F.round(total, 6).alias("salience"))


def keep_or_park(scored: DataFrame, top_n: int = 0, least: int = 3, least_relation: int = 2) -> DataFrame:
    """``kept`` and the reason of the park: a concept in scope or mentioned ``least`` times, and among the ``top_n`` most salient
    concepts where that is not 0; a relation mentioned ``least_relation`` times."""
    concept, scope_hit = F.col("kind") != "relation", F.coalesce(F.col("scope_match") == 1, F.lit(False))
    rows = scored.withColumn("_top", F.lit(True))
    if top_n:
        top = scored.filter(concept).orderBy(F.desc("salience"), "id").limit(top_n).select("id", F.lit(True).alias("_top"))
        rows = scored.join(top, "id", "left").withColumn("_top", F.coalesce("_top", F.lit(False)))
    frequent = F.col("mention_count") >= F.when(concept, least).otherwise(least_relation)
    kept = F.when(concept, (scope_hit | frequent) & F.col("_top")).otherwise(frequent)
    of_concept = F.concat_ws("; ", F.when(~scope_hit, "not in scope"), F.when(~frequent, f"mention_count < {least}"), F.when(~F.col("_top"), f"below top-{top_n}"))
    reason = F.when(~concept, f"mention_count < {least_relation}").when(of_concept == "", "low salience").otherwise(of_concept)
    return rows.withColumn("kept", kept).withColumn("reason", F.when(~F.col("kept"), reason)).drop("_top")


def simple_salience(concepts: DataFrame, topics: DataFrame, floor: float = 0.15, block_topics: int = 100_000) -> DataFrame:
    """``concepts`` (label, grounded) with salience (half for a topic within the label or around it, 0.3 for grounding, 0.2 for
    being named) and ``kept``. The topics (topic) of a scope go to the concepts in lists of about ``block_topics``, whatever their number."""
    use_checkpoints(concepts.sparkSession)
    names = topics.select(fold_key(F.col("topic")).alias("t")).distinct()
    lists = parts(names.count(), block_topics)
    listed = names.groupBy(F.pmod(F.xxhash64("t"), F.lit(lists)).alias("_b")).agg(F.collect_list("t").alias("_topics")).checkpoint()
    label, rows = fold_key(F.col("label")), concepts.withColumn("scope_hit", F.lit(False))
    for b in range(lists):
        one = listed.filter(F.col("_b") == b).agg(F.flatten(F.collect_list("_topics")).alias("_topics"))
        rows = rows.join(F.broadcast(one)).withColumn("scope_hit", F.col("scope_hit") | F.exists("_topics", lambda t: label.contains(t) | t.contains(label))).drop("_topics")
    total = F.round(F.when(F.col("scope_hit"), 0.5).otherwise(0.0) + F.when(F.col("grounded"), 0.3).otherwise(0.0) + 0.2, 3)
    return rows.withColumn("salience", total).withColumn("kept", F.col("salience") >= floor)


def vocabulary_statistics(candidates: DataFrame, elements: DataFrame) -> DataFrame:
    a = candidates.groupBy("kind").agg(F.count(F.lit(1)).alias("n_in"))
    b = elements.groupBy("kind").agg(F.count(F.lit(1)).alias("n_out"), F.count_if("literal_span").alias("n_literal"), F.count_if("llm_only").alias("n_llm_only"))
    return a.join(b, "kind").withColumn("merge_ratio", F.bround(F.col("n_in") / F.col("n_out"), 2))
