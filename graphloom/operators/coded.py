"""A graph of triples kept as tables of numbers: terms, edges by direction and relation, types. Many calls are answered from one store.

Terms are numbered in their own order, so that ties by number are ties by name and only the nodes of a result need their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.operators.context import entity_edges, node_types, relevance
from graphloom.operators.graph import small, use_checkpoints

#: Nodes of a frontier up to which, counted, their numbers are a filter of the scan; edges are sorted by their source, so it skips row groups.
FILTER_IDS = 1_000
SCHEMAS = {"terms": "term string, id long", "edges": "src long, dst long, way string, rel string", "types": "id long, type string"}


@dataclass(frozen=True)
class CodedGraph:
    """``terms`` (term, id), ``edges`` (src, dst, way, rel) each in the ways ``out`` and ``in``, ``types`` (id, type)."""

    terms: DataFrame
    edges: DataFrame
    types: DataFrame


def store_graph(triples: DataFrame, path: str) -> CodedGraph:
    """Write the entity edges and types of ``triples`` (s, p, o, o_kind) under ``path`` and read them back.

    Rows are dealt by ranges of all their columns, so a hot relation or node is spread over tasks and files. A triple with a null in it or
    an empty relation is left out; repeated triples are one; a node with several types has the first by name."""
    spark = triples.sparkSession
    edges = entity_edges(triples, unique=False).dropna().filter("rel <> ''")
    types = node_types(triples).dropna()
    names = edges.select(F.explode(F.array("src", "dst")).alias("term")).unionByName(types.select(F.col("node").alias("term"))).distinct()
    names.repartitionByRange("term").sortWithinPartitions("term").select("term", F.monotonically_increasing_id().alias("id")).write.parquet(f"{path}/terms")
    terms = spark.read.schema(SCHEMAS["terms"]).parquet(f"{path}/terms")
    side = lambda end: terms.select(F.col("term").alias(end), F.col("id").alias("_" + end))
    coded = edges.join(side("src"), "src").join(side("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "rel").distinct()  # numbers are compared, and the ranges are sampled behind this exchange
    ways = F.array(F.struct("src", "dst", F.lit("out").alias("way")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("in").alias("way")))
    both = coded.select(F.explode(ways).alias("e"), "rel").select("e.*", "rel")
    both.repartitionByRange("way", "rel", "src", "dst").sortWithinPartitions("way", "rel", "src").write.partitionBy("way", "rel").parquet(f"{path}/edges")
    kinds = types.join(terms, F.col("node") == F.col("term")).select("id", "type")
    kinds.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/types")
    return load_graph(spark, path)


def load_graph(spark: SparkSession, path: str) -> CodedGraph:
    return CodedGraph(*[spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") for n in ("terms", "edges", "types")])


def kept_graph(triples: DataFrame, path: str) -> CodedGraph:
    """The graph stored under ``path``; it is stored first if no whole one lies there. ``types``, written last, tells that it is whole."""
    spark = triples.sparkSession
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(f"{path}/types/_SUCCESS")):
        return load_graph(spark, path)
    files.delete(at(path), True)
    return store_graph(triples, path)


def _next(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """``frontier`` (node, ..; checkpointed) joined to ``edges`` as (dst, ..): by a filter of the scan, a broadcast or a shuffle, whichever its count allows."""
    if frontier.limit(FILTER_IDS + 1).count() <= FILTER_IDS:
        edges = edges.filter(F.col("src").isin([r["node"] for r in frontier.select("node").distinct().collect()]))  # counted: a bounded list
    return edges.join(small(frontier), F.col("src") == F.col("node")).drop("src", "node")


def coded_hops(graph: CodedGraph, focal: DataFrame, k: int, relations: list[str] | None = None) -> DataFrame:
    """(focal, node, hop) as numbers, of what lies within ``k`` steps of the terms ``focal`` in either direction, over all or some relations.

    A focal term that the graph does not hold has no rows."""
    use_checkpoints(focal.sparkSession)
    step = graph.edges if relations is None else graph.edges.filter(F.col("rel").isin(relations))
    starts = graph.terms.join(small(focal.select(F.col("focal").alias("term")).distinct()), "term").select(F.col("id").alias("focal"))
    frontier = seen = starts.select("focal", F.col("focal").alias("node"), F.lit(0).alias("hop")).checkpoint()
    for hop in range(1, k + 1):
        found = _next(step.select("src", "dst"), frontier.select("focal", "node")).select("focal", F.col("dst").alias("node")).distinct()
        frontier = found.join(seen, ["focal", "node"], "left_anti").withColumn("hop", F.lit(hop)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def named(graph: CodedGraph, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the terms of the numbers in ``columns``. Few numbers, counted, are a filter of the scan of the terms; more meet it as a broadcast, beyond that in a join."""
    rows = rows.checkpoint()
    ids = rows.select(F.explode(F.array(*columns)).alias("id")).filter("id is not null").distinct().checkpoint()
    terms = graph.terms
    if ids.limit(FILTER_IDS + 1).count() <= FILTER_IDS:
        terms = terms.filter(F.col("id").isin([r["id"] for r in ids.collect()]))  # counted: a bounded list
    terms = small(terms.join(small(ids), "id").checkpoint())
    for c in columns:
        rows = rows.join(terms.select(F.col("id").alias(c), F.col("term").alias("_term")), c).drop(c).withColumnRenamed("_term", c)
    return rows


def coded_context_graph(graph: CodedGraph, ages: DataFrame, focal: DataFrame, goal_types: list[str], k: int = 3, max_nodes: int = 150) -> DataFrame:
    """``context.context_graph`` of a stored graph, with the same rows for every focal term that it holds; ``ages`` (node, age_min) are by name."""
    near = coded_hops(graph, focal, k)
    among = small(near.select("node").distinct().checkpoint())
    types = graph.types.withColumnRenamed("id", "node").join(among, "node", "left_semi")
    aged = ages.join(graph.terms, F.col("node") == F.col("term")).select(F.col("id").alias("node"), "age_min")
    scored = near.join(types, "node", "left").join(aged, "node", "left").withColumn("type", F.coalesce("type", F.lit("Thing")))
    scored = scored.withColumn("relevance", F.round(relevance(F.col("hop"), F.col("type").isin(goal_types), F.coalesce("age_min", F.lit(0.0))), 9))
    order = W.partitionBy("focal").orderBy(F.desc(F.col("hop") == 0), F.desc("relevance"), "node")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max_nodes).select("focal", "node", "type", "hop", "relevance", "rank")
    return named(graph, best, ["focal", "node"]).select("focal", "node", "type", "hop", "relevance", "rank")


def coded_neighborhood(graph: CodedGraph, seeds: DataFrame, hops: int, kind: str) -> DataFrame:
    """``graph.neighborhood`` of a stored graph: (node) of one type within ``hops`` of any seed (id), seeds included."""
    near = coded_hops(graph, seeds.select(F.col("id").alias("focal")), hops).select("node").distinct()
    return named(graph, near.join(graph.types.filter(F.col("type") == kind).select(F.col("id").alias("node")), "node", "left_semi"), ["node"])


def coded_path(graph: CodedGraph, source: str, target: str) -> DataFrame:
    """``graph.shortest_path`` of a stored graph: one row (path) of terms, the least by its nodes among the shortest; no row if there is none."""
    spark = graph.terms.sparkSession
    use_checkpoints(spark)
    ends = {r["term"]: r["id"] for r in graph.terms.filter(F.col("term").isin(source, target)).collect()}
    none = spark.createDataFrame([], "path array<string>")
    if source not in ends or target not in ends:
        return spark.createDataFrame([([source],)], "path array<string>") if source == target else none
    goal, step = ends[target], graph.edges.filter("way = 'out'").select("src", "dst")
    frontier = spark.createDataFrame([(ends[source], [ends[source]])], "node long, path array<long>").checkpoint()
    seen = frontier.select("node")
    while not frontier.isEmpty():
        hit = frontier.filter(F.col("node") == goal)
        if not hit.isEmpty():
            steps = hit.select(F.posexplode("path").alias("at", "node"))
            return named(graph, steps, ["node"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("path"))
        found = _next(step, frontier).groupBy(F.col("dst").alias("node")).agg(F.min(F.array_append("path", F.col("dst"))).alias("path"))
        frontier = found.join(seen, "node", "left_anti").checkpoint()
        seen = seen.unionByName(frontier.select("node"))
    return none
