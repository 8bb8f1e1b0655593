"""Sources and sinks: corpora, stage tables, traces, triples, papers, vectors, caches, generated sensor feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.schemas import RUNS, VECTORS

_LINE = r'^(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@(\S+))?)\s*\.\s*$'


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): every file that is not empty as one row; the id is the file's stem without a stage suffix."""
    return spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))


def stem(path: Column) -> Column:
    """What sibling artifacts of one source share in their names."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(_content|_scope|_candidates|_vocabulary|_sentences|_index)?\.[A-Za-z0-9]+$", "")


def write_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """Write a stage's table; returns its row of statistics, written beside it."""
    df.write.mode("overwrite").parquet(f"{path}/stage={stage}")
    stats = read_stage(df.sparkSession, path, stage).agg(F.lit(stage).alias("stage"), F.count(F.lit(1)).alias("rows"))
    stats.write.mode("overwrite").parquet(f"{path}/stats_{stage}")
    return df.sparkSession.read.parquet(f"{path}/stats_{stage}")


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{path}/stage={stage}")


def read_runs(spark: SparkSession, path: str, goal: str | None = None, since: float | None = None) -> DataFrame:
    """Spans of the runs of one goal from JSON files; files that are not runs give nothing."""
    runs = spark.read.schema(RUNS).option("multiLine", True).option("mode", "PERMISSIVE").json(path).filter("run_id is not null")
    if goal is not None:
        runs = runs.filter(F.col("goal") == goal)
    spans = runs.select("run_id", "goal", F.posexplode("spans").alias("seq", "x")).select("run_id", "goal", "seq", "x.*")
    return spans.filter(F.col("start") >= since) if since is not None else spans


def parse_triples(lines: DataFrame, graph: str = "default") -> DataFrame:
    """Triples of N-Triples lines (value)."""
    part = lambda i: F.nullif(F.regexp_extract("value", _LINE, i), F.lit(""))
    literal = F.regexp_extract("value", _LINE, 5)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(literal, r'\\"', '"'), r"\\n", "\n"), r"\\\\", r"\\")
    is_iri = part(3).isNotNull() | part(4).isNotNull()
    return lines.filter(F.col("value").rlike(_LINE)).select(
        F.lit(graph).alias("g"), F.regexp_replace(F.regexp_extract("value", _LINE, 1), "^<|>$", "").alias("s"), part(2).alias("p"), F.when(is_iri, F.coalesce(part(3), part(4))).otherwise(plain).alias("o"),
        F.when(is_iri, "iri").otherwise("literal").alias("o_kind"), part(6).alias("datatype"), part(7).alias("lang"),
    )


def triple_lines(triples: DataFrame) -> DataFrame:
    """(value): one N-Triples line a triple."""
    node = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    tail = F.when(F.col("datatype").isNotNull(), F.concat(F.lit("^^<"), "datatype", F.lit(">"))).when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise("")
    obj = F.when(F.col("o_kind") == "iri", node("o")).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))
    return triples.select(F.concat(node("s"), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One version of a triples table partitioned by version; an unknown one is an error."""
    found = spark.read.parquet(path).filter(F.col("version") == version)
    if found.isEmpty():
        raise ValueError(f"unknown ontology version {version}")
    return found.drop("version")


def emit_classes(classes: DataFrame, edges: DataFrame, relations: DataFrame, disjoint: DataFrame, root: str = "DomainEntity") -> DataFrame:
    """Triples of admitted classes (id, label, alt_labels, parked), parents, relations and axioms; parked ones hang under ``root``."""
    t = lambda df, s, p, o, kind: df.select(F.lit("ontology").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    c = F.col
    alts = classes.select("id", F.explode(F.slice("alt_labels", 1, 12)).alias("alt"))
    parts = [
        t(classes, c("id"), "rdf:type", F.lit("owl:Class"), "iri"), t(classes, c("id"), "rdfs:label", c("label"), "literal"), t(alts, c("id"), "skos:altLabel", c("alt"), "literal"),
        t(edges, c("child"), "rdfs:subClassOf", c("parent"), "iri"), t(classes.filter("parked"), c("id"), "rdfs:subClassOf", F.lit(root), "iri"),
        t(relations, c("id"), "rdf:type", F.lit("owl:ObjectProperty"), "iri"), t(relations, c("id"), "rdfs:domain", c("domain_id"), "iri"), t(relations, c("id"), "rdfs:range", c("range_id"), "iri"),
        t(disjoint, c("a"), "owl:disjointWith", c("b"), "iri"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def cumulative(base: DataFrame, delta: DataFrame, version: str) -> DataFrame:
    """The base version with the delta, its version literal replaced."""
    old = base.filter("p <> 'owl:versionInfo'")
    mark = base.filter("p = 'owl:versionInfo'").withColumn("o", F.lit(version))
    return old.unionByName(mark, allowMissingColumns=True).unionByName(delta, allowMissingColumns=True).distinct()


def ingest_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers: cited ids become stubs; later non-null attributes win, nulls never do."""
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), F.col("seq"))).alias(x)
    own = papers.select(F.lit("Paper").alias("type"), F.col("id").alias("key"), "title", "year", "citations", "seq")
    named = lambda kind, col: papers.select(F.lit(kind).alias("type"), col.alias("key"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("citations"), "seq")
    rest = named("Paper", F.explode("references")).unionByName(named("Author", F.explode("authors"))).unionByName(named("Venue", F.col("venue"))).unionByName(named("Topic", F.explode("topics")))
    nodes = own.unionByName(rest).filter("key is not null").groupBy("type", "key").agg(last("title"), last("year"), last("citations"))
    edge = lambda rel, a, b: papers.select(F.lit(rel).alias("rel"), a.alias("src"), b.alias("dst"))
    wrote = papers.select(F.lit("WROTE").alias("rel"), F.explode("authors").alias("src"), F.col("id").alias("dst"))
    edges = edge("CITES", F.col("id"), F.explode("references")).unionByName(edge("PUBLISHED_IN", F.col("id"), F.col("venue"))).unionByName(edge("ON_TOPIC", F.col("id"), F.explode("topics"))).unionByName(wrote)
    return nodes, edges.filter("src is not null and dst is not null").distinct()


def append_vectors(df: DataFrame, path: str) -> None:
    """Append rows (id, chunk, vec, text, meta) to a vector table."""
    df.write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A vector table as it is now; empty where nothing has been appended."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], VECTORS)
    return spark.read.schema(VECTORS).parquet(path)


def embed_with_cache(texts: DataFrame, cache_path: str, embed: Callable, model: str, dim: int) -> DataFrame:
    """(id, vec) of texts (id, text): only distinct texts that the table at ``cache_path`` lacks go through ``embed``, a mapInPandas
    function from (key, text) to (key, vec), once; their vectors are stored first and read from there. A text that ``embed`` does not
    return gets a zero vector."""
    spark, schema = texts.sparkSession, "key string, vec array<float>"
    at = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    known = spark.read.schema(schema).parquet(cache_path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else spark.createDataFrame([], schema)
    keyed = texts.withColumn("key", F.sha1(F.concat_ws("|", F.lit(model), F.lit(str(dim)), "text")))
    misses = keyed.select("key", "text").dropDuplicates(["key"]).join(known, "key", "left_anti")
    misses.mapInPandas(embed, schema).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(schema).parquet(cache_path).dropDuplicates(["key"])
    return keyed.join(stored, "key", "left").select("id", F.coalesce("vec", F.array_repeat(F.lit(0.0).cast("float"), dim)).alias("vec"))


def routed_sink(df: DataFrame, path: str) -> None:
    """Rows by day and route."""
    df.write.partitionBy("day", "route").mode("append").parquet(path)


def sensor_feed(spark: SparkSession, cameras: int, seed: int = 42) -> DataFrame:
    """Triples of cameras on roads with one reading each, all drawn from hashes of the camera's number."""
    n = spark.range(cameras)
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    name = lambda kind, i: F.format_string(kind + "_%d", i)
    roads = spark.range((cameras + 24) // 25)
    fact = lambda s, p, o, kind: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    cam, read, road = name("Camera", F.col("id")), name("Reading", F.col("id")), name("Road", F.col("id"))
    of = F.array(
        fact(cam, "rdf:type", F.lit("Camera"), "iri"), fact(cam, "locatedOn", name("Road", F.floor(F.col("id") / 25).cast("bigint")), "iri"), fact(cam, "hasStatus", F.lit("active"), "literal"),
        fact(read, "rdf:type", F.lit("SensorReading"), "iri"), fact(read, "observedBy", cam, "iri"), fact(read, "hasValue", (draw("v", 80) + 1).cast("string"), "literal"),
        fact(read, "hasConfidence", F.format_number(0.6 + draw("c", 40) / 100, 2), "literal"), fact(read, "hasTime", F.date_format(F.timestamp_seconds(F.lit(1735741920) + draw("t", 601)), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "literal"),
    )
    roads = roads.select(F.explode(F.array(fact(road, "rdf:type", F.lit("RoadSegment"), "iri"), fact(road, "hasName", road, "literal"), fact(road, "partOf", F.lit("City"), "iri"))).alias("t"))
    return n.select(F.explode(of).alias("t")).unionByName(roads).select(F.lit("sensors").alias("g"), "t.*")


#: Lights of the incident scene and their distance north of the incident in metres, and where that is.
SCENE_LIGHTS = [("TL_90", 60.0), ("TL_88", 210.0), ("TL_91", 430.0), ("TL_97", 700.0)]
SCENE_PLACE, METRES_A_DEGREE = (40.75, -73.99), 111_320.0


def incident_scene(spark: SparkSession) -> DataFrame:
    """Triples of an active incident, a road and four lights at known distances, in the sensors' graph."""
    lat, lon = SCENE_PLACE
    rows = [("Incident_I204", "rdf:type", "Incident", "iri"), ("Incident_I204", "hasStatus", "active", "literal"), ("Incident_I204", "hasLatitude", str(lat), "literal"), ("Incident_I204", "hasLongitude", str(lon), "literal")]
    road = "RoadSegment_Main_St_NB"
    rows += [(road, "rdf:type", "RoadSegment", "iri"), (road, "hasIdentifier", "Main-St-NB", "literal"), (road, "hasSpeedLimit", "50", "literal")]
    for light, metres in SCENE_LIGHTS:
        rows += [(light, "rdf:type", "TrafficLight", "iri"), (light, "locatedOn", road, "iri"), (light, "hasLatitude", str(lat + metres / METRES_A_DEGREE), "literal"), (light, "hasLongitude", str(lon), "literal")]
    return spark.createDataFrame([("sensors", *r) for r in rows], "g string, s string, p string, o string, o_kind string")


def sampled_rows(df: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """At most ``n`` rows of every ``by``, spread evenly over its order: those at floor(i * count / n)."""
    group = W.partitionBy(by)
    placed = df.withColumn("_at", F.row_number().over(group.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    first = F.ceil(F.col("_at") * n / F.col("_n"))
    return placed.filter((F.col("_n") <= n) | ((first < n) & (F.floor(first * F.col("_n") / n) == F.col("_at")))).drop("_at", "_n")
