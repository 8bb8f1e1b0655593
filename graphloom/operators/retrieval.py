"""Vector retrieval: hashed bag-of-words vectors, top-k search, memory of notes, hybrid recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import edge_order, search_row, sliding_chunks, year_matches
from graphloom.operators.blocks import MOST_PARTITIONS, TILE_ROWS, Best, Runner, matrix, meet, streamed
from graphloom.operators.graph import neighborhood
from graphloom.sources.io import append_vectors, read_vectors

#: Rows whose scores with all centres a task holds at once.
TILE = 1024
#: Queries in a block: every block meets all vectors, so these are shuffled once for as many queries.
BLOCK_ROWS = 65_536
#: Scores that a task holds at once: those of a slice of its block with one tile.
SCORES = 2**20


def hashed_terms(docs: DataFrame, dims: int = 256) -> DataFrame:
    """(id, dim, weight), sparse and L2-normalised: each word adds 1.0 at one md5 place and 0.5 at another."""
    words = docs.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).groupBy("id", "w").agg(F.count(F.lit(1)).alias("n"))
    place = lambda salt: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), "w")), 1, 8), 16, 10).cast("bigint"), F.lit(dims))
    hits = words.select("id", "n", F.explode(F.array(F.struct(place("a:").alias("dim"), F.lit(1.0).alias("v")), F.struct(place("b:").alias("dim"), F.lit(0.5).alias("v")))).alias("h"))
    summed = hits.groupBy("id", F.col("h.dim").alias("dim")).agg(F.sum(F.col("n") * F.col("h.v")).alias("x"))
    norm = summed.groupBy("id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return summed.join(norm, "id").select("id", "dim", (F.col("x") / F.col("norm")).alias("weight"))


def dense(terms: DataFrame, ids: DataFrame, dims: int = 256) -> DataFrame:
    """(id, vec) of every id; one without words gets zeros."""
    maps = terms.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("_m", i.cast("bigint")), F.lit(0.0)))
    return ids.select("id").join(maps, "id", "left").select("id", vec.alias("vec"))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of a list column as rows of length 1; a zero vector stays zero."""
    rows = matrix(column)
    norm = np.linalg.norm(rows, axis=1)
    return rows / np.where(norm > 0, norm, 1)[:, None]


def _best_of(k: int, digits: int, kinds: tuple[str, str]) -> tuple[Runner, str]:
    """What a task does with a block of queries (query_id, _q) and tiles of vectors (seq, id, _v): the ``k`` best of each query.

    Only a slice of their scores is held at once, and only those that can be among the best are rounded; so a task's memory hangs on neither table."""
    slack = 10.0**-digits  # what rounding may lift

    def run(block: pa.Table, tiles: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        q, asked = unit_rows(block["_q"]), block["query_id"].combine_chunks()
        best, ids = Best(len(q), k), None
        for tile in tiles:
            v, seq = unit_rows(tile["_v"]), tile["seq"].to_numpy()
            given = tile["id"].combine_chunks()
            known, step = 0 if ids is None else len(ids), max(1, SCORES // max(1, len(v)))
            for lo in range(0, len(q), step):
                raw = q[lo : lo + step] @ v.T
                edge = best.edge[lo : lo + step]
                if len(v) > k and not np.isfinite(edge).all():
                    edge = np.maximum(edge, np.partition(np.where(np.isnan(raw), -np.inf, raw), -k, axis=1)[:, -k])
                at, row = np.nonzero(raw >= edge[:, None] - slack)
                best.offer(at + lo, np.round(raw[at, row], digits), seq[row], row + known)
            ids = (given if ids is None else pa.concat_arrays([ids, given])).take(pa.array(best.handles()[-1]))
        if ids is not None and len(ids):
            at, score, seq, _ = best.rows()
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), ids, pa.array(seq), pa.array(score)], names=["query_id", "id", "seq", "score"])

    return run, f"query_id {kinds[0]}, id {kinds[1]}, seq bigint, score double"


def _sides(queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, tuple[str, str]]:
    kinds = queries.schema["query_id"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    numbers = lambda df: F.col("vec") if df.schema["vec"].dataType == T.ArrayType(T.FloatType(), df.schema["vec"].dataType.containsNull) else F.col("vec").cast("array<double>")
    asked = queries.filter("vec is not null").select("query_id", numbers(queries).alias("_q"))
    return asked, vectors.filter("vec is not null").select(F.col("seq").cast("long").alias("seq"), "id", numbers(vectors).alias("_v")), kinds


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block_rows: int = BLOCK_ROWS, digits: int = 6) -> DataFrame:
    """(query_id, id, seq, score): for each query (query_id, vec) its ``k`` best of the vectors (seq, id, vec) in each rack, exactly.

    Queries meet vectors block by block in a shuffle; a task holds one block, one tile and ``k`` rows a query, the driver none."""
    asked, given, kinds = _sides(queries, vectors)
    return meet(asked, given, *_best_of(k, digits, kinds), block_rows=block_rows)


def fit_cells(vectors: DataFrame, cells: int = 256, sample_rows: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Unit centres of up to ``cells`` cells, fitted by k-means on a sample: the ``sample_rows`` vectors with the lowest hash."""
    sample = vectors.filter("vec is not null").select("vec").orderBy(F.xxhash64("vec")).limit(sample_rows).toArrow()
    if not len(sample):
        return np.zeros((0, 0))
    v = np.unique(unit_rows(sample["vec"]), axis=0)
    rng = np.random.default_rng(0)
    centres = v[rng.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        near = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centres)
    return centres


def in_cells(rows: DataFrame, vec: str, centres: np.ndarray, cells: int = 1) -> DataFrame:
    """``rows`` with ``cell``: a row for each of the ``cells`` nearest centres of its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                part = batch.slice(lo, TILE)
                score = unit_rows(part.column(vec)) @ centres.T
                near = np.argpartition(-score, min(cells, score.shape[1]) - 1, axis=1)[:, :cells]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))], names=[*rows.schema.names, "cell"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))


def index_vectors(vectors: DataFrame, path: str, centres: np.ndarray) -> None:
    """Store the vectors (seq, id, vec) as lists by cell, and the centres beside them."""
    _, given, _ = _sides(vectors.withColumn("query_id", F.col("id")), vectors)
    in_cells(given, "_v", centres).write.partitionBy("cell").parquet(f"{path}/lists")
    vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")


def probe(queries: DataFrame, path: str, k: int, probes: int = 16, block_rows: int = BLOCK_ROWS, digits: int = 6) -> DataFrame:
    """(query_id, id, seq, score) as :func:`nearest`, from the ``probes`` cells nearest to each query; all cells give the exact result.

    Queries meet the lists of their cells on the cell. A long list is dealt to parts and many queries of a cell to blocks, so a hot cell is many tasks."""
    spark = queries.sparkSession
    kept = spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()  # bounded by the number of cells
    lists = spark.read.parquet(f"{path}/lists")
    if not len(kept):
        return nearest(queries, lists.select("seq", "id", F.col("_v").alias("vec")), k, block_rows, digits)
    centres = unit_rows(kept["centre"])
    asked, _, _ = _sides(queries, lists.withColumn("vec", F.col("_v")))
    kinds = queries.schema["query_id"].dataType.simpleString(), lists.schema["id"].dataType.simpleString()
    asked = in_cells(asked, "_q", centres, probes)
    sizes = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (8 * TILE_ROWS)).cast("int").alias("_parts")).join(asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks")), "cell")
    sizes = F.broadcast(sizes)  # a row for each cell at most
    groups = F.pmod(F.xxhash64("cell", "_part", "_b"), F.lit(MOST_PARTITIONS))
    asked = asked.join(sizes, "cell").withColumn("_b", F.pmod(F.xxhash64("query_id"), F.col("_blocks").cast("long"))).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    asked = asked.select("query_id", "_q", "cell", "_part", "_b", F.lit(0).alias("_side"), F.lit(-1).alias("_tile"))
    rows = lists.join(sizes, "cell").withColumn("_h", F.xxhash64("seq", "id")).withColumn("_part", F.pmod("_h", F.col("_parts")).cast("int"))
    rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks").cast("long") - 1))).select("seq", "id", "_v", "cell", "_part", "_b", F.lit(1).alias("_side"), F.pmod(F.shiftright("_h", 20), F.lit(8)).cast("int").alias("_tile"))
    both = asked.unionByName(rows, allowMissingColumns=True).withColumns({"_rack": F.col("cell").cast("long") * 2**20 + F.col("_part"), "_block": F.col("_b")})
    tasks = min(len(centres) * 4, MOST_PARTITIONS)
    return streamed(both, groups, tasks, *_best_of(k, digits, kinds))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of what the tasks found; order of arrival breaks ties."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("seq")


def top_k(queries: DataFrame, vectors: DataFrame | str, k: int, block_rows: int = BLOCK_ROWS, probes: int = 16) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, vec) against vectors (seq, id, vec) by cosine; order of arrival breaks ties.

    ``vectors`` is a table, searched exactly, or the path of an index, of which each query probes ``probes`` cells."""
    found = probe(queries, vectors, k, probes, block_rows) if isinstance(vectors, str) else nearest(queries, vectors, k, block_rows)
    return ranked(found, k)


def embedded(texts: DataFrame, dims: int = 256) -> DataFrame:
    """(id, vec) of texts (id, text): hashed bag of words, the same for notes and questions."""
    return dense(hashed_terms(texts, dims), texts, dims)


def chunks(notes: DataFrame, size: int = 800, overlap: int = 150) -> DataFrame:
    """(id, chunk, text) of notes (id, text)."""
    return notes.select("id", F.posexplode(sliding_chunks(F.col("text"), size, overlap)).alias("chunk", "text"))


def remember(notes: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame] = embedded, size: int = 800, overlap: int = 150) -> DataFrame:
    """Chunk notes (id, text, and ``meta`` map<string,string> where there is one), embed the chunks, append them to the vector table at
    ``path``, and return the whole table as read again. ``embed`` turns (id, text) into (id, vec)."""
    pieces = chunks(notes, size, overlap).withColumn("key", F.concat_ws("#", F.col("id").cast("string"), F.col("chunk").cast("string")))
    vectors = embed(pieces.select(F.col("key").alias("id"), "text")).withColumnRenamed("id", "key")
    meta = notes.select("id", F.col("meta") if "meta" in notes.columns else F.create_map().cast("map<string,string>").alias("meta")).dropDuplicates(["id"])
    rows = pieces.join(vectors, "key").join(meta, "id").select(F.col("id").cast("string").alias("id"), "chunk", F.col("vec").cast("array<double>").alias("vec"), "text", "meta")
    append_vectors(rows, path)
    return read_vectors(notes.sparkSession, path)


def recall(questions: DataFrame, memory: DataFrame, k: int = 5, embed: Callable[[DataFrame], DataFrame] = embedded) -> DataFrame:
    """(query_id, notes): for each question (query_id, text) its ``k`` nearest chunks as (id, note), the strongest at both ends."""
    asked = embed(questions.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    stored = memory.withColumn("seq", F.xxhash64("id", "chunk", "text"))
    hits = top_k(asked, stored.select("seq", F.struct("id", F.col("text").alias("note")).alias("id"), "vec"), k)
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("_n"))
    return listed.select("query_id", edge_order(F.transform("_n", lambda x: x["id"]), "edges").alias("notes"))


def hybrid_recall(questions: DataFrame, vectors: DataFrame, edges: DataFrame, types: DataFrame, k: int = 3, hops: int = 1, kind: str = "Paper") -> tuple[DataFrame, DataFrame]:
    """(seeds, context): the ``k`` nearest vectors (seq, id, vec) of questions (query_id, vec), and the nodes of a kind within
    ``hops`` of any seed in the graph, seeds included."""
    seeds = top_k(questions, vectors, k)
    return seeds, neighborhood(edges, types, seeds.select("id").distinct(), hops, kind)


def search_papers(papers: DataFrame, years: Column | None = None, by_citations: bool = False, k: int = 10) -> DataFrame:
    """The first ``k`` papers (seq, id, title, authors, year, citations, abstract) as search rows: only years of the spec, and a paper without
    a year is in none; in order of arrival or the most cited first. The top-k is the operator; no task sorts all rows."""
    fits = papers if years is None else papers.filter(year_matches(F.col("year"), years))
    order = [F.desc(F.coalesce("citations", F.lit(0))), "seq"] if by_citations else ["seq"]
    return fits.orderBy(*order).limit(k).select(search_row(F.struct(*papers.columns)).alias("r")).select("r.*")


def recall_of_groups(found: DataFrame, queries: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) where the gold of a query (query_id, group) is all members (id, group) of its group: these are counted, never listed."""
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    hits = found.filter(F.col("rank") <= k).join(queries, "query_id").join(members.select("id", F.col("group").alias("_g")), "id").filter("group = _g").groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    return queries.join(sizes, "group").join(hits, "query_id", "left").select("query_id", (F.coalesce("_hits", F.lit(0)) / F.col("_n")).alias("recall"))


def recall_at_k(found: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) of ranked results against gold (query_id, id)."""
    hits = gold.join(found.filter(F.col("rank") <= k).select("query_id", "id").withColumn("_h", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("_h", F.lit(0)).cast("double")).alias("recall"))
