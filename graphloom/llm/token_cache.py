"""Token counts through a digest cache.

A stored table maps (tokenizer version, content digest) to a token count. The version is the digest
of the tokenizer file, so a changed file never meets old counts. The content is normalised as far as
leaves every count as it is: a null text becomes the empty text. Counting joins the digests of the
documents to the table; only for digests without a count are texts fetched, one row for each, encoded,
and their counts appended; a second join gives every row its count. Copies and documents of earlier runs
cost no encoding, and where all is known no text leaves the scan.

The table is Parquet at ``cache_path``, one folder a version, in storage that all executors reach. Counts of runs that
append at the same time may be there twice; they are equal, and one is read.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each get a row;
null ids stay null; other columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import codec, text_slices
from graphloom.llm.shared import stored, whole

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"
#: Up to so many missing digests, the keys of their rows are broadcast; beyond that the texts are shuffled.
BROADCAST_ROWS = 500_000


def tokenizer_version(vocab_path: str) -> str:
    """Digest of the tokenizer file."""
    with open(vocab_path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str | None = None) -> DataFrame:
    """The stored counts, of one version or of all, each once; none where nothing has been stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    if version is not None:
        rows = rows.filter(F.col("version") == version)
    # keyed by a struct, so that a join on the digest deals both sides anew and a hot digest can be split
    once = rows.groupBy(F.struct("version", "digest").alias("_k")).agg(F.max("n_tokens").alias("n_tokens"))
    return once.select(F.col("_k.version").alias("version"), F.col("_k.digest").alias("digest"), "n_tokens")


def count_tokens(docs: DataFrame, vocab_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, bytes and tokens of its whole text. New counts are appended to the cache first."""
    spark, version = docs.sparkSession, tokenizer_version(vocab_path)
    text = whole(text_col)
    content = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.unhex(F.sha2(text, 256)).alias("_d"), F.xxhash64(F.col(id_col), text).alias("_row"))
    first = content.groupBy("_d").agg(F.min("_row").alias("_row"))
    known = read_cache(spark, cache_path, version)
    missing = stored(first.join(known, F.col("_d") == F.col("digest"), "left_anti"), "missing-digests")
    keys = missing.select("_row").distinct()
    if missing.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab_path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in text_slices(texts):
                n = c.counts(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([version] * (hi - lo)), b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64())], names=["version", "digest", "n_tokens"])

    texts = content.join(keys, "_row", "left_semi").select("_d", "_t")
    texts.mapInArrow(run, CACHE_SCHEMA).write.mode("append").partitionBy("version").parquet(cache_path)
    counts = read_cache(spark, cache_path, version)
    wanted = content.select("doc_id", F.octet_length("_t").cast("long").alias("n_bytes"), "_d")
    return wanted.join(counts, F.col("_d") == F.col("digest")).select("doc_id", "n_bytes", "n_tokens")
