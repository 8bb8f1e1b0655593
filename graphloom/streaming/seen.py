"""Ids that a stream has handled, kept so that a batch reads only the part that may hold its own.

Under the folder of the state, ``base/upto=n/bucket=b`` holds all ids up to batch n, dealt to buckets by hash, and ``log/batch=n`` those of one batch
since, sorted by bucket. A batch reads the buckets of its ids. From time to time base and log become a new base, which a replayed batch does not use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import remove

BUCKETS = 256
#: Batches after which the log is folded into a new base.
FOLD_EVERY = 32


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _numbered(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers n of the finished folders ``name=n``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    paths = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(p.getName().split("=")[1]) for p in paths if p.getName().startswith(name + "=") and done(p))


def seen_before(spark: SparkSession, state: str, number: int) -> DataFrame:
    """(id, bucket) of all batches before ``number``; a filter on bucket reads only those folders of the base, and row groups of the log."""
    schema = "id string, bucket int"
    bases = [n for n in _numbered(spark, f"{state}/base", "upto") if n < number]
    start = bases[-1] if bases else -1
    parts = [f"{state}/base/upto={start}"] if bases else []
    parts += [f"{state}/log/batch={n}" for n in _numbered(spark, f"{state}/log", "batch") if start < n < number]
    out = spark.createDataFrame([], schema)
    for part in parts:  # at most one base and FOLD_EVERY batches
        out = out.unionByName(spark.read.schema(schema).parquet(part))
    return out


def leave_out_seen(items: DataFrame, state: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """``items`` (id, ..) of batch ``number`` without those of earlier batches; only the buckets of their ids are read."""
    spark = items.sparkSession
    marked = items.withColumn("_b", bucket_of(F.col("id"), buckets))
    mine = [r["_b"] for r in marked.select("_b").distinct().collect()]  # at most ``buckets`` numbers
    earlier = seen_before(spark, state, number).filter(F.col("bucket").isin(mine))
    return marked.join(earlier.select("id", F.col("bucket").alias("_b")).distinct(), ["id", "_b"], "left_anti").select(*items.columns)


def remember(ids: DataFrame, state: str, number: int, buckets: int = BUCKETS, fold_every: int = FOLD_EVERY) -> None:
    """Keep ``ids`` (id) as those of batch ``number``; done again, it replaces what the batch left before.

    The last two bases stay, and the logs after the older one, so that the batch can be replayed after its fold."""
    spark = ids.sparkSession
    ids.select("id", bucket_of(F.col("id"), buckets).alias("bucket")).sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{state}/log/batch={number}")
    bases = [n for n in _numbered(spark, f"{state}/base", "upto") if n < number]
    if number - (bases[-1] if bases else -1) < fold_every:
        return
    whole = seen_before(spark, state, number + 1).distinct()
    whole.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{state}/base/upto={number}")
    for old in bases[:-1]:
        remove(spark, f"{state}/base/upto={old}")
    if bases:
        for old in _numbered(spark, f"{state}/log", "batch"):
            if old <= bases[-1]:
                remove(spark, f"{state}/log/batch={old}")
