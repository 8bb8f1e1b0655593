"""Sums over everything before a row of its key, without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.storage import shared_base

#: Places of a key that one window sees at most: two to this power.
BITS = 12


def _within(partition: list[str], at: str, value: str) -> Column:
    """Sum of ``value`` over the places before a row's own in its part."""
    return F.coalesce(F.sum(value).over(W.partitionBy(*partition).orderBy(at).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))


def _offsets(sums: DataFrame, bits: int) -> DataFrame:
    """(_k, _b, _o): for every block of a key (_k, _b, _v) the sum of all blocks before it.

    If the numbers of the blocks span more than one window may see, they are dealt to blocks themselves."""
    sums = sums.checkpoint()
    ends = sums.agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).first()
    if ends["lo"] is None or ends["hi"] - ends["lo"] < 2**bits:
        return sums.select("_k", "_b", _within(["_k"], "_b", "_v").alias("_o"))
    sums = sums.withColumn("_up", F.shiftright("_b", bits))
    above = _offsets(sums.groupBy("_k", F.col("_up").alias("_b")).agg(F.sum("_v").alias("_v")), bits).select("_k", F.col("_b").alias("_up"), F.col("_o").alias("_above"))
    return sums.join(above, ["_k", "_up"]).select("_k", "_b", (_within(["_k", "_up"], "_b", "_v") + F.col("_above")).alias("_o"))


def sum_before(df: DataFrame, key: str, at: str, value: str, name: str, bits: int = BITS) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over the rows of the same ``key`` at an earlier place ``at`` (integers).

    Rows at one place do not count for each other, missing values count as nothing; a row without a place has nothing before it and counts
    for no other. A key is cut in blocks of places, each summed and windowed on its own, and the blocks' sums are added up in as many levels
    as the places need; so a key that holds a third of all rows is many tasks."""
    shared_base(df.sparkSession)
    placed = df.filter(F.col(at).isNotNull()).withColumn("_k", F.struct(F.col(key).alias("k"))).withColumn("_b", F.shiftright(F.col(at).cast("long"), bits))
    offsets = _offsets(placed.groupBy("_k", "_b").agg(F.sum(value).alias("_v")), bits)
    out = placed.join(offsets, ["_k", "_b"]).withColumn(name, _within(["_k", "_b"], at, value) + F.col("_o")).drop("_k", "_b", "_o")
    return out.unionByName(df.filter(F.col(at).isNull()).withColumn(name, F.lit(0)))
