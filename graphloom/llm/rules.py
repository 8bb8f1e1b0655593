"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: its words, symbols, repeated lines and repeated 8-word windows.
The corpus rule hashes normalised lines, counts the distinct documents of a host that hold each
line, takes lines above the limit out, and rejects documents that have too little left.

A line is above the limit when more than ``max_docs`` distinct documents of its host hold it; copies of one text are one
document, however many they are. Near copies are documents of their own: lines that many of them share go like all others.

Lines are known by one hash of host and line. Texts are read once: figures and line keys are stored. A count of all of a line's places
with partial sums bounds its documents from above; only lines beyond the limit, few as they are, meet the rows again, before any exchange.

Defined results: a null text has no words and fails the base rules; an empty text likewise; rows
that repeat id, host and text are each judged as one document is; a null host is a host of its own; columns other
than the four named are never touched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import BLANK, identity, stored, whole

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Up to so many lines beyond the limit, their keys are broadcast.
BROADCAST_ROWS = 500_000


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, BLANK, " ")))


def line_key(host: str | Column, line: Column) -> Column:
    """One hash of a host and a normalised line."""
    return F.xxhash64(host, line)


def base_features(rows: DataFrame, *others: str) -> DataFrame:
    """Of rows (doc_id, _k1, _k2, _t and ``others``, which stay): the base figures of the whole text ``_t``."""
    words = rows.select("doc_id", "_k1", "_k2", *others, "_t", F.array_remove(F.split("_t", BLANK), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.when(
        F.size("_w") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("_w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_w", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = words.select(
        "doc_id", "_k1", "_k2", *others,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        starts.alias("_h"),
    )
    # Windows sorted by hash put equal ones side by side; each then covers the words up to the next repeated window.
    by_hash = counted.select(
        "doc_id", "_k1", "_k2", *others, "n_words", "word_chars", "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    places = F.sort_array(
        F.transform(
            F.filter(
                "_s",
                lambda x, k: (x["h"] == F.get("_s", k - 1)["h"]) & (k > 0) | F.coalesce(x["h"] == F.get("_s", k + 1)["h"], F.lit(False)),
            ),
            lambda x: x["i"],
        )
    )
    found = by_hash.withColumn("_p", places)
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get("_p", k + 1) - p), F.lit(WINDOW))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return found.select(
        "doc_id", "_k1", "_k2", *others, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def line_keys(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source") -> DataFrame:
    """One row per input row, stored: its figures, ``_row`` which tells repeated rows apart, a hash of host and text, and the key and words of each line with a word."""
    lines = F.transform(F.split("_t", "\n"), _normal)
    keyed = F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.struct(line_key(F.col("_host"), x).alias("key"), F.size(F.split(x, " ")).alias("words")))
    rows = docs.select(F.col(id_col).alias("doc_id"), *identity(id_col, host_col, text_col), whole(text_col).alias("_t"), F.col(host_col).alias("_host"))
    rows = rows.withColumns({"_text": F.xxhash64("_host", "_t"), "_lines": keyed}).drop("_host")
    return stored(base_features(rows, "_text", "_lines").withColumn("_row", F.monotonically_increasing_id()), "figures")


def removed_lines(rows: DataFrame, max_docs=25) -> DataFrame:
    """(_row, _lost, removed_words) of the rows of :func:`line_keys` that lose lines: the keys of those lines and the words that go with them."""
    often = stored(rows.select(F.explode("_lines.key").alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_docs).select("_key"), "often")
    lines = rows.select("_row", "_text", F.explode("_lines").alias("_l")).select("_row", "_text", F.col("_l.key").alias("_key"), F.col("_l.words").cast("long").alias("_w"))
    held = stored(lines.join(small(often), "_key").groupBy("_row", "_text", "_key").agg(F.sum("_w").alias("_words")), "common-lines")
    hot = stored(held.select("_key", "_text").distinct().groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_docs).select("_key"), "boilerplate")
    return held.join(small(hot), "_key").groupBy("_row").agg(F.collect_set("_key").alias("_lost"), F.sum("_words").alias("removed_words"))


def small(keys: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if its rows are counted to be few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def quality_rules(
    docs: DataFrame, id_col="doc_id", text_col="text", host_col="source",
    min_words=20, max_repeat_percent=30, max_docs=25, min_left=0.4, min_left_words=8,
) -> DataFrame:
    """Figures and verdict of each row: ``kept`` is false if a base rule fails, or if fewer than ``min_left_words``
    words or less than the share ``min_left`` of them stay once lines above the limits are out."""
    rows = line_keys(docs, id_col, text_col, host_col)
    joined = rows.drop("_text", "_lines").join(removed_lines(rows, max_docs), "_row", "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (removed > 0) & ((F.col("n_words") - removed < min_left_words) | (F.col("n_words") - removed < min_left * F.col("n_words")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), removed.alias("removed_words"), (~failed & ~depleted).alias("kept"), "_k1", "_k2", "_lost",
    )


def apply_rules(docs: DataFrame, id_col="doc_id", text_col="text", host_col="source", **limits) -> DataFrame:
    """The documents that pass, with lines above the limits taken out of their texts; same columns as ``docs``.

    The verdicts are stored first: a filter on them would otherwise be pushed below the figures and repeat their work."""
    verdict = stored(quality_rules(docs, id_col, text_col, host_col, **limits).select("_k1", "_k2", "_lost", "kept"), "verdicts")
    verdict = verdict.filter("kept").select(F.col("_k1").alias("_v1"), F.col("_k2").alias("_v2"), "_lost").dropDuplicates(["_v1", "_v2"])
    keyed = docs.select(F.struct("*").alias("_row"), *identity(id_col, host_col, text_col), F.col(host_col).alias("_host"), F.col(text_col).alias("_t"))
    left = F.filter(F.split("_t", "\n"), lambda x: ~F.array_contains("_lost", line_key(F.col("_host"), _normal(x))))
    text = F.when(F.col("_lost").isNull(), F.col("_t")).otherwise(F.array_join(left, "\n"))
    joined = keyed.join(verdict, (F.col("_k1") == F.col("_v1")) & (F.col("_k2") == F.col("_v2"))).withColumn("_text", text)
    return joined.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns])
