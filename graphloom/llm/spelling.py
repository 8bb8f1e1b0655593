"""Spelling variants: words one edit apart, found by scanning sorted vocabularies with banded edit rows.

A scan keeps one row of the edit matrix for each depth of the current word, three cells wide, for all words of its list at
once. The next word of the sorted list reuses the rows of the prefix that it shares with the last one and computes only what
follows; words whose row has passed one edit leave, and once a prefix has no other word left the whole range that shares it is skipped.

To spread the scan, the vocabulary is dealt to lists. Of two words one edit apart whose shorter one has ``m`` code points, either the first
``m // 2`` or the last ``m - m // 2`` code points agree; so lists hold the words of ``m`` and ``m + 1`` code points that share
such a beginning, or such an end (these are scanned from the back). A list longer than ``list_rows`` is dealt once more, by what is left of
and right of each place of an edit; such lists cannot be longer than the alphabet allows. No pair is lost, and each is found once.

Defined results: null and empty texts have no runs; a null id counts as the empty text; repeated rows count each time;
words are compared by code points; other columns are never touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import stored, whole
from graphloom.operators.blocks import parts, pieces

#: A run of letters of the basic and the Latin-1 range.
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of one list; a longer list is dealt by the place of the edit.
LIST_ROWS = 4096
_LIST = ["_key", "_m", "_lo", "_hi"]


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 1) -> DataFrame:
    """(id, run) for each maximal run of letters of the whole text; A to Z in lower case, other letters as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.filter(F.regexp_extract_all(whole(text_col), F.lit(RUN), F.lit(0)), lambda x: F.length(x) >= least_length)
    one = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("r"))
    plain = F.when(F.col("r").rlike("[À-Þ]"), F.translate("r", upper, lower)).otherwise(F.lower("r"))
    return one.select("id", plain.alias("run"))


def vocabulary(runs: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of rows (word), counted over all of them."""
    return runs.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def scan(words: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs (i, j), i < j, of places of a sorted list of distinct words that are exactly one edit apart."""
    sizes = np.array([len(w) for w in words])
    chars = np.zeros((len(words), sizes.max() + 3), np.int32)
    for i, w in enumerate(words):
        chars[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), np.int32)
    lanes = np.arange(len(words))
    # Cell b of depth d holds the edits between the word's first d and a lane's first d - 1 + b code points.
    rows = [(lanes, np.tile(np.array([2, 0, 1], np.int8), (len(words), 1)))]
    for j, word in enumerate(words):
        shared = len(commonprefix([word, words[j - 1]])) if j else 0
        if len(rows) <= shared:  # the last word ended where no other was left: so do all that share that prefix
            continue
        del rows[shared + 1 :]
        for d in range(shared, len(word)):
            at, cell = rows[-1]
            if len(at) < 2:
                break
            differs = chars[at, max(d - 1, 0) : d + 2] != chars[j, d]
            if not d:
                differs = np.insert(differs, 0, True, axis=1)
            new = cell + differs
            np.minimum(new[:, :2], cell[:, 1:] + 1, out=new[:, :2])
            np.minimum(new[:, 1], new[:, 0] + 1, out=new[:, 1])
            np.minimum(new[:, 2], new[:, 1] + 1, out=new[:, 2])
            alive = new.min(axis=1) <= 1
            rows.append((at[alive], new[alive]))
        if len(rows) == len(word) + 1:
            at, cell = rows[-1]
            last = sizes[at] - len(word) + 1
            fits = (last >= 0) & (last <= 2) & (at < j)
            at = at[fits]
            for i in at[cell[fits, last[fits]] == 1].tolist():
                yield i, j


def _halves(words: DataFrame, least_length: int) -> DataFrame:
    """Each word in its lists: for the two lengths that the shorter word of a pair can have, by beginning and by end."""
    size = F.length("word")
    one = words.select("word", "n", F.explode(F.array(size - 1, size)).alias("_m")).filter(F.col("_m") >= least_length)
    half = F.floor(F.col("_m") / 2).cast("int")
    end = F.reverse("word").substr(F.lit(1), F.col("_m") - half)
    sides = F.array(
        F.struct(F.lit(False).alias("back"), half.alias("lo"), F.col("_m").alias("hi"), F.col("word").substr(F.lit(1), half).alias("part")),
        F.struct(F.lit(True).alias("back"), F.lit(0).alias("lo"), (half - 1).alias("hi"), end.alias("part")),
    )
    one = one.withColumn("s", F.explode(sides))
    return one.select("word", "n", "_m", F.col("s.lo").alias("_lo"), F.col("s.hi").alias("_hi"), F.col("s.back").alias("_back"), F.xxhash64("_m", "s.back", "s.part").alias("_key"))


def _places(listed: DataFrame) -> DataFrame:
    """Words of an overlong list by each place that its pairs may differ in, with the letter there left out or not."""
    left = lambda i: F.col("word").substr(F.lit(1), i)
    right = lambda i: F.substring("word", i + 1, F.length("word"))
    shorter = F.length("word") == F.col("_m")
    at = F.explode(F.sequence(F.col("_lo"), F.col("_hi"))).alias("i")
    keys = F.when(shorter, F.array(F.xxhash64(F.lit("r"), "_key", "i", left(F.col("i")), right(F.col("i") + 1)), F.xxhash64(F.lit("i"), "_key", "i", left(F.col("i")), right(F.col("i")))))
    keys = keys.otherwise(F.array(F.xxhash64(F.lit("i"), "_key", "i", left(F.col("i")), right(F.col("i") + 1))))
    one = listed.select("word", "n", "_m", "_lo", "_hi", "_back", "_key", at)
    return one.select("word", "n", "_m", F.col("i").alias("_lo"), F.col("i").alias("_hi"), "_back", F.explode(keys).alias("_key"))


def near_words(words: DataFrame, least_length: int = 6, list_rows: int = LIST_ROWS) -> DataFrame:
    """(word, near, near_n) of words (word, n), both ways, for every two that are one edit apart."""
    kind = words.schema["n"].dataType.simpleString()
    listed = stored(_halves(words, least_length), "word-lists")
    long = stored(listed.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > list_rows).select("_key"), "long-lists")
    if long.isEmpty():
        dealt = listed
    else:
        dealt = listed.join(long, "_key", "left_anti").unionByName(_places(listed.join(long, "_key")))
    dealt = dealt.withColumn("_sorted", F.when(F.col("_back"), F.reverse("word")).otherwise(F.col("word")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, m, lo, hi), table in pieces(batches, _LIST):
            if table.num_rows < 2:
                continue
            words, n = table["word"].to_pylist(), table["n"].to_pylist()
            out = []
            for i, j in scan(table["_sorted"].to_pylist()):
                if min(len(words[i]), len(words[j])) == m and lo <= len(commonprefix([words[i], words[j]])) <= hi:
                    out += [(words[i], words[j], n[j]), (words[j], words[i], n[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["word", "near", "near_n"])

    tasks = parts(listed.count(), 4 * LIST_ROWS)
    sorted_lists = dealt.select(*_LIST, "_sorted", "word", "n").repartition(tasks, *_LIST).sortWithinPartitions(*_LIST, "_sorted")
    return sorted_lists.mapInArrow(run, f"word string, near string, near_n {kind}")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last of each chain, by doubling; chains must have no cycle."""
    roots, open_links = stored(forms.select("word", F.col("form").alias("root")), "roots"), 1
    while open_links:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stored(roots.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_open")), "roots")
        open_links = roots.filter("_open").count()
        roots = roots.drop("_open")
    return roots


def group_variants(words: DataFrame, least_length: int = 6, ratio: Column | int = 5, list_rows: int = LIST_ROWS) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the form of a word is its near word of largest n, the first of equals, if that is ``ratio`` times the word's n."""
    words = stored(words.select("word", "n"), "vocabulary")
    near = near_words(words, least_length, list_rows).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_n"), F.col("near").alias("form"))).alias("_b"))
    formed = -F.col("_b._n") >= ratio * F.col("n")
    graded = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("_b.form")).alias("form"), F.when(formed, -F.col("_b._n")).cast("long").alias("form_n")
    )
    graded = stored(graded, "forms")
    roots = followed(graded.filter("form is not null"))
    return graded.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
