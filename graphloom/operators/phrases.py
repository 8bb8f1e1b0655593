"""Noun phrases of texts from a table of word classes, with their places."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import use_checkpoints

#: Words of letters (with an apostrophe or hyphen inside), and numbers.
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[0-9]+(?:[.,][0-9]+)*")
#: Word classes: determiner, adjective, number, noun; whatever else a table names ends a phrase.
DETERMINER, ADJECTIVE, NUMBER, NOUN = "D", "A", "M", "N"
_PARTS = re.compile(f"({_WORD.pattern})")
_CODES = {c: c for c in (DETERMINER, ADJECTIVE, NUMBER, NOUN)}
#: Words of a phrase and what follows them as far as it may belong to it, each behind a mark of its gap.
_RUN = re.compile("[DAMN](?:_[AMN])*")
#: Words of a lexicon up to which every task gets it whole; beyond that as many common words of the texts, and the others meet it in a join.
LEXICON_WORDS = 500_000


def _phrases(parts: list[str], classes: list[str]) -> Iterator[tuple[int, int, int]]:
    """(start, start without determiner, end) of every phrase of a text, given as its gaps and words in turn: a determiner at most, then adjectives,
    numbers and nouns parted by blanks only, up to the last noun of these."""
    ends = list(accumulate(map(len, parts)))
    gaps = ["_" if gap == " " or gap and not gap.strip(" \t") else "|" for gap in parts[:-1:2]]
    coded = "".join(map(str.__add__, gaps, [_CODES.get(c, "x") for c in classes]))  # two characters a word
    for run in _RUN.finditer(coded):
        start, last = run.start() // 2, coded.rfind(NOUN, run.start(), run.end()) // 2
        if last >= 0:
            yield ends[2 * start], ends[2 * (start + (run.group()[0] == DETERMINER))], ends[2 * last + 1]


def _scan(keys: list[str], classed: Callable[[list[str], int, pa.RecordBatch], list[str]]) -> Callable:
    """A ``mapInArrow`` function from rows (keys, text, ..) to their phrases, at most some 50,000 a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], [[], [], [], []]

            def out() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())  # noqa: B023
                columns = [batch.column(k).take(at) for k in keys]  # noqa: B023
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32()]
                return pa.RecordBatch.from_arrays(columns + [pa.array(v, t) for v, t in zip(found, kinds)], names=[*keys, "text", "start", "bare_start", "end"])  # noqa: B023

            for i, text in enumerate(batch.column("text").to_pylist()):
                parts = _PARTS.split(text)
                for start, bare, end in _phrases(parts, classed([w.lower() for w in parts[1::2]], i, batch)):
                    row.append(i)
                    for column, value in zip(found, (text[start:end], start, bare, end)):
                        column.append(value)
                if len(row) > 50_000:
                    yield out()
                    row, found = [], [[], [], [], []]
            yield out()

    return run


def _default(word: str, unknown: str) -> str:
    return NUMBER if word[0].isdigit() else unknown


def _words(text: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(text)}


def _common(rows: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """(word, class or null) of the words that the most ``rows`` hold: those above a power of two of rows, so that they are at most ``most``."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter()
            for text in batch.column("text").to_pylist():
                n.update(_words(text))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    words = rows.select("text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("power"))
    words = words.filter("power > 0").join(lexicon, "word", "left").checkpoint()
    least, room = 64, most
    for power, n in sorted(words.groupBy("power").count().collect(), reverse=True):  # at most 63 rows
        if n > room:
            break
        least, room = power, room - n
    return words.filter(F.col("power") >= least).select("word", "class")


def noun_phrases(rows: DataFrame, lexicon: DataFrame, keys: list[str], unknown: str = NOUN, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(keys, text, start, bare_start, end) of the noun phrases of ``rows`` (keys, text); places are code points, ``bare_start`` is behind a determiner.

    ``lexicon`` (word, class) gives classes of lower-case words, ``D A M N`` or others; a word with several takes the least of them. A word that it
    lacks is ``unknown``, a number ``M``. Null and empty texts have no phrase; equal rows have theirs each.

    A lexicon of up to ``lexicon_words``, which are counted, goes to every task. With a larger one the most common words of the texts, as many at most,
    go there with their classes; only the others meet the lexicon in a join, and their classes come back to the texts by digest."""
    use_checkpoints(rows.sparkSession)
    lexicon = lexicon.filter("word is not null and class is not null").groupBy("word").agg(F.min("class").alias("class")).checkpoint()
    rows = rows.select(*keys, "text").filter("text <> ''")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, text string, start int, bare_start int, end int"
    if lexicon.limit(lexicon_words + 1).count() <= lexicon_words:
        known = rows.sparkSession.sparkContext.broadcast({r["word"]: r["class"] for r in lexicon.collect()})  # counted: a bounded table
        return rows.mapInArrow(_scan(keys, lambda words, i, batch: [known.value.get(w) or _default(w, unknown) for w in words]), schema)

    known = rows.sparkSession.sparkContext.broadcast({r["word"]: r["class"] or _default(r["word"], unknown) for r in _common(rows, lexicon, lexicon_words).collect()})
    digest = F.unhex(F.sha2("text", 256))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = dict(zip(batch.column("_h").to_pylist(), batch.column("text").to_pylist()))
            of, words = [], []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(of, pa.binary()), pa.array(words, pa.string())], names=["_h", "word"])  # noqa: B023

            for h, text in texts.items():
                new = [w for w in _words(text) if w not in known.value]
                of += [h] * len(new)
                words += new
                if len(words) > 50_000:
                    yield out()
                    of, words = [], []
            yield out()

    found = rows.select(digest.alias("_h"), "text").mapInArrow(rare, "_h binary, word string").join(lexicon, "word")
    named = found.groupBy("_h").agg(F.map_from_entries(F.collect_set(F.struct("word", "class"))).alias("_c"))
    given = rows.withColumn("_h", digest).join(named, "_h", "left").select(*keys, "text", "_c")

    def classed(words: list[str], i: int, batch: pa.RecordBatch) -> list[str]:
        own = dict(batch.column("_c")[i].as_py() or ())
        return [known.value.get(w) or own.get(w) or _default(w, unknown) for w in words]

    return given.mapInArrow(_scan(keys, classed), schema)
