"""Surfacing and merging of mentions, terms and triples. Extractors plug in as ``mapInPandas`` functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import LEADING, dedup_key, fenced_json, fold_key, lemma, looks_like_term, matches_with_offsets, sentences
from graphloom.operators.blocks import meet
from graphloom.operators.graph import small, use_checkpoints
from graphloom.operators.phrases import noun_phrases


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sentences(F.col(text_col))).alias("sentence_index", "text"))


#: Patterns of the default extractor by source: names, gerunds, and adjectives on request.
NAMES, GERUNDS, ADJECTIVES = r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*", r"[a-z]{3,}ing(?![A-Za-z])", r"[a-z]{2,}(?:able|ible|ical|ive|ous|ful|less)(?![A-Za-z])"
#: A number with what it counts, a date, or a percentage.
VALUES = r"\d{4}-\d{2}-\d{2}|\d+(?:[.,]\d+)*(?: ?%| (?:psi|km|m|kg|g|mph|minutes|hours|seconds|days|usd)(?![A-Za-z]))?"


def _placed(rows: DataFrame, keys: list[str], pattern: str, source: str) -> DataFrame:
    """(keys, text, start, end, source) of a pattern's matches that no letter or digit precedes; a leading determiner is cut off, and
    what is nothing else is left out."""
    hits = rows.select(*keys, F.col("text").alias("_t"), F.explode(matches_with_offsets(F.col("text"), pattern)).alias("m")).select(*keys, "_t", "m.*")
    free = hits.filter((F.col("start") == 0) | ~F.substr("_t", F.col("start"), F.lit(1)).rlike(r"[\p{L}\p{N}_]"))
    head = F.substring_index("text", " ", 1)
    cut = F.lower(head).isin(LEADING)
    skip = F.when(cut, F.length(head) + 1).otherwise(0)
    return free.filter(~(cut & (head == F.col("text")))).select(*keys, F.substr("text", skip + 1).alias("text"), (F.col("start") + skip).alias("start"), "end", F.lit(source).alias("source"))


def surface_concepts(docs: DataFrame, extractor: Callable | None = None, schema: str = "doc_id bigint, text string, start int, end int, source string", adjectives: bool = False, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, start, end, source): runs of capitalised words and gerunds, adjectives on request, and with a ``lexicon`` (word, class) noun
    phrases without their determiner, as source ``term``; or whatever ``extractor`` yields from (doc_id, text)."""
    if extractor:
        return docs.select("doc_id", "text").mapInPandas(extractor, schema)
    kinds = [(NAMES, "name"), (GERUNDS, "gerund")] + [(ADJECTIVES, "adjective")] * adjectives
    found = reduce(DataFrame.unionByName, [_placed(docs.select("doc_id", "text"), ["doc_id"], p, s) for p, s in kinds])
    if lexicon is not None:
        bare = F.substr("text", F.col("bare_start") - F.col("start") + 1)
        found = found.unionByName(noun_phrases(docs, lexicon, ["doc_id"]).select("doc_id", bare.alias("text"), F.col("bare_start").alias("start"), "end", F.lit("term").alias("source")))
    return found.filter(looks_like_term(F.col("text")))


def surface_mentions(sents: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """(doc_id, sentence_index, surface_form, mention_type, start, end, source) of sentences (doc_id, sentence_index, text): values, names that
    touch no value and are no pronoun, and with a ``lexicon`` (word, class) noun phrases that touch neither."""
    keys = ["doc_id", "sentence_index"]
    rows = sents.select(*keys, "text").withColumn("doc_id", F.struct("doc_id", "sentence_index")).drop("sentence_index")
    values = _placed(rows, ["doc_id"], VALUES, "ner").withColumn("mention_type", F.lit("value"))
    names = without_overlaps(_placed(rows, ["doc_id"], NAMES, "ner"), values).withColumn("mention_type", F.lit("entity"))
    if lexicon is not None:
        chunks = noun_phrases(rows, lexicon, ["doc_id"]).select("doc_id", "text", "start", "end", F.lit("noun_chunk").alias("source"), F.lit("entity").alias("mention_type"))
        names = names.unionByName(without_overlaps(chunks, values.unionByName(names)))
    return values.unionByName(names).select("doc_id.doc_id", "doc_id.sentence_index", F.col("text").alias("surface_form"), "mention_type", "start", "end", "source")


def surface_relations(sents: DataFrame, verbs: DataFrame) -> DataFrame:
    """Verbs of a lexicon (verb) in sentences, extended by a following particle or preposition. The next word is looked up in the sentence's own row."""
    words = F.split(F.lower("text"), r"[^a-z]+")
    both = sents.select("doc_id", "sentence_index", words.alias("_w")).select("doc_id", "sentence_index", F.posexplode(F.transform("_w", lambda w, i: F.struct(w.alias("word"), F.get("_w", i + 1).alias("next")))).alias("pos", "_p"))
    joined = both.select("doc_id", "sentence_index", "pos", "_p.word", "_p.next").join(verbs, F.col("word") == F.col("verb"))
    particle = F.col("next").isin("in", "on", "at", "to", "by", "of", "with", "from", "for", "up", "out", "off", "over")
    return joined.select("doc_id", "sentence_index", "pos", F.when(particle, F.concat_ws(" ", "word", "next")).otherwise(F.col("word")).alias("relation"))


#: Verbs of a lexicon up to which, counted, they are looked up in a sentence's own row.
VERBS = 5_000


def surface_triples(sents: DataFrame, verbs: DataFrame) -> DataFrame:
    """subject-verb-object by pattern around the first verb of each sentence, with a negation flag. Up to ``VERBS`` verbs, counted, are looked up in
    the sentence's own row; more of them meet its words in a join."""
    words = sents.select("doc_id", "sentence_index", "text", F.split(F.regexp_replace("text", r"[.!?]+$", ""), r"\s+").alias("w"))
    verbs = verbs.select("verb").filter("verb is not null").distinct()
    if verbs.limit(VERBS + 1).count() <= VERBS:
        known = [r["verb"] for r in verbs.collect()]  # counted: a bounded list
        placed = F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.lower(x).alias("verb")))
        first = words.withColumn("_v", F.get(F.filter(placed, lambda h: h["verb"].isin(known)), F.lit(0))).filter("_v.pos > 0").select("*", "_v.pos", "_v.verb")
    else:
        hits = words.select("*", F.posexplode("w").alias("pos", "word")).join(verbs, F.lower("word") == F.col("verb"))
        first = hits.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "sentence_index").orderBy("pos"))).filter("_r = 1 and pos > 0")
    side = lambda a, n: F.array_join(F.filter(F.slice("w", a, n), lambda x: ~F.lower(x).isin("not", "never", "no", "does", "did")), " ")
    subject, obj = side(F.lit(1), F.col("pos")), side(F.col("pos") + 2, F.greatest(F.size("w") - F.col("pos") - 1, F.lit(0)))
    out = first.select("doc_id", "sentence_index", subject.alias("subject"), F.col("verb").alias("predicate"), obj.alias("object"), F.col("text").rlike(r"(?i)\b(not|never|no)\b").alias("negated"))
    return out.filter("object <> ''")


def without_overlaps(mentions: DataFrame, taken: DataFrame) -> DataFrame:
    """Mentions (doc_id, start, end) that touch none of ``taken``."""
    t = taken.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return mentions.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")


class _Lower(dict):
    """Lower forms of one character for ``str.translate``: one that is longer stays as it is, and a final sigma is a sigma."""

    def __missing__(self, code: int) -> int:
        low = chr(code).lower()
        self[code] = code if len(low) > 1 else 0x3C3 if low == "\u03c2" else ord(low)
        return self[code]


_LOWER = _Lower()


def _lowered(text: str) -> str:
    """Lower case that keeps every place."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def _matches(words: list[str]) -> Callable[[str, bool, int], Iterator[tuple[int, int, int]]]:
    """A search of one text for many words (in lower case): (place in ``words``, start, end), at most ``most`` of each word, never overlapping itself."""
    import ahocorasick

    tree = ahocorasick.Automaton()
    for i, w in enumerate(words):
        tree.add_word(w, i)
    tree.make_automaton()
    sizes = [len(w) for w in words]

    def search(text: str, bounded: bool, most: int) -> Iterator[tuple[int, int, int]]:
        low, reach, found = _lowered(text), {}, {}
        for last, i in tree.iter(low):
            start, end = last + 1 - sizes[i], last + 1
            if start < reach.get(i, 0) or found.get(i, 0) >= most or bounded and (start and _letter(low[start - 1]) or end < len(low) and _letter(low[end])):
                continue
            reach[i], found[i] = end, found.get(i, 0) + 1
            yield i, start, end

    return search


def _letter(c: str) -> bool:
    """ASCII letters and digits, and what folds to such a letter."""
    return c.isascii() and c.isalnum() or c in "\u0130\u0131\u017f\u212a"


def find_phrases(docs: DataFrame, phrases: DataFrame, most: int = 50, bounded: bool = True, block_phrases: int = 50_000) -> DataFrame:
    """(doc_id, term, start, end) for each place of each phrase (term) in documents (doc_id, text): case-insensitive, with no ASCII letter or digit
    (or what folds to one) before or after it if ``bounded``, at most ``most`` places of a phrase in a document, from the front, never overlapping. Places are code points.

    Up to ``block_phrases`` phrases are counted, then go to the tasks as one automaton, and documents are read in one pass without an
    exchange. More of them meet the documents in blocks of that size, each an automaton of its own, by a shuffle."""
    terms = phrases.select("term").filter("term <> ''").distinct()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, term string, start int, end int"
    given = docs.select("doc_id", "text").filter("text <> ''")

    def places(words: list[str]) -> Callable[[pa.Table | pa.RecordBatch], pa.RecordBatch]:
        forms: dict[str, list[str]] = {}
        for w in words:
            forms.setdefault(_lowered(w), []).append(w)
        search, named = _matches(list(forms)), list(forms.values())

        def found(batch: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            doc, term, start, end = [], [], [], []
            ids = batch.column("doc_id").combine_chunks() if isinstance(batch, pa.Table) else batch.column("doc_id")

            def out() -> pa.RecordBatch:
                rows = [pa.array(doc, pa.int64()), pa.array(term, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                return pa.RecordBatch.from_arrays([ids.take(rows[0]), *rows[1:]], names=["doc_id", "term", "start", "end"])

            for row, text in enumerate(batch.column("text").to_pylist()):
                for i, a, b in search(text, bounded, most):
                    for name in named[i]:
                        doc.append(row), term.append(name), start.append(a), end.append(b)
                if len(doc) > 50_000:
                    yield out()
                    doc, term, start, end = [], [], [], []
            yield out()

        return found

    if terms.limit(block_phrases + 1).count() <= block_phrases:
        words = [r["term"] for r in terms.collect()]  # counted: a bounded list

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = places(words) if words else lambda batch: ()
            for batch in batches:
                yield from found(batch)

        return given.mapInArrow(scan, schema)

    def run(block: pa.Table, tiles: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = places(block["term"].to_pylist())
        for tile in tiles:
            yield from found(tile)

    return meet(terms, given, run, schema, block_rows=block_phrases, tile_rows=256)


def resolved_terms(docs: DataFrame, terms: DataFrame, most: int = 50) -> DataFrame:
    """(doc_id, term, start, end) of all places of the terms, and a row without a place for each that is nowhere in the documents."""
    return terms.select("term").distinct().join(find_phrases(docs, terms, most), "term", "left").select("doc_id", "term", "start", "end")


def dedup_mentions(raws: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """Group (kind, text, source, doc_id, start, end) by lemma key; the canonical form is the most frequent, then longest, then first by name.

    Forms are counted first, with partial sums, and the key of each is made once. ``repeated`` (doc_id, null too) names the documents that may
    hold a place of a form more than once; the places of all others are counted with their forms and not dealt. Without it that is every document: a
    place then meets the number of its form's key in a join, broadcast if the forms are counted to be few, and is dealt by document as plain numbers and counted once."""
    use_checkpoints(raws.sparkSession)
    dealt, once = raws, F.lit(0)
    if repeated is not None:
        again = repeated.select(F.col("doc_id").alias("_d")).distinct().checkpoint()
        dealt, once = None, F.count("start")
        if not again.isEmpty():
            dealt = raws.join(small(again), F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
            raws = raws.join(small(again.withColumn("_again", F.lit(True))), F.col("doc_id").eqNullSafe(F.col("_d")), "left")
            once = F.count(F.when(F.col("_again").isNull(), F.col("start")))
    by_source = raws.groupBy("kind", "text", "source").agg(F.count(F.lit(1)).alias("n"), once.cast("long").alias("once"))  # plain counts first: sets of all rows would be sorted
    forms = by_source.groupBy("kind", "text").agg(F.sum("n").alias("n"), F.sum("once").alias("once"), F.collect_list("source").alias("s")).repartition("kind", "text")
    forms = forms.select("*", dedup_key(F.col("text")).alias("key")).checkpoint().filter("key <> ''")
    merged = forms.groupBy("kind", "key").agg(
        F.min_by("text", F.struct(-F.col("n"), -F.length("text"), "text")).alias("canonical"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("sources"), F.array_sort(F.collect_list("text")).alias("variants"),
        F.sum("once").alias("_once"),
    )
    found = F.col("_once")
    if dealt is not None:
        merged = merged.withColumn("_id", F.monotonically_increasing_id()).checkpoint()
        coded = small(forms.select("kind", "text", "key").join(merged.select("kind", "key", "_id"), ["kind", "key"]).select("kind", "text", "_id").checkpoint())
        dealt = dealt.filter("start is not null").join(coded, ["kind", "text"]).select("_id", "doc_id", "start", "end").repartition("doc_id").distinct()  # the distinct keeps this partitioning
        merged = merged.join(dealt.groupBy("_id").agg(F.count(F.lit(1)).alias("_places")), "_id", "left")
        found = found + F.coalesce("_places", F.lit(0))
    return merged.select(
        "kind", "key", "canonical", "sources", "variants", F.greatest(found, F.lit(1)).alias("mention_count"), (found > 0).alias("literal_span"), (F.col("sources") == F.array(F.lit("llm"))).alias("llm_only")
    )


def surfacing_statistics(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("literal_span").alias("n_literal"), F.count_if("llm_only").alias("n_llm_only"), F.count_if(~F.col("literal_span")).alias("n_implicit"))


def exact_places(occurrences: DataFrame, texts: DataFrame) -> DataFrame:
    """``occurrences`` (doc_id, start, end, ..) with ``text`` set to the exact slice of the document (doc_id, text); offsets are authoritative."""
    source = texts.select("doc_id", F.col("text").alias("_src"))
    return occurrences.drop("text").join(source, "doc_id").withColumn("text", F.substring("_src", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_src")


def cheap_first_union(cheap: DataFrame, proposed: DataFrame) -> DataFrame:
    """(key, text, source, grounded): one row a key; a cheap mention (text) wins over a proposed one (text, grounded) and is grounded."""
    both = cheap.select("text", F.lit("cheap").alias("source"), F.lit(0).alias("_p"), F.lit(True).alias("grounded")).unionByName(proposed.select("text", F.lit("llm").alias("source"), F.lit(1).alias("_p"), "grounded"))
    keyed = both.withColumn("key", fold_key(F.col("text")))
    first = keyed.groupBy("key").agg(F.min(F.struct("_p", "text", "source", "grounded")).alias("_m"))
    return first.select("key", "_m.text", "_m.source", "_m.grounded")


def union_statistics(cheap: DataFrame, proposed: DataFrame) -> DataFrame:
    """One row: cheap mentions, proposed ones, and how many of these the cheap extractor had already."""
    known = cheap.select(fold_key(F.col("text")).alias("key")).distinct().withColumn("_h", F.lit(True))
    found = proposed.withColumn("key", fold_key(F.col("text"))).join(known, "key", "left").agg(F.count(F.lit(1)).alias("llm"), F.count("_h").alias("merged"))
    return cheap.agg(F.count(F.lit(1)).alias("cheap")).join(found)


def batched(rows: DataFrame, n: int, by: str, order: str) -> DataFrame:
    """``rows`` with ``batch``, a number for every ``n`` rows of each ``by`` in ``order``."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / n).cast("int"))


def prompts(batches: DataFrame, by: str, head: str = "Below are %d sentences from a source document, indexed %s.") -> DataFrame:
    """(by, batch, n, prompt): the numbered sentences (sentence_index, text) of each batch below a head that names how many and which."""
    listed = batches.groupBy(by, "batch").agg(F.array_sort(F.collect_list(F.struct("sentence_index", "text"))).alias("_s"))
    numbers = F.array_join(F.transform("_s", lambda x: x["sentence_index"].cast("string")), ", ")
    body = F.array_join(F.transform("_s", lambda x: F.concat(x["sentence_index"].cast("string"), F.lit(": "), x["text"])), "\n")
    return listed.select(by, "batch", F.size("_s").alias("n"), F.concat(F.format_string(head, F.size("_s"), numbers), F.lit("\n\nSentences:\n"), body).alias("prompt"))


_REPLY = "results map<string,struct<mentions:array<struct<surface:string,mention_type:string>>,triples:array<struct<subject:string,predicate:string,object:string,negated:boolean>>>>"


def parsed_replies(replies: DataFrame, batches: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(mentions, triples) of model replies (by, batch, reply): fences off, the JSON object read, numbers of sentences that are no part of
    the batch left out, blank fields too; a mention that is no value is an entity."""
    parsed = replies.select(by, "batch", F.explode(F.from_json(fenced_json(F.col("reply")), _REPLY)["results"]).alias("_i", "_r")).withColumn("sentence_index", F.trim("_i").try_cast("int"))
    inside = parsed.join(batches.select(by, "batch", "sentence_index").distinct(), [by, "batch", "sentence_index"], "left_semi")
    m = inside.select(by, "sentence_index", F.explode("_r.mentions").alias("m"))
    kind = F.lower(F.trim("m.mention_type"))
    mentions = m.select(by, "sentence_index", F.trim("m.surface").alias("surface_form"), F.when(kind == "value", "value").otherwise("entity").alias("mention_type"), F.lit("llm").alias("source")).filter("surface_form <> ''")
    t = inside.select(by, "sentence_index", F.explode("_r.triples").alias("t"))
    triples = t.select(by, "sentence_index", *[F.trim(f"t.{c}").alias(c) for c in ("subject", "predicate", "object")], F.coalesce("t.negated", F.lit(False)).alias("negated"), F.lit("llm").alias("source"))
    return mentions, triples.filter("subject <> '' and predicate <> '' and object <> ''")


def gate_override(gated: DataFrame, labels: DataFrame) -> DataFrame:
    """``gated`` (canonical, kind, bin, reason) after a model's labels (term, label): concepts that passed as classes may turn out to be
    individuals or no terms; a missing label leaves them, relations are never moved."""
    known = labels.groupBy(F.col("term").alias("_t")).agg(F.max("label").alias("_l"))
    asked = (F.col("kind") == "concept") & (F.col("bin") == "class")
    moved = asked & F.coalesce(F.col("_l").isin("individual", "non_concept"), F.lit(False))
    said = F.when(F.col("_l") == "individual", "LLM: named individual").otherwise("LLM: not a domain term")
    joined = gated.join(known, F.col("canonical") == F.col("_t"), "left")
    return joined.withColumn("reason", F.when(moved, said).otherwise(F.col("reason"))).withColumn("bin", F.when(moved, F.col("_l")).otherwise(F.col("bin"))).drop("_t", "_l")


def grounded_in(terms: DataFrame, docs: DataFrame, stop: list[str]) -> DataFrame:
    """``terms`` (term) with ``grounded``: the phrase itself is within a text (text), or all its tokens but stop words are; in lower case, hyphens
    and white space as one blank."""
    use_checkpoints(terms.sparkSession)
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s-]+", " "))
    asked = terms.select("term").distinct().withColumn("_p", norm(F.col("term"))).withColumn("_w", F.array_except(F.split("_p", " "), F.array(*map(F.lit, [*stop, ""])))).checkpoint()
    wanted = asked.select(F.explode(F.array_distinct(F.concat(F.array("_p"), "_w"))).alias("term"))
    seen = find_phrases(docs.select(F.lit(0).alias("doc_id"), norm(F.col("text")).alias("text")), wanted, 1, False).select(F.col("term").alias("_s")).distinct().checkpoint()
    whole = asked.join(seen, F.col("_p") == F.col("_s"), "left_semi").select("term")
    tokens = asked.select("term", F.explode("_w").alias("_t")).join(seen.withColumn("_h", F.lit(1)), F.col("_t") == F.col("_s"), "left").groupBy("term").agg(F.count_if(F.col("_h").isNull()).alias("_n")).filter("_n = 0").select("term")
    hit = whole.unionByName(tokens).distinct().withColumn("grounded", F.lit(True))
    return terms.join(hit, "term", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def merge_mentions(raw: DataFrame) -> DataFrame:
    """Merge (surface_form, mention_type, source, sentence_index, seq) on the lower-cased form; first form stays, a model's type wins."""
    typed = lambda s: F.min_by(F.when(F.col("source") == s, F.col("mention_type")), F.when((F.col("source") == s) & F.col("mention_type").isNotNull(), F.col("seq")))
    return raw.groupBy(F.lower(F.trim("surface_form")).alias("key")).agg(
        F.min_by("surface_form", "seq").alias("surface_form"), F.coalesce(typed("llm"), typed("ner"), F.lit("entity")).alias("mention_type"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("sentence_index")).alias("sentences"),
    )


def merge_triples(raw: DataFrame, mentions: DataFrame) -> DataFrame:
    """Merge raw triples on folded subject, predicate lemma and object; negation sticks; the object's type is looked up."""
    fold = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    keyed = raw.withColumn("_s", fold("subject")).withColumn("_p", lemma(F.trim("predicate"))).withColumn("_o", fold("object"))
    merged = keyed.groupBy("_s", "_p", "_o").agg(
        F.min_by("subject", "seq").alias("subject"), F.min_by("predicate", "seq").alias("predicate"), F.min_by("object", "seq").alias("object"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("sentence_index")).alias("sentence_indices"),
        F.min("sentence_index").alias("sentence_index"), F.bool_or("negated").alias("negated"), F.min("seq").alias("seq"),
    )
    types = mentions.select(fold("surface_form").alias("_o"), F.col("mention_type").alias("object_type")).dropDuplicates(["_o"])
    return merged.join(types, "_o", "left").drop("_s", "_p", "_o")


def triple_statistics(merged: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("sources") == F.array(F.lit(s)))
    return merged.agg(F.count_if("negated").alias("negated"), F.count_if(F.size("sources") > 1).alias("both_sources"), one("dep_parse").alias("dep_only"), one("llm").alias("llm_only"))
