"""Column expressions over text: cleaning, keys, labels, literals and lists."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What the markdown cleaner takes out or keeps, in this order (pattern, replacement).
MARKDOWN_RULES = [
    (r"(?sd)\A---\s*\n.*?\n---\s*\n", ""),
    (r"(?s)<!--.*?-->", " "),
    (r"(?s)```.*?```", " "),
    (r"`[^`\n]*`", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"(?md)^\|.*\|.*$", ""),
    (r"(?md)^#{1,6}\s+", ""),
    (r"(?md)^>+\s*", ""),
    (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"),
    (r"_{1,3}([^_\n]+)_{1,3}", "$1"),
    ("&gt;", ">"),
    ("&lt;", "<"),
    ("&amp;", "&"),
    ("&nbsp;", " "),
    (r"(?s)\$\$.*?\$\$", " "),
    (r"\$[^$\n]+\$", ""),
    ("[\u2460-\u2469]", ""),
    (r"(?md)^\s*---\s*$", ""),
    (r"\n{3,}", "\n\n"),
]
#: Beginnings of headings whose block is left out, of a numbered section, and of lines that begin other blocks.
SKIPPED_HEADINGS = [
    r"EXAMPLE\s+\d", "Solution", r"HOW TO\b", r"BE PREPARED\b", "MANIPULATIVE MATHEMATICS", "Learning Objectives?", "Practice Makes Perfect", "Writing Exercises?", "Everyday Math",
    "Self Check", r"Practice\s+Test", r"Review\s+Exercises?", r"Key\s+(?:Concepts?|Terms?|Takeaways?)", r"Chapter\s+(?:Review|Outline)", r"TRY IT\b",
]
NUMBERED_SECTION = r"(?i)^#{1,6}\s+\d+\.\d+\s+(?!EXERCISES)\S"
EXERCISE_LINE = r"(?i)^\s*\d+\.\d+\s+EXERCISES\b"
QUOTED_TASK = r"(?i)^\s*>+\s*(?:TRY IT|HOW TO)\b"
#: Beginnings of sentences that state no fact.
NOISE_STARTS = [r"Figure\s+\d", r"Step\s+\d", r"Chapter\s+\d", r"Solution\b", r"This\s+OpenStax\b", r"http\S+", r"\d{1,3}\.\s", r"[A-Z]\s+[A-Z]\b"]
#: Words that make a numbered term a label of the document.
DOCUMENT_WORDS = ["chapter", "page", "section", "figure", "fig", "table", "example", "exercise", "exercises", "step", "solution", "appendix", "part", "problem", "unit"]
#: Entity names left over when a parser splits an entity, and words that end or begin no term.
ENTITY_NAMES = ["gt", "lt", "amp", "quot", "nbsp", "apos"]
#: Leading articles and determiners that labels and terms lose.
ARTICLES = ["the", "a", "an", "this", "that", "these", "those"]
#: Words that labels lose at their beginning.
LABEL_LEADING = ["a", "an", "the", "this", "that", "these", "those", "its", "their", "his", "her", "our", "your", "some", "any"]
#: Words of headings that are scaffolding and no topic, of headings whose sections are left out, and ends of a defined term.
HEADING_NOISE = [
    "example", "solution", r"try\s*it", r"how\s*to", r"be\s*prepared", r"manipulative\s*mathematics", "exercise", "exercises", r"chapter\s*outline", r"learning\s*objectives", r"key\s*concepts", r"key\s*terms",
    "glossary", r"self\s*check", "practice", "answers?", "step", "review", r"everyday\s*math",
]
EXCLUDED_SECTIONS = [
    "example", "solution", r"try\s*it", r"how\s*to", r"be\s*prepared", r"manipulative\s*mathematics", "exercises?", r"practice(\s*makes\s*perfect)?", r"self\s*check", "answers?", r"chapter\s*(review|practice\s*test)",
    r"review\s*exercises?",
]
CLAUSE_ENDS = ["[.,;:]", " and ", " or ", " which ", " that ", " when ", " because ", " so ", r"\bof\b", " if "]
#: Determiners and pronouns that begin no term.
LEADING = [*ARTICLES, "my", "your", "his", "her", "its", "our", "their", "some", "any", "each", "every", "no", "all", "both", "which", "what", "whose", "it", "he", "she", "they", "we", "you", "i", "another", "such"]


def clean_markdown(text: Column) -> Column:
    """Markup, code, formulas and table rows out, entities decoded, in a fixed order."""
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), MARKDOWN_RULES, text)


def cleaning_statistics(text: Column) -> Column:
    """struct of characters at first, without exercise blocks, without markup, how many are gone, and in percent."""
    less = F.array_join(without_exercises(text), "\n")
    n = [F.length(x) for x in (text, less, clean_markdown(less))]
    names = ("original_chars", "after_exercise_removal", "after_markdown_clean")
    return F.struct(*[x.alias(c) for x, c in zip(n, names, strict=True)], (n[0] - n[2]).alias("chars_removed"), F.bround(100 * (1 - n[2] / n[0]), 1).alias("pct_removed"))


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """Compatibility forms (ligatures, full-width letters) as plain ones. Only rows beyond ASCII bring text to Python."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _composed(F.when(odd, text))).otherwise(text)


def clean_surface(text: Column) -> Column:
    """White space collapsed, edge punctuation off; give it :func:`composed` text where that may hold compatibility forms."""
    edge = r"[\s\"'`.,;:!?()\[\]{}<>|*#-]+"
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), f"^{edge}|{edge}$", "")


def lemma(word: Column) -> Column:
    """A lower-case word without its regular plural or verb ending."""
    w = F.lower(word)
    return (
        F.when(w.rlike("(ss|us|is)$"), w)
        .when(w.rlike("ies$") & (F.length(w) > 4), F.regexp_replace(w, "ies$", "y"))
        .when(w.rlike("(xes|ses|ches|shes|zes)$"), F.regexp_replace(w, "es$", ""))
        .when(w.rlike("s$") & (F.length(w) > 3), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def dedup_key(surface: Column) -> Column:
    """Lemmas of the words, joined; the lower-cased surface if there are none."""
    words = F.filter(F.split(F.lower(F.trim(surface)), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    key = F.array_join(F.transform(words, lemma), " ")
    return F.when(key != "", key).otherwise(F.lower(F.trim(surface)))


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def fold_key(text: Column) -> Column:
    """Hyphens and white space count as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[-\s]+", " "))


def slug(text: Column, join: str = "_") -> Column:
    """Runs of other characters become ``join``; ``compact`` style is ``join=''``."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", join), f"^{join}+|{join}+$" if join else "^$", "")


def canonical_label(surface: Column, kind: Column) -> Column:
    """PascalCase for concepts, camelCase for relations; words of up to 6 capitals stay; leading articles and possessives go unless they
    are all there is. A surface without letters and digits is its own label, a blank one ``Unnamed``."""
    words = F.regexp_extract_all(surface, F.lit("[A-Za-z0-9]+"), F.lit(0))
    content = F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(LABEL_LEADING), None).otherwise(i)), lambda i: i.isNotNull())
    kept = F.when(F.size(content) > 0, F.slice(words, F.get(content, F.lit(0)) + 1, F.size(words))).otherwise(words)
    title = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))
    cap = lambda w: F.when(w.rlike("^[A-Z]{1,6}$"), w).otherwise(title(w))
    small = lambda w: F.when(w.rlike("^(?=.*[A-Z])[A-Z0-9]{1,6}$"), w).otherwise(F.lower(w))
    camel = F.transform(kept, lambda w, i: F.when(i == 0, small(w)).otherwise(cap(w)))
    label = F.array_join(F.when(kind == "relation", camel).otherwise(F.transform(kept, cap)), "")
    return F.when(F.size(words) > 0, label).otherwise(F.coalesce(F.nullif(F.trim(surface), F.lit("")), F.lit("Unnamed")))


def literal_type(surface: Column) -> Column:
    """struct(value, datatype) of a literal: percent and decimal, unit or thousands integer, ISO date, else string; null if blank."""
    s = F.trim(surface)
    number = F.regexp_replace(F.regexp_extract(s, r"^([+-]?[0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "")
    whole = F.regexp_replace(number, r"\.0+$", "")
    typed = lambda value, kind: F.struct(value.alias("value"), F.lit(f"xsd:{kind}").alias("datatype"))
    return (
        F.when(s.isNull() | (s == ""), F.lit(None))
        .when(s.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?\s*%$"), typed(number, "decimal"))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), typed(s, "date"))
        .when(s.rlike(r"^[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.0+)?(\s+[A-Za-z/]+)?$"), typed(whole, "integer"))
        .when(s.rlike(r"^[+-]?[0-9]+\.[0-9]+(\s+[A-Za-z/]+)?$"), typed(number, "decimal"))
        .otherwise(typed(s, "string"))
    )


def year_bounds(spec: Column) -> tuple[Column, Column]:
    """First and last year of ``2024``, ``2019-2023``, ``since Y`` or ``before Y``; null without a year."""
    first, second = F.regexp_extract(spec, r"([0-9]{4})", 1).try_cast("int"), F.regexp_extract(spec, r"[0-9]{4}\s*-\s*([0-9]{4})", 1).try_cast("int")
    low = F.when(first.isNotNull() & spec.rlike("(?i)before"), F.lit(1900)).otherwise(first)
    return low, F.when(first.isNotNull() & spec.rlike("(?i)since"), F.year(F.current_date())).otherwise(F.coalesce(second, first))


def year_matches(year: Column, spec: Column) -> Column:
    """Whether a year is within a spec's bounds; a null spec passes all, a null year never matches another."""
    low, high = year_bounds(spec)
    return spec.isNull() | F.coalesce(year.between(low, high), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences in order; white space after an end mark parts them."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def knowledge_sentence(sentence: Column, tags: Column | None = None) -> Column:
    """Begins like a fact, has letters and six tokens or more (words and marks); with ``tags``, word classes from
    an extractor, also a verb and a noun."""
    text = F.trim(sentence)
    ok = ~text.rlike("(?i)^(?:" + "|".join(NOISE_STARTS) + ")") & text.rlike("[A-Za-z]") & (F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) >= 6)
    return ok if tags is None else ok & F.array_contains(tags, "VERB") & F.arrays_overlap(tags, F.array(F.lit("NOUN"), F.lit("PROPN")))


def sliding_chunks(text: Column, size: int = 800, overlap: int = 150) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the last; the last one may be short."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def packed_paragraphs(text: Column, chars: int) -> Column:
    """Paragraphs joined greedily to chunks of at most ``chars`` characters; a longer paragraph is a chunk by itself."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["open"] == "", p).otherwise(F.concat(a["open"], F.lit("\n\n"), p))
        full = (a["open"] != "") & (F.length(joined) > chars)
        return F.struct(F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"]))


def blocks_with_offsets(text: Column) -> Column:
    """Blank-line blocks with the place in the text where each begins."""
    parts = F.split(text, "\n\n")
    placed = F.aggregate(
        parts,
        F.struct(F.array().cast("array<struct<start:int,block:string>>").alias("out"), F.lit(0).alias("at")),
        lambda a, p: F.struct(F.array_append(a["out"], F.struct(a["at"].alias("start"), p.alias("block"))).alias("out"), (a["at"] + F.length(p) + 2).alias("at")),
        lambda a: a["out"],
    )
    return F.filter(placed, lambda b: F.trim(b["block"]) != "")


def section_filter(text: Column, heading: str, dropped: str) -> Column:
    """struct(lines, dropped): lines outside sections whose heading matches ``dropped``, deeper subsections included, and the
    headings of the sections left out.

    ``heading`` is a pattern whose first group's length is the level. State: the level of the open dropped section, 0 if none."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("lines"), none.alias("dropped"), F.lit(0).alias("level"))

    def step(a: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, heading, 1))
        free = (level > 0) & ((a["level"] == 0) | (level <= a["level"]))
        hit = free & line.rlike(dropped)
        opened = F.when(hit, level).when(free, 0).otherwise(a["level"])
        return F.struct(
            F.when(opened == 0, F.array_append(a["lines"], line)).otherwise(a["lines"]).alias("lines"), F.when(hit, F.array_append(a["dropped"], line)).otherwise(a["dropped"]).alias("dropped"), opened.alias("level")
        )

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: F.struct(a["lines"].alias("lines"), a["dropped"].alias("dropped")))


#: Sections of worked examples, exercises and activities, by their headings.
EXCLUDED = r"(?i)\b(" + "|".join(EXCLUDED_SECTIONS) + r")\b"
HEADING = r"^(#{1,6})\s+\S"


def content_lines(text: Column, heading: str = HEADING, dropped: str = EXCLUDED) -> Column:
    return section_filter(text, heading, dropped)["lines"]


def clean_phrase(text: Column) -> Column:
    """White space collapsed, punctuation at the edges off."""
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"""^[.,;:!?()\[\]{}"']+|[.,;:!?()\[\]{}"']+$""", ""))


def topic_title(heading: Column) -> Column:
    """True for headings of 2 to 9 words that are no scaffolding, hold no markup and are letters and blanks for 85 % at least."""
    noise = r"(?i)\b(" + "|".join(HEADING_NOISE) + r")\b"
    letters = F.length(F.regexp_replace(heading, r"[^\p{L}\s]", "")) / F.greatest(F.length(heading), F.lit(1))
    return (heading != "") & ~heading.rlike(noise) & ~heading.rlike(r"[$\\{}|=^_]") & F.regexp_count(heading, F.lit("[A-Za-z]+")).between(2, 9) & (letters >= 0.85)


def looks_like_term(text: Column) -> Column:
    """A term has two characters and two letters in a row at least, and is no markup, address, entity or file name."""
    low = F.lower(text)
    junk = low.isin(ENTITY_NAMES) | text.contains("|") | low.rlike("&[a-z]{2,5};?") | text.rlike(r"^(#|!|<|http|www\.|img-|&)") | text.rlike(r"\.(png|jpg|jpeg|gif|svg)$")
    return (F.length(text) >= 2) & text.rlike("[A-Za-z]{2,}") & ~junk


def trimmed_term(text: Column, stop_words: list[str]) -> Column:
    """The term without leading determiners and pronouns and without punctuation at its edges; null if only stop words are left."""
    words = F.split(clean_surface(text), " ")
    first = F.get(F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(LEADING), None).otherwise(i)), lambda i: i.isNotNull()), F.lit(0))
    kept = F.when(first.isNotNull(), F.slice(words, first + 1, F.size(words)))
    content = F.exists(kept, lambda w: w.rlike("[A-Za-z]{2,}") & ~F.lower(w).isin(stop_words))
    return F.when(content, clean_surface(F.array_join(kept, " ")))


def kind_gate(text: Column, kind: Column) -> Column:
    """struct(bin, reason): classes, individuals (a particular with a digit) and non-concepts. Relations lose only debris and digits."""
    out = lambda b, r: F.struct(F.lit(b).alias("bin"), F.lit(r).alias("reason"))
    relation, digit = F.coalesce(kind == "relation", F.lit(False)), text.rlike("[0-9]")
    label = digit & F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, DOCUMENT_WORDS)))
    return (
        F.when(~F.coalesce(text.rlike("[A-Za-z]"), F.lit(False)), F.when(relation, out("non_concept", "no letters")).otherwise(out("non_concept", "no letters (pure symbol/number)")))
        .when(text.rlike(r"[\\${}^_|<>&]"), out("non_concept", "LaTeX/markup debris"))
        .when(relation & digit, out("non_concept", "numeric (not a relation)"))
        .when(relation, out("class", "predicate"))
        .when(label, out("non_concept", "numbered document-structure label"))
        .when(digit, out("individual", "contains a numeric value (a particular)"))
        .otherwise(out("class", "common-noun phrase"))
    )


def edge_order(items: Column, mode: str = "observed") -> Column:
    """Window order: as given, or with ``mode='edges'`` the strongest at both ends."""
    if mode == "observed":
        return items
    n = F.size(items)
    front = F.filter(items, lambda x, i: i % 2 == 0)
    back = F.reverse(F.filter(items, lambda x, i: i % 2 == 1))
    return F.when(n > 2, F.concat(front, back)).otherwise(items)


def envelope(source: Column, key: Column, text: Column) -> Column:
    """Untrusted text with its provenance around it."""
    return F.format_string('<untrusted source="%s" id="%s">\n%s\n</untrusted>', source, key.cast("string"), text)


def without_exercises(text: Column) -> Column:
    """Lines outside exercises, worked examples and end-of-section blocks.

    State: content, or skipping: after a bare exercise line up to the next numbered section, under a skipped heading up to a heading
    of its depth or above, or after a quoted task up to a blank line."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("content").alias("mode"), F.lit(0).alias("depth"))
    opens = r"(?i)^#{1,6}\s+(?:" + "|".join(SKIPPED_HEADINGS) + ")"

    def step(a: Column, line: Column) -> Column:
        depth, was = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1)), a["mode"]
        ends = (
            F.when(was == "section", line.rlike(NUMBERED_SECTION)).when(was == "heading", (depth > 0) & (depth <= a["depth"])).when(was == "paragraph", F.trim(line) == "").otherwise(True)
        )
        hit = (was.isin("content", "heading")) & ends & line.rlike(opens)
        mode = F.when(line.rlike(EXERCISE_LINE), "section").when(hit, "heading").when((was == "content") & line.rlike(QUOTED_TASK), "paragraph").when(ends, "content").otherwise(was)
        return F.struct(F.when(mode == "content", F.array_append(a["out"], line)).otherwise(a["out"]).alias("out"), mode.alias("mode"), F.when(hit, depth).otherwise(a["depth"]).alias("depth"))

    return F.aggregate(F.split(text, "\n"), start, step, lambda a: a["out"])


def distinct_folded(items: Column) -> Column:
    """Items without those that equal an earlier one in lower case; order kept."""
    low = F.transform(items, lambda x: F.lower(F.trim(x)))
    return F.filter(items, lambda x, i: F.array_position(low, F.lower(F.trim(x))) == i + 1)


def topic_list(text: Column) -> Column:
    """Outline lines (``1.2 Title``), then headings, that read as topics; the first of each name."""
    titles = lambda head: F.regexp_extract_all(text, F.lit(rf"(?md)^{head}\s+(.+?)\s*$"), F.lit(1))
    found = F.transform(F.concat(titles(r"\d+\.\d+"), titles("#{1,6}")), clean_phrase)
    return distinct_folded(F.filter(found, topic_title))


def objectives(text: Column, reach: int = 14) -> Column:
    """Lines within ``reach`` lines after one with "you will be able to", bullets off, up to a heading or a blank line after the first of them."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("left"), F.lit(0).alias("got"))

    def step(a: Column, line: Column) -> Column:
        cue, bare = F.lower(line).contains("you will be able to"), F.trim(F.regexp_replace(line, r"^\s+", ""))
        item = clean_phrase(F.regexp_replace(bare, r"^[-*•]\s*", ""))
        stop = bare.startswith("#") | ((bare == "") & (a["got"] > 0))
        take = ~stop & (a["left"] > 0) & (item != "")
        left = F.when(cue, F.lit(reach)).when(stop, F.lit(0)).otherwise(F.greatest(a["left"] - 1, F.lit(0)))
        return F.struct(F.when(take, F.array_append(a["out"], item)).otherwise(a["out"]).alias("out"), left.alias("left"), F.when(cue, 0).when(take, a["got"] + 1).otherwise(a["got"]).alias("got"))

    return distinct_folded(F.aggregate(F.split(text, r"\r\n|[\r\n]"), start, step, lambda a: a["out"]))


def defined_terms(text: Column) -> Column:
    """Terms of "is called X" up to the end of its clause, "X is defined as" or "X is the name", and bold "**Term:**" with its
    colon inside; one to four words with a small letter, the first of each."""
    all_of = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(1))
    bold = F.filter(F.transform(all_of(r"\*\*([^*]+?)\*\*"), F.trim), lambda b: b.endswith(":") & ~b.rlike(r"(?i)\b(" + "|".join(HEADING_NOISE) + r")\b"))
    found = F.concat(
        all_of(rf"(?i)\b(?:is|are)\s+called\s+(?:(?:the|an?)\s+)?([a-z][a-z\- ]{{2,40}}?)(?={'|'.join(CLAUSE_ENDS)})"),
        all_of(r"(?i)\b([a-z][a-z\- ]{2,40}?)\s+(?:is|are)\s+(?:defined as|the name)\b"),
        bold,
    )
    clean = F.transform(found, clean_phrase)
    return distinct_folded(F.filter(clean, lambda t: (t != "") & F.size(F.split(t, r"\s+")).between(1, 4) & t.rlike("[a-z]")))


def skeleton(topics: Column, aims: Column, terms: Column, cap: int = 80) -> Column:
    """The first ``cap`` topics, objectives and terms as one text."""
    part = lambda name, items: F.concat(F.lit(name + ":\n"), F.array_join(F.transform(F.slice(items, 1, cap), lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.concat_ws("\n", part("Topics", topics), part("Objectives", aims), part("Terms", terms))


def context_text(surface: Column, source: Column, starts: Column, n: int = 3, width: int = 60, ends: Column | None = None) -> Column:
    """The surface and up to ``n`` windows of ``width`` characters around its places; the surface alone if it has none."""
    places = F.slice(F.transform(starts, lambda s: F.struct(s.alias("s"), (s + F.length(surface)).alias("e"))) if ends is None else F.arrays_zip(starts.alias("s"), ends.alias("e")), 1, n)
    at = lambda p: F.greatest(p["s"] - width, F.lit(0))
    window = lambda p: F.trim(F.regexp_replace(F.substr(source, at(p) + 1, p["e"] + width - at(p)), r"\s+", " "))
    return F.when(F.coalesce(F.size(places), F.lit(0)) > 0, F.concat(surface, F.lit(" || "), F.array_join(F.transform(places, window), " ... "))).otherwise(surface)


def search_row(paper: Column) -> Column:
    """struct(id, title, authors, year, citations, abstract_snippet) of a paper: its first three authors and the first 300 characters of its abstract."""
    return F.struct(
        paper["id"].alias("id"), paper["title"].alias("title"), F.slice(F.coalesce(paper["authors"], F.array().cast("array<string>")), 1, 3).alias("authors"), paper["year"].alias("year"),
        F.coalesce(paper["citations"], F.lit(0)).alias("citations"), F.substring(F.coalesce(paper["abstract"], F.lit("")), 1, 300).alias("abstract_snippet"),
    )


def window_note(title: Column, abstract: Column, authors: Column) -> Column:
    """A compact note: title, first three authors, first sentence of the abstract, cut to 300 characters."""
    first = F.substring(F.split(abstract, r"\. ")[0], 1, 300)
    return F.concat_ws(" — ", title, F.array_join(F.slice(authors, 1, 3), ", "), first)


def fenced_json(reply: Column) -> Column:
    """The JSON object in a model's reply: code fences off, else from the first to the last brace; null if there is none."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(reply), r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```$", ""))
    found = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def merged_unique(*lists: Column) -> Column:
    """Scope terms of several lists: trimmed, blanks out, the first of each name whatever its case."""
    items = F.filter(F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda x: F.trim(x)), lambda x: x != "")
    return distinct_folded(items)


def matches_with_offsets(text: Column, pattern: str) -> Column:
    """array of struct(text, start, end): what ``pattern`` (never empty, one group around it at most) matches, with places in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    start = F.struct(F.array().cast("array<struct<text:string,start:int,end:int>>").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["gap"]
        end = begin + F.length(x["m"])
        return F.struct(F.array_append(a["out"], F.struct(x["m"].alias("text"), begin.alias("start"), end.alias("end"))).alias("out"), end.alias("at"))

    pairs = F.transform(found, lambda m, i: F.struct(m.alias("m"), F.get(between, i).alias("gap")))
    return F.aggregate(pairs, start, step, lambda a: a["out"])
