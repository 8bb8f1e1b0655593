"""Column expressions against the stated results."""

from pyspark.sql import functions as F

from graphloom.functions import text as X


def one(spark, column, *values, names="t"):
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names.split())).select(column.alias("x")).first()["x"]


def test_year_specs(spark):
    c = lambda spec, y: spark.createDataFrame([(spec, y)], "s string, y int").select(X.year_matches(F.col("y"), F.col("s")).alias("x")).first()["x"]
    assert [c("since 2024", 2024), c("since 2024", 2023), c("2024", 2024), c("2024", 2025), c("2019-2023", 2019), c("2019-2023", 2024), c("before 2020", 1900), c("before 2020", 2021)] == [True, False, True, False, True, False, True, False]
    assert c(None, None) is True and c("2024", None) is False


def test_literals(spark):
    lit = lambda t: one(spark, X.literal_type(F.col("t")), t)
    want = {"47 psi": ("47", "xsd:integer"), "47": ("47", "xsd:integer"), "12%": ("12", "xsd:decimal"), "1,234": ("1234", "xsd:integer"), "3.5": ("3.5", "xsd:decimal"), "3.0": ("3", "xsd:integer"), "2024-05-06": ("2024-05-06", "xsd:date"), "north gate": ("north gate", "xsd:string")}
    for t, w in want.items():
        assert tuple(lit(t)) == w, t
    assert lit("  ") is None


def test_sections_drop_deeper_headings(spark):
    t = "# Whole Numbers\nkeep\n# EXAMPLE 1.1\n144 divided by 12\n## Step\nx\n# Fractions\nkeep too\n# 1.1 EXERCISES\nProblem 1\n## Use Place Value\ny"
    lines = one(spark, X.content_lines(F.col("t"), r"^(#{1,6})\s", r"(?i)EXAMPLE|EXERCISES"), t)
    assert lines == ["# Whole Numbers", "keep", "# Fractions", "keep too"]
    assert one(spark, X.content_lines(F.col("t"), r"^(#{1,6})\s", "EXAMPLE"), "no heading\nat all") == ["no heading", "at all"]


def test_chunks_and_blocks(spark):
    assert [len(x) for x in one(spark, X.sliding_chunks(F.col("t")), "x" * 1500)] == [800, 800, 200]
    assert one(spark, X.sliding_chunks(F.col("t")), "") == []
    assert one(spark, X.packed_paragraphs(F.col("t"), 7), "aa\n\nbb\n\ncccccccccc\n\nd") == ["aa\n\nbb", "cccccccccc", "d"]
    t = "ab\n\n\n\ncd"
    assert all(t[b["start"] :].startswith(b["block"]) for b in one(spark, X.blocks_with_offsets(F.col("t")), t))


def test_keys_and_labels(spark):
    assert one(spark, X.slug(F.col("t")), "I-204 Main") == "i_204_main" and one(spark, X.slug(F.col("t"), ""), "I-204") == "i204"
    assert one(spark, X.canonical_label(F.col("t"), F.lit("concept")), "the water main") == "WaterMain"
    assert one(spark, X.canonical_label(F.col("t"), F.lit("relation")), "dispatched to EMS") == "dispatchedToEMS"
    assert one(spark, X.dedup_key(F.col("t")), "Water  Mains") == "water main"
    assert one(spark, X.kind_gate(F.col("t"), F.lit("concept")), "Engine 7")["bin"] == "individual"
    assert one(spark, X.kind_gate(F.col("t"), F.lit("concept")), "--")["bin"] == "non_concept"


def test_edge_order_and_markdown(spark):
    a = F.array(*map(F.lit, "abcde"))
    assert one(spark, X.edge_order(a), "") == list("abcde") and one(spark, X.edge_order(a, "edges"), "") == list("acedb")
    assert one(spark, X.clean_markdown(F.col("t")), "# Head\n**bold** [link](http://x) `code` <b>x</b>") == "Head\nbold link   <b>x</b>"


def test_exercise_blocks(spark):
    t = "intro\n> TRY IT : 1.1\nmore of it\n\nback\n## EXAMPLE 1.1\n1. a\n### deeper\nb\n## Solution\nc\n## Next\ntext\n 1.1 EXERCISES\n## Practice\nd\n# 1.2 EXERCISES\ne\n# 1.2 Use It\nend"
    assert one(spark, X.without_exercises(F.col("t")), t) == ["intro", "", "back", "## Next", "text", "# 1.2 Use It", "end"]


def test_markdown_rules(spark):
    t = "---\ntitle: x\n---\n<!-- c\nd -->A ***b*** __c__ _d_ &lt;e&gt; &amp; $x+1$ \u2460 $$y\nz$$\n| a | b |\n\n\n\n> quote\n---\nend"
    assert one(spark, X.clean_markdown(F.col("t")), t) == " A b c d <e> &    \n\n\nquote\n\nend".replace("\n\n\n", "\n\n")
    got = one(spark, X.cleaning_statistics(F.col("t")), "# Head\n## EXAMPLE 1\nx\n# 1.1 Next\n**b**")
    assert tuple(got) == (38, 23, 15, 23, 60.5)


def test_sections_report_what_is_dropped(spark):
    got = one(spark, X.section_filter(F.col("t"), r"^(#{1,6})\s", "EXAMPLE|EXERCISES"), "# A\n# EXAMPLE 1\n## S\n# 1.1 EXERCISES\ny")
    assert got["lines"] == ["# A"] and got["dropped"] == ["# EXAMPLE 1", "# 1.1 EXERCISES"]


def test_terms_and_gates(spark):
    assert one(spark, X.clean_surface(X.composed(F.col("t"))), " *\ufb01re\uff11 {x}| ") == "fire1 {x"
    assert one(spark, X.dedup_key(F.col("t")), "Na\u00efve  Caf\u00e9s") == "na\u00efve caf\u00e9"
    assert [one(spark, X.looks_like_term(F.col("t")), t) for t in ("gt", "a|b", "x.png", "&amp", "water", "w", "www.x")] == [False, False, False, False, True, False, False]
    assert [one(spark, X.trimmed_term(F.col("t"), ["two", "it", "of"]), t) for t in ("your  whole number,", "the two", "it")] == ["whole number", None, None]
    gate = lambda t, k: tuple(one(spark, X.kind_gate(F.col("t"), F.lit(k)), t))
    assert gate("see Chapter 3", "concept")[0] == "non_concept" and gate("a_b", "concept")[0] == "non_concept" and gate("step 2 of", "relation") == ("non_concept", "numeric (not a relation)")
    assert gate("divides by", "relation") == ("class", "predicate") and gate("water main", "concept") == ("class", "common-noun phrase")
    assert one(spark, X.fenced_json(F.col("t")), 'so:\n```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}' and one(spark, X.fenced_json(F.col("t")), "none") is None
    assert one(spark, X.merged_unique(F.array(F.lit("A "), F.lit("b")), F.array(F.lit("a"), F.lit(" "), F.lit("C"))), "") == ["A", "b", "C"]
    tags = F.array(F.lit("VERB"), F.lit("NOUN"))
    s = "Crews seal the main at noon."
    assert one(spark, X.knowledge_sentence(F.col("t"), tags), s) and not one(spark, X.knowledge_sentence(F.col("t"), F.array(F.lit("VERB"))), s) and not one(spark, X.knowledge_sentence(F.col("t")), "Figure 3 shows the main at noon today.")


def test_skeleton_parts(spark):
    t = "# Whole Numbers\n1.2 Use Place Value\n# whole numbers\nYou will be able to:\n- name parts\n- Name Parts\n- add them\n\n- not this\nA ray is called a half line. A point is defined as a place. **Line segment:** x"
    assert one(spark, X.topic_list(F.col("t")), t) == ["Use Place Value", "Whole Numbers"]
    assert one(spark, X.objectives(F.col("t")), t) == ["name parts", "add them"]
    assert one(spark, X.defined_terms(F.col("t")), t) == ["half line", "A point", "Line segment"]
    s = one(spark, X.skeleton(X.topic_list(F.col("t")), X.objectives(F.col("t")), X.defined_terms(F.col("t"))), t)
    assert s.startswith("Topics:\n- Use Place Value\n- Whole Numbers\nObjectives:\n- name parts")


def test_skeleton_rules(spark):
    topics = lambda t: one(spark, X.topic_list(F.col("t")), t)
    assert topics("# Key Concepts Review\n# Add $x$ Now\n# One\n# A 12 34 56 B\n## (Prime Factors):\n#Not one\n3.1  Add Whole Numbers \n3.1.2 Not Outline") == ["Add Whole Numbers", "Prime Factors"]
    aims = lambda t: one(spark, X.objectives(F.col("t")), t)
    assert aims("you will be able to:\n\nname parts.\n* add them\n\nnot this") == ["name parts", "add them"]
    assert aims("x\nYou will be able to\n- one\n## Stop\n- two") == ["one"] and len(aims("You will be able to\n" + "\n".join(f"item {i}" for i in range(20)))) == 14
    terms = lambda t: one(spark, X.defined_terms(F.col("t")), t)
    assert terms("We use **important words** here") == [] and terms("**Key Terms:** x **Unit rate:** y **Ratio**: z") == ["Unit rate"]
    assert terms("This is called the unit rate of the line, which is called slope and more.") == ["unit rate", "slope"]
    assert terms("Seven is the name of it. 4: A LINE IS DEFINED AS it.") == ["Seven"]
    label = lambda t, k="concept": one(spark, X.canonical_label(F.col("t"), F.lit(k)), t)
    assert [label(t) for t in ("ABCDEF rule", "their NATO3 plan", "the the cat", "%%", " ", "the", "ABCDEFG x")] == ["ABCDEFRule", "Nato3Plan", "Cat", "%%", "Unnamed", "The", "AbcdefgX"]
    assert [label(t, "relation") for t in ("the EMS3 sends", "Is Part Of", "ISO reads XML")] == ["EMS3Sends", "isPartOf", "ISOReadsXML"]
    assert one(spark, X.context_text(F.col("t"), F.lit("x"), F.array().cast("array<int>")), "fire") == "fire"
    text = "# A\nkeep\n## Try It 3\ngone\n### Deep\ngone\n# Chapter Review\ngone\n# Previews\nkeep"
    assert one(spark, X.content_lines(F.col("t")), text) == ["# A", "keep", "# Previews", "keep"]


def test_windows(spark):
    t = "x" * 100 + " fire " + "y" * 100
    got = one(spark, X.context_text(F.lit("fire"), F.col("t"), F.array(F.lit(101))), t)
    assert got == "fire || " + "x" * 59 + " fire " + "y" * 59
    note = one(spark, X.window_note(F.lit("T"), F.col("t"), F.array(*map(F.lit, "abcd"))), "First part. Second.")
    assert note == "T — a, b, c — First part"
