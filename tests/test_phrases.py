"""Noun phrases: places, classes, both ways of meeting the lexicon."""

import random

import pytest

from pyspark.sql import functions as F

from graphloom.operators import phrases, surface

LEXICON = [("the", "D"), ("a", "D"), ("every", "D"), ("big", "A"), ("red", "A"), ("runs", "V"), ("sees", "V"), ("it", "R"), ("of", "P"), ("in", "P"), ("very", "X"), (None, "N"), ("odd", None), ("fast", "X"), ("fast", "A")]


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, class string")


@pytest.mark.parametrize("most", [500_000, 3])
def test_phrases_with_a_small_and_a_large_lexicon(spark, lexicon, most):
    texts = [
        (1, "The big red dog runs. It sees 12 cats, a\tmouse\nhouse of Zoé and the very end"), (2, None), (3, ""), (4, "the the big"), (5, "a a dog's dinner big"), (6, "\U0001f600 the mother-in-law"),
        (None, "fast dog"), (7, "12 big"), (8, "dog,cat"), (8, "dog,cat"),
    ]
    got = phrases.noun_phrases(spark.createDataFrame(texts, "doc_id long, text string"), lexicon, ["doc_id"], lexicon_words=most)
    assert rows(got.filter("doc_id = 1"), "start", "bare_start", "text") == sorted([(0, 4, "The big red dog"), (30, 30, "12 cats"), (39, 41, "a\tmouse"), (47, 47, "house"), (56, 56, "Zoé and"), (73, 73, "end")], key=repr)
    rest = rows(got.filter("doc_id > 1 or doc_id is null"), "doc_id", "text", "start", "bare_start", "end")
    assert rest == sorted([(5, "a dog's dinner", 2, 4, 16), (6, "the mother-in-law", 2, 6, 19), (None, "fast dog", 0, 0, 8), *[(8, "dog", 0, 0, 3), (8, "cat", 4, 4, 7)] * 2], key=repr)


def test_both_ways_agree(spark, lexicon):
    draw = random.Random(8)
    words = [w for w, _ in LEXICON if w] + ["dog", "cat", "7", "tree"]
    texts = [(i % 50, "".join(draw.choice(words) + draw.choice([" ", " ", " ", ", ", "\n"]) for _ in range(draw.randrange(30)))) for i in range(120)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    near, far = (rows(phrases.noun_phrases(d, lexicon, ["doc_id"], lexicon_words=n), "doc_id", "start", "end", "text") for n in (500_000, 2))
    assert near == far and near and all(dict(enumerate(texts))[0] is not None and t == t.strip() for *_, t in near)


def test_concepts_and_mentions_take_phrases(spark, lexicon):
    docs = spark.createDataFrame([(1, "the big dog sees Red Crew")], "doc_id bigint, text string")
    assert ("big dog", 4, 11, "term") in rows(surface.surface_concepts(docs, lexicon=lexicon), "text", "start", "end", "source")
    sents = spark.createDataFrame([(1, 0, "the big dog sees Red Crew in 2 km")], "doc_id bigint, sentence_index int, text string")
    got = rows(surface.surface_mentions(sents, lexicon), "surface_form", "mention_type", "source")
    assert got == [("2 km", "value", "ner"), ("Red Crew", "entity", "ner"), ("the big dog", "entity", "noun_chunk")]


@pytest.mark.parametrize("most", [5_000, 0])
def test_triples_with_few_and_many_verbs(spark, monkeypatch, most):
    monkeypatch.setattr(surface, "VERBS", most)
    sents = spark.createDataFrame([(1, 0, "The pump Feeds the tank."), (1, 1, "runs it feeds"), (1, 2, "The pump does not feeds or runs tanks!"), (2, 0, None), (2, 1, ""), (3, 0, "it runs")], "doc_id long, sentence_index int, text string")
    verbs = spark.createDataFrame([("feeds",), ("runs",), (None,), ("runs",)], "verb string")
    got = rows(surface.surface_triples(sents, verbs), "doc_id", "sentence_index", "subject", "predicate", "object", "negated")
    assert got == [(1, 0, "The pump", "feeds", "the tank", False), (1, 2, "The pump", "feeds", "or runs tanks", True)]


def test_common_words_do_not_meet_the_lexicon(spark, lexicon):
    texts = [(i, "the red dog of tree" + chr(97 + i % 20) * (1 + i // 20)) for i in range(40)] + [(i, "big dog") for i in range(40)] + [(90, "odd fast 3"), (91, "odd fast 3"), (92, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string").filter("text <> ''")
    known = lexicon.filter("word is not null and class is not null").groupBy("word").agg(F.min("class").alias("class"))
    assert rows(phrases._common(d, known, 5), "word", "class") == sorted([("the", "D"), ("red", "A"), ("dog", None), ("of", "P"), ("big", "A")], key=repr)
    assert rows(phrases._common(d, known, 4), "word") == [("dog",)]  # words as common as each other go or stay together
    near, far = (rows(phrases.noun_phrases(d, lexicon, ["doc_id"], lexicon_words=n), "doc_id", "start", "bare_start", "end", "text") for n in (500_000, 5))
    assert near == far and len(near) == 122
