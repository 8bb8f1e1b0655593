"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, jaccard, langid, lattice, negatives, quality_trees, rules, secrets, shards, spelling, token_cache, vantage
from graphloom.llm.shared import crc_fold, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_tiled_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("_k1", "_k2", "_lost")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = bpe.encode(docs, vocab, decoded_col="decoded")
    return decoded.select("doc_id", *bpe.digests(decoded))


def op2_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(crc_fold("doc_id", 5) != 0)
    scored = quality_trees.score(docs, quality_trees.train(docs, labels))
    return scored.select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.shard(table(spark, sf_dir, "documents"), 24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "v_slot")


def op4_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents"), vocab, shared_folder(spark, "token-counts"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.find_secrets(docs, secrets.train(docs)).select("doc_id", *secrets.span_columns())


def op8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.lattice_scores(docs, crc_fold("doc_id", 7) == 2, public_tokenizers.path("piece_bpe_32k.model"))


def op9_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    machines = langid.train(docs.filter(crc_fold("doc_id", 3) != 1))
    found = langid.predict(docs, machines)
    return found.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.letter_runs(table(spark, sf_dir, "documents"), least_length=6)
    code = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(code, F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(code % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.vocabulary(words, 6, 5), 6, 5)


def op12_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("_id") % 100 == 0, label=label)


def op13_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"), F.col("_id") % 20 == 0, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_boosted_quality": op2_boosted_quality,
    "op3_slot_shards": op3_slot_shards,
    "op4_digest_cache": op4_digest_cache,
    "op5_markov_secrets": op5_markov_secrets,
    "op6_tiled_jaccard": op6_tiled_jaccard,
    "op7_line_frequency": op7_line_frequency,
    "op8_lattice": op8_lattice,
    "op9_alignment": op9_alignment,
    "op10_language": op10_language,
    "op11_spelling": op11_spelling,
    "op12_angles": op12_angles,
    "op13_vantage": op13_vantage,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op6_tiled_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1""",
    "op7_line_frequency": rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (SELECT row, unnest(range(1, len(w) - 6)) AS i FROM d),
grams AS (SELECT win.row, i, array_to_string(w[i:i + 7], ' ') AS g FROM win JOIN d USING (row)),
twice AS (SELECT row, i FROM (SELECT *, count(*) OVER (PARTITION BY row, g) AS n FROM grams) WHERE n > 1),
cover AS (SELECT row, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT row, i, lead(i) OVER (PARTITION BY row ORDER BY i) AS nxt FROM twice) GROUP BY 1),
raw AS (SELECT row, source, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
norm AS (SELECT * FROM (SELECT row, source, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS x FROM raw) WHERE x <> ''),
per AS (SELECT source, row, x, sum(len(string_split(x, ' '))) AS nw FROM norm GROUP BY 1, 2, 3),
hot AS (SELECT source, x FROM (SELECT DISTINCT n.source, n.x, d.t FROM norm n JOIN d USING (row)) GROUP BY 1, 2 HAVING count(*) > 25),
gone AS (SELECT row, sum(nw) AS n FROM per JOIN hot ON per.x = hot.x AND per.source IS NOT DISTINCT FROM hot.source GROUP BY 1),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words
  FROM d LEFT JOIN dup USING (row) LEFT JOIN cover USING (row) LEFT JOIN gone USING (row))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
  AND NOT (removed_words > 0 AND (n_words - removed_words < 8 OR n_words - removed_words < 0.4 * n_words)) AS kept
FROM f""",
    "op11_spelling": r"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x] || range(8), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc),
o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
k AS (SELECT id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM o WHERE length(r) >= 6 GROUP BY 1, 2),
y AS (
  SELECT r, c, flatten(list_transform(string_split(id || ':' || r, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END)) AS b FROM k),
h AS (
  SELECT r, c, xor(list_reduce([4294967295::BIGINT] || list_transform(b, lambda x: x::BIGINT), lambda a, x: xor(a // 256, crc[(xor(a % 256, x) + 1)::INT])), 4294967295) AS h FROM y, bits),
w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1),
v AS (
  SELECT word, n, length(word) AS size, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!"#$%&()*+,-./:;<=>?@[]^_{|}') AS one
  FROM w WHERE length(word) >= 6 AND n >= 5),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM v a JOIN v b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.one, b.one) = 1),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY 1),
f AS (
  SELECT v.word, v.n, coalesce(g.n_near, 0)::BIGINT AS n_near,
    CASE WHEN g.top >= 5 * v.n THEN (SELECT min(p.near) FROM p WHERE p.word = v.word AND p.near_n = g.top) END AS form, CASE WHEN g.top >= 5 * v.n THEN g.top END AS form_n
  FROM v LEFT JOIN g USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at AND f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f e ON e.word = r.at AND e.form IS NULL""",
    "op12_angles": """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score FROM e a JOIN e c ON a.row <> c.row WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.row, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.row = p.row AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.k <= 5)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op13_vantage": """
WITH e AS (
  SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.row <> c.row WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
