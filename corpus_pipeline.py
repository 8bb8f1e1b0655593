"""A training-data pipeline: five stages over ``documents``, each one operator of ``graphloom.llm``.

Quality rules drop documents and take boilerplate lines out, the Jaccard join keeps one document of
each group of near copies, decontamination drops documents that hold test items, secret scans replace
each secret by a mark, and BPE encoding turns what is left into token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, jaccard, rules, secrets
from graphloom.llm.shared import cleared, shared_folder
from graphloom.storage import remove


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(docs, secrets.train(docs), redact="[secret]").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return encoded.select("doc_id", "lang", "source", *bpe.digests(encoded), F.col("ids"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the Markov scan, the alignment or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and what a stage
    needed on the way, its input included, is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name.replace(" ", "-"))
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
