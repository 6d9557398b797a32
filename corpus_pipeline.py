"""From documents to token ids: language, near duplicates, repeated passages, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. SQL can't express the stages; the
tests hold the Jaccard join, decontamination, chunks and BPE against brute force, and the whole against planted cases.

Null, empty and blank texts have no letter and go in the first stage; where later stages are given them, they stay as they are,
but blank ones that the second leaves alone. Rows with a null doc_id pass the joins untouched. Repeated rows are equal texts with
one id: they have the same fate, and all of them stay or go. Very long texts are worked through in parts. Empty tables give
empty tables. Columns that operators use for their own are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwise.llm import bpe, decontaminate, jaccard, language, substrings
from tarnwise.llm.common import materialize

#: Posterior below which a document's language counts as unknown.
SURE = 0.5
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is more likely than all others together, go. The labelled documents teach, about 4,000 of each language.

    If no document has a letter and a language, there is none to tell apart, and all documents with a letter stay.
    """
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    if lettered.where(F.col("lang").isNotNull()).isEmpty():
        return lettered
    found = language.identify(docs, docs.select("doc_id", "text", "lang"), prefix="__")
    return found.where((F.col("__lang_pred") != "und") & (F.col("__score") >= SURE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the least doc_id stays."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut from the later texts; documents of which nothing but white space is left go."""
    left = substrings.dedupe(docs, prefix="__new_").where((F.col("__new_n_spans") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that consist of little else go."""
    left = decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    return bpe.tokenize(docs, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", cut_benchmark),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
