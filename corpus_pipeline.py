"""From raw documents to token ids: five stages, each calling one operator of tidemark.llm.

Every stage works on all that the one before it kept, and all but the last return the columns
of documents. Nulls, empty texts, repeated rows, empty tables and extra columns are handled as
the operators' modules say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_codec, decontaminate, lang_id, simhash_ball, weak_quality
from tidemark.llm.shared import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay."""
    return lang_id.keep(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality probability is one half or more, and that pass the base rules, stay."""
    return weak_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash_ball.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, however long the rest of them is."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"), twentieths=0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_codec.encode(docs.select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither the classifier nor the estimation nor BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents; what each kept is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
