"""From raw documents to token ids, in stages that each read what the last one kept.

Documents without a language, or surely in another one than they are labelled with, go;
then all but one of each group of near duplicates, then those that hold benchmark
passages; the rest are encoded. Every stage but the last returns the columns of
``documents`` and drops whole rows only.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from larder.llm import bpe, langid, minhash, winnow
from larder.session import Workspace

RANKS = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found and does not contradict their label.

    A null text, or one without a letter, goes; so does a document that the classifier,
    with a score of 0.9 or more, puts into another language than its label says.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less than a twentieth of whose words lie in benchmark passages."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    coded = bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                        same.alias("lossless"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("byte-level BPE", tokenise),
]

#: Neither a fitted classifier nor a tokenizer can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next.

    Null and empty texts are rejected by the first stage. Of repeated rows, and of rows
    that share a doc_id, one stays; rows without a doc_id are near duplicates of nothing
    and are kept if clean. An empty table gives an empty result. Columns beside those of
    ``documents`` pass through until the last stage, whose columns are doc_id, lang,
    source, n_tokens, ids and lossless.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
