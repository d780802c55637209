"""From documents to token codes: the stages of a training corpus, in order.

Each stage takes all rows its predecessor kept and returns a DataFrame; between stages the
rows are written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemeter.llm import bpe, language_id, line_dedup, mixing, near_dedup
from grovemeter.llm.common import table
from grovemeter.scratch import stage as written

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
PIECES_FILE = public_tokenizers.path("piece_bpe_32k.model")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, a NULL language filled in; the others go.

    Those are texts that are NULL or without a letter, and other scripts or noise. Repeated rows
    stay; an empty table stays empty.
    """
    return language_id.keep_identified(docs, PIECES_FILE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; emptied ones go."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document taken twice is there twice."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and the SHA-256 of what the ids decode to."""
    coded = bpe.encode_with_check(docs.select("doc_id", "lang", "source", "text"), BPE_FILE)
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_documents),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Sampling, the language model and byte-pair codes have no SQL form; a test runs every stage
#: beside a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
