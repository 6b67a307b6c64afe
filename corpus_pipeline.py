"""The corpus pipeline: each stage works on all documents that the one before it kept.

In every stage null text counts as empty, rows of equal id and text are treated alike, further columns pass
through (the last stage returns its own), and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import line_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from graphloom.llm.queries import model_path
from graphloom.session import materialize


def reject_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far from their language and source go: null and empty texts too.
    Repeated rows stay or go together."""
    return quality_rules.keep_good(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text. Null text becomes the empty text; a repeated
    row counts as its one document, and each is returned."""
    out = line_dedup.drop_common_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingle similarity, the least doc_id stays, with all its rows. Empty texts and rows without
    doc_id link with nothing and stay."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: none, once or twice. Those without words go; repeated rows come
    equally often."""
    return mixing.repeat_taken(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian 32-bit) and their number, with the text that they decode to, row by row: doc_id, lang,
    source, ids, n_tokens and decoded. An empty text has its begin and end."""
    return sentencepiece_codec.encode_documents(docs, model_path()).select("doc_id", "lang", "source", "ids", "n_tokens", "decoded")


STAGES = [
    ("quality_rules", reject_by_quality),
    ("line_dedup", drop_lines),
    ("ngram_join", keep_one_of_each_group),
    ("mix_sources", mix),
    ("sentencepiece", encode),
]
#: The robust estimates, the components and the encoding can't be expressed in SQL; tests hold the stages to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
