"""Corpus pipeline: reject poor documents, drop exact and near copies, replace personal data, pack what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane.llm import digest_index, ngram_join, ordinal, packing, surrogates
from latelane.llm.common import read, unused, without
from latelane.llm.queries import LEAST_TAIL, SEQUENCE_WORDS, SURROGATE_KEY
from latelane.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, gives the highest grade with enough probability.

    Null and empty texts are scored like others, as texts without words; rows that repeat or have no id too.  An empty
    table stays empty.
    """
    model = ordinal.train(docs, read(spark, sf_dir, "labels"), ordinal.grade_of_labels())
    return ordinal.select(docs, model, LEAST_TAIL)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal documents: of texts that differ only in white space, the row with the smallest id, null ids last.

    Null and empty texts are equal; of rows that repeat id and text one stays.  An empty table stays empty.
    """
    return digest_index.DigestIndex(spark).keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id, null ids last, of each group of near copies.  Rows are told apart by their place, not their id.

    Null and empty texts have no shingles and stay.  An empty table stays empty.
    """
    place, = unused(docs.columns, "place")
    placed = materialise(docs.withColumn(place, F.monotonically_increasing_id()), "near_placed")
    found = ngram_join.join(placed, key=place).select(F.col(place).alias("at"), F.col("component_id").alias("group"))
    rows = placed.select(F.col(place).alias("at"), "doc_id")
    named = materialise(found.join(rows, "at").select("at", "doc_id", "group"), "near_named")
    first = named.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "at")).alias("first"))
    # Both sides are shuffled for this join, so AQE splits the partitions of a large group.
    gone = named.join(first, "group").filter(F.col("at") != F.col("first.at")).select(F.col("at").alias(place))
    return without(placed, materialise(gone, "near_copies_gone"), [place]).drop(place)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the text, null where that is.

    Null and empty texts stay as they are, rows that repeat or have no id are treated like others.  An empty table stays empty.
    """
    return surrogates.redact(docs, SURROGATE_KEY).withColumn("n_chars", F.char_length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their texts and their bins of ``SEQUENCE_WORDS`` words.

    A source, and a group of equal texts, is at most once in a bin.  The pieces of one ``row_place`` put together are the
    document's text.  Null and empty texts are a piece of no words; rows that repeat or have no id have pieces of their own.  An
    empty table has no pieces.
    """
    return packing.pack_texts(docs, SEQUENCE_WORDS)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("redact", redact), ("pack", pack)]

#: A fitted model decides the first stage, so SQL cannot express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
