"""A training-data pipeline over documents: rules, exact and near duplicates, mixing, tokens.

Every stage works on all that its predecessor kept and returns the columns of documents, whatever they are called; the
last returns doc_id, the ids and their digests. Each result is written to the shared folder and read again, so a lost
executor costs one stage's tasks at most.

Nulls: a null or empty text has no words and goes with the quality rules; null lang and source are groups, and sources,
of their own; a null doc_id is an id like any other, last in order. Rows equal in every column are one exact duplicate
group, of which one row stays, so none reaches the later stages twice; the mix then gives a row for each copy it takes.
Very long texts are read whole. Ties of length keep the smallest doc_id. An empty table, or one of which the rules keep
nothing, gives no rows in any stage. The output shard of the mix is the order of its rows in the written table; as a stage returns
the columns of documents only, its number is given by quire.llm.mixing.deal(shard_column=...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import staged, table
from quire.llm.exact_dedup import exact_dedup
from quire.llm.mixing import deal
from quire.llm.pieces import encoded
from quire.llm.quality_rules import filter_documents
from quire.llm.simhash import near_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return filter_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a row for each copy taken, in shuffled output shards."""
    return deal(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with the digests of ids and of the decoded text."""
    return encoded(docs, ids=True).select("_doc.doc_id", "tokens.*")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

#: Iterated estimates, components and seeded draws: not expressible in SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, f"pipeline_{name}")
    return docs
