"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every stage's result as
Parquet to the shared folder and rereads it as the next one's docs. All but the last return the
columns of documents. Rows with one doc_id count as one document.

Defined results: rows with a null doc_id go through all stages and are copies of nothing; null and empty
texts are documents without words, which the classifier judges like any others and which end as their end id alone. Repeated
rows stay repeated up to the packing. Empty tables give no rows; without labels nothing is rejected. Columns beyond
those of documents pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import line_spread, mixing, ngram_join, packing, rule_ensemble
from lynceus.llm.columns import cut, table

#: Ids of dropped copies up to this number are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not reject."""
    return rule_ensemble.keep_good(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sources share."""
    return line_spread.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id."""
    groups = ngram_join.linked(docs)
    copies = cut(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    return docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: each at least once, those of small sources more often."""
    return mixing.remixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]
#: SQL can't express the classifier or the tokenizer; tests/llm/test_pipeline.py holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
