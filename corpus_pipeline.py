"""The corpus pipeline: five stages over documents, each a training-data operator.

Edge cases, for each stage: an empty table gives an empty one; repeated rows are
rows of their own until near-dedup; extra columns, whatever their names, are
carried whole up to mixing; null doc_id and null source are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm.common import forget, table, written
from panelforge.llm.language_id import keep_identified
from panelforge.llm.line_dedup import deduplicated
from panelforge.llm.mixing import mixed
from panelforge.llm.near_texts import near_groups
from panelforge.llm.packing import packed
from panelforge.llm.simhash import keep_first


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected go, null texts and texts without a letter among them."""
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has are deleted; a text that was a copy throughout becomes empty, no row goes."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more; empty texts are alike."""
    return keep_first(docs, near_groups(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for; those of no words at their source's rate."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; an empty text is one token."""
    return packed(docs)


STAGES = [("language-id", language_id), ("line-dedup", line_dedup), ("near-dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Learned and iterative stages have no SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(spark, before)
        before = docs
    return docs
