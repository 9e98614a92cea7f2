"""The corpus pipeline: stages over ``documents``, each written and read again.

Null and empty texts are clean, are in no class of copies and hold no benchmark window; they stay until mixing, which takes words and so leaves out
documents without any. Ids may be null or repeat: stages go by id and text, and of rows equal in both one stays after the jaccard join. Very long texts are
read whole by each stage. Further columns, whatever their names, come back as they are from all stages but the last. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cuelake.llm import decontamination, jaccard_join, mixing, toxicity
from cuelake.llm.common import materialize, table
from cuelake.llm.queries import write_tokens


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five words, 0.8) stays."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as its target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, and what each document has in them."""
    return write_tokens(docs)


STAGES = [("toxicity", clean), ("jaccard join", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("token files", tokens)]

#: The stages learn a classifier and tokenize: SQL cannot say them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
