"""A training corpus from raw documents: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import prepare
from tallyloom.llm.lines import deduped_documents
from tallyloom.llm.mixing import mixed_documents
from tallyloom.llm.packing import pack
from tallyloom.llm.simhash import one_of_each
from tallyloom.llm.toxicity import clean_documents
from tallyloom.session import materialise

# The tagger, the hash filters and the packer are not SQL; tests/llm checks the rows instead.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; whole rows, unchanged."""
    return clean_documents(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier document holds."""
    return deduped_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs).drop("rid")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written before the next begins."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
