"""A corpus pipeline: quality rules, near-duplicates, substring duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factgraph.llm._spark import Scratch
from factgraph.llm.neardup import Params, drop_near_duplicates
from factgraph.llm.packing import pack, token_pieces
from factgraph.llm.quality import filter_quality
from factgraph.llm.substring import remove_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_quality(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8."""
    return drop_near_duplicates(docs, p=Params(shingle=5, percent=80))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that occur earlier are cut; the documents stay."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs))


STAGES = [("quality_rules", quality_rules), ("minhash_neardup", minhash_neardup), ("substring_dedup", substring_dedup), ("packing", packing)]

#: Near-duplicates by five-word shingles follow from SQL, the repetition verdict and the tokens do not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
