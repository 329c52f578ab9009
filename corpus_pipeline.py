"""Document pipeline: each stage is one operator, written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fillsight.llm import bpe, decontam, quality, simhash, suffix
from fillsight.llm.queries import rank_file, table
from fillsight.session import materialize


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that an earlier document holds are cut out of the texts."""
    return suffix.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an occurrence of a benchmark window go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the remaining texts, with the digests of the ids and of the decoded bytes."""
    return bpe.tokenized(docs, rank_file())


STAGES = [
    ("quality classifier", drop_low_quality),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("suffix-array dedup", cut_repeated_strings),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

# The classifier and the tokenizer have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
