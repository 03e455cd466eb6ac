"""A corpus pipeline of five training-data operators; every stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortloom.llm import common, op02_toxicity, op03_bpe, op08_exact, op09_minmax, op10_decontaminate


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic by the lexicon that their labels teach."""
    return op02_toxicity.drop_toxic(docs, lexicon=op02_toxicity.learn(docs, common.table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return op08_exact.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return op09_minmax.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op10_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text that they decode to."""
    return op03_bpe.encode_and_decode(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: Near duplicates and BPE can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; a stage's table goes as soon as the next one's is written."""
    docs, old = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = common.materialize(stage(spark, docs, sf_dir), name)
        common.release(spark, *old)
        old = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
