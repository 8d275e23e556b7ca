"""A corpus from rules to packed sequences; each stage is one operator of ``strandlake.llm``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import decontaminate, lines, ngram_join, pack, quality, tokens


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: null, empty and short texts go, rows are judged one by one, all columns stay."""
    return quality.kept_only(docs)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier line: null stays null, a text without a kept line is empty, rows that repeat an id keep what is new in each; all columns stay."""
    return lines.without_later_matches(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id: null and empty texts and rows without an id stay, rows that repeat an id stay or go together; all columns stay."""
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item: null and empty texts stay, as do all if there is no item with a word; all columns stay."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens that hold all documents, one row a piece: null and empty texts give the end id alone; an empty table gives no rows."""
    return pack.packed_documents(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_rules", rules), ("line_dedup", new_lines), ("ngram_join", one_of_each), ("decontamination", clean_of_benchmark), ("packing", packed)]

#: Several stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(lambda docs, stage: stage[1](spark, docs, sf_dir), STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
