"""From raw documents to token files, each stage on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import decontaminate, mixing, near_dup, quality, token_files
from evalspark.llm.common import public_tokenizer, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives at least an even chance.

    Whole texts are scored, however long; null and empty texts by the constant
    alone; rows that repeat, or have no id, are scored each."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, of similarity 0.8 or more.

    The smallest id stays, before rows without one; of rows that share an id,
    or have none, one alone stays if they are near copies. Texts without words
    are near copies of nothing and all stay."""
    return near_dup.drop_near_duplicates(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark. Texts without words
    share none; repeated rows are judged each."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks. A null source
    is a source; rows that share an id, or have none, draw each for itself."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: place, length and checksum of every document. A
    null or empty text is its end alone; null ids come first."""
    return token_files.token_table(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates),
          ("decontaminate", drop_contaminated), ("mix", mix), ("token_files", encode)]

# Training a classifier is not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each on the written result of the one before. Other columns
    pass through whatever their names; empty tables give an empty result."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
