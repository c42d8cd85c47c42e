"""End-to-end plans built from the operators (the reference's command flows).

- ``evaluation``: predictions -> per-task accuracy -> run rows (3.2)
- ``analysis``:   run rows -> gains -> scope / task summaries (3.3)
- ``prepare``:    raw benchmark rows -> one normalised sample table (3.1)
- ``sequences``:  training samples -> masked token sequences + holdout (3.4)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import training_prompt, user_prompt
from evalspark.operators import compare, normalize, scoring, sequences
from evalspark.plans import bindings as B


def run_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long per-(method, scope, task) accuracy from the prediction table."""
    preds = B.predictions(spark, sf_dir).withColumnRenamed("ok", "correct")
    return scoring.task_accuracy(preds, ("method", "scope"), requested=K.TASKS)


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide run rows (method, scope, 8 tasks, macro_average) with labels."""
    acc = run_accuracy(spark, sf_dir)
    runs = scoring.run_metrics(acc, ("method", "scope"))
    compare.require_columns(runs)
    return compare.label_conditions(runs)


@dataclass
class Analysis:
    runs: DataFrame
    gains: DataFrame
    long_gains: DataFrame
    scope_summary: DataFrame
    task_summary: DataFrame


def analysis(spark: SparkSession, sf_dir: str, cache: bool = True) -> Analysis:
    """The comparison flow. The gains carry both macros, so everything behind
    them comes from one accuracy aggregate; they feed four consumers and are
    cached (tiny: one row per scope)."""
    runs = run_rows(spark, sf_dir)
    gains = compare.paired_gains(runs, macros=True)
    if cache:
        runs = runs.cache()
        gains = gains.cache()
    lg = compare.long_gains(gains)
    return Analysis(runs, gains, lg, compare.scope_summary(runs, gains),
                    compare.task_summary(gains))


def ranked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sweep runs (full scope, method x rank) as wide rows with a ``Rank`` column."""
    preds = B.rank_sweep_predictions(spark, sf_dir).withColumnRenamed("ok", "correct")
    acc = scoring.task_accuracy(preds, ("method", "scope", "rank"), requested=K.TASKS)
    runs = scoring.run_metrics(acc, ("method", "scope", "rank"))
    return runs.withColumnRenamed("rank", "Rank")


def prepared_samples(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    return normalize.normalize_all(B.raw_benchmarks(spark, sf_dir), limit=limit)


def training_with_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = B.training_samples(spark, sf_dir)
    return (t.withColumn("full_prompt", training_prompt("instruction", "input", "output"))
             .withColumn("user_prompt", user_prompt("instruction", "input")))


def vocabulary(spark: SparkSession, sf_dir: str, size: int = 200) -> DataFrame:
    return sequences.build_vocabulary(B.table(spark, sf_dir, "benchmark"), "text", size)


def tokenized(spark: SparkSession, sf_dir: str, cutoff: int = 256) -> DataFrame:
    t = training_with_prompts(spark, sf_dir)
    return sequences.tokenize_examples(t, vocabulary(spark, sf_dir), ["conv_id", "turn"], cutoff)


def split_sequences(spark: SparkSession, sf_dir: str, cutoff: int = 256, val_size: int = 120,
                    seed: int = 42) -> DataFrame:
    tok = tokenized(spark, sf_dir, cutoff)
    return sequences.holdout_split(tok, val_size, seed, ["conv_id", "turn"])


def as_text_array(col: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(F.col(col), lambda x: x.cast("string")), sep)
