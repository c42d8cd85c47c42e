"""The reference's command flows as Spark plans: prepare, evaluate,
summarize, analyze. Each reads its inputs, runs distributed operators and
writes its outputs; the driver only loops over run configurations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import training_prompt, user_prompt
from evalspark.operators import compare as G
from evalspark.operators import normalize as N
from evalspark.operators import runs as R
from evalspark.operators import scoring as E
from evalspark.operators import sequences as S
from evalspark.operators.common import ord_of
from evalspark.sources import readers, writers

PREDICTION_SCHEMA = ("correct boolean, generated_text string, id string, label string, "
                     "pos bigint, prediction string, task string")


def prepare_benchmarks(raw_by_task: Mapping[str, DataFrame], out_dir: str,
                       limit: int | None = None) -> str:
    """Normalise every task's raw rows (B1-B10) and write them as JSONL, one
    folder per task (A9)."""
    samples = N.normalize_all(raw_by_task, limit=limit)
    return writers.write_jsonl(samples, out_dir, partition_col="task")


def prepare_labelled(spark: SparkSession, task: str, records_path: str, labels_path: str, record_schema: str,
                     out_dir: str, label_col: str = "label", limit: int | None = None) -> str:
    """Normalise one task whose labels lie in a file of their own (A4, then
    B1-B10) and write it beside the others, in the folder of its task (A9)."""
    raw = readers.zip_labels(spark, records_path, labels_path, record_schema, label_col)
    samples = N.head_limit(N.normalize_task(task, raw), limit)
    return writers.write_jsonl(samples, out_dir, partition_col="task", keep_other_parts=True)


@dataclass
class TrainingData:
    """What ``prepare_training`` wrote, and the report on it."""

    samples: str
    sequences: str
    batches: str
    report: DataFrame


def prepare_training(spark: SparkSession, source_path: str, vocab: DataFrame, out_dir: str, batch_size: int,
                     max_train_samples: int | None = None, cutoff_len: int = 256, val_set_size: int = 120, seed: int = 42,
                     train_on_inputs: bool = False) -> TrainingData:
    """From a training file to padded batches.

    Writes under ``out_dir``: ``samples`` (the normalised records as JSONL, in
    source order by ``pos``), ``sequences`` (token sequences by split) and
    ``batches`` (left-padded, numbered within each split).
    """
    root = out_dir.rstrip("/")
    samples = readers.read_training_json(spark, source_path)
    writers.write_jsonl(samples, f"{root}/samples")
    kept = spark.read.schema("pos bigint, instruction string, input string, output string").json(f"{root}/samples")
    kept = S.cap_samples(kept, max_train_samples)
    prompts = kept.select("pos", training_prompt("instruction", "input", "output").alias("full_prompt"),
                          user_prompt("instruction", "input").alias("user_prompt"))
    tokens = S.tokenize_examples(prompts, vocab, ["pos"], cutoff_len, train_on_inputs)
    split = S.holdout_split(tokens, val_set_size, seed, ["pos"])
    split.write.mode("overwrite").partitionBy("split").parquet(f"{root}/sequences")
    sequences = spark.read.parquet(f"{root}/sequences")
    for name in ("train", "validation"):
        part = sequences.filter(F.col("split") == name).drop("split")
        S.pad_batches(part, batch_size, ["pos"]).write.mode("overwrite").parquet(f"{root}/batches/split={name}")
    return TrainingData(f"{root}/samples", f"{root}/sequences", f"{root}/batches", S.sequence_report(sequences))


def prepare_run(spark: SparkSession, spec: Row, vocab: DataFrame, out_dir: str, source_path: str | None = None) -> TrainingData:
    """``prepare_training`` as a run's spec row (A7 or I1) asks for it."""
    return prepare_training(
        spark, source_path or spec["train_data_path"], vocab, out_dir, spec["per_device_batch_size"],
        max_train_samples=spec["max_train_samples"], cutoff_len=spec["cutoff_len"], val_set_size=spec["val_set_size"],
        seed=spec["seed"], train_on_inputs=spec["train_on_inputs"])


@dataclass
class RunConfig:
    run_name: str
    method: str
    scope: str
    model_name: str = ""
    model_id: str = ""
    runtime: str = ""
    task_names: Sequence[str] = K.TASKS


def evaluate_run(spark: SparkSession, samples_path: str, run: RunConfig,
                 generator_factory: Callable[[], Callable[[list[str]], list[str]]],
                 predictions_root: str, metrics_root: str,
                 tasks: Sequence[str] | str | None = None, batch_size: int = 1) -> DataFrame:
    """Evaluate one run: samples -> prompts -> generator -> scored
    predictions (written per task) -> per-task accuracy -> one metrics row
    (written under ``metrics_root/<run_name>``). Returns the metrics row.

    ``tasks`` overrides the run's own task list (E1); the macro average is
    then over the overridden list.
    """
    chosen = E.parse_task_selection(tasks) or tuple(run.task_names)
    samples = readers.read_eval_samples(spark, samples_path, tasks=chosen)
    # One row per task comes to the driver; a task without samples must not
    # leave an earlier evaluation's predictions to be counted.
    without = set(chosen) - {r["task"] for r in samples.select("task").distinct().collect()}
    if without:
        raise ValueError(f"no samples for: {', '.join(sorted(without))}")
    generated = E.generate_batches(E.with_eval_prompt(samples), generator_factory,
                                   batch_size=batch_size, keep=("id", "task", "label", "pos"))
    scored = E.score_predictions(generated)
    pred_path = f"{predictions_root.rstrip('/')}/{run.run_name}"
    writers.write_jsonl(scored.select("id", "task", "label", "pos", "prediction", "correct",
                                      "generated_text"), pred_path, partition_col="task",
                        keep_other_parts=True)
    # Accuracy is computed from the written predictions: generation runs once.
    preds = (spark.read.schema(PREDICTION_SCHEMA).json(pred_path)
             .filter(F.col("_part").isin(*chosen)).withColumn("run_name", F.lit(run.run_name)))
    runs = spark.createDataFrame([(run.run_name,)], "run_name string")
    acc = E.task_accuracy(preds, ("run_name",), requested=list(chosen), runs=runs)
    metrics = E.run_metrics(acc, ("run_name",), tasks=list(chosen)).drop("n_tasks")
    for key in ("model_name", "model_id", "method", "scope", "runtime"):
        metrics = metrics.withColumn(key, F.lit(getattr(run, key)))
    writers.write_jsonl(metrics, f"{metrics_root.rstrip('/')}/{run.run_name}")
    return metrics


def evaluate_snapshot(spark: SparkSession, runs_root: str, run_name: str, samples_path: str,
                      generator_factory: Callable[[Row], Callable[[], Callable[[list[str]], list[str]]]],
                      tasks: Sequence[str] | str | None = None, device: str = "cpu",
                      pattern: str = "config.snapshot.toml") -> DataFrame:
    """Evaluate a run as its own snapshot says (A7, then :func:`evaluate_run`).

    The snapshot under ``runs_root/run_name`` gives method, scope, model,
    tasks (unless ``tasks`` are given) and, with the device, the batch size
    (E2). ``generator_factory(spec)`` gives the run's generator maker. Predictions
    and metrics are written into the run's folder.
    """
    specs = readers.read_run_specs(spark, runs_root, pattern=f"{run_name}/{pattern}")
    spec = specs.withColumn("_batch", E.eval_batch_size(F.col("per_device_batch_size"), device)).first()
    run = RunConfig(run_name, spec["method"], spec["scope"], spec["model_name"], spec["model_id"], spec["runtime"],
                    tuple(spec["task_names"]))
    home = f"{runs_root.rstrip('/')}/{run_name}"
    return evaluate_run(spark, samples_path, run, generator_factory(spec), f"{home}/predictions", f"{home}/metrics",
                        tasks=tasks, batch_size=spec["_batch"])


def summarize(spark: SparkSession, metrics_root: str, out_dir: str,
              metadata_root: str | None = None) -> DataFrame:
    """Summary CSV over all runs (F1-F4): union of keys, sorted columns,
    metadata counts when present; no runs -> header only."""
    metrics = readers.read_run_metrics(spark, metrics_root, pattern="*/*.json")
    metadata = (readers.read_run_metadata(spark, metadata_root, pattern="*/*.json")
                if metadata_root else None)
    summary = R.summarize_runs(metrics, metadata, spark=spark)
    summary.write.mode("overwrite").option("header", True).csv(f"{out_dir.rstrip('/')}/summary")
    return summary


def analyze(spark: SparkSession, out_dir: str, metrics_root: str | None = None,
            results_csv: str | None = None, strict: bool = False, ranked_csv: str | None = None) -> dict[str, DataFrame]:
    """Comparison tables (G1-G17) from run metrics, falling back to a results
    CSV when no metrics file exists (A5/A8); writes the five tables (A11).
    ``ranked_csv``, a summary of runs at several ranks, adds the rank sweep and
    the gap at equal rank (G10, G11) as two more tables."""
    runs = readers.read_run_metrics(spark, metrics_root, pattern="*/*.json",
                                    strict=strict) if metrics_root else None
    if runs is None:
        if results_csv is None:
            raise FileNotFoundError("no run metrics found and no results CSV given")
        runs = readers.read_results_csv(spark, results_csv)
        # Rows of a CSV count in file order, whatever else it holds.
        order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                         F.monotonically_increasing_id().alias("row"))
        runs = runs.select(*[c for c in runs.columns if c != "run_dir"], order.alias("run_dir"))
    runs = G.label_conditions(G.require_columns(runs))
    runs = G.first_run(runs, "run_dir")
    runs = runs.cache()
    gains = G.paired_gains(runs, macros=True).cache()
    scope_tbl = G.scope_summary(runs, gains)
    task_tbl = G.task_summary(gains)
    comparison = G.reference_comparison(runs)
    tables = {
        "summary_table": (runs, ["method", "scope", "macro_average", *K.TASKS]),
        "dora_gains_table": (gains, ["scope", *K.TASKS, "macro_average"]),
        "scope_summary": (scope_tbl, scope_tbl.columns),
        "task_summary": (task_tbl, task_tbl.columns),
        "official_reference_comparison": (comparison, comparison.columns),
    }
    order = {"scope_summary": ord_of(F.col("scope"), list(K.SCOPES)),
             "dora_gains_table": ord_of(F.col("scope"), list(K.SCOPES)),
             "task_summary": ord_of(F.col("task"), list(K.TASKS))}
    ranked = {}
    if ranked_csv is not None:
        sweep = G.rank_sweep(readers.read_results_csv(spark, ranked_csv)).select(
            "method", "method_label", "scope", "rank", "macro_average", "macro_points").cache()
        ranked = {"rank_sweep": sweep, "rank_matched_gap": G.rank_matched_gap(sweep)}
        tables |= {name: (df, df.columns) for name, df in ranked.items()}
    writers.write_tables(out_dir, tables, sort_by=order)
    return {**ranked, "runs": runs, "gains": gains, "scope_summary": scope_tbl,
            "task_summary": task_tbl, "reference_comparison": comparison,
            "headline": G.headline(scope_tbl, task_tbl)}
