"""Run-configuration tables (I1-I4): presets overlaid for many runs at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark import constants as K
from evalspark.operators.common import require, sized_broadcast, small_table


PRESET_SCHEMAS = {
    "experiments": ("task_names array<string>, rank int, alpha int, dropout double, max_train_samples int, "
                    "num_epochs int, val_set_size int, save_steps int, eval_steps int, weight_decay double, "
                    "train_on_inputs boolean, seed int, max_new_tokens int, train_data_path string, "
                    "method_overrides map<string, struct<learning_rate: double, rank: int, alpha: int, dropout: double>>"),
    "models": "model_id string, learning_rate double, cutoff_len int, trust_remote_code boolean",
    "runtimes": ("per_device_batch_size int, effective_batch_size int, gradient_checkpointing boolean, use_4bit boolean, "
                 "bnb_4bit_quant_type string, bnb_4bit_compute_dtype string, bnb_4bit_use_double_quant boolean"),
}
# What a preset must tell; everything else has a default.
PRESET_REQUIRED = {"experiments": (), "models": ("model_id", "learning_rate"),
                   "runtimes": ("per_device_batch_size", "effective_batch_size", "gradient_checkpointing")}
PRESET_FOLDERS = {"experiments": "experiments", "models": "models", "runtimes": "runtime"}


@dataclass(frozen=True)
class Presets:
    """Preset tables, one row per name: ``experiments``, ``models`` and
    ``runtimes`` with the columns of ``PRESET_SCHEMAS`` behind ``name``."""

    experiments: DataFrame
    models: DataFrame
    runtimes: DataFrame


def preset_tables(spark: SparkSession, experiments: Mapping[str, Mapping] = K.EXPERIMENT_PRESETS,
                  models: Mapping[str, Mapping] = K.MODEL_PRESETS,
                  runtimes: Mapping[str, Mapping] = K.RUNTIME_PRESETS) -> Presets:
    """Presets given as mappings, name -> values; absent values are null."""
    def rows(kind: str, given: Mapping[str, Mapping]) -> DataFrame:
        names = StructType.fromDDL(PRESET_SCHEMAS[kind]).names
        unknown = {c for values in given.values() for c in values} - set(names)
        if unknown:
            raise ValueError(f"unknown preset values: {', '.join(sorted(unknown))}")
        data = [(name, *(_plain(values.get(c)) for c in names)) for name, values in given.items()]
        return small_table(spark, data, "name string, " + PRESET_SCHEMAS[kind])

    return Presets(rows("experiments", experiments), rows("models", models), rows("runtimes", runtimes))


def _plain(value):
    if isinstance(value, Mapping):  # overrides by method
        return {m: {k: o.get(k) for k in ("learning_rate", "rank", "alpha", "dropout")} for m, o in value.items()}
    return list(value) if isinstance(value, tuple) else value


def overlay_presets(requests: DataFrame, presets: Presets | None = None) -> DataFrame:
    """One spec row per requested run.

    ``requests`` has ``experiment, model, runtime, method, scope`` and optional
    overrides ``rank`` and ``train_data_path`` (null = none). Precedence:
    explicit value > method override > experiment value > built-in default;
    learning rate: method override > model preset. ``presets`` are the
    built-in ones unless given (:func:`preset_tables`, or TOML files by
    ``sources.readers.read_presets``). An unknown preset name raises, as does a
    preset that lacks a value without default.
    """
    given = presets or preset_tables(requests.sparkSession)
    req = requests
    for c, kind in (("rank", "int"), ("train_data_path", "string")):
        req = req.withColumn(c, F.col(c).cast(kind) if c in requests.columns else F.lit(None).cast(kind))
    req = req.withColumnsRenamed({"rank": "req_rank", "train_data_path": "req_path"})
    j, sides = req, {"experiments": ("experiment", "exp_"), "models": ("model", "model_"), "runtimes": ("runtime", "run_")}
    missing = F.lit(None).cast("string")
    for kind, (key, prefix) in sides.items():
        table = getattr(given, kind)
        side = table.select(F.col("name").alias(key), F.lit(True).alias(f"{prefix}known"),
                            *[F.col(c).alias(prefix + c) for c in table.columns if c != "name"])
        j = j.join(sized_broadcast(side), key, "left")
        lacks = [F.when(F.col(prefix + c).isNull(), F.lit(f"{key} preset lacks {c}")) for c in PRESET_REQUIRED[kind]]
        missing = F.coalesce(missing, F.when(F.col(f"{prefix}known").isNull(), F.lit(f"unknown preset: {key}")), *lacks)
    j = require(j, missing.isNull(), F.coalesce(missing, F.lit("")))
    over = F.element_at(F.col("exp_method_overrides"), F.col("method"))
    d = K.SPEC_DEFAULTS

    def first(key: str, *sources, kind: str | None = None, default=None):
        value = F.coalesce(*sources, F.lit(d[key] if default is None else default))
        return (value.cast(kind) if kind else value).alias(key)

    plain = {"num_epochs": "int", "val_set_size": "int", "save_steps": "int", "eval_steps": "int", "weight_decay": "double",
             "train_on_inputs": "boolean", "seed": "int", "max_new_tokens": "int"}
    runtime = {"use_4bit": "boolean", "bnb_4bit_quant_type": "string", "bnb_4bit_compute_dtype": "string",
               "bnb_4bit_use_double_quant": "boolean"}
    tasks = F.array(*map(F.lit, K.TASKS))
    return j.select(
        "experiment", "model", F.col("model_model_id").alias("model_id"), "runtime", "method", "scope",
        F.col("req_rank").alias("requested_rank"),
        F.coalesce(over["learning_rate"], F.col("model_learning_rate")).alias("learning_rate"),
        first("rank", F.col("req_rank"), over["rank"], F.col("exp_rank"), kind="int"),
        first("alpha", over["alpha"], F.col("exp_alpha"), kind="int"),
        first("dropout", over["dropout"], F.col("exp_dropout"), kind="double"),
        first("cutoff_len", F.col("model_cutoff_len"), kind="int"),
        first("trust_remote_code", F.col("model_trust_remote_code"), kind="boolean"),
        F.col("run_per_device_batch_size").alias("per_device_batch_size"),
        F.col("run_effective_batch_size").alias("effective_batch_size"),
        F.col("run_gradient_checkpointing").alias("gradient_checkpointing"),
        *[first(c, F.col(f"run_{c}"), kind=t) for c, t in runtime.items()],
        F.coalesce(F.col("exp_task_names"), tasks).alias("task_names"),
        F.col("exp_max_train_samples").alias("max_train_samples"),
        *[first(c, F.col(f"exp_{c}"), kind=t) for c, t in plain.items()],
        first("train_data_path", F.col("req_path"), F.col("exp_train_data_path"), default=K.DEFAULT_TRAIN_DATA_PATH))


def run_matrix(requests: DataFrame, scopes: Sequence[str] = K.SCOPES, stamp: str | None = None
               ) -> DataFrame:
    """Every requested (model, method[, rank], runtime) for each scope, with
    a run name ``[stamp-]model-method-scope-runtime[-r<rank>]``. The scope
    vocabulary is a driver-side list, fanned out with ``explode`` (no join)."""
    runs = requests.withColumn("scope", F.explode(F.array(*[F.lit(s) for s in scopes])))
    parts = [F.col("model"), F.col("method"), F.col("scope"), F.col("runtime")]
    if stamp:
        parts.insert(0, F.lit(stamp))
    name = F.concat_ws("-", *parts)
    if "rank" in runs.columns:
        name = F.when(F.col("rank").isNull(), name).otherwise(
            F.concat(name, F.lit("-r"), F.col("rank").cast("string")))
    return runs.withColumn("run_name", name)


def validate_spec(specs: DataFrame, tasks: Sequence[str] = K.TASKS) -> DataFrame:
    """An unknown task in ``task_names`` raises."""
    known = F.array(*[F.lit(t) for t in tasks])
    bad = F.coalesce(F.array_except(F.col("task_names"), known), F.array(F.lit("NULL")))
    return require(specs, F.size(bad) == 0,
                   F.concat(F.lit("tasks that don't exist: "), F.array_join(bad, ",")))


def drop_null_fields(specs: DataFrame, cols: Sequence[str] | None = None,
                     out: str = "snapshot_json") -> DataFrame:
    """I4: JSON text of each row with null-valued keys left out (recursively)."""
    use = list(cols) if cols is not None else list(specs.columns)
    return specs.withColumn(out, F.to_json(F.struct(*[F.col(f"`{c}`") for c in use])))
