"""Queries for run-configuration tables (I1-I4) and accumulation steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import configs as I
from evalspark.operators.sequences import accumulation_steps
from evalspark.plans import bindings as B
from evalspark.plans.registry import query, rounded
from evalspark.plans.sql import PREDICTIONS

EXPERIMENT = "paper_llama2_7b"
MODEL = "llama2_7b"
RUNTIME = "colab_a100_40gb_llama"
# Scope runs use another experiment and model than sweep runs, and the
# runtime follows the method, so the preset joins key on real columns.
SCOPE_EXPERIMENT = "paper_colab"
SCOPE_MODEL = "llama3_8b"
DORA_RUNTIME = "colab_l4_llama"


def run_requests(spark, sf):
    """One request per (method, scope) evaluated, plus one per sweep (method, rank)."""
    p = B.predictions(spark, sf).select("method", "scope").distinct().withColumn(
        "rank", F.lit(None).cast("int"))
    s = B.rank_sweep_predictions(spark, sf).select("method", "scope", "rank").distinct()
    swept = F.col("rank").isNotNull()
    return (p.unionByName(s)
             .withColumn("experiment", F.when(swept, EXPERIMENT).otherwise(SCOPE_EXPERIMENT))
             .withColumn("model", F.when(swept, MODEL).otherwise(SCOPE_MODEL))
             .withColumn("runtime", F.when(F.col("method") == "lora", RUNTIME)
                         .otherwise(DORA_RUNTIME)))


def _sql_lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"cast({v!r} as double)"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_sql_lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def _vals(rows, cols):
    body = ", ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) v({', '.join(cols)}))"


_EXP = _vals([(n, list(p["task_names"]), p["rank"], p["alpha"], p["dropout"], p["max_train_samples"],
               p["num_epochs"], p["val_set_size"], p["save_steps"], p["eval_steps"],
               p["weight_decay"], p["train_on_inputs"], p["seed"], p["max_new_tokens"])
              for n, p in K.EXPERIMENT_PRESETS.items()],
             ["experiment", "task_names", "exp_rank", "exp_alpha", "exp_dropout",
              "max_train_samples", "num_epochs", "val_set_size", "save_steps", "eval_steps",
              "weight_decay", "train_on_inputs", "seed", "max_new_tokens"])
_OVR = _vals([(n, m, o.get("learning_rate"), o.get("rank"), o.get("alpha"), o.get("dropout"))
              for n, p in K.EXPERIMENT_PRESETS.items()
              for m, o in dict(p["method_overrides"]).items()],
             ["experiment", "method", "ovr_lr", "ovr_rank", "ovr_alpha", "ovr_dropout"])
_MOD = _vals([(n, p["model_id"], p["learning_rate"], p["cutoff_len"], p["trust_remote_code"])
              for n, p in K.MODEL_PRESETS.items()],
             ["model", "model_id", "model_lr", "cutoff_len", "trust_remote_code"])
_RT = _vals([(n, p["per_device_batch_size"], p["effective_batch_size"], p["gradient_checkpointing"],
              p["use_4bit"]) for n, p in K.RUNTIME_PRESETS.items()],
            ["runtime", "per_device_batch_size", "effective_batch_size", "gradient_checkpointing",
             "use_4bit"])

SPEC_SQL = f"""with {PREDICTIONS},
req as (
  select *,
    case when requested_rank is null then '{SCOPE_EXPERIMENT}' else '{EXPERIMENT}' end as experiment,
    case when requested_rank is null then '{SCOPE_MODEL}' else '{MODEL}' end as model,
    case when method = 'lora' then '{RUNTIME}' else '{DORA_RUNTIME}' end as runtime from (
    select distinct method, scope, cast(null as int) as requested_rank from predictions
    union all
    select distinct case when id % 7 <= 3 then 'lora' else 'dora' end, 'full',
      cast(case id % 7 when 0 then 32 when 1 then 16 when 2 then 8 when 3 then 4
                       when 4 then 16 when 5 then 8 else 4 end as int)
    from predictions) r),
spec as (
  select r.method, r.scope, r.requested_rank, r.model, r.runtime, e.task_names,
    cast(coalesce(r.requested_rank, o.ovr_rank, e.exp_rank, 8) as int) as rank,
    cast(coalesce(o.ovr_alpha, e.exp_alpha, 16) as int) as alpha,
    cast(coalesce(o.ovr_dropout, e.exp_dropout, 0.05) as double) as dropout,
    cast(coalesce(o.ovr_lr, m.model_lr) as double) as learning_rate,
    cast(m.cutoff_len as int) as cutoff_len, cast(t.per_device_batch_size as int) as per_device_batch_size,
    cast(t.effective_batch_size as int) as effective_batch_size, t.gradient_checkpointing, t.use_4bit,
    'nf4' as bnb_4bit_quant_type, 'bfloat16' as bnb_4bit_compute_dtype, true as bnb_4bit_use_double_quant,
    'data/commonsense_15k.json' as train_data_path,
    cast(e.max_train_samples as int) as max_train_samples, cast(e.val_set_size as int) as val_set_size,
    cast(e.num_epochs as int) as num_epochs, cast(e.save_steps as int) as save_steps,
    cast(e.eval_steps as int) as eval_steps, cast(e.seed as int) as seed,
    cast(e.max_new_tokens as int) as max_new_tokens
  from req r left join {_EXP} e on r.experiment = e.experiment
  left join {_OVR} o on r.experiment = o.experiment and r.method = o.method
  left join {_MOD} m on r.model = m.model left join {_RT} t on r.runtime = t.runtime)
"""

SPEC_COLS = ["method", "scope", "requested_rank", "rank", "alpha", "dropout", "learning_rate",
             "cutoff_len", "per_device_batch_size", "effective_batch_size",
             "gradient_checkpointing", "use_4bit", "bnb_4bit_quant_type", "bnb_4bit_compute_dtype",
             "bnb_4bit_use_double_quant", "train_data_path", "max_train_samples", "val_set_size",
             "num_epochs", "save_steps", "eval_steps", "seed", "max_new_tokens"]


_OVERLAY_SQL = SPEC_SQL + "select " + ", ".join(
    "round(dropout, 6) as dropout" if c == "dropout" else
    "round(learning_rate, 8) as learning_rate" if c == "learning_rate" else c
    for c in SPEC_COLS) + ", len(task_names) as n_tasks from spec"


def _overlaid(spec):
    return rounded(spec.select(*SPEC_COLS, F.size("task_names").cast("bigint").alias("n_tasks"))
                   .withColumn("learning_rate", F.round("learning_rate", 8)))


@query("overlay_presets", _OVERLAY_SQL)
def q_overlay_presets(spark, sf):
    return _overlaid(I.overlay_presets(run_requests(spark, sf)))


def _toml(values: dict) -> str:
    """A preset as TOML text, absent values left out."""
    def text(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(text, v)) + "]"
        return f'"{v}"' if isinstance(v, str) else repr(v)

    lines = [f"{k} = {text(v)}" for k, v in values.items() if v is not None and not isinstance(v, dict)]
    for method, over in values.get("method_overrides", {}).items():
        lines += [f"[method_overrides.{method}]", *(f"{k} = {text(v)}" for k, v in over.items())]
    return "\n".join(lines) + "\n"


@query("overlay_presets_from_files", _OVERLAY_SQL)
def q_overlay_presets_from_files(spark, sf):
    """The same specs, with the presets read back from TOML files."""
    from evalspark.session import scratch_path
    from evalspark.sources import readers, writers

    root = scratch_path(spark, "presets")
    for folder, given in (("experiments", K.EXPERIMENT_PRESETS), ("models", K.MODEL_PRESETS), ("runtime", K.RUNTIME_PRESETS)):
        files = spark.createDataFrame([(n, _toml(v)) for n, v in given.items()], "name string, text string")
        writers.write_text_by_run(files, f"{root}/{folder}", "text", "name")
    presets = readers.read_presets(spark, root, pattern="*/*.txt")
    return _overlaid(I.overlay_presets(run_requests(spark, sf), presets))


@query("run_matrix", f"""with {PREDICTIONS},
req as (select distinct '{MODEL}' as model, method, '{RUNTIME}' as runtime,
          cast(case id % 7 when 0 then 32 when 1 then 16 when 2 then 8 when 3 then 4
                            when 4 then 16 when 5 then 8 else 4 end as int) as rank
        from (select id, case when id % 7 <= 3 then 'lora' else 'dora' end as method from predictions) p)
select model, method, runtime, rank, s.scope,
  concat_ws('-', model, method, s.scope, runtime) || '-r' || cast(rank as varchar) as run_name
from req, (values {', '.join(f"('{s}')" for s in K.SCOPES)}) s(scope)""")
def q_run_matrix(spark, sf):
    req = (B.rank_sweep_predictions(spark, sf).select("method", "rank").distinct()
           .withColumn("model", F.lit(MODEL)).withColumn("runtime", F.lit(RUNTIME)))
    return I.run_matrix(req).select("model", "method", "runtime", "rank", "scope", "run_name")


def _unique_specs(spark, sf):
    spec = I.overlay_presets(run_requests(spark, sf))
    return spec.dropDuplicates(["method", "scope", "rank"])


@query("validate_spec", SPEC_SQL + "select distinct method, scope, rank, len(task_names) as n_tasks from spec")
def q_validate_spec(spark, sf):
    s = I.validate_spec(_unique_specs(spark, sf))
    return s.select("method", "scope", "rank", F.size("task_names").cast("bigint").alias("n_tasks"))


_SNAP_COLS = ["method", "scope", "rank", "alpha", "dropout", "learning_rate", "max_train_samples",
              "val_set_size", "seed"]


# The value of each key as the snapshot's text has it: numbers as doubles.
_SNAP_TEXT = ("method", "scope")


@query("drop_null_fields", SPEC_SQL + "select distinct method, scope, rank, concat_ws(',', " + ", ".join(
    f"case when {c} is not null then '{c}' end" for c in sorted(_SNAP_COLS)) + ") as present_keys, " + ", ".join(
    f"{c} as snap_{c}" if c in _SNAP_TEXT else f"round(cast({c} as double), 8) as snap_{c}" for c in _SNAP_COLS) + " from spec")
def q_drop_null_fields(spark, sf):
    specs = I.overlay_presets(run_requests(spark, sf)).select(*_SNAP_COLS).distinct()
    s = I.drop_null_fields(specs, cols=_SNAP_COLS)
    keys = F.array_join(F.array_sort(F.json_object_keys("snapshot_json")), ",")

    def value(c):
        text = F.get_json_object("snapshot_json", f"$.{c}")
        return (text if c in _SNAP_TEXT else F.round(text.cast("double"), 8)).alias(f"snap_{c}")
    return s.select("method", "scope", "rank", keys.alias("present_keys"), *map(value, _SNAP_COLS))


@query("accumulation_steps", SPEC_SQL + "select distinct method, scope, rank, per_device_batch_size, "
       "effective_batch_size, cast(effective_batch_size / per_device_batch_size as bigint) "
       "as accumulation_steps from spec")
def q_accumulation_steps(spark, sf):
    s = _unique_specs(spark, sf)
    return s.select("method", "scope", "rank", "per_device_batch_size", "effective_batch_size",
                    accumulation_steps("effective_batch_size", "per_device_batch_size")
                    .alias("accumulation_steps"))
