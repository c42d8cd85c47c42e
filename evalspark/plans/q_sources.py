"""Queries for sources and sinks (A1-A11) and run summaries.

Each writes data derived from the driver tables into a fresh folder under
the shared checkpoint root, then reads it back with the operator under test;
the oracle is the SQL of the table that was written.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import adapters as H
from evalspark.operators import runs as R
from evalspark.operators import scoring
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.q_adapters import MODULES_SQL
from evalspark.plans.q_configs import SPEC_SQL, run_requests
from evalspark.plans.q_normalize import OUT_SQL, SAMPLES_SQL
from evalspark.plans.q_prompts import TRAINING_SQL
from evalspark.plans.registry import query, rounded
from evalspark.plans.sql import ACC, PREDICTIONS, RUNS
from evalspark.session import scratch_path
from evalspark.sources import readers, writers


@query("read_training_json", f"with {TRAINING_SQL} select instruction, input, output from training")
def q_read_training_json(spark, sf):
    t = B.training_samples(spark, sf)
    # Empty inputs are written without the key, as the upstream files do.
    t = t.withColumn("input", F.when(F.col("input") != "", F.col("input")))
    path = writers.write_json_array(t.select("instruction", "input", "output"),
                                    scratch_path(spark, "training-json"))
    return readers.read_training_json(spark, path).select("instruction", "input", "output")


PIQA_SCHEMA = "id bigint, goal string, sol1 string, sol2 string, label bigint"


@query("read_jsonl", "select o_orderkey as id, 'Order ' || cast(o_orderkey as varchar) as goal, "
       "o_orderstatus as sol1, o_orderpriority as sol2, o_orderkey % 2 as label from orders")
def q_read_jsonl(spark, sf):
    raw = B.piqa_raw(spark, sf).drop("pos")
    path = writers.write_jsonl(raw, scratch_path(spark, "piqa-jsonl"))
    return readers.read_jsonl(spark, path, PIQA_SCHEMA)


@query("write_jsonl", f"""with {PREDICTIONS} select id, task, method, scope, ok as correct from predictions""")
def q_write_jsonl(spark, sf):
    p = B.predictions(spark, sf).withColumnRenamed("ok", "correct")
    path = writers.write_jsonl(p, scratch_path(spark, "predictions-jsonl"))
    back = spark.read.schema("correct boolean, id bigint, method string, scope string, task string"
                             ).json(path)
    # keys were written in sorted order
    return back.select("id", "task", "method", "scope", "correct")


@query("read_eval_samples", SAMPLES_SQL + OUT_SQL + " from samples")
def q_read_eval_samples(spark, sf):
    s = P.prepared_samples(spark, sf)
    path = writers.write_jsonl(s, scratch_path(spark, "samples-jsonl"))
    back = readers.read_eval_samples(spark, path, limit=None)
    return back.select("id", "task", "instruction",
                       F.array_join("choices", "|").alias("choices_text"), "label", "pos")


@query("zip_labels", "select o_orderkey as pos, o_orderkey as id, 'Order ' || cast(o_orderkey as varchar) "
       "as goal, o_orderstatus as sol1, o_orderpriority as sol2, cast(o_orderkey % 2 as varchar) as label "
       "from orders")
def q_zip_labels(spark, sf):
    raw = B.piqa_raw(spark, sf)
    rec_path = scratch_path(spark, "piqa-records")
    lab_path = scratch_path(spark, "piqa-labels")
    # Both files in id order (range-partitioned, so part files follow the order).
    raw.orderBy("pos").select(F.to_json(F.struct("id", "goal", "sol1", "sol2")).alias("v")) \
        .write.text(rec_path)
    raw.orderBy("pos").select(F.col("label").cast("string")).write.text(lab_path)
    z = readers.zip_labels(spark, rec_path, lab_path,
                           "id bigint, goal string, sol1 string, sol2 string")
    return z.select("pos", "id", "goal", "sol1", "sol2", "label")


# --- run files: metrics, metadata, summary ---------------------------------------

def run_metric_rows(spark, sf):
    acc = P.run_accuracy(spark, sf)
    runs = scoring.run_metrics(acc, ("method", "scope"))
    return runs.withColumn("run_name", F.concat_ws("-", "method", "scope"))


RANK_OF = K.REPRODUCTION_RANK


def run_metadata_rows(spark, sf):
    """Per run: trainable parameters of its adapter over the whole module
    inventory (scope-selected modules, preset rank per method) and the total."""
    mods = B.modules(spark, sf)
    sel = H.select_modules(mods)
    per = sel.groupBy("scope").agg(
        F.sum(F.col("in_features") + F.col("out_features")).alias("_io"),
        F.sum("out_features").alias("_out"))
    # The inventory total rides along by stacking it under the per-scope rows
    # and reading it back with a window over this 4-row table (no join).
    base = mods.agg(F.sum(F.col("in_features") * F.col("out_features")).alias("_base"))
    stacked = per.unionByName(base, allowMissingColumns=True)
    per = (stacked.withColumn("_base", F.max("_base").over(Window.partitionBy()))
                  .filter(F.col("scope").isNotNull()))
    grid = per.withColumn("method", F.explode(F.array(*[F.lit(m) for m in K.METHODS])))
    rank = F.when(F.col("method") == "lora", RANK_OF["lora"]).otherwise(RANK_OF["dora"])
    trainable = F.when(F.col("method") == "dora", rank * F.col("_io") + F.col("_out")).otherwise(
        rank * F.col("_io"))
    meta = (grid.withColumn("trainable_parameters", trainable.cast("long"))
                .withColumn("total_parameters", (F.col("_base") + F.col("trainable_parameters"))
                            .cast("long")))
    return meta.select(F.concat_ws("-", "method", "scope").alias("run_name"), "method", "scope",
                       rank.alias("rank"), "trainable_parameters", "total_parameters")


def _write_runs(spark, sf):
    root_m = writers.write_metrics_json(run_metric_rows(spark, sf), scratch_path(spark, "metrics"))
    root_d = writers.write_metrics_json(run_metadata_rows(spark, sf), scratch_path(spark, "metadata"))
    metrics = readers.read_run_metrics(spark, root_m, pattern="*/*.json")
    metadata = readers.read_run_metadata(spark, root_d, pattern="*/*.json")
    return metrics, metadata


META_SQL = f"""{MODULES_SQL},
per as (select scope, sum(in_features + out_features) as io, sum(out_features) as o
        from selected group by scope),
base as (select sum(in_features * out_features) as b from modules),
meta as (
  select m.method || '-' || per.scope as run_name, m.method, per.scope,
    case m.method when 'lora' then {RANK_OF['lora']} else {RANK_OF['dora']} end as rank,
    cast(case m.method when 'lora' then {RANK_OF['lora']} * io else {RANK_OF['dora']} * io + o end as bigint)
      as trainable_parameters
  from per, (values ('lora'), ('dora')) m(method)),
meta2 as (select meta.*, cast(base.b + trainable_parameters as bigint) as total_parameters
          from meta, base)"""

TASK_COLS = ", ".join(f'round(r."{t}", 6) as "{t}"' for t in K.TASKS)
RUN_SQL = f"with {PREDICTIONS},\n{ACC},\n{RUNS},\n{META_SQL}\n"


@query("read_run_metrics", RUN_SQL + f"""select method || '-' || scope as run_dir, method || '-' || scope
  as run_name, method, scope, {TASK_COLS.replace('r."', '"')}, round(macro_average, 6) as macro_average, n_tasks
from runs""")
def q_read_run_metrics(spark, sf):
    metrics, _ = _write_runs(spark, sf)
    return rounded(metrics.select("run_dir", "run_name", "method", "scope",
                                  *[F.col(f"`{t}`") for t in K.TASKS], "macro_average", "n_tasks"))


@query("write_metrics_json", RUN_SQL + f"""select method || '-' || scope as run_dir, method || '-' || scope
  as run_name, method, scope, {TASK_COLS.replace('r."', '"')}, round(macro_average, 6) as macro_average, n_tasks
from runs""")
def q_write_metrics_json(spark, sf):
    root = writers.write_metrics_json(run_metric_rows(spark, sf), scratch_path(spark, "metrics-only"))
    back = spark.read.option("multiLine", True).json(root)
    # partition folders come back as the ``_run`` column
    return rounded(back.select(F.col("_run").alias("run_dir"), "run_name", "method", "scope",
                               *[F.col(f"`{t}`") for t in K.TASKS], "macro_average", "n_tasks"))


@query("empty_summary", RUN_SQL + """select h.place, h.column_name, (select count(*) from runs where n_tasks = 0) as n_rows
from (values (0, 'run_name'), (1, 'macro_average')) h(place, column_name)""")
def q_empty_summary(spark, sf):
    """summarise the runs that evaluated no task -- none exist, so no
    metrics file is written and the summary is the bare header: its columns
    in order, each with the number of its rows."""
    rows = run_metric_rows(spark, sf).filter(F.col("n_tasks") == 0)
    root = writers.write_metrics_json(rows, scratch_path(spark, "metrics-none"))
    summary = R.summarize_runs(readers.read_run_metrics(spark, root, pattern="*/*.json"), spark=spark)
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("column_name")) for i, c in enumerate(summary.columns)])
    counted = summary.agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.explode(names).alias("h"), "n_rows").select("h.place", "h.column_name", "n_rows")


@query("read_run_metadata", RUN_SQL + "select run_name as run_dir, trainable_parameters, "
       "total_parameters from meta2")
def q_read_run_metadata(spark, sf):
    _, metadata = _write_runs(spark, sf)
    return metadata.select("run_dir", "trainable_parameters", "total_parameters")


SUMMARY_SQL = RUN_SQL + f""", summary as (
  select r.method || '-' || r.scope as run_name, r.method, r.scope, {TASK_COLS},
    round(r.macro_average, 6) as macro_average, r.n_tasks,
    m.trainable_parameters, m.total_parameters,
    round(case when m.total_parameters > 0
               then cast(m.trainable_parameters as double) / m.total_parameters * 100 else 0.0 end, 6)
      as trainable_percentage
  from runs r left join meta2 m on r.method = m.method and r.scope = m.scope)
"""


@query("summarize_runs", SUMMARY_SQL + "select * from summary")
def q_summarize_runs(spark, sf):
    metrics, metadata = _write_runs(spark, sf)
    return rounded(R.summarize_runs(metrics, metadata))


@query("attach_metadata", SUMMARY_SQL + "select run_name, trainable_parameters, total_parameters "
       "from summary")
def q_attach_metadata(spark, sf):
    metrics, metadata = _write_runs(spark, sf)
    return R.attach_metadata(metrics, metadata).select(
        "run_name", "trainable_parameters", "total_parameters")


@query("trainable_percentage", SUMMARY_SQL + "select run_name, trainable_percentage from summary")
def q_trainable_percentage(spark, sf):
    metrics, metadata = _write_runs(spark, sf)
    return rounded(R.attach_metadata(metrics, metadata).select("run_name", "trainable_percentage"))


@query("read_results_csv", SUMMARY_SQL + "select * from summary")
def q_read_results_csv(spark, sf):
    metrics, metadata = _write_runs(spark, sf)
    summary = rounded(R.summarize_runs(metrics, metadata))
    path = scratch_path(spark, "summary-csv")
    summary.write.option("header", True).csv(path)
    return readers.read_results_csv(spark, path, schema=summary.schema)


_TABLE_HEADERS = {
    "summary_table": ["method", "scope", "macro_average", *K.TASKS],
    "dora_gains_table": ["scope", *K.TASKS, "macro_average"],
    "scope_summary": ["scope", "scope_label", "lora_macro", "dora_macro", "delta", "delta_points",
                      "task_wins", "task_ties", "task_losses", "best_task", "worst_task",
                      "mean_task_delta_points", "median_task_delta_points", "task_delta_std_points"],
    "task_summary": ["task", "task_label", "best_scope", "best_scope_label", "best_delta_points",
                     "worst_scope", "worst_scope_label", "worst_delta_points", "positive_scopes"],
    "official_reference_comparison": ["source", "method", "method_label", "paper_method", "rank",
                                      "params_percent", "macro_average", "macro_points", *K.TASKS],
}


# What tells a table's rows apart.
_TABLE_KEYS = {"summary_table": ["method", "scope"], "dora_gains_table": ["scope"], "scope_summary": ["scope"],
               "task_summary": ["task"], "official_reference_comparison": ["source", "method"]}
_TABLE_TEXT = {"method", "scope", "scope_label", "best_task", "worst_task", "task", "task_label", "best_scope",
               "best_scope_label", "worst_scope", "worst_scope_label", "source", "method_label", "paper_method"}


def _write_tables_sql() -> str:
    """Every cell of the five tables: table, row, column, and its text or number."""
    from evalspark.plans import q_compare as C
    from evalspark.plans.sql import ANALYSIS
    tables = {
        "summary_table": ANALYSIS + "select * from runs",
        "dora_gains_table": C.GAINS_SQL,
        "scope_summary": C.SCOPE_SUMMARY_SQL,
        "task_summary": C.TASK_SUMMARY_SQL,
        "official_reference_comparison": C.REFERENCE_SQL,
    }
    cells = []
    for name, header in _TABLE_HEADERS.items():
        key = " || '|' || ".join(_TABLE_KEYS[name])
        for i, c in enumerate(header):
            value = (f'"{c}" as text_value, cast(null as double) as number_value' if c in _TABLE_TEXT else
                     f'cast(null as varchar) as text_value, round(cast("{c}" as double), 6) + 0.0 as number_value')
            cells.append(f"select '{name}' as table_name, {key} as row_key, {i} as place, '{c}' as column_name, {value} from t_{name}")
    return "with " + ", ".join(f"t_{n} as ({q})" for n, q in tables.items()) + "\n" + "\nunion all\n".join(cells)


@query("write_tables", _write_tables_sql())
def q_write_tables(spark, sf):
    from evalspark.operators import compare
    from evalspark.operators.common import ord_of
    # Five tables share the run rows and gains: compute those once.
    a = P.analysis(spark, sf, cache=True)
    comp = compare.reference_comparison(a.runs)
    frames = {"summary_table": a.runs, "dora_gains_table": a.gains, "scope_summary": a.scope_summary,
              "task_summary": a.task_summary, "official_reference_comparison": comp}
    order = {"scope_summary": ord_of(F.col("scope"), list(K.SCOPES)),
             "dora_gains_table": ord_of(F.col("scope"), list(K.SCOPES)),
             "task_summary": ord_of(F.col("task"), list(K.TASKS))}
    paths = writers.write_tables(scratch_path(spark, "tables"), {n: (df, _TABLE_HEADERS[n]) for n, df in frames.items()},
                                 sort_by=order)
    out = None
    for name, path in paths.items():
        back = spark.read.option("header", True).csv(path)
        key = F.concat_ws("|", *_TABLE_KEYS[name])
        cells = F.array(*[F.struct(
            F.lit(i).alias("place"), F.lit(c).alias("column_name"),
            (F.col(f"`{c}`") if c in _TABLE_TEXT else F.lit(None).cast("string")).alias("text_value"),
            (F.lit(None).cast("double") if c in _TABLE_TEXT else F.col(f"`{c}`").cast("double")).alias("number_value"))
            for i, c in enumerate(back.columns)])
        one = back.select(F.lit(name).alias("table_name"), key.alias("row_key"), F.explode(cells).alias("c")).select(
            "table_name", "row_key", "c.*")
        out = one if out is None else out.unionByName(one)
    a.runs.unpersist()
    a.gains.unpersist()
    return rounded(out)


SPEC_TOML_COLS = ["run_dir", "method", "scope", "rank", "alpha", "dropout", "learning_rate",
                  "cutoff_len", "per_device_batch_size", "effective_batch_size", "use_4bit",
                  "val_set_size", "seed", "max_new_tokens", "n_tasks"]


def _toml_text(spec):
    """Render one TOML snapshot per spec row (null keys left out; seed and
    cutoff_len left out on purpose so the reader's defaults apply)."""
    def kv(key, col, quote=False):
        v = F.col(col).cast("string")
        v = F.concat(F.lit('"'), v, F.lit('"')) if quote else v
        return F.when(F.col(col).isNotNull(), F.concat(F.lit(f"{key} = "), v, F.lit("\n")))
    tasks = F.concat(F.lit("task_names = ["),
                     F.array_join(F.transform("task_names", lambda t: F.concat(F.lit('"'), t, F.lit('"'))),
                                  ", "), F.lit("]\n"))
    bool_txt = lambda c: F.when(F.col(c), "true").otherwise("false")
    return F.concat_ws(
        "",
        kv("experiment_name", "experiment", True), tasks,
        kv("max_train_samples", "max_train_samples"), kv("val_set_size", "val_set_size"),
        kv("max_new_tokens", "max_new_tokens"),
        F.lit("\n[model]\n"), kv("name", "model", True), kv("model_id", "model_id", True),
        kv("learning_rate", "learning_rate"),
        F.lit("\n[adapter]\n"), kv("method", "method", True), kv("scope", "scope", True),
        kv("rank", "rank"), kv("alpha", "alpha"), kv("dropout", "dropout"),
        F.lit("\n[runtime]\n"), kv("name", "runtime", True),
        kv("per_device_batch_size", "per_device_batch_size"),
        kv("effective_batch_size", "effective_batch_size"),
        F.concat(F.lit("gradient_checkpointing = "), bool_txt("gradient_checkpointing"), F.lit("\n")),
        F.concat(F.lit("use_4bit = "), bool_txt("use_4bit"), F.lit("\n")))


@query("read_run_specs", SPEC_SQL + """select method || '-' || scope || '-' ||
  coalesce('r' || cast(requested_rank as varchar), 'preset') as run_dir, method, scope,
  cast(rank as bigint) as rank, cast(alpha as bigint) as alpha, round(dropout, 6) as dropout,
  round(learning_rate, 8) as learning_rate, cast(256 as bigint) as cutoff_len,
  cast(per_device_batch_size as bigint) as per_device_batch_size,
  cast(effective_batch_size as bigint) as effective_batch_size, use_4bit,
  cast(val_set_size as bigint) as val_set_size, cast(42 as bigint) as seed,
  cast(max_new_tokens as bigint) as max_new_tokens, len(task_names) as n_tasks from spec""")
def q_read_run_specs(spark, sf):
    from evalspark.operators.configs import overlay_presets
    spec = overlay_presets(run_requests(spark, sf))
    spec = spec.withColumn("run_dir", F.concat_ws(
        "-", "method", "scope", F.coalesce(F.concat(F.lit("r"), F.col("requested_rank").cast("string")),
                                           F.lit("preset"))))
    root = writers.write_text_by_run(spec.withColumn("toml", _toml_text(spec)), scratch_path(
        spark, "snapshots"), "toml", "run_dir")
    back = readers.read_run_specs(spark, root, pattern="*/*.txt")
    out = back.withColumn("n_tasks", F.size("task_names").cast("bigint"))
    return rounded(out.select(*SPEC_TOML_COLS)).withColumn("learning_rate",
                                                           F.round("learning_rate", 8))
