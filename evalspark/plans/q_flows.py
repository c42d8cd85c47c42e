"""Queries for the command flows: several operators from files to files."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators.configs import overlay_presets
from evalspark.plans import bindings as B
from evalspark.plans import commands as C
from evalspark.plans import pipelines as P
from evalspark.plans.q_configs import run_requests
from evalspark.plans.q_normalize import OUT_SQL, SAMPLES_SQL
from evalspark.plans.q_scoring import fake_generator_factory, generate_sql
from evalspark.plans.q_sequences import TOKEN_SQL
from evalspark.plans.q_sources import _toml_text
from evalspark.plans.registry import query, rounded
from evalspark.plans.sql import ANALYSIS, METHOD_DIM, SWEEP
from evalspark.session import scratch_path
from evalspark.sources import readers, writers

_FLOW_VAL, _FLOW_BATCH = 120, 8


# Rows are told apart by what they hold: places in the file follow from how the
# array files were written, and repeated rows are alike.
@query("training_flow", TOKEN_SQL + f"""
select array_to_string(input_ids, ',') as ids_text, array_to_string(labels, ',') as labels_text,
  count(*) as n from model_in group by all""")
def q_training_flow(spark, sf):
    """From a training file to token sequences (A1, D1-D6); the sequences of
    both splits, which together are all of them."""
    path = writers.write_json_array(B.training_samples(spark, sf).select("instruction", "input", "output"),
                                    scratch_path(spark, "flow-training"))
    done = C.prepare_training(spark, path, P.vocabulary(spark, sf), scratch_path(spark, "flow-out"), _FLOW_BATCH,
                              val_set_size=_FLOW_VAL)
    rows = spark.read.parquet(done.sequences)
    return rows.groupBy(P.as_text_array("input_ids").alias("ids_text"), P.as_text_array("labels").alias("labels_text")
                        ).agg(F.count(F.lit(1)).alias("n"))


@query("training_flow_report", TOKEN_SQL + f""", sizes as (select count(*) as n from model_in),
kept as (select n, case when n > {_FLOW_VAL} then {_FLOW_VAL} else 0 end as val from sizes)
select 'train' as split, n - val as examples, cast(ceil((n - val) / {_FLOW_BATCH}.0) as bigint) as batches,
  true as padded_to_eights from kept
union all
select 'validation', val, cast(ceil(val / {_FLOW_BATCH}.0) as bigint), true from kept where val > 0""")
def q_training_flow_report(spark, sf):
    """Examples and padded batches of each split, as the flow writes them."""
    path = writers.write_json_array(B.training_samples(spark, sf).select("instruction", "input", "output"),
                                    scratch_path(spark, "flow-training"))
    done = C.prepare_training(spark, path, P.vocabulary(spark, sf), scratch_path(spark, "flow-out"), _FLOW_BATCH,
                              val_set_size=_FLOW_VAL)
    even = (F.size("input_ids") == F.col("padded_length")) & (F.col("padded_length") % 8 == 0)
    rows = spark.read.parquet(done.batches).groupBy("split", "batch").agg(
        F.count(F.lit(1)).alias("n"), F.min(even).alias("even"), F.count_distinct("padded_length").alias("lengths"))
    return rows.groupBy("split").agg(
        F.sum("n").alias("examples"), F.count(F.lit(1)).alias("batches"),
        (F.min("even") & (F.max("lengths") == 1) & (F.max("n") <= _FLOW_BATCH)).alias("padded_to_eights"))


_SNAPSHOT_RUN = "lora-full"


@query("evaluate_snapshot", f"""with gen as ({generate_sql()}),
scored as (
  select s.task, case s.task
    {" ".join(f"when '{t}' then regexp_extract(lower(g.generated_text), '{rx}', 1)" for t, rx in K.ANSWER_PATTERNS.items())}
    end = s.label as correct
  from ({SAMPLES_SQL} select * from samples) s join gen g on s.task = g.task and s.pos = g.pos),
acc as (select task, avg(case when correct then 1.0 else 0.0 end) as accuracy from scored group by task)
select '{_SNAPSHOT_RUN}' as run_name, 'lora' as method, 'full' as scope, 'llama3_8b' as model_name,
  {", ".join(f"round(max(case when task = '{t}' then accuracy end), 6) as " + chr(34) + t + chr(34) for t in K.TASKS)},
  round(avg(accuracy), 6) as macro_average
from acc""")
def q_evaluate_snapshot(spark, sf):
    """Evaluate a run as its written snapshot says (A7, E1-E7): method, scope,
    model, tasks and batch size come from the file."""
    spec = overlay_presets(run_requests(spark, sf).filter(
        (F.col("method") == "lora") & (F.col("scope") == "full") & F.col("rank").isNull()))
    root = scratch_path(spark, "flow-runs")
    named = spec.select(F.lit(_SNAPSHOT_RUN).alias("run"), _toml_text(spec).alias("toml"))
    named.select(F.col("toml").alias("value")).coalesce(1).write.text(f"{root}/{_SNAPSHOT_RUN}/snapshot")
    samples = C.prepare_benchmarks(B.raw_benchmarks(spark, sf), scratch_path(spark, "flow-samples"))
    row = C.evaluate_snapshot(spark, root, _SNAPSHOT_RUN, samples, lambda spec: fake_generator_factory, device="cuda",
                              pattern="snapshot/part-*.txt")
    return rounded(row.select("run_name", "method", "scope", "model_name", *[F.col(f"`{t}`") for t in K.TASKS], "macro_average"))


@query("analyze_rank_sweep", ANALYSIS.rstrip() + f""",
{SWEEP}
select r.method, m.method_label, cast("Rank" as int) as "rank", round(macro_average * 100, 6) as macro_points,
  round(case when max(case when r.method = 'lora' then 1 end) over (partition by "Rank") = 1
              and max(case when r.method = 'dora' then 1 end) over (partition by "Rank") = 1
        then (max(case when r.method = 'dora' then macro_average end) over (partition by "Rank")
            - max(case when r.method = 'lora' then macro_average end) over (partition by "Rank")) * 100 end, 6) as gap_points
from sweep_runs r join {METHOD_DIM} m on r.method = m.method""")
def q_analyze_rank_sweep(spark, sf):
    """The analysis flow with a ranked summary: the sweep and the gap at equal
    rank, read back from the tables that it writes (A8, G10, G11, A11)."""
    ranked = scratch_path(spark, "flow-ranked")
    P.ranked_rows(spark, sf).write.option("header", True).csv(ranked)
    metrics = writers.write_metrics_json(
        P.run_rows(spark, sf).withColumn("run_name", F.concat_ws("-", "method", "scope")), scratch_path(spark, "flow-metrics"))
    out = scratch_path(spark, "flow-tables")
    C.analyze(spark, out, metrics_root=metrics, ranked_csv=ranked)
    sweep = spark.read.option("header", True).csv(f"{out}/rank_sweep")
    gap = spark.read.option("header", True).csv(f"{out}/rank_matched_gap")
    joined = sweep.join(gap.select("rank", "gap_points"), "rank", "left")
    return rounded(joined.select("method", "method_label", F.col("rank").cast("int").alias("rank"),
                                 F.col("macro_points").cast("double").alias("macro_points"),
                                 F.col("gap_points").cast("double").alias("gap_points")))


@query("prepare_labelled", SAMPLES_SQL + OUT_SQL + " from samples where task = 'piqa'")
def q_prepare_labelled(spark, sf):
    """One task from a records file and a labels file (A4) to normalised samples.
    Both files are written in id order, so a line's place is its row's."""
    raw = B.piqa_raw(spark, sf)
    records, labels = scratch_path(spark, "flow-records"), scratch_path(spark, "flow-labels")
    raw.orderBy("pos").select(F.to_json(F.struct("id", "goal", "sol1", "sol2", F.col("pos").alias("place")))).write.text(records)
    raw.orderBy("pos").select(F.col("label").cast("string")).write.text(labels)
    out = C.prepare_labelled(spark, "piqa", records, labels, "id bigint, goal string, sol1 string, sol2 string",
                             scratch_path(spark, "flow-labelled"))
    got = readers.read_eval_samples(spark, out)
    # Lines are numbered from 0; the ids behind them are the places of the table.
    return got.select("id", "task", "instruction", F.array_join("choices", "|").alias("choices_text"), "label",
                      F.col("id").cast("long").alias("pos"))
