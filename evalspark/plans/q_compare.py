"""Queries for run summaries (F) and comparison analytics (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import compare
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.registry import query, rounded
from evalspark.session import cut_lineage
from evalspark.plans.sql import ANALYSIS, METHOD_DIM, SCOPE_DIM, SWEEP, TASK_DIM, _values

TASK_COLS_SQL = ", ".join(f'"{t}"' for t in K.TASKS)

LABELED = ANALYSIS + f""", labeled as (
  select r.*, m.method_label, s.scope_label, m.method_label || ' - ' || s.scope_label as condition
  from runs r join {METHOD_DIM} m on r.method = m.method join {SCOPE_DIM} s on r.scope = s.scope)
"""


@query("require_columns", ANALYSIS + f"select method, scope, round(macro_average, 6) as macro_average, "
       + ", ".join(f'round("{t}", 6) as "{t}"' for t in K.TASKS) + " from runs")
def q_require_columns(spark, sf):
    runs = P.run_rows(spark, sf)
    return rounded(compare.require_columns(runs).select(
        "method", "scope", "macro_average", *[F.col(f"`{t}`") for t in K.TASKS]))


@query("label_conditions", LABELED + "select method, scope, method_label, scope_label, condition "
       "from labeled")
def q_label_conditions(spark, sf):
    return P.run_rows(spark, sf).select("method", "scope", "method_label", "scope_label", "condition")


@query("first_run", ANALYSIS.rstrip() + f",\n{SWEEP},\n" + """
named as (select *, method || '-' || scope || '-r' || lpad(cast("Rank" as varchar), 2, '0') as run_dir
          from sweep_runs)
select method, scope, run_dir, round(macro_average, 6) as macro_average from (
  select *, row_number() over (partition by method, scope order by run_dir) as rn from named) z
where rn = 1""")
def q_first_run(spark, sf):
    ranked = P.ranked_rows(spark, sf)
    named = ranked.withColumn("run_dir", F.concat_ws(
        "-", "method", "scope", F.concat(F.lit("r"), F.lpad(F.col("Rank").cast("string"), 2, "0"))))
    return rounded(compare.first_run(named, "run_dir").select(
        "method", "scope", "run_dir", "macro_average"))


GAINS_SQL = (ANALYSIS + "select g.scope, s.scope_label, "
             + ", ".join(f"round(max(case when task = '{t}' then delta end), 6) as \"{t}\"" for t in K.TASKS)
             + ", round(max(m.macro_delta), 6) as macro_average "
             f"from gl g join gm m on g.scope = m.scope join {SCOPE_DIM} s on g.scope = s.scope "
             "group by g.scope, s.scope_label")


@query("paired_gains", GAINS_SQL)
def q_paired_gains(spark, sf):
    return rounded(P.analysis(spark, sf, cache=False).gains.drop("lora_macro", "dora_macro"))


@query("long_accuracy", LABELED + f"""
select l.method, l.scope, l.condition, t.task, t.task_label,
  round(a.accuracy, 6) as accuracy, round(a.accuracy * 100, 6) as accuracy_pct
from labeled l join acc a on l.method = a.method and l.scope = a.scope
join {TASK_DIM} t on a.task = t.task""")
def q_long_accuracy(spark, sf):
    la = compare.long_accuracy(P.run_rows(spark, sf))
    return rounded(la.select("method", "scope", "condition", "task", "task_label", "accuracy",
                             "accuracy_pct"))


@query("long_gains", ANALYSIS + """
select scope, scope_label, task, task_label, round(delta, 6) as delta,
  round(delta_points, 6) as delta_points, round(macro_delta_points, 6) as macro_delta_points
from glx""")
def q_long_gains(spark, sf):
    lg = P.analysis(spark, sf, cache=False).long_gains
    return rounded(lg.select("scope", "scope_label", "task", "task_label", "delta",
                             "delta_points", "macro_delta_points"))


SCOPE_SUMMARY_SQL = ANALYSIS + """
select g.scope, g.scope_label,
  round(m.lora_macro, 6) as lora_macro, round(m.dora_macro, 6) as dora_macro,
  round(m.macro_delta, 6) as delta, round(m.macro_delta * 100, 6) as delta_points,
  count(*) filter (where g.delta > 0) as task_wins,
  count(*) filter (where g.delta = 0) as task_ties,
  count(*) filter (where g.delta < 0) as task_losses,
  first(g.task_label order by g.delta desc, g.task_ord) as best_task,
  first(g.task_label order by g.delta asc, g.task_ord) as worst_task,
  round(avg(g.delta_points), 6) as mean_task_delta_points,
  round(median(g.delta_points), 6) as median_task_delta_points,
  round(stddev_pop(g.delta_points), 6) as task_delta_std_points
from glx g join gm m on g.scope = m.scope
group by g.scope, g.scope_label, m.lora_macro, m.dora_macro, m.macro_delta"""


@query("scope_summary", SCOPE_SUMMARY_SQL)
def q_scope_summary(spark, sf):
    return rounded(P.analysis(spark, sf, cache=False).scope_summary)


TASK_SUMMARY_SQL = ANALYSIS + """
select task, task_label,
  first(scope order by delta desc, scope_ord) as best_scope,
  first(scope_label order by delta desc, scope_ord) as best_scope_label,
  round(first(delta_points order by delta desc, scope_ord), 6) as best_delta_points,
  first(scope order by delta asc, scope_ord) as worst_scope,
  first(scope_label order by delta asc, scope_ord) as worst_scope_label,
  round(first(delta_points order by delta asc, scope_ord), 6) as worst_delta_points,
  count(*) filter (where delta > 0) as positive_scopes
from glx group by task, task_label"""


@query("task_summary", TASK_SUMMARY_SQL)
def q_task_summary(spark, sf):
    return rounded(P.analysis(spark, sf, cache=False).task_summary)


_PUB = _values(
    [tuple(r[c] for c in ["source", "method", "paper_method", "rank", "params_percent",
                          *K.TASKS, "macro_average"]) for r in K.PUBLISHED_REFERENCE],
    ["source", "method", "paper_method", '"rank"', "params_percent",
     *[f'"{t}"' for t in K.TASKS], "macro_average"])

COMPARISON_SQL = ANALYSIS + f""", comp as (
  select source, method, paper_method, cast("rank" as int) as "rank",
         cast(params_percent as double) as params_percent,
         {TASK_COLS_SQL}, macro_average from {_PUB} p
  union all
  select 'Reproduction', method, case method when 'lora' then 'LoRA' else 'DoRA' end,
         case method when 'lora' then 32 else 16 end, cast(null as double),
         {TASK_COLS_SQL}, macro_average from runs where scope = 'full')
"""


REFERENCE_SQL = (COMPARISON_SQL + """
select source, c.method, m.method_label, paper_method, "rank", params_percent,
  round(macro_average, 6) as macro_average, round(macro_average * 100, 6) as macro_points, """
       + ", ".join(f'round("{t}", 6) as "{t}"' for t in K.TASKS)
       + f" from comp c join {METHOD_DIM} m on c.method = m.method")


@query("reference_comparison", REFERENCE_SQL)
def q_reference_comparison(spark, sf):
    return rounded(compare.reference_comparison(P.run_rows(spark, sf)))


@query("comparison_labels", COMPARISON_SQL + f"""
select source, c.method, replace(source, ' Table 1 ', chr(10) || 'Table 1 ') as label,
  case m.method_label when 'LoRA' then 'LoRA (r=32)' when 'DoRA' then 'DoRA (r=16)' end as method_rank_label,
  round(macro_average * 100, 6) as macro_points
from comp c join {METHOD_DIM} m on c.method = m.method""")
def q_comparison_labels(spark, sf):
    comp = compare.comparison_labels(compare.reference_comparison(P.run_rows(spark, sf)))
    return rounded(comp.select("source", "method", "label", "method_rank_label", "macro_points"))


SWEEP_SQL = ANALYSIS.rstrip() + f",\n{SWEEP}\n"


@query("rank_sweep", SWEEP_SQL + f"""
select r.method, m.method_label, r.scope, cast("Rank" as int) as "rank",
  round(macro_average, 6) as macro_average, round(macro_average * 100, 6) as macro_points
from sweep_runs r join {METHOD_DIM} m on r.method = m.method""")
def q_rank_sweep(spark, sf):
    sw = compare.rank_sweep(P.ranked_rows(spark, sf))
    return rounded(sw.select("method", "method_label", "scope", "rank", "macro_average",
                             "macro_points"))


@query("rank_matched_gap", SWEEP_SQL + """
select l."Rank" as "rank", round(l.macro_average * 100, 6) as lora_macro_points,
  round(d.macro_average * 100, 6) as dora_macro_points,
  round(d.macro_average * 100 - l.macro_average * 100, 6) as gap_points
from sweep_runs l join sweep_runs d on l."Rank" = d."Rank"
where l.method = 'lora' and d.method = 'dora'""")
def q_rank_matched_gap(spark, sf):
    sw = compare.rank_sweep(P.ranked_rows(spark, sf))
    return rounded(compare.rank_matched_gap(sw))


_LABEL_COLS = [K.TASK_LABELS[t] for t in K.TASKS]


@query("accuracy_matrix", LABELED + "select condition, " + ", ".join(
    f"round(max(case when a.task = '{t}' then a.accuracy * 100 end), 6) as \"{K.TASK_LABELS[t]}\""
    for t in K.TASKS) + " from labeled l join acc a on l.method = a.method and l.scope = a.scope "
    "group by condition")
def q_accuracy_matrix(spark, sf):
    la = compare.long_accuracy(P.run_rows(spark, sf))
    return rounded(compare.accuracy_matrix(la))


@query("gain_matrix", ANALYSIS + "select scope_label, " + ", ".join(
    f"round(max(case when task = '{t}' then delta_points end), 6) as \"{K.TASK_LABELS[t]}\""
    for t in K.TASKS) + " from glx group by scope_label")
def q_gain_matrix(spark, sf):
    return rounded(compare.gain_matrix(P.analysis(spark, sf, cache=False).long_gains))


@query("gain_distribution", ANALYSIS + """
select scope, scope_label,
  round(quantile_cont(delta_points, 0.25), 6) as q1_points,
  round(quantile_cont(delta_points, 0.5), 6) as median_points,
  round(quantile_cont(delta_points, 0.75), 6) as q3_points,
  round(min(delta_points), 6) as min_points, round(max(delta_points), 6) as max_points,
  round(max(macro_delta_points), 6) as macro_delta_points, count(*) as n_tasks
from glx group by scope, scope_label""")
def q_gain_distribution(spark, sf):
    return rounded(compare.gain_distribution(P.analysis(spark, sf, cache=False).long_gains))


@query("gain_distribution_sketch", """
select l_returnflag, round(min(l_extendedprice), 6) as least, round(max(l_extendedprice), 6) as greatest, count(*) as n,
  true as q1_within, true as median_within, true as q3_within from lineitem group by l_returnflag""")
def q_gain_distribution_sketch(spark, sf):
    """The box statistics by a sketch over groups of many rows: the rank of each
    returned quartile is counted exactly and held against the stated error."""
    rows = B.table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    box = compare.box_statistics(rows, "price", ["l_returnflag"], exact=False)
    # One row per group: a few short ones.
    near = rows.join(F.broadcast(box), "l_returnflag").groupBy("l_returnflag", "least", "greatest", "n").agg(*[
        # The share below, and the share up to, the value enclose the asked rank.
        ((F.count_if(F.col("price") < F.col(c)) / F.count(F.lit(1)) <= r + compare.SKETCH_ERROR)
         & (F.count_if(F.col("price") <= F.col(c)) / F.count(F.lit(1)) >= r - compare.SKETCH_ERROR)).alias(f"{c}_within")
        for c, r in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return rounded(near)


@query("macro_by_condition", LABELED + "select scope, scope_label, method, method_label, "
       "round(macro_average * 100, 6) as macro_points from labeled")
def q_macro_by_condition(spark, sf):
    return rounded(compare.macro_by_condition(P.run_rows(spark, sf)))


@query("headline", f"""with ss as ({SCOPE_SUMMARY_SQL.replace(
    'select g.scope, g.scope_label,', 'select g.scope, g.scope_label, max(g.scope_ord) as scope_ord,', 1)}),
ts as ({TASK_SUMMARY_SQL})
select
  (select first(scope_label order by delta_points desc, scope_ord) from ss) as best_scope_label,
  (select first(delta_points order by delta_points desc, scope_ord) from ss) as best_delta_points,
  (select first(scope_label order by task_wins desc, scope_ord) from ss) as broadest_scope_label,
  (select first(task_wins order by task_wins desc, scope_ord) from ss) as broadest_task_wins,
  (select first(scope_label order by task_wins asc, scope_ord) from ss) as least_reliable_scope_label,
  (select count(*) from ts) as n_tasks,
  (select count(*) from ts where positive_scopes > 0) as tasks_with_positive_scope""")
def q_headline(spark, sf):
    # Both tables come from the gains, which are a few rows: written once.
    gains = cut_lineage(P.analysis(spark, sf, cache=False).gains)
    return rounded(compare.headline(compare.scope_summary(None, gains), compare.task_summary(gains)))
