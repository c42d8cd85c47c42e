"""Queries for scoring."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import scoring
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.registry import query, rounded
from evalspark.plans.sql import ACC, PREDICTIONS, RUNS

GEN_SQL = f"""with {PREDICTIONS},
gen as (
  select id, method, scope, task, label,
    concat('The answer is ', case when id % 10 = 9 then 'unclear'
      when ok then upper(label) else 'untrue' end, '.') as generated_text
  from (select id, method, scope, task, ok,
          case task when 'boolq' then 'true' when 'piqa' then 'solution2'
            when 'hellaswag' then 'ending4' when 'winogrande' then 'option1'
            else 'answer3' end as label
        from predictions) z)
"""

# One regexp_extract per distinct pattern, over the lower-cased, trimmed text.
_PRED_SQL = "case " + " ".join(
    f"when task in ({', '.join(repr(t) for t in K.ANSWER_PATTERNS if K.ANSWER_PATTERNS[t] == rx)}) "
    f"then regexp_extract(lower(trim(generated_text)), '{rx}', 1)"
    for rx in dict.fromkeys(K.ANSWER_PATTERNS.values())) + " end"


@query("extract_prediction", GEN_SQL + f"select id, task, {_PRED_SQL} as prediction from gen")
def q_extract_prediction(spark, sf):
    from evalspark.functions.text import extract_prediction
    g = B.generated_text(spark, sf)
    return g.select("id", "task", extract_prediction("task", "generated_text").alias("prediction"))


@query("score_predictions", GEN_SQL + f"""
select id, task, label, prediction, prediction = label as correct, trim(generated_text) as generated_text
from (select *, {_PRED_SQL} as prediction from gen) s""")
def q_score_predictions(spark, sf):
    g = B.generated_text(spark, sf)
    return scoring.score_predictions(g).select(
        "id", "task", "label", "prediction", "correct", "generated_text")


_SELECTION = "BOOLQ, piqa,arc-easy"
_SELECTED = scoring.parse_task_selection(_SELECTION)


@query("select_tasks", f"with {PREDICTIONS} select id, method, scope, task, ok from predictions "
       f"where task in ({', '.join(repr(t) for t in _SELECTED)})")
def q_select_tasks(spark, sf):
    p = B.predictions(spark, sf)
    return scoring.select_tasks(p, _SELECTION)


# Evaluation batch size for a runtime with per-device batch 4 on a GPU (x4).
_EVAL_BATCH = 16


@query("batch_slices", f"""with {PREDICTIONS}
select id, task,
  cast(floor((row_number() over (partition by task order by id) - 1) / {_EVAL_BATCH}) as bigint) as batch,
  cast((row_number() over (partition by task order by id) - 1) % {_EVAL_BATCH} as int) as batch_offset
from predictions""")
def q_batch_slices(spark, sf):
    p = B.predictions(spark, sf).select("id", "task")
    return scoring.batch_slices(p, _EVAL_BATCH, order_cols=["id"], group_cols=["task"])


@query("task_accuracy", f"with {PREDICTIONS},\n{ACC}\n"
       "select method, scope, task, n, n_correct, round(accuracy, 6) as accuracy from acc")
def q_task_accuracy(spark, sf):
    return rounded(P.run_accuracy(spark, sf).select(
        "method", "scope", "task", "n", "n_correct", "accuracy"))


@query("macro_average", f"with {PREDICTIONS},\n{ACC},\n{RUNS}\n"
       "select method, scope, round(macro_average, 6) as macro_average, n_tasks from runs")
def q_macro_average(spark, sf):
    return rounded(scoring.macro_average(P.run_accuracy(spark, sf)))


_WIDE = ", ".join(f'round("{t}", 6) as "{t}"' for t in K.TASKS)


@query("run_metrics", f"with {PREDICTIONS},\n{ACC},\n{RUNS}\n"
       f"select method, scope, {_WIDE}, round(macro_average, 6) as macro_average, n_tasks from runs")
def q_run_metrics(spark, sf):
    return rounded(scoring.run_metrics(P.run_accuracy(spark, sf)))


def fake_generator_factory():
    """A deterministic stand-in for a model: answers with the first option
    listed in the prompt's answer-format line."""
    rx = re.compile(r"Answer format: ([a-z0-9]+)")

    def generate(prompts: list[str]) -> list[str]:
        out = []
        for p in prompts:
            m = rx.search(p)
            out.append(f"  I pick {m.group(1) if m else 'nothing'}.\n")
        return out
    return generate


def generate_sql() -> str:
    from evalspark.plans.q_normalize import SAMPLES_SQL
    return SAMPLES_SQL + """
select task, pos, id,
  concat('I pick ', coalesce(nullif(regexp_extract(instruction, 'Answer format: ([a-z0-9]+)', 1), ''),
                             'nothing'), '.') as generated_text
from samples"""


@query("generate_batches", None)
def q_generate_batches(spark, sf):
    s = scoring.with_eval_prompt(P.prepared_samples(spark, sf))
    g = scoring.generate_batches(s, fake_generator_factory, batch_size=_EVAL_BATCH,
                                 keep=("task", "pos", "id"))
    return g.withColumn("generated_text", F.regexp_replace("generated_text", r"^\s+|\s+$", ""))
