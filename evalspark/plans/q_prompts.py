"""Queries for prompt text (C1-C4); C5 lives with scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import eval_prompt, format_prompt, training_prompt, user_prompt
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.q_normalize import SAMPLES_SQL, sql_text
from evalspark.plans.registry import query

TRAINING_SQL = """training as (
  select u.conv_id, u.turn, u.text as instruction, coalesce(y.text, '') as input, a.text as output
  from conversations u
  join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and a.role = 'assistant'
  left join conversations y on y.conv_id = u.conv_id and y.role = 'system'
  where u.role = 'user')"""

NO_INPUT = (f"{sql_text(K.PROMPT_NO_INPUT_HEAD + K.PROMPT_INSTRUCTION)} || instruction || "
            f"{sql_text(chr(10) + chr(10) + K.PROMPT_RESPONSE)}")
WITH_INPUT = (f"{sql_text(K.PROMPT_WITH_INPUT_HEAD + K.PROMPT_INSTRUCTION)} || instruction || "
              f"{sql_text(chr(10) + chr(10) + K.PROMPT_INPUT)} || input || "
              f"{sql_text(chr(10) + chr(10) + K.PROMPT_RESPONSE)}")
PROMPT_SQL = f"(case when input <> '' then {WITH_INPUT} else {NO_INPUT} end)"


@query("format_prompt", f"with {TRAINING_SQL} select conv_id, turn, {PROMPT_SQL} as prompt from training")
def q_format_prompt(spark, sf):
    t = B.training_samples(spark, sf)
    return t.select("conv_id", "turn", format_prompt("instruction", "input").alias("prompt"))


@query("training_prompt", f"with {TRAINING_SQL} select conv_id, turn, "
       f"{PROMPT_SQL} || output as full_prompt from training")
def q_training_prompt(spark, sf):
    t = B.training_samples(spark, sf)
    return t.select("conv_id", "turn",
                    training_prompt("instruction", "input", "output").alias("full_prompt"))


@query("user_prompt", f"with {TRAINING_SQL} select conv_id, turn, input <> '' as has_input, "
       f"{PROMPT_SQL} as user_prompt from training")
def q_user_prompt(spark, sf):
    t = B.training_samples(spark, sf)
    return t.select("conv_id", "turn", (F.col("input") != "").alias("has_input"),
                    user_prompt("instruction", "input").alias("user_prompt"))


@query("eval_prompt", SAMPLES_SQL + f"select task, pos, {NO_INPUT} as prompt from samples")
def q_eval_prompt(spark, sf):
    s = P.prepared_samples(spark, sf)
    return s.select("task", "pos", eval_prompt("instruction").alias("prompt"))
