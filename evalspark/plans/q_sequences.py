"""Queries for training-sequence preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import sequences as S
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.q_prompts import PROMPT_SQL, TRAINING_SQL
from evalspark.plans.registry import query

RX = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]+"
CUTOFF = 256
VAL_SIZE = 120
SEED = 42
PAD_BATCH = 8

TOKEN_SQL = f"""with {TRAINING_SQL},
prompts as (select conv_id, turn, {PROMPT_SQL} || output as full_prompt, {PROMPT_SQL} as user_prompt
            from training),
vocab as (
  select token, cast(row_number() over (order by n desc, token) + 3 as int) as id
  from (select token, count(*) as n
        from (select unnest(regexp_extract_all(text, '{RX}')) as token from benchmark) t
        group by token order by n desc, token limit 200) c),
pieces as (
  select conv_id, turn, 'full' as which, unnest(tk) as token, generate_subscripts(tk, 1) as i
  from (select conv_id, turn, regexp_extract_all(full_prompt, '{RX}') as tk from prompts) a
  union all
  select conv_id, turn, 'user', unnest(tk), generate_subscripts(tk, 1)
  from (select conv_id, turn, regexp_extract_all(user_prompt, '{RX}') as tk from prompts) b),
enc as (
  select conv_id, turn, which, list(coalesce(v.id, 3) order by i) as ids
  from pieces p left join vocab v on p.token = v.token group by conv_id, turn, which),
seqs as (
  select f.conv_id, f.turn, f.ids as raw_ids,
    case when f.ids[-1] <> 2 and len(list_slice(f.ids, 1, {CUTOFF})) < {CUTOFF}
         then list_append(list_slice(f.ids, 1, {CUTOFF}), 2) else list_slice(f.ids, 1, {CUTOFF}) end
      as input_ids,
    least(len(u.ids), {CUTOFF}) as prompt_len
  from enc f join enc u on f.conv_id = u.conv_id and f.turn = u.turn
  where f.which = 'full' and u.which = 'user'),
model_in as (
  select *, list_transform(input_ids, lambda x: 1) as attention_mask,
    list_transform(input_ids, lambda x, i: case when i <= prompt_len then -100 else x end) as labels
  from seqs),
split as (
  select *, case when row_number() over (
      order by sha256(concat_ws(':', '{SEED}', cast(conv_id as varchar), cast(turn as varchar))),
               conv_id, turn) <= {VAL_SIZE} then 'validation' else 'train' end as split
  from model_in)
"""


def _txt(c: str):
    return P.as_text_array(c)


def _sql_txt(c: str) -> str:
    return f"array_to_string({c}, ',')"


@query("cap_samples", f"with {TRAINING_SQL} select conv_id, turn from training "
       "order by conv_id, turn limit 100")
def q_cap_samples(spark, sf):
    return S.cap_samples(B.training_samples(spark, sf), 100, ["conv_id", "turn"]).select(
        "conv_id", "turn")


@query("cap_samples_large", f"with {TRAINING_SQL} select conv_id, turn, output from training "
       "order by conv_id, turn limit 5000")
def q_cap_samples_large(spark, sf):
    return S.cap_samples(B.training_samples(spark, sf), 5000, ["conv_id", "turn"]).select("conv_id", "turn", "output")


@query("encode_tokens", TOKEN_SQL + f"select conv_id, turn, len(raw_ids) as n_tokens, "
       f"{_sql_txt('raw_ids')} as ids_text from seqs")
def q_encode_tokens(spark, sf):
    t = P.training_with_prompts(spark, sf)
    enc = S.encode_tokens(t, "full_prompt", P.vocabulary(spark, sf), ["conv_id", "turn"],
                          out="raw_ids")
    return enc.select("conv_id", "turn", F.size("raw_ids").cast("bigint").alias("n_tokens"),
                      _txt("raw_ids").alias("ids_text"))


@query("truncate_append_eos", TOKEN_SQL + f"select conv_id, turn, len(input_ids) as n_tokens, "
       f"{_sql_txt('input_ids')} as ids_text from seqs")
def q_truncate_append_eos(spark, sf):
    tok = P.tokenized(spark, sf, CUTOFF)
    return tok.select("conv_id", "turn", F.size("input_ids").cast("bigint").alias("n_tokens"),
                      _txt("input_ids").alias("ids_text"))


@query("attention_mask", TOKEN_SQL + f"select conv_id, turn, {_sql_txt('attention_mask')} as mask_text "
       "from model_in")
def q_attention_mask(spark, sf):
    tok = P.tokenized(spark, sf, CUTOFF)
    return tok.select("conv_id", "turn", _txt("attention_mask").alias("mask_text"))


@query("mask_labels", TOKEN_SQL + f"select conv_id, turn, prompt_len, {_sql_txt('labels')} as labels_text "
       "from model_in")
def q_mask_labels(spark, sf):
    tok = P.tokenized(spark, sf, CUTOFF)
    return tok.select("conv_id", "turn", F.col("prompt_len").cast("bigint").alias("prompt_len"),
                      _txt("labels").alias("labels_text"))


@query("holdout_split", TOKEN_SQL + "select conv_id, turn, split from split")
def q_holdout_split(spark, sf):
    return P.split_sequences(spark, sf, CUTOFF, VAL_SIZE, SEED).select("conv_id", "turn", "split")


LARGE_VAL = 1_000


@query("holdout_split_large", TOKEN_SQL.replace(f"<= {VAL_SIZE} then", f"<= {LARGE_VAL} and count(*) over () > {LARGE_VAL} then")
       + "select conv_id, turn, split from split")
def q_holdout_split_large(spark, sf):
    return P.split_sequences(spark, sf, CUTOFF, LARGE_VAL, SEED).select("conv_id", "turn", "split")


@query("pad_batches", TOKEN_SQL + f""", batched as (
  select *, cast(floor((row_number() over (order by conv_id, turn) - 1) / {PAD_BATCH}) as bigint) as batch
  from model_in),
padded as (
  select *, cast(ceil(max(len(input_ids)) over (partition by batch) / 8) * 8 as int) as padded_length
  from batched)
select conv_id, turn, batch, padded_length,
  repeat('0,', padded_length - len(input_ids)) || {_sql_txt('input_ids')} as ids_text,
  repeat('0,', padded_length - len(input_ids)) || {_sql_txt('attention_mask')} as mask_text,
  repeat('-100,', padded_length - len(input_ids)) || {_sql_txt('labels')} as labels_text
from padded""")
def q_pad_batches(spark, sf):
    tok = P.tokenized(spark, sf, CUTOFF)
    padded = S.pad_batches(tok, PAD_BATCH, ["conv_id", "turn"])
    return padded.select("conv_id", "turn", "batch", "padded_length",
                         _txt("input_ids").alias("ids_text"), _txt("attention_mask").alias("mask_text"),
                         _txt("labels").alias("labels_text"))


@query("sequence_report", TOKEN_SQL + """
select split, count(*) as examples, cast(sum(len(input_ids)) as bigint) as tokens,
  cast(max(len(input_ids)) as bigint) as max_length,
  count(*) filter (where list_bool_and(list_transform(labels, lambda x: x = -100))) as fully_masked
from split group by split""")
def q_sequence_report(spark, sf):
    return S.sequence_report(P.split_sequences(spark, sf, CUTOFF, VAL_SIZE, SEED))
