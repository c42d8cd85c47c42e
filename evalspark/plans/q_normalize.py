"""Queries for benchmark normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import label_to_index
from evalspark.operators import normalize as N
from evalspark.plans import bindings as B
from evalspark.plans import pipelines as P
from evalspark.plans.registry import query


def sql_text(s: str) -> str:
    """A Python string as a DuckDB expression (newlines via chr(10))."""
    parts = s.split("\n")
    out = " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
    return f"({out})"


def _t(c: str) -> str:
    return f"coalesce(cast({c} as varchar), 'None')"


def _mc(q: str, choices: str) -> str:
    lines = (f"array_to_string(list_transform({choices}, lambda c, i: chr(10) || 'answer' || "
             f"cast(i as varchar) || ': ' || c), '')")
    return (f"{sql_text(K.MC_HEAD + chr(10) + chr(10) + 'Question: ')} || {q} || {lines} || "
            f"{sql_text(chr(10) + chr(10) + K.MC_FORMAT)}")


NL = "\n"
TASK_SQL = {
    "boolq": f"""select {_t('question')} as id, 'boolq' as task,
    {sql_text(K.BOOLQ_HEAD + 'Passage: ')} || {_t('passage')} || {sql_text(NL + 'Question: ')} ||
    {_t('question')} || {sql_text(NL + NL + K.BOOLQ_FORMAT)} as instruction,
    ['true', 'false'] as choices, case when answer then 'true' else 'false' end as label, pos
  from (select d.doc_id as pos, 'Is document ' || cast(d.doc_id as varchar) || ' acceptable?' as question,
               d.text as passage, l.quality = 1 as answer
        from documents d join labels l on d.doc_id = l.doc_id) r""",
    "piqa": f"""select cast(o_orderkey as varchar) as id, 'piqa' as task,
    {sql_text(K.PIQA_HEAD + 'Goal: ')} || 'Order ' || cast(o_orderkey as varchar) ||
    {sql_text(NL + 'solution1: ')} || {_t('o_orderstatus')} || {sql_text(NL + 'solution2: ')} ||
    {_t('o_orderpriority')} || {sql_text(NL + NL + K.PIQA_FORMAT)} as instruction,
    [{_t('o_orderstatus')}, {_t('o_orderpriority')}] as choices,
    'solution' || cast(o_orderkey % 2 + 1 as varchar) as label, o_orderkey as pos
  from orders""",
    "social_i_qa": f"""select cast(c_custkey as varchar) as id, 'social_i_qa' as task,
    {sql_text(K.SOCIAL_HEAD + 'Context: ')} || {_t('c_name')} || {sql_text(NL + 'Question: Which segment?' + NL + 'answer1: ')} ||
    {_t('c_mktsegment')} || {sql_text(NL + 'answer2: NONE' + NL + 'answer3: OTHER' + NL + NL + K.SOCIAL_FORMAT)} as instruction,
    [{_t('c_mktsegment')}, 'NONE', 'OTHER'] as choices,
    'answer' || cast(c_custkey % 3 + 1 as varchar) as label, c_custkey as pos
  from customer""",
    "hellaswag": f"""select cast(p_partkey as varchar) as id, 'hellaswag' as task,
    {sql_text(K.HELLASWAG_HEAD + 'Context: ')} || 'Part ' || p_name ||
    {sql_text(NL + 'ending1: ')} || p_brand || {sql_text(NL + 'ending2: ')} || p_type ||
    {sql_text(NL + 'ending3: ')} || p_name || {sql_text(NL + 'ending4: ')} || cast(p_size as varchar) ||
    {sql_text(NL + NL + K.HELLASWAG_FORMAT)} as instruction,
    [p_brand, p_type, p_name, cast(p_size as varchar)] as choices,
    'ending' || cast(p_partkey % 4 + 1 as varchar) as label, p_partkey as pos
  from part""",
    "winogrande": f"""select cast(s_suppkey as varchar) as id, 'winogrande' as task,
    {sql_text(K.WINOGRANDE_HEAD + 'Sentence: ')} || s_name || ' paid _' ||
    {sql_text(NL + 'option1: cash' + NL + 'option2: credit' + NL + NL + K.WINOGRANDE_FORMAT)} as instruction,
    ['cash', 'credit'] as choices,
    'option' || cast(s_suppkey % 2 + 1 as varchar) as label, s_suppkey as pos
  from supplier""",
    "ARC-Easy": f"""select coalesce(case when p_partkey % 5 != 0 then cast(p_partkey as varchar) end, q) as id,
    'ARC-Easy' as task, {_mc('q', 'ch')} as instruction, ch as choices,
    'answer' || cast(p_partkey % 4 + 1 as varchar) as label, p_partkey as pos
  from (select *, 'Which brand makes the ' || p_name || '?' as q,
               [p_brand, p_type, p_name, cast(p_size as varchar)] as ch from part) r""",
    "ARC-Challenge": f"""select cast(event_id as varchar) as id, 'ARC-Challenge' as task,
    {_mc('q', 'ch')} as instruction, ch as choices,
    'answer' || cast(event_id % 5 + 1 as varchar) as label, event_id as pos
  from (select *, 'What kind of event is ' || cast(event_id as varchar) || '?' as q,
               [event_type, 'view', 'click', 'purchase', 'error'] as ch from events) r""",
    "openbookqa": f"""select cast(c_custkey as varchar) as id, 'openbookqa' as task,
    {_mc('q', 'ch')} as instruction, ch as choices,
    case when c_custkey % 2 = 0 then 'answer1' else 'answer4' end as label, c_custkey as pos
  from (select *, case when c_custkey % 3 = 2 then 'Segment of ' || c_name || '?'
                       else 'What is the market segment of ' || c_name || '?' end as q,
               [c_mktsegment, 'NONE', 'OTHER', 'ALL'] as ch from customer) r""",
}

SAMPLES_SQL = "with samples as (\n" + "\nunion all\n".join(
    f"select * from ({TASK_SQL[t]}) x_{i}" for i, t in enumerate(K.TASKS)) + ")\n"

OUT_SQL = "select id, task, instruction, array_to_string(choices, '|') as choices_text, label, pos"


def _out(df):
    return df.select("id", "task", "instruction",
                     F.array_join("choices", "|").alias("choices_text"), "label", "pos")


def _one(task: str, name: str, fn):
    @query(name, f"{OUT_SQL} from ({TASK_SQL[task]}) s")
    def q(spark, sf):
        return _out(fn(B.RAW_BINDINGS[task](spark, sf)))
    return q


_one("boolq", "normalize_boolq", N.normalize_boolq)
_one("piqa", "normalize_piqa", N.normalize_piqa)
_one("social_i_qa", "normalize_social", N.normalize_social)
_one("hellaswag", "normalize_hellaswag", N.normalize_hellaswag)
_one("winogrande", "normalize_winogrande", N.normalize_winogrande)
_one("ARC-Easy", "normalize_mc_nested", lambda df: N.normalize_mc_nested(df, "ARC-Easy"))
_one("openbookqa", "normalize_mc_flat", lambda df: N.normalize_mc_flat(df, "openbookqa"))


@query("normalize_all", SAMPLES_SQL + OUT_SQL + " from samples")
def q_normalize_all(spark, sf):
    return _out(P.prepared_samples(spark, sf))


_HEAD_N = 50
_HEAD_LARGE = 5000


def _head_sql(n: int) -> str:
    return (SAMPLES_SQL + OUT_SQL + " from (select *, row_number() over "
            f"(partition by task order by pos) as rn from samples) z where rn <= {n}")


@query("head_limit", _head_sql(_HEAD_N))
def q_head_limit(spark, sf):
    return _out(N.head_limit(P.prepared_samples(spark, sf), _HEAD_N))


@query("head_limit_large", _head_sql(_HEAD_LARGE))
def q_head_limit_large(spark, sf):
    """The same plan as ``head_limit`` for a limit of thousands."""
    return _out(N.head_limit(P.prepared_samples(spark, sf), _HEAD_LARGE))


@query("label_to_index", """
select 'ARC-Easy' as task, p_partkey as pos, substr('ABCD', cast(p_partkey % 4 + 1 as int), 1) as answer_key,
       cast(p_partkey % 4 + 1 as int) as answer_index from part
union all
select 'ARC-Challenge', event_id, cast(event_id % 5 + 1 as varchar), cast(event_id % 5 + 1 as int) from events
union all
select 'openbookqa', c_custkey, case when c_custkey % 2 = 0 then 'A' else '4' end,
       case when c_custkey % 2 = 0 then 1 else 4 end from customer""")
def q_label_to_index(spark, sf):
    parts = []
    for task in ("ARC-Easy", "ARC-Challenge", "openbookqa"):
        raw = B.RAW_BINDINGS[task](spark, sf)
        parts.append(raw.select(F.lit(task).alias("task"), F.col("pos"),
                                F.col("answerKey").alias("answer_key"),
                                label_to_index("answerKey").alias("answer_index")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_CAT = ", ".join(
    f"('{t}', '{d}', {('NULL' if s is None else repr(s))}, '{sp}')"
    for t, (d, s, sp) in K.BENCHMARK_CATALOG.items())


@query("benchmark_catalog", SAMPLES_SQL + f"""
select s.task, c.dataset, c.subset, c.split, count(*) as n_samples
from samples s left join (select * from (values {_CAT}) v(task, dataset, subset, split)) c
  on s.task = c.task
group by s.task, c.dataset, c.subset, c.split""")
def q_benchmark_catalog(spark, sf):
    counts = P.prepared_samples(spark, sf).groupBy("task").agg(F.count(F.lit(1)).alias("n_samples"))
    return N.attach_catalog(counts).select("task", "dataset", "subset", "split", "n_samples")
