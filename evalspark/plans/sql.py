"""DuckDB SQL for the oracle check: the same bindings and computations,
written independently as plain SQL over the driver's parquet views."""

from __future__ import annotations

from evalspark import constants as K


def _values(rows, cols) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(select * from (values {body}) v({', '.join(cols)}))"


TASK_DIM = _values([(t, K.TASK_LABELS[t], i) for i, t in enumerate(K.TASKS)],
                   ["task", "task_label", "task_ord"])
SCOPE_DIM = _values([(s, K.SCOPE_LABELS[s], i) for i, s in enumerate(K.SCOPES)],
                    ["scope", "scope_label", "scope_ord"])
METHOD_DIM = _values([(m, K.METHOD_LABELS[m], i) for i, m in enumerate(K.METHODS)],
                     ["method", "method_label", "method_ord"])


def task_case(expr: str) -> str:
    whens = " ".join(f"when {i} then '{t}'" for i, t in enumerate(K.TASKS))
    return f"case cast({expr} as int) {whens} end"


PREDICTIONS = f"""predictions as (
  select o_orderkey as id,
    case when o_orderkey % 2 = 0 then 'lora' else 'dora' end as method,
    case when floor(o_orderkey/2) % 3 = 0 then 'full'
         when floor(o_orderkey/2) % 3 = 1 then 'attention_only' else 'mlp_only' end as scope,
    {task_case('floor(o_orderkey/6) % 8')} as task,
    (o_custkey*7 + o_orderkey*13) % 100 < 70 as ok
  from orders)"""

ACC = """acc as (
  select method, scope, task, count(*) as n,
         cast(sum(case when ok then 1 else 0 end) as bigint) as n_correct,
         cast(sum(case when ok then 1 else 0 end) as double) / count(*) as accuracy
  from predictions group by method, scope, task)"""


def wide_cols(src: str = "accuracy") -> str:
    return ",\n    ".join(f"max(case when task = '{t}' then {src} end) as \"{t}\"" for t in K.TASKS)


RUNS = f"""runs as (
  select method, scope,
    {wide_cols()},
    avg(accuracy) as macro_average, count(accuracy) as n_tasks
  from acc group by method, scope)"""

GAINS = f"""gl as (
  select l.scope, l.task, d.accuracy - l.accuracy as delta
  from acc l join acc d on l.scope = d.scope and l.task = d.task
   and l.method = 'lora' and d.method = 'dora'),
gm as (
  select l.scope, l.macro_average as lora_macro, d.macro_average as dora_macro,
         d.macro_average - l.macro_average as macro_delta
  from runs l join runs d on l.scope = d.scope and l.method = 'lora' and d.method = 'dora'),
glx as (
  select g.scope, s.scope_label, s.scope_ord, g.task, t.task_label, t.task_ord, g.delta,
         g.delta * 100 as delta_points, m.macro_delta, m.macro_delta * 100 as macro_delta_points
  from gl g join {TASK_DIM} t on g.task = t.task join {SCOPE_DIM} s on g.scope = s.scope
  join gm m on g.scope = m.scope)"""

ANALYSIS = f"with {PREDICTIONS},\n{ACC},\n{RUNS},\n{GAINS}\n"

# Sweep: predictions relabelled as (method, rank), full scope.
SWEEP = f"""sweep_pred as (
  select id, task, ok,
    case when id % 7 <= 3 then 'lora' else 'dora' end as method,
    case id % 7 when 0 then 32 when 1 then 16 when 2 then 8 when 3 then 4
                when 4 then 16 when 5 then 8 else 4 end as rank,
    'full' as scope
  from predictions),
sweep_acc as (
  select method, scope, rank, task, count(*) as n,
         cast(sum(case when ok then 1 else 0 end) as double) / count(*) as accuracy
  from sweep_pred group by method, scope, rank, task),
sweep_runs as (
  select method, scope, rank as "Rank",
    {wide_cols()},
    avg(accuracy) as macro_average
  from sweep_acc group by method, scope, rank)"""
