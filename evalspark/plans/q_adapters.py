"""Queries for adapter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.operators import adapters as H
from evalspark.plans import bindings as B
from evalspark.plans.registry import query, rounded

PROJ_CASE = "case cast(p_partkey % 7 as int) " + " ".join(
    f"when {i} then '{p}'" for i, p in enumerate(B._PROJ)) + " end"

MODULES_SQL = f"""modules as (
  select p_brand as model, 'layers.' || cast(p_partkey as varchar) || '.' || {PROJ_CASE} as module_name,
         cast(p_size * 64 as bigint) as in_features, cast((p_size + 1) * 32 as bigint) as out_features
  from part),
targets as (select * from (values {', '.join(f"('{s}', '{t}')" for s, ts in K.TARGET_MODULES.items() for t in ts)}) v(scope, suffix)),
scopes as (select distinct scope from targets),
selected as (
  select m.*, s.scope from modules m join scopes s on true
  where exists (select 1 from targets t where t.scope = s.scope and suffix(m.module_name, t.suffix)))"""

RANKS = (4, 8, 16, 32)


@query("select_modules", f"with {MODULES_SQL} select model, scope, module_name from selected")
def q_select_modules(spark, sf):
    return H.select_modules(B.modules(spark, sf)).select("model", "scope", "module_name")


@query("adapter_parameters", f"""with {MODULES_SQL},
agg as (select model, scope, sum(in_features + out_features) as io, sum(out_features) as o,
               count(*) as n_modules from selected group by model, scope)
select model, scope, m.method, r.rank, n_modules,
  cast(r.rank * io + case when m.method = 'dora' then o else 0 end as bigint) as trainable_parameters
from agg, (values ('lora'), ('dora')) m(method), (values {', '.join(f'({r})' for r in RANKS)}) r(rank)""")
def q_adapter_parameters(spark, sf):
    sel = H.select_modules(B.modules(spark, sf))
    return H.adapter_parameters(sel, RANKS)


MANIFEST_SQL = f"""{MODULES_SQL},
manifest as (
  select model, scope, 'lora' as method, module_name || '.' || p as param_name
  from selected, (values ('lora_A'), ('lora_B')) v(p)
  union all
  select model, scope, 'dora', module_name || '.' || p
  from selected, (values ('lora_A'), ('lora_B'), ('magnitude')) v(p))"""


def _manifest(spark, sf):
    sel = H.select_modules(B.modules(spark, sf))
    with_method = sel.withColumn("method", F.explode(F.array(*[F.lit(m) for m in K.METHODS])))
    return H.parameter_manifest(with_method)


@query("parameter_manifest", f"with {MANIFEST_SQL} select model, scope, method, param_name from manifest")
def q_parameter_manifest(spark, sf):
    return _manifest(spark, sf).select("model", "scope", "method", "param_name")


@query("reconcile_names", f"""with {MANIFEST_SQL},
e as (select model, param_name from manifest where method = 'lora' and scope = 'full'),
l as (select model, param_name from manifest where method = 'dora' and scope = 'attention_only')
select model, param_name, 'missing' as kind from (select * from e except select * from l) a
union all
select model, param_name, 'unexpected' from (select * from l except select * from e) b""")
def q_reconcile_names(spark, sf):
    m = _manifest(spark, sf)
    expected = m.filter((F.col("method") == "lora") & (F.col("scope") == "full"))
    loaded = m.filter((F.col("method") == "dora") & (F.col("scope") == "attention_only"))
    return H.reconcile_names(expected, loaded).select("model", "param_name", "kind")


S = B.ADAPTER_ALPHA / B.ADAPTER_RANK

VEC_SQL = f"""arows as (
  select label as module, row_number() over (partition by label order by vec_id) - 1 as k, embedding
  from embeddings qualify k < {B.ADAPTER_RANK}),
A as (select module, k, unnest(embedding)::double as a, generate_subscripts(embedding, 1) - 1 as j
      from arows),
W as (select vec_id as row_idx, label as module, unnest(embedding)::double as w,
             generate_subscripts(embedding, 1) - 1 as j
      from embeddings),
Bc as (select vec_id as row_idx, label as module, k, cast((vec_id + k) % 5 - 2 as double) / 10 as b
       from embeddings, (select unnest(range({B.ADAPTER_RANK})) as k) kk),
bias as (select vec_id as row_idx, cast(label as double) / 10 as bias from embeddings),
delta as (select b.row_idx, a.j, sum(b.b * a.a) * {S} as d from Bc b join A a
          on b.module = a.module and b.k = a.k group by b.row_idx, a.j),
merged as (select w.row_idx, w.j, w.w, w.w + d.d as md from W w join delta d
           on w.row_idx = d.row_idx and w.j = d.j),
mnorm as (select row_idx, sqrt(sum(md * md)) as nrm from merged group by row_idx),
X as (select cast(n_nationkey as bigint) as x_id, n_nationkey % 10 as module, j,
             cast(((n_nationkey * 7 + j) % 11 - 5) as double) / 10 as x
      from nation, (select unnest(range(64)) as j) jj),
XM as (select distinct x_id, module from X),
ax as (select x.x_id, a.k, sum(a.a * x.x) as ax from A a join X x on a.module = x.module and a.j = x.j
       group by x.x_id, a.k),
wx as (select x.x_id, w.row_idx, sum(w.w * x.x) as wx from W w join X x
       on w.module = x.module and w.j = x.j group by x.x_id, w.row_idx),
bax as (select xm.x_id, b.row_idx, sum(b.b * ax.ax) as bax
        from Bc b join XM xm on b.module = xm.module join ax on ax.x_id = xm.x_id and ax.k = b.k
        group by xm.x_id, b.row_idx)"""


def _long(df, arr: str):
    return df.select("row_idx", F.posexplode(arr).alias("j", "value")).select(
        F.col("row_idx").cast("bigint").alias("row_idx"), F.col("j").cast("bigint").alias("j"),
        "value")


@query("row_magnitude", "select vec_id as row_idx, round(sqrt(sum(x * x)), 6) as magnitude from "
       "(select vec_id, unnest(embedding)::double as x from embeddings) z group by vec_id")
def q_row_magnitude(spark, sf):
    w = B.weight_rows(spark, sf)
    return rounded(H.row_magnitude(w).select(F.col("row_idx").cast("bigint"), "magnitude"))


@query("lowrank_delta", f"with {VEC_SQL} select row_idx, cast(j as bigint) as j, (round(d, 6) + 0.0) as value "
       "from delta")
def q_lowrank_delta(spark, sf):
    d = H.lowrank_delta(B.weight_rows(spark, sf), B.a_rows(spark, sf), B.ADAPTER_ALPHA,
                        B.ADAPTER_RANK)
    return rounded(_long(d, "delta"))


@query("merge_lora", f"with {VEC_SQL} select row_idx, cast(j as bigint) as j, (round(md, 6) + 0.0) as value "
       "from merged")
def q_merge_lora(spark, sf):
    m = H.merge_lora(B.weight_rows(spark, sf), B.a_rows(spark, sf), B.ADAPTER_ALPHA, B.ADAPTER_RANK)
    return rounded(_long(m, "merged"))


@query("merge_dora", f"with {VEC_SQL} select m.row_idx, cast(j as bigint) as j, "
       f"(round(md * ({B.DORA_MAGNITUDE} / greatest(n.nrm, 1e-12)), 6) + 0.0) as value "
       "from merged m join mnorm n on m.row_idx = n.row_idx")
def q_merge_dora(spark, sf):
    m = H.merge_dora(B.weight_rows(spark, sf), B.a_rows(spark, sf), B.ADAPTER_ALPHA, B.ADAPTER_RANK)
    return rounded(_long(m, "merged"))


@query("project_lora", f"with {VEC_SQL} select wx.x_id, wx.row_idx, "
       f"(round(wx.wx + bias.bias + {S} * bax.bax, 6) + 0.0) as y from wx "
       "join bias on wx.row_idx = bias.row_idx "
       "join bax on wx.x_id = bax.x_id and wx.row_idx = bax.row_idx")
def q_project_lora(spark, sf):
    y = H.project_lora(B.input_batch(spark, sf), B.weight_rows(spark, sf), B.a_rows(spark, sf),
                       B.ADAPTER_ALPHA, B.ADAPTER_RANK)
    return rounded(y.select("x_id", F.col("row_idx").cast("bigint"), "y"))


@query("project_dora", f"""with {VEC_SQL},
g as (select row_idx, {B.DORA_MAGNITUDE} / greatest(nrm, 1e-12) as g from mnorm)
select wx.x_id, wx.row_idx,
  (round((wx.wx + bias.bias) + (g.g - 1) * wx.wx + g.g * {S} * bax.bax, 6) + 0.0) as y
from wx join bias on wx.row_idx = bias.row_idx join g on wx.row_idx = g.row_idx
join bax on wx.x_id = bax.x_id and wx.row_idx = bax.row_idx""")
def q_project_dora(spark, sf):
    y = H.project_dora(B.input_batch(spark, sf), B.weight_rows(spark, sf), B.a_rows(spark, sf),
                       B.ADAPTER_ALPHA, B.ADAPTER_RANK)
    return rounded(y.select("x_id", F.col("row_idx").cast("bigint"), "y"))
