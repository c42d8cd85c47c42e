"""Low-rank adapter tables (H1-H10), re-aimed at many models / large vector tables.

Layouts:
- modules: ``model, module_name, in_features, out_features`` (one row per linear layer)
- weight rows: ``module, row_idx, w ARRAY<DOUBLE>, b ARRAY<DOUBLE>`` (+ optional
  ``bias DOUBLE``, ``m DOUBLE``): row ``row_idx`` of W, of B (rank wide), the
  bias entry and the magnitude entry for that output row.
- A: ``module, k, a ARRAY<DOUBLE>`` (rank rows of width in_features).

Weight rows are the distributed side and never shuffle; A (rank rows per
module) and the input batch are broadcast within a checked bound, and each
Arrow batch of weight rows meets them in one matrix product per module. Beyond
the bound both sides are dealt out by blocks (``operators/blocks.py``).
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, StructField, StructType

from evalspark import constants as K
from evalspark.functions.vectors import l2_norm
from evalspark.operators.blocks import map_blocks, matrix, vectors
from evalspark.operators.common import require

NORM_FLOOR = 1e-12
SUPPORTED_TYPES = ("Linear", "Linear4bit")


def select_modules(modules: DataFrame, scopes: Sequence[str] = K.SCOPES,
                   targets: Mapping[str, Sequence[str]] = K.TARGET_MODULES,
                   type_col: str | None = None) -> DataFrame:
    """H1: modules whose name ends with any target suffix of each scope.

    One scan: scopes are a closed, driver-side vocabulary, so the scopes that
    take a module are constant ``endswith`` predicates on its row, and a
    model's matches are counted over its own rows (a model's inventory is a
    few thousand rows). A (model, scope) with zero matches raises, as does a
    matched module of an unsupported (or already adapted) type.
    """
    def takes(scope: str) -> Column:
        hits = [F.col("module_name").endswith(suffix) for suffix in targets[scope]]
        return reduce(operator.or_, hits, F.lit(False))

    taken = {f"_takes{i}": F.coalesce(takes(s), F.lit(False)) for i, s in enumerate(scopes)}
    seen = {f"_seen{i}": F.max(f"_takes{i}").over(Window.partitionBy("model")) for i in range(len(scopes))}
    rows = modules.withColumns(taken).withColumns(seen)
    for i, scope in enumerate(scopes):
        rows = require(rows, F.col(f"_seen{i}"), F.concat(
            F.lit("no target modules for model "), F.coalesce(F.col("model").cast("string"), F.lit("NULL")),
            F.lit(f" scope {scope}")))
    wanted = F.filter(F.array(*[F.when(F.col(f"_takes{i}"), F.lit(s)) for i, s in enumerate(scopes)]),
                      lambda x: x.isNotNull())
    selected = rows.withColumn("scope", F.explode(wanted)).select(*modules.columns, "scope")
    if type_col is not None:
        selected = require(selected, F.col(type_col).isin(*SUPPORTED_TYPES), F.concat(
            F.lit("unsupported target module type: "), F.coalesce(F.col(type_col), F.lit("NULL"))))
    return selected


def adapter_parameters(selected: DataFrame, ranks: Sequence[int],
                       methods: Sequence[str] = K.METHODS) -> DataFrame:
    """H2: trainable parameters per (model, scope, method, rank):
    lora sum r*(in+out); dora adds sum out (the magnitude vector)."""
    base = selected.groupBy("model", "scope").agg(
        F.sum(F.col("in_features").cast("long") + F.col("out_features").cast("long"))
         .alias("_io"),
        F.sum(F.col("out_features").cast("long")).alias("_out"),
        F.count(F.lit(1)).alias("n_modules"))
    grid = (base.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))
                .withColumn("rank", F.explode(F.array(*[F.lit(int(r)) for r in ranks]))))
    lora = F.col("rank").cast("long") * F.col("_io")
    trainable = F.when(F.col("method") == "dora", lora + F.col("_out")).otherwise(lora)
    return grid.select("model", "scope", "method", "rank", "n_modules",
                       trainable.alias("trainable_parameters"))


def parameter_manifest(selected: DataFrame, method_col: str = "method",
                       sort: bool = False) -> DataFrame:
    """H4: ``module.param`` names per adapted module (dora adds magnitude).

    ``sort`` orders the names (a distributed range sort), as a written
    manifest lists them; a DataFrame has no order otherwise."""
    params = F.when(F.col(method_col) == "dora",
                    F.array(F.lit("lora_A"), F.lit("lora_B"), F.lit("magnitude"))
                    ).otherwise(F.array(F.lit("lora_A"), F.lit("lora_B")))
    out = selected.withColumn("_p", F.explode(params))
    out = out.withColumn("param_name", F.concat(F.col("module_name"), F.lit("."), F.col("_p"))
                         ).drop("_p")
    return out.orderBy("model", "param_name") if sort else out


def reconcile_names(expected: DataFrame, loaded: DataFrame,
                    keys: Sequence[str] = ("model",), name_col: str = "param_name") -> DataFrame:
    """H3: names expected but not loaded (``missing``) and loaded but not
    expected (``unexpected``), one row each; empty means the sets agree."""
    sides = [side.select(*keys, name_col, F.lit(i == 0).alias("_e"), F.lit(i == 1).alias("_l"))
             for i, side in enumerate((expected, loaded))]
    both = sides[0].unionByName(sides[1]).groupBy(*keys, name_col).agg(
        F.max("_e").alias("_e"), F.max("_l").alias("_l"))  # pre-aggregated before the one shuffle
    kind = F.when(~F.col("_l"), "missing").when(~F.col("_e"), "unexpected")
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull()).drop("_e", "_l")


def require_reconciled(diff: DataFrame) -> DataFrame:
    """H3 strict: any mismatch raises when the result is computed."""
    return require(diff, F.lit(False), F.concat(
        F.lit("Adapter checkpoint mismatch: "), F.col("kind"), F.lit(" "), F.col("param_name")))


def row_magnitude(weights: DataFrame, w_col: str = "w", out: str = "magnitude") -> DataFrame:
    """H5: L2 norm of every weight row."""
    return weights.withColumn(out, l2_norm(w_col))


def _scaling(alpha: float, rank: int) -> float:
    if rank <= 0:
        raise ValueError(f"rank {rank} is not positive")
    return float(alpha) / float(rank)


def _low_rank(module, rows: pa.Table, a: pa.Table, s: float) -> np.ndarray:
    """``s * B A`` of a block of rows."""
    if not a.num_rows:
        raise ValueError(f"no rows of A for module {module}")
    b_rows, a_rows = matrix(rows.column("b")), matrix(a.sort_by("k").column("a"))
    if b_rows.shape[1] != len(a_rows):
        raise ValueError(f"module {module}: rows of B have {b_rows.shape[1]} entries, A has {len(a_rows)} rows")
    return s * (b_rows @ a_rows)


def _magnitudes(module, rows: pa.Table, m_col: str, merged: np.ndarray) -> np.ndarray:
    m = rows.column(m_col)
    if m.null_count:
        raise ValueError(f"a row of module {module} has no magnitude")
    return m.to_numpy().astype(np.float64) / np.maximum(np.linalg.norm(merged, axis=1), NORM_FLOOR)


def _bias(rows: pa.Table) -> np.ndarray | float:
    if "bias" not in rows.column_names:
        return 0.0
    return rows.column("bias").to_numpy().astype(np.float64)


def _with_rows(weights: DataFrame, a_rows: DataFrame, out: str, kind: DataType, values) -> DataFrame:
    """``weights`` with a column made from each block of rows and its A."""
    names = weights.columns

    def block(module, rows: pa.Table, a: pa.Table) -> pa.Table:
        return rows.select(names).append_column(out, values(module, rows, a))

    schema = StructType([*weights.schema.fields, StructField(out, kind)])
    spread = [c for c, t in weights.dtypes if not t.startswith(("array", "map"))]
    return map_blocks(weights, a_rows.select("module", "k", "a"), "module", ["a"], block, schema, spread, whole=True)


def lowrank_delta(weights: DataFrame, a_rows: DataFrame, alpha: float, rank: int,
                  out: str = "delta") -> DataFrame:
    """H6: row i of ``B·A · alpha/rank``, one matrix product per block of rows;
    rank <= 0 is an error, as is a module without rows of A."""
    s = _scaling(alpha, rank)
    return _with_rows(weights, a_rows, out, ArrayType(DoubleType()),
                      lambda module, rows, a: vectors(_low_rank(module, rows, a, s)))


def merge_lora(weights: DataFrame, a_rows: DataFrame, alpha: float, rank: int) -> DataFrame:
    """H7: merged row ``w + delta``."""
    s = _scaling(alpha, rank)
    return _with_rows(weights, a_rows, "merged", ArrayType(DoubleType()),
                      lambda module, rows, a: vectors(matrix(rows.column("w")) + _low_rank(module, rows, a, s)))


def merge_dora(weights: DataFrame, a_rows: DataFrame, alpha: float, rank: int,
               m_col: str = "m") -> DataFrame:
    """H8: ``d = w + delta``; merged row ``d * m / max(||d||, 1e-12)``. A row
    without magnitude fails the job."""
    s = _scaling(alpha, rank)

    def merged(module, rows, a):
        d = matrix(rows.column("w")) + _low_rank(module, rows, a, s)
        return vectors(d * _magnitudes(module, rows, m_col, d)[:, None])

    return _with_rows(weights, a_rows, "merged", ArrayType(DoubleType()), merged)


def _with_ax(x: DataFrame, a_rows: DataFrame) -> DataFrame:
    """A·x once per input vector (rank-sized), before it meets the weight rows."""
    def values(module, rows, a):
        if not a.num_rows:
            raise ValueError(f"no rows of A for module {module}")
        return vectors(matrix(rows.column("x")) @ matrix(a.sort_by("k").column("a")).T)

    return _with_rows(x, a_rows, "_ax", ArrayType(DoubleType()), values)


def _projected(x: DataFrame, rows: DataFrame, arrays: Sequence[str], product) -> DataFrame:
    """One row per (module, input, block of rows): ``row_idx`` and ``y`` as
    arrays; ``product(rows, inputs)`` gives the matrix input by row."""
    def block(module, part: pa.Table, xs: pa.Table) -> pa.Table | None:
        if not xs.num_rows:
            return None
        y = product(part, xs)
        n, index = part.num_rows, part.column("row_idx").combine_chunks()
        every = pa.ListArray.from_arrays(pa.array(np.arange(xs.num_rows + 1) * n, pa.int32()),
                                         pa.concat_arrays([index] * xs.num_rows))
        return pa.table({"module": pa.array([module] * xs.num_rows, part.schema.field("module").type),
                         "x_id": xs.column("x_id"), "row_idx": every, "y": vectors(y)})

    kinds = {"module": rows.schema["module"].dataType, "x_id": x.schema["x_id"].dataType,
             "row_idx": ArrayType(rows.schema["row_idx"].dataType), "y": ArrayType(DoubleType())}
    schema = StructType([StructField(c, t) for c, t in kinds.items()])
    return map_blocks(rows, x.select("module", "x_id", *arrays), "module", arrays, block, schema, ["row_idx"])


def _by_row(blocks: DataFrame) -> DataFrame:
    return blocks.select("module", "x_id", F.explode(F.arrays_zip("row_idx", "y")).alias("_p")).select(
        "module", "x_id", "_p.row_idx", "_p.y")


def project_lora_blocks(x: DataFrame, weights: DataFrame, a_rows: DataFrame, alpha: float, rank: int) -> DataFrame:
    """H9 with one output array per (input, block of rows): ``module``,
    ``x_id``, ``row_idx`` and ``y`` (arrays of equal length)."""
    s = _scaling(alpha, rank)

    def product(rows, xs):
        low = matrix(xs.column("_ax")) @ matrix(rows.column("b")).T
        return matrix(xs.column("x")) @ matrix(rows.column("w")).T + _bias(rows) + s * low

    return _projected(_with_ax(x, a_rows), weights, ["x", "_ax"], product)


def project_lora(x: DataFrame, weights: DataFrame, a_rows: DataFrame, alpha: float,
                 rank: int) -> DataFrame:
    """H9: ``y_i = w_i·x + bias_i + s * b_i·(A x)`` per (input, output row)
    (dropout off)."""
    return _by_row(project_lora_blocks(x, weights, a_rows, alpha, rank))


def project_dora_blocks(x: DataFrame, weights: DataFrame, a_rows: DataFrame, alpha: float, rank: int,
                        m_col: str = "m") -> DataFrame:
    """H10 with one output array per (input, block of rows)."""
    s = _scaling(alpha, rank)

    def gains(module, rows, a):
        d = matrix(rows.column("w")) + _low_rank(module, rows, a, s)
        return pa.array(_magnitudes(module, rows, m_col, d))

    def product(rows, xs):
        bias, g = _bias(rows), rows.column("_g").to_numpy()
        base = matrix(xs.column("x")) @ matrix(rows.column("w")).T + bias
        low = matrix(xs.column("_ax")) @ matrix(rows.column("b")).T
        return base + (g - 1) * (base - bias) + g * s * low

    return _projected(_with_ax(x, a_rows), _with_rows(weights, a_rows, "_g", DoubleType(), gains), ["x", "_ax"], product)


def project_dora(x: DataFrame, weights: DataFrame, a_rows: DataFrame, alpha: float,
                 rank: int, m_col: str = "m") -> DataFrame:
    """``y + (g-1)(y - bias) + g * s * b_i·(A x)`` with
    ``g = m_i / max(||w_i + delta_i||, 1e-12)``; equals projecting with H8 rows."""
    return _by_row(project_dora_blocks(x, weights, a_rows, alpha, rank, m_col))


def project_rows(x: DataFrame, rows: DataFrame, row_col: str = "merged") -> DataFrame:
    """Plain ``row·x + bias`` with already merged rows (the H8/H7 fast path)."""
    def product(part, xs):
        return matrix(xs.column("x")) @ matrix(part.column(row_col)).T + _bias(part)

    return _by_row(_projected(x, rows, ["x"], product))
