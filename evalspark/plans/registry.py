"""Registered queries: one per operator, each with its DuckDB oracle (when
the operator is expressible in SQL).

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) over whole tables; doubles are rounded to 6 places in the final
projection only, on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (final projection only)."""
    cols = []
    for name, dtype in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append(F.round(c, places).alias(name) if dtype in ("double", "float") else c)
    return df.select(*cols)


def load_all() -> None:
    """Import the query modules so their decorators register."""
    from evalspark.plans import (  # noqa: F401
        q_adapters,
        q_compare,
        q_configs,
        q_flows,
        q_normalize,
        q_prompts,
        q_scoring,
        q_sequences,
        q_sources,
    )
    from evalspark.plans.q_scoring import generate_sql
    ORACLES.setdefault("generate_batches", generate_sql())
