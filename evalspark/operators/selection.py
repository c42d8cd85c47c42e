"""Order statistics by counting: the n-th key of a table or of each group.

Taking the first n rows needs only the n-th key: rows are then kept by
comparing with it, where they are, without a sort or shuffle of whole rows.
The key itself is found on the key columns alone. Where a group has more than
``RANKED`` rows, rows are counted per range of the leading key column, and the
range that holds the n-th is cut into ranges again, until few enough are left
to rank. The plan is the same for every n.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from evalspark.operators.common import BROADCAST_ROW_LIMIT, dense_position, require

RANGES = 4096  # ranges counted in one pass
RANKED = 200_000  # rows of a group that are ranked in one task
_HUGE = 1e300
_TIE = "rows tie at the limit; order by further columns"


def _leading(column: Column, dtype: str) -> Column:
    """A double that never falls as the column rises; it only deals rows to
    ranges, so it may be equal for different keys."""
    if dtype in ("string", "binary"):
        # The first six bytes as a number: strings are ordered by their bytes.
        head = F.rpad(F.hex(F.substring(column.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    if dtype == "date":
        return F.unix_date(column).cast("double")
    if dtype.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if dtype == "boolean":
        return column.cast("int").cast("double")
    number = column.cast("double")
    # Spark orders NaN above every number.
    return F.when(F.isnan(number), _HUGE).otherwise(F.greatest(F.lit(-_HUGE), F.least(F.lit(_HUGE), number)))


def _same(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> Column:
    cond = F.lit(True)
    for g in groups:
        cond = cond & left[g].eqNullSafe(right[f"_of_{g}"])
    return cond


def _narrowed(keys: DataFrame, groups: list[str], state: DataFrame) -> DataFrame:
    """The keys whose leading value lies in their group's range."""
    if not groups:  # the one range is known on the driver
        row = state.first()
        cols = {"_lo": F.lit(row["_lo"]), "_hi": F.lit(row["_hi"]), "_want": F.lit(row["_want"])}
        joined = keys.withColumns(cols)
    else:
        side = state.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_lo", "_hi", "_want")
        joined = keys.join(F.broadcast(side), _same(keys, side, groups)).drop(*[f"_of_{g}" for g in groups])
    return joined.filter(F.col("_lead").between(F.col("_lo"), F.col("_hi")))


def nth_keys(df: DataFrame, n: int, order_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """The n-th smallest key of each group that has more than ``n`` rows:
    ``group_cols`` and the ``order_cols`` of that row.

    Key columns must not be null (an error at once), and no other row may have
    the n-th row's key (fails the job: which of them belongs to the first n is
    not defined).
    """
    from evalspark.session import cut_lineage

    order, groups = list(order_cols), list(group_cols)
    keys = df.select(*groups, *order).withColumn("_lead", _leading(F.col(order[0]), dict(df.dtypes)[order[0]]))
    blank = F.lit(False)
    for c in order:
        blank = blank | F.col(c).isNull()
    stats = keys.groupBy(*groups).agg(F.min("_lead").alias("_lo"), F.max("_lead").alias("_hi"),
                                      F.count(F.lit(1)).alias("_n"), F.count_if(blank).alias("_blank"))
    seen = stats.agg(F.max("_n").alias("n"), F.sum("_blank").alias("blank"), F.count(F.lit(1)).alias("groups")).first()
    if seen["blank"]:
        raise ValueError(f"order columns hold null: {', '.join(order)}")
    if groups and seen["groups"] > BROADCAST_ROW_LIMIT:
        raise ValueError(f"more than {BROADCAST_ROW_LIMIT} groups")
    if (seen["n"] or 0) <= RANKED:
        rows = keys.withColumn("_want", F.lit(n).cast("long"))
    else:
        state = cut_lineage(stats.filter(F.col("_n") > n).select(*groups, "_lo", "_hi", F.lit(n).cast("long").alias("_want")))
        while True:
            step = (F.col("_hi") - F.col("_lo")) / RANGES
            part = F.when(step > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("_lead") - F.col("_lo")) / step))
                          ).otherwise(0).cast("int")
            counts = _narrowed(keys, groups, state).groupBy(*groups, part.alias("_part"), "_want").agg(
                F.count(F.lit(1)).alias("_c"), F.min("_lead").alias("_lo"), F.max("_lead").alias("_hi"))
            upto = F.sum("_c").over(Window.partitionBy(*groups).orderBy("_part"))  # at most RANGES rows a group
            state = cut_lineage(counts.withColumn("_upto", upto).filter(
                (F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_c") < F.col("_want"))).select(
                *groups, "_lo", "_hi", (F.col("_want") - F.col("_upto") + F.col("_c")).alias("_want"), "_c"))
            if not state.filter((F.col("_c") > RANKED) & (F.col("_lo") < F.col("_hi"))).count():
                break
        rows = _narrowed(keys, groups, state)
        if state.filter(F.col("_c") > RANKED).count():
            # One leading value in very many rows: ranked over range partitions.
            placed = dense_position(rows, order, groups, out="_at")
            pair = placed.filter(F.col("_at").between(F.col("_want") - 1, F.col("_want"))).groupBy(*groups).agg(
                F.min_by(_key(order), "_at").alias("_key"), F.max_by(_key(order), "_at").alias("_next"),
                F.count(F.lit(1)).alias("_c"))
            checked = require(pair, (F.col("_c") == 1) | (F.col("_key") != F.col("_next")), _TIE)
            return checked.select(*groups, *[F.col(f"_key.k{i}").alias(c) for i, c in enumerate(order)])
    w = Window.partitionBy(*groups).orderBy(*order)
    ranked = rows.withColumns({"_at": F.row_number().over(w),
                               "_tied": F.coalesce(_key(order) == F.lead(_key(order)).over(w), F.lit(False)),
                               "_more": F.lead(F.lit(1)).over(w).isNotNull() if (seen["n"] or 0) <= RANKED else F.lit(True)})
    found = ranked.filter((F.col("_at") == F.col("_want")) & F.col("_more"))
    return require(found, ~F.col("_tied"), _TIE).select(*groups, *order)


def _key(order: Sequence[str], prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(f"k{i}") for i, c in enumerate(order)])


def not_beyond(df: DataFrame, last: Row | None, order: Sequence[str]) -> Column:
    """Whether a row's key is at most that of ``last``; true for every row
    where there is none."""
    if last is None:
        return F.lit(True)
    row, kinds = last, dict(df.dtypes)
    return _key(order) <= F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(f"k{i}") for i, c in enumerate(order)])


def upto_nth(df: DataFrame, n: int, order_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """Adds ``_upto``: whether a row is among the first ``n`` of its group."""
    order, groups = list(order_cols), list(group_cols)
    last = nth_keys(df, n, order, groups)
    if not groups:
        return df.withColumn("_upto", not_beyond(df, last.first(), order))
    side = last.select(*[F.col(g).alias(f"_of_{g}") for g in groups], *[F.col(c).alias(f"_last_{c}") for c in order])
    joined = df.join(F.broadcast(side), _same(df, side, groups), "left")
    beyond = F.col(f"_last_{order[0]}").isNotNull() & (_key(order) > _key(order, "_last_"))
    return joined.withColumn("_upto", ~beyond).drop(*side.columns)


def first_n(df: DataFrame, n: int | None, order_cols: Sequence[str], group_cols: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in ``order_cols`` order; ``None`` keeps
    all. Rows stay where they are; see :func:`nth_keys` for what keys must be."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    return upto_nth(df, n, order_cols, group_cols).filter("_upto").drop("_upto")
