"""Shared building blocks: dimension tables, checked broadcasts, exact positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# A dimension side is broadcast only when it is proven to be at most this many
# rows; beyond that the join falls back to a shuffle join.
BROADCAST_ROW_LIMIT = 1_000_000


def require(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Fail the job when any row breaks ``ok``.

    The check is a filter predicate (``assert_true`` returns NULL when it
    holds), so column pruning cannot drop it the way it drops an unused
    ``raise_error`` column. The partition's number, which never decides, makes
    the checked condition itself nondeterministic (a comparison of ``rand()``
    with its bounds is simplified away): the optimiser then neither merges a
    later filter into it (``scope = 'full'`` would be assumed inside the check,
    which would fail on every other valid row) nor moves either past the other.
    Filters that should reach the scan go before the check.
    """
    msg = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.assert_true((F.spark_partition_id() < 0) | ok, msg).isNull())


# Byte bound for broadcasting array-valued sides (vectors, matrices).
BROADCAST_BYTE_LIMIT = 256 * 1024 * 1024


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` only if it has at most ``max_rows`` rows (checked)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def array_bytes(df: DataFrame, array_cols: Sequence[str], bytes_per_element: int = 8) -> int:
    """Bytes that the arrays of a table hold (nested ones flattened), from one
    small aggregate. Rows that carry vectors make a row count meaningless as a
    size bound."""
    def elements(c: str) -> Column:
        col = F.col(c)
        if dict(df.dtypes)[c].startswith("array<array<"):
            return F.aggregate(col, F.lit(0).cast("long"), lambda acc, a: acc + F.size(a))
        return F.size(col).cast("long")

    total = sum((F.coalesce(F.sum(elements(c)), F.lit(0)) for c in array_cols), F.lit(0))
    return df.agg(total.alias("n")).first()["n"] * bytes_per_element


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str,
                max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """A driver-side literal table (presets, vocabularies of labels), hinted
    for broadcast. Its size is known here, so the check costs no job."""
    if len(rows) > max_rows:
        raise ValueError(f"literal table of {len(rows)} rows is too large to broadcast")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def map_literal(mapping: dict, key: Column) -> Column:
    """Look a key up in a small driver-side mapping (NULL when absent)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def ord_of(key: Column, vocabulary: Sequence[str]) -> Column:
    """Position of ``key`` in a closed vocabulary (NULL when absent)."""
    return map_literal({v: i for i, v in enumerate(vocabulary)}, key)


_ROW_BITS = 33  # monotonically_increasing_id = (partition index << 33) + row index


def dense_position(df: DataFrame, order_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), out: str = "pos0") -> DataFrame:
    """Exact 0-based row index within each ``partition_cols`` group, in
    ``order_cols`` order (which must be unique within a group).

    ``row_number()`` over a whole group would send the group to one task.
    Instead the rows are range-partitioned and sorted on (group, order) --
    the only full shuffle -- so a hot group spans many tasks. Inside a range
    partition the row index is the low bits of ``monotonically_increasing_id``
    (dense, in sorted order). A small table of (range partition, group) ->
    first index, row count, and the running count of earlier partitions is
    broadcast back. ``partition_cols`` must be low-cardinality (tasks, not
    ids): that table has at most one row per range partition and group.

    The indexed rows feed two branches (the stats and the final join). Two
    separate range exchanges could sample different bounds, so the indexed
    rows are written once with a reliable ``checkpoint()`` into the shared
    checkpoint folder; both branches read the same partition ids, and a lost
    executor re-reads the files instead of re-sampling.
    """
    from evalspark.session import cut_lineage

    keys = [*partition_cols, *order_cols]
    mid = F.col("_mid")
    ranged = cut_lineage(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
          .withColumn("_mid", F.monotonically_increasing_id())
          .withColumn("_rp", F.shiftright(mid, _ROW_BITS))
          .withColumn("_ri", mid.bitwiseAND((1 << _ROW_BITS) - 1))
          .drop("_mid"))
    stats = ranged.groupBy("_rp", *partition_cols).agg(
        F.min("_ri").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w_prev = (Window.partitionBy(*partition_cols) if partition_cols else Window.partitionBy())
    w_prev = w_prev.orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w_prev), F.lit(0))).drop("_n")
    side = offsets.withColumnsRenamed({c: f"_of_{c}" for c in ["_rp", *partition_cols]})
    same = ranged["_rp"] == side["_of__rp"]
    for c in partition_cols:  # a null group is a group
        same = same & ranged[c].eqNullSafe(side[f"_of_{c}"])
    joined = ranged.join(F.broadcast(side), same).drop(*[f"_of_{c}" for c in ["_rp", *partition_cols]])
    pos = F.col("_off") + F.col("_ri") - F.col("_first")
    return joined.withColumn(out, pos.cast("long")).drop("_rp", "_ri", "_first", "_off")


def first_row(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str]) -> DataFrame:
    """The first row per group in ``order_cols`` order: ``row_number() = 1``,
    which Spark plans as a partial group limit, so a hot group ships one row
    per map task."""
    w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
