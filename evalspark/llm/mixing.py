"""Mixing sources to target weights (DataFrame functions only).

Sizes are summed per source, target sizes follow from the weights, and each
document is repeated floor(rate) times plus one further copy, drawn with the
fractional part of the rate from a hash of the seed and the document id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import quoted, whole_row
from evalspark.operators.common import dense_position, sized_broadcast

WORDS = r"[^\x20\x09-\x0D]+"
HASH_HEX_DIGITS = 12  # 48 bits of the md5: exact in a double


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-whitespace (ASCII whitespace); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the seed and the key (a null key has its own)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(text), 1, HASH_HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** HASH_HEX_DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2),
                   budget: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Target size of each source.

    ``sizes``: one row per source (``source``, ``source_size``). The weights
    repeat over the sources in code-point order, null last. The sources share
    ``budget`` times the whole size by weight; a source stops at ``ceiling``
    times its own size and what it leaves is shared again by weight, until no
    source is above. Each round is one aggregate whose two sums alone come to
    the driver; the rounds end when no further source reaches its ceiling. A
    source whose size is 0 has target 0.
    """
    ranked = dense_position(
        sizes.withColumn("_last", F.col("source").isNull()), ["_last", "source"], out="_p")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_p") % len(weights) + 1).cast("int"))
    shares = ranked.select("source", "source_size", weight.alias("_w"),
                           (F.col("source_size") * F.lit(float(ceiling))).alias("_cap"))
    whole = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    want, level, capped_before = whole * budget, 0.0, -1
    while True:
        # Sources at their ceiling under the level so far; the level only rises.
        capped = F.col("_cap") <= F.col("_w") * F.lit(level)
        got = shares.agg(
            F.count_if(capped).alias("n"),
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0)).alias("w")).first()
        if got["n"] == capped_before or got["w"] == 0:
            break
        capped_before, level = got["n"], (want - got["held"]) / got["w"]
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    if got["w"] == 0:
        target = F.col("_cap")
    return shares.select("source", "source_size", target.alias("target"))


def _draws(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``draw`` in [0, 1) to rows with ``id`` and ``text``: fixed by the id
    where a row has one of its own, else by id, text and the row's place in
    the scan, so that rows without id and rows of one id draw apart."""
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and id is not null")
    again = sized_broadcast(again.select(F.col("id").alias("again")))
    placed = rows.withColumn("at", F.monotonically_increasing_id())
    own = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")),
                      F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")), F.col("at").cast("string"))
    shared = F.col("id").isNull() | F.col("again").isNotNull()
    draw = F.when(shared, hash_uniform(own, seed)).otherwise(hash_uniform(F.col("id"), seed))
    return placed.join(again, F.col("id") == F.col("again"), "left").withColumn("draw", draw).drop("at", "again")


def _with_rates(rows: DataFrame, weights, budget: float, ceiling: float) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``rate`` to rows with ``source`` and
    ``size``. Source totals are summed map side before the shuffle; they are
    broadcast only if they are few (checked), else joined by shuffle, where
    Spark splits a hot source."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = sized_broadcast(source_targets(totals, weights, budget, ceiling).withColumnRenamed("source", "of_source"),
                              max_rows=100_000)
    joined = rows.join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_source")
    return joined.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _copies() -> Column:
    whole = F.floor("rate")
    return (whole + (F.col("draw") < F.col("rate") - whole).cast("long")).cast("long")


def mixture_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", weights: Sequence[float] = (3, 1, 2),
                 budget: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document: its id, ``source``, ``size``, ``source_size``,
    ``target`` and ``copies`` (how often the mix takes it, at most
    ``ceil(ceiling)``).

    Defined cases: a null or empty text has size 0; a null source is a source
    of its own, last in order; rows without an id, and rows that share one,
    draw each for itself (from their text and place, so reruns over the same
    files agree); an empty table gives an empty plan. Other columns of
    ``docs`` are not looked at.
    """
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(source_col).alias("source"))
    sized = _draws(rows, seed).withColumn("size", word_count(F.col("text"))).drop("text")
    return _with_rates(sized, weights, budget, ceiling).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", _copies().alias("copies"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: Sequence[float] = (3, 1, 2),
                budget: float = 1.5, ceiling: float = 2.0, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as the plan takes it, with the
    columns of ``docs`` unchanged. The texts move through no shuffle: the copy
    count is computed on the row itself, from the few source targets."""
    rows = docs.select(whole_row(docs).alias("row"), quoted(id_col).alias("id"), quoted(text_col).alias("text"),
                       quoted(source_col).alias("source")).withColumn("size", word_count(F.col("text")))
    planned = _with_rates(_draws(rows, seed), weights, budget, ceiling)
    return planned.select("row", F.explode(F.array_repeat(F.lit(True), _copies().cast("int"))).alias("copy")).select("row.*")
