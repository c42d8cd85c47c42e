"""Training-sequence preparation.

Token ids are produced by a word-level vocabulary table (the tokenizer shape
the reference's tests use): split on ``\\w+|[^\\w\\s]+``, look each piece up,
unknown pieces get the unk id. Lookups run inside Arrow batches against a
broadcast vocabulary of checked size, so nothing is exploded or shuffled.
Batches and the holdout are decided on narrow key tables; token arrays are
written once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark import constants as K
from evalspark.functions.text import col_of
from evalspark.operators.common import dense_position, require
from evalspark.operators.selection import first_n, not_beyond, nth_keys


def cap_samples(df: DataFrame, n: int | None, order_cols: Sequence[str] = ("pos",)) -> DataFrame:
    """The first ``max_train_samples`` rows in source order (None = all)."""
    return first_n(df, n, list(order_cols))


def build_vocabulary(texts: DataFrame, text_col: str = "text", size: int = 200,
                     first_id: int = K.UNK_ID + 1) -> DataFrame:
    """Word-level vocabulary: the ``size`` most frequent pieces by (count desc,
    token), ids from ``first_id``. Counting is a partial+final aggregate."""
    pieces = texts.select(F.explode(F.regexp_extract_all(
        F.col(text_col), F.lit(K.TOKEN_PATTERN), 0)).alias("token"))
    counts = pieces.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(size)
    w = Window.orderBy(F.desc("n"), "token")  # over <= size rows only
    return top.select("token", (F.row_number().over(w) + (first_id - 1)).cast("int").alias("id"))


# Vocabularies up to this many entries are broadcast; larger ones are joined by
# a shuffle on the token (AQE splits hot tokens).
VOCAB_BROADCAST_LIMIT = 2_000_000


def _pieces(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(col_of(c), F.lit(K.TOKEN_PATTERN), 0), F.array().cast("array<string>"))


def token_ids(vocab: DataFrame, unk_id: int = K.UNK_ID):
    """D2 as a column function: ``f(text column) -> ARRAY<INT>``.

    The vocabulary (checked against ``VOCAB_BROADCAST_LIMIT``; None beyond it)
    is broadcast as two Arrow arrays; each batch's distinct pieces are looked
    up at once. A repeated token has its smallest id. A null text has no ids.
    """
    entries = vocab.groupBy("token").agg(F.min(F.col("id").cast("int")).alias("id")).limit(VOCAB_BROADCAST_LIMIT + 1)
    table = entries.toArrow()
    if table.num_rows > VOCAB_BROADCAST_LIMIT:
        return None
    sent = vocab.sparkSession.sparkContext.broadcast(
        (table.column("token").combine_chunks(), table.column("id").combine_chunks()))

    @F.arrow_udf("array<int>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, ids = sent.value
        for pieces in batches:
            lengths = pc.fill_null(pc.list_value_length(pieces), 0)
            found = pc.dictionary_encode(pc.list_flatten(pieces))
            known = pc.take(ids, pc.index_in(found.dictionary, value_set=tokens))
            flat = pc.take(pc.fill_null(known, unk_id), found.indices)
            ends = pc.cumulative_sum(lengths).cast(pa.int32())
            yield pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), flat)

    return lambda text: look_up(_pieces(text))


def _encode_by_join(df: DataFrame, text_col: str, vocab: DataFrame, key_cols: Sequence[str], out: str,
                    unk_id: int, carry: Sequence[str]) -> DataFrame:
    """D2 against a vocabulary too large to send: a row per piece, joined on
    the token and regrouped by ``key_cols``, which must identify a row."""
    side = vocab.groupBy(F.col("token").alias("_tok")).agg(F.min(F.col("id").cast("int")).alias("_tid"))
    rows = df.select(*key_cols, *carry, F.posexplode_outer(_pieces(text_col)).alias("_p", "_tok"))
    piece = F.struct("_p", F.coalesce(F.col("_tid"), F.lit(unk_id)).alias("i"))
    grouped = rows.join(side, "_tok", "left").groupBy(*key_cols).agg(
        F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), piece))).alias("_s"),
        *[F.first(c).alias(c) for c in carry])
    return grouped.withColumn(out, F.transform("_s", lambda x: x["i"])).drop("_s")


def encode_tokens(df: DataFrame, text_col: str, vocab: DataFrame, key_cols: Sequence[str],
                  out: str = "input_ids", unk_id: int = K.UNK_ID,
                  carry: Sequence[str] = ()) -> DataFrame:
    """``key_cols``, ``carry`` and ``out``, the token ids of ``text_col``
    (unknown -> ``unk_id``). Rows stay where they are and need no key of their
    own; only a vocabulary beyond ``VOCAB_BROADCAST_LIMIT`` is joined."""
    ids = token_ids(vocab, unk_id)
    if ids is None:
        return _encode_by_join(df, text_col, vocab, key_cols, out, unk_id, carry)
    return df.select(*key_cols, *carry, ids(text_col).alias(out))


def truncate_append_eos(ids: Column | str, cutoff: int, eos_id: int = K.EOS_ID) -> Column:
    """D3: cut at ``cutoff``; append EOS when the last id is not EOS and the
    sequence is shorter than ``cutoff`` (an empty sequence raises, as upstream)."""
    cut = F.slice(col_of(ids), 1, cutoff)
    add = (F.element_at(cut, -1) != eos_id) & (F.size(cut) < cutoff)
    return F.when(add, F.concat(cut, F.array(F.lit(eos_id)))).otherwise(cut)


def attention_mask(ids: Column | str) -> Column:
    """Ones, same length as the ids."""
    return F.array_repeat(F.lit(1), F.size(col_of(ids)))


def mask_labels(ids: Column | str, prompt_len: Column | int, train_on_inputs: bool = False,
                ignore: int = K.IGNORE_INDEX) -> Column:
    """labels = ids with the first ``prompt_len`` positions set to -100
    (capped at the sequence length), unless training on inputs."""
    if train_on_inputs:
        return col_of(ids)
    n = prompt_len if isinstance(prompt_len, Column) else F.lit(prompt_len)
    return F.transform(col_of(ids), lambda x, i: F.when(i < n, F.lit(ignore)).otherwise(x))


def tokenize_examples(samples: DataFrame, vocab: DataFrame, key_cols: Sequence[str],
                      cutoff: int, train_on_inputs: bool = False,
                      eos_id: int = K.EOS_ID, unk_id: int = K.UNK_ID) -> DataFrame:
    """D2-D5 together: ``full_prompt`` and ``user_prompt`` columns in, model
    inputs out (input_ids, attention_mask, labels, prompt_len). Of the user
    prompt only the number of pieces is needed, so it isn't encoded."""
    sized = samples.withColumn("prompt_len", F.least(F.size(_pieces("user_prompt")), F.lit(cutoff)))
    coded = encode_tokens(sized, "full_prompt", vocab, key_cols, "_full", unk_id, carry=["prompt_len"])
    return (coded.withColumn("input_ids", truncate_append_eos("_full", cutoff, eos_id))
                 .withColumn("attention_mask", attention_mask("input_ids"))
                 .withColumn("labels", mask_labels("input_ids", F.col("prompt_len"), train_on_inputs))
                 .drop("_full"))


def holdout_split(df: DataFrame, val_size: int, seed: int, key_cols: Sequence[str]) -> DataFrame:
    """Exact-size, seeded validation set; adds ``split`` in {train, validation}.

    The rows of smallest sha256("seed:key...") (then key) go to validation:
    exact size, stable under repartitioning. Only hashes and keys are read to
    find the last of them; rows are then marked where they are by comparing.
    No split when ``val_size <= 0`` or ``val_size >= n`` (everything is train).
    Null or repeated keys at the limit are errors.
    """
    if val_size <= 0:
        return df.withColumn("split", F.lit("train"))
    keys = [F.col(c).cast("string") for c in key_cols]
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), *keys), 256)
    order = ["_h", *key_cols]
    hashed = df.withColumn("_h", h)
    last = nth_keys(hashed, val_size, order).first()
    if last is None:  # no more than val_size rows
        return df.withColumn("split", F.lit("train"))
    split = F.when(not_beyond(hashed, last, order), "validation").otherwise("train")
    return hashed.withColumn("split", split).drop("_h")


def batch_index(df: DataFrame, batch_size: int, order_cols: Sequence[str], multiple: int = 8) -> DataFrame:
    """The plan of D7 on a narrow table: per row its ``order_cols``, ``batch``
    and the batch's ``padded_length``. Only keys and lengths are ranked."""
    lengths = df.select(*order_cols, F.size("input_ids").alias("_len"))
    pos = dense_position(lengths, list(order_cols), out="_p")
    batched = pos.select(*order_cols, "_len", F.floor(F.col("_p") / batch_size).cast("long").alias("batch"))
    longest = F.max("_len").over(Window.partitionBy("batch"))
    return batched.select(*order_cols, "batch", (F.ceil(longest / multiple) * multiple).cast("int").alias("padded_length"))


def pad_batches(df: DataFrame, batch_size: int, order_cols: Sequence[str],
                multiple: int = 8, pad_id: int = K.PAD_ID, ignore: int = K.IGNORE_INDEX
                ) -> DataFrame:
    """Consecutive batches of ``batch_size``; every sequence is left-padded
    to the batch's longest length rounded up to a multiple of ``multiple``
    (ids -> pad, mask -> 0, labels -> -100).

    The batches are laid out on keys and lengths alone (:func:`batch_index`);
    the token arrays meet that table once. ``order_cols`` must identify a row
    and not be null (both fail the job)."""
    index = batch_index(df, batch_size, order_cols, multiple).groupBy(*order_cols).agg(
        F.first("batch").alias("batch"), F.first("padded_length").alias("padded_length"), F.count(F.lit(1)).alias("_rows"))
    index = require(index, F.col("_rows") == 1, "rows of one key can't be told apart in batches").drop("_rows")
    joined = require(df.join(index, list(order_cols), "left"), F.col("batch").isNotNull(), "a row's key is null")
    k = F.col("padded_length") - F.size("input_ids")
    left = {"input_ids": pad_id, "attention_mask": 0, "labels": ignore}
    return joined.withColumns({c: F.concat(F.array_repeat(F.lit(v), k), F.col(c)) for c, v in left.items()}
                              ).select(*df.columns, "batch", "padded_length")


def accumulation_steps(effective: Column | str, per_device: Column | str) -> Column:
    """Effective / per-device batch; not divisible raises."""
    e, p = col_of(effective), col_of(per_device)
    return F.when(e % p == 0, (e / p).cast("long")).otherwise(
        F.raise_error(F.lit("the effective batch isn't a whole number of device batches"))
        .cast("long"))


def sequence_report(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Examples per split, with token totals and the fully-masked count
    (a prompt that fills the cutoff leaves no trainable label)."""
    fully_masked = F.forall(F.col("labels"), lambda x: x == K.IGNORE_INDEX)
    return df.groupBy(split_col).agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum(F.size("input_ids")).cast("long").alias("tokens"),
        F.max(F.size("input_ids")).cast("long").alias("max_length"),
        F.sum(F.when(fully_masked, 1).otherwise(0)).cast("long").alias("fully_masked"))
