"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import scratch_path

# The six ASCII whitespace bytes: the class [\x20\x09-\x0D].
WHITESPACE = b" \t\n\x0b\x0c\r"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    Used where one result feeds several jobs: later jobs read the files, and a
    lost executor costs one re-read instead of the whole lineage.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can clash."""
    return F.struct(*map(quoted, df.columns))


def as_bytes(value) -> bytes:
    """The bytes of one Arrow string or binary scalar; null counts as empty."""
    raw = value.as_buffer()
    return b"" if raw is None else raw.to_pybytes()


def public_tokenizer(name: str) -> str:
    """Place of a public vocabulary file; the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)
