"""Writers (A9-A11) plus the snapshot/array-file sinks the round trips need.

All writes are plain distributed DataFrame writes; nothing is gathered on
the driver. Files are equal to the reference's as data, not as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sorted_select(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite",
                partition_col: str | None = None, keep_other_parts: bool = False) -> str:
    """One object per line, keys in sorted order, nulls kept.

    ``partition_col`` writes one folder per value (e.g. one per task) while
    every record keeps that key, as the per-task files upstream do. With
    ``keep_other_parts`` an overwrite replaces only the folders it has rows for.
    """
    out = _sorted_select(df)
    writer = None
    if partition_col is not None:
        out = out.withColumn("_part", F.col(partition_col))
        writer = out.write.mode(mode).partitionBy("_part").option(
            "partitionOverwriteMode", "dynamic" if keep_other_parts else "static")
    else:
        writer = out.write.mode(mode)
    writer.option("ignoreNullFields", False).json(path)
    return path


def write_metrics_json(df: DataFrame, root: str, run_col: str = "run_name",
                       mode: str = "overwrite") -> str:
    """A10: one JSON object per run, keys sorted, under ``root/<run>/``.

    The run folder comes from ``partitionBy`` on a copy of the run column, so
    the object itself still carries every key. Absent (null) task scores are
    omitted, as a run that skipped a task has no such key.
    """
    out = _sorted_select(df).withColumn("_run", F.col(run_col))
    out.write.mode(mode).partitionBy("_run").json(root)
    return root


def write_tables(out_dir: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
                 mode: str = "overwrite", sort_by: Mapping[str, Column] | None = None
                 ) -> dict[str, str]:
    """Headered CSVs with a fixed column order, one folder per table;
    ``sort_by`` gives an optional row order per table (e.g. vocabulary order)."""
    paths: dict[str, str] = {}
    for name, (df, order) in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        if sort_by and name in sort_by:
            df = df.orderBy(sort_by[name])
        df.select(*[F.col(f"`{c}`") for c in order]).write.mode(mode).option(
            "header", True).csv(path)
        paths[name] = path
    return paths


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One JSON array per partition around lines that the JVM has written."""
    line = lambda values: pa.RecordBatch.from_arrays([values], names=["value"])
    yield line(pa.array(["["], pa.string()))
    lead = "  "
    for batch in batches:
        if batch.num_rows:
            yield line(pc.binary_join_element_wise(pa.array([lead, *[", "] * (batch.num_rows - 1)], pa.string()), batch.column(0), ""))
            lead = ", "
    yield line(pa.array(["]"], pa.string()))


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write each partition as one JSON *array* file (null keys omitted) --
    the shape of the reference's training file, produced without gathering
    rows anywhere."""
    objects = _sorted_select(df).select(F.to_json(F.struct("*")).alias("value"))
    objects.mapInArrow(_array_lines, "value string").write.mode(mode).text(path)
    return path


def write_text_by_run(df: DataFrame, root: str, text_col: str, run_col: str,
                      mode: str = "overwrite") -> str:
    """Write one text file per run under ``root/<run>/`` (used for snapshots)."""
    df.select(F.col(text_col).alias("value"), F.col(run_col).alias("_run")).write.mode(
        mode).partitionBy("_run").text(root)
    return root
