"""Matrix products over tables of vectors, a block of rows at a time.

The many rows (``left``) stay where they are: each Arrow batch holds a block
of rows, which meets its module's matrix (``right``) in one product. The matrix
is broadcast if its bytes are within a checked bound. Beyond it, both sides are
dealt by (module, row block, matrix block), so a module that holds a third of
all rows is many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalspark.operators import common

ROW_BLOCK = 4096  # rows of the left side in one task, where both sides are dealt out
MATRIX_BLOCK = 4096  # rows of the right side in one task

Block = Callable[[object, pa.Table, pa.Table], pa.Table | None]


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The rows of an array column as one matrix; they must agree in length."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    widths = pc.unique(pc.list_value_length(arr)).to_pylist()
    if None in widths or len(widths) > 1:
        raise ValueError("vectors of one module are null or differ in length")
    flat = arr.flatten()
    if flat.null_count:
        raise ValueError("a vector holds null")
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(arr), widths[0] if widths else 0)


def vectors(rows: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an array column."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()),
                                    pa.array(np.ascontiguousarray(rows).ravel(), pa.float64()))


def parts_of(table: pa.Table, key: str) -> Iterator[tuple[object, pa.Table]]:
    """The rows of each key, in the order in which keys appear."""
    codes = pc.dictionary_encode(table.column(key).combine_chunks(), null_encoding="encode")
    for i, name in enumerate(codes.dictionary.to_pylist()):
        yield name, table.filter(pc.equal(codes.indices, i))


def _shape_up(out: pa.Table, schema: pa.Schema) -> list[pa.RecordBatch]:
    return out.select(schema.names).cast(schema).to_batches()


def map_blocks(left: DataFrame, right: DataFrame, key: str, right_arrays: Sequence[str], block: Block,
               schema: StructType, spread: Sequence[str], whole: bool = False) -> DataFrame:
    """``block(key, left rows, right rows)`` for every block of rows of a key.

    ``right`` is broadcast if its arrays hold at most
    ``common.BROADCAST_BYTE_LIMIT``; else left rows are dealt to blocks by a
    hash of ``spread``, and right rows by one of their other columns, unless
    ``whole`` (a module's right rows belong together). ``block`` then sees each
    pair of blocks once. A left key without right rows reaches ``block`` with
    an empty right side.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    if common.array_bytes(right, right_arrays) <= common.BROADCAST_BYTE_LIMIT:
        every = right.toArrow()  # within the bound just checked
        sent = left.sparkSession.sparkContext.broadcast((dict(parts_of(every, key)), every.slice(0, 0)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables, none = sent.value
            for batch in batches:
                for name, part in parts_of(pa.Table.from_batches([batch]), key):
                    got = block(name, part, tables.get(name, none))
                    if got is not None:
                        yield from _shape_up(got, out)

        return left.mapInArrow(run, schema)

    rows = left.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    cols = right.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    n, m = max(1, -(-rows // ROW_BLOCK)), 1 if whole else max(1, -(-cols // MATRIX_BLOCK))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int")
    a = left.withColumn("_row_block", own).withColumn("_matrix_block", each(m))
    names = [c for c in right.columns if c not in right_arrays and c != key]
    b = right.withColumn("_matrix_block", F.pmod(F.xxhash64(*names), F.lit(m)).cast("int") if m > 1 else F.lit(0)
                         ).withColumn("_row_block", each(n))
    keys = [key, "_row_block", "_matrix_block"]

    def pair(x: pa.Table, y: pa.Table) -> pa.Table:
        got = block(x.column(key)[0].as_py(), x, y) if x.num_rows else None
        return out.empty_table() if got is None else got.select(out.names).cast(out)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(pair, schema)
