"""Where a record stands: places of lines in files, and objects of array files.

Rows of a file split come in file order, so a row's place is what the splits
before hold plus its number in its own split. Only the per-split counts (a few
short rows) are summed; the rows themselves are neither sorted, shuffled nor
written.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.operators.common import require, sized_broadcast
from evalspark.session import cut_lineage


def scanned(df: DataFrame) -> DataFrame:
    """A file scan with its file (``_f``), the start of its split (``_b``) and
    a number that rises by one from row to row of a split (``_m``)."""
    return df.select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
                     F.monotonically_increasing_id().alias("_m"))


def placed(rows: DataFrame, per_file: bool = False, out: str = "pos") -> DataFrame:
    """Adds each row's place over all files in path order (or in its file) to
    a frame from :func:`scanned` and drops the scan's columns.

    The splits are counted in one pass and met in another. If the second dealt
    splits to tasks in another way, numbers would shift; each row checks that
    its number lies within its split's count, which a shift always breaks for
    the split's first or last row.
    """
    splits = rows.groupBy("_f", "_b").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = (Window.partitionBy("_f").orderBy("_b") if per_file else Window.orderBy("_f", "_b"))
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = sized_broadcast(cut_lineage(splits.withColumn("_before", before)))  # a row per split
    own = F.col("_m") - F.col("_first")
    joined = require(rows.join(splits, ["_f", "_b"], "left"), F.coalesce((own >= 0) & (own < F.col("_n")), F.lit(False)),
                     "splits were dealt out differently between two passes; run again")
    return joined.withColumn(out, F.col("_before") + own).drop("_f", "_b", "_m", "_first", "_n", "_before")


# ------------------------------------------------- objects of JSON array files

# A piece of text up to the next closing brace. The brace never follows a
# backslash in a string (JSON has no such escape), so escapes lie in a piece.
_MARKS = re.compile(r'\\.|"|\{', re.S)
_END = re.compile(r"\s*(\[\s*)?\]\s*\Z")


def _walk(marks: list[str], in_string: bool) -> tuple[bool, int]:
    """(whether a string is open at the end, braces opened outside strings)."""
    opened = 0
    for mark in marks:
        if mark == '"':
            in_string = not in_string
        elif mark == "{" and not in_string:
            opened += 1
    return in_string, opened


class _Run:
    """A split read from one of the two possible states at its start: in a
    string or not. Depths are relative to the unknown depth at the start."""

    def __init__(self, in_string: bool):
        self.in_string, self.depth = in_string, 0
        self.closed: dict[int, int] = {}  # relative depth after a closing brace -> how many

    def add(self, marks: list[str]) -> None:
        self.in_string, opened = _walk(marks, self.in_string)
        self.depth += opened
        if not self.in_string:
            self.depth -= 1
            self.closed[self.depth] = self.closed.get(self.depth, 0) + 1


def _split_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split what it does to either state at its start: the state and the
    depth at its end and how many braces close at each depth; and whether its
    last piece can be the end of an array. A file's last piece has no brace
    behind it but counts as if it had: a sound file ends one below depth 0."""
    key, runs, last = None, (), ""

    def row():
        told = json.dumps({"ends": [r.in_string for r in runs], "depths": [r.depth for r in runs],
                           "closed": [sorted(r.closed.items()) for r in runs], "bracket": bool(_END.match(last))})
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([told])],
                                          names=["_f", "_b", "told"])

    for batch in batches:
        for f, b, piece in zip(*(batch.column(c).to_pylist() for c in ("_f", "_b", "value"))):
            if key != (f, b):
                if runs:
                    yield row()
                key, runs = (f, b), (_Run(False), _Run(True))
            marks, last = _MARKS.findall(piece), piece
            for r in runs:
                r.add(marks)
    if runs:
        yield row()


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one file's splits in order: state, depth and objects closed before
    each, and the objects of the file."""
    in_string, depth, objects, out, told = False, 0, 0, [], {}
    for f, b, text in sorted(pdf[["_f", "_b", "told"]].itertuples(index=False, name=None)):
        told, which = json.loads(text), int(in_string)
        out.append((f, b, in_string, depth, objects))
        objects += sum(n for d, n in told["closed"][which] if depth + d == 0)
        depth += told["depths"][which]
        in_string = told["ends"][which]
    if in_string or depth != -1 or not told["bracket"]:
        raise ValueError(f"not a whole JSON array: {out[0][0]}")
    return pd.DataFrame([(*r, objects) for r in out], columns=["_f", "_b", "_in", "_depth", "_objects", "_total"])


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects that end in a split, with their numbers in the file, and
    what is left open at its end (``whole`` false, as is the end of an object
    that an earlier split began)."""
    key, held = None, []
    state = {"in": False, "depth": 0, "n": 0, "from": False}
    out: dict[str, list] = {"_f": [], "_b": [], "number": [], "text": [], "whole": []}

    def emit(text, whole):
        for name, value in zip(out, (*key, state["n"], text, whole)):
            out[name].append(value)

    def flush():
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        got = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))
        for v in out.values():
            v.clear()
        return got

    def leave():
        text = "".join(held)
        if text and key is not None:
            emit(text, False)

    for batch in batches:
        for f, b, first, depth, objects, piece in zip(*(
                batch.column(c).to_pylist() for c in ("_f", "_b", "_in", "_depth", "_objects", "value"))):
            if key != (f, b):
                leave()
                key, held = (f, b), []
                state = {"in": first, "depth": depth, "n": objects, "from": depth > 0 or first}
            state["in"], opened = _walk(_MARKS.findall(piece), state["in"])
            state["depth"] += opened
            held.append(piece)
            if state["in"] or state["depth"] == 0:  # the brace is text, or there is none: the file's end
                held.append("}" if state["in"] else "")
                continue
            state["depth"] -= 1
            held.append("}")
            if state["depth"] == 0:
                emit("".join(held), not state["from"])
                held, state["from"], state["n"] = [], False, state["n"] + 1
        if out["_f"]:
            yield flush()
    leave()
    if out["_f"]:
        yield flush()


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of files that hold one JSON array each: ``pos`` (place over
    all files in path order, from 0) and ``json`` (text of the object).

    A large array is read by many tasks: Spark cuts it into byte ranges that
    begin behind a closing brace. A first pass tells what each range does to
    either state at its start (inside a string or not), the states are followed
    through the few ranges of a file, and a second pass cuts the objects. Only
    pieces of objects that span two ranges are brought together.

    What lies between objects must be blanks, commas and the brackets; anything
    else fails the job.
    """
    pieces = scanned(spark.read.option("lineSep", "}").text(path)).select("_f", "_b", "value")
    states = pieces.mapInArrow(_split_states, "_f string, _b bigint, told string")
    starts = cut_lineage(states.groupBy("_f").applyInPandas(
        _starts, "_f string, _b bigint, _in boolean, _depth int, _objects bigint, _total bigint"))
    # Objects are numbered over all files in path order.
    earlier = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    files = starts.groupBy("_f").agg(F.first("_total").alias("_total")).select(
        "_f", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    numbered = cut_lineage(starts.join(files, "_f").select("_f", "_b", "_in", "_depth", F.expr("_objects + _earlier").alias("_objects")))
    known = require(pieces.join(sized_broadcast(numbered), ["_f", "_b"], "left"), F.col("_in").isNotNull(),
                    "a split appeared between two passes; run again")
    parts = known.mapInArrow(_objects, "_f string, _b bigint, number bigint, text string, whole boolean")
    spanning = parts.filter(~F.col("whole")).groupBy("_f", "number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "text"))), lambda x: x["text"]), "").alias("text"))
    every = parts.filter("whole").select("_f", "number", "text").unionByName(spanning)
    head = F.regexp_extract("text", r"^[\s,\[]*", 0)
    body = F.substr(F.col("text"), F.length(head) + 1)
    is_object = F.startswith(body, F.lit("{"))
    # After the last object only the closing bracket is left.
    rest = F.col("text").rlike(r"^\s*(\[\s*)?\]?\s*$")
    checked = require(every, is_object | rest, "an array file holds something else than objects")
    return checked.filter(is_object).select(F.col("number").alias("pos"), body.alias("json"))
