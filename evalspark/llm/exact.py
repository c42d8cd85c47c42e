"""Exact deduplication by content-defined chunk recipes.

A text (whitespace runs made one space) is cut where a rolling hash of its
bytes says so, so equal passages give equal chunks. Chunks are grouped by
fingerprint *and* content: a fingerprint with one content is a verified
identifier as it stands; where contents share a fingerprint, each gets its own
number. A text is then the ordered list of its chunk identifiers, and equal
lists are equal texts. Chunk contents move once; documents are compared by
their short lists only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import WHITESPACE, as_bytes, written

MIN_CHUNK, MAX_CHUNK = 1024, 16384
CUT_BITS = 11  # a cut every 2 KiB on average past the smallest chunk
_GEAR = np.random.default_rng(20_231).integers(0, 2**32, 256, dtype=np.uint32)
_SEGMENT = 1 << 22  # bytes hashed at once


def normalise(text: bytes) -> bytes:
    """Each run of ASCII whitespace becomes one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    head = b" " if text[0] in WHITESPACE else b""
    tail = b" " if text[-1] in WHITESPACE else b""
    return head + b" ".join(words) + tail


def _cut_places(data: bytes) -> np.ndarray:
    """Offsets after which the hash of the 16 bytes before asks for a cut."""
    found = []
    for at in range(0, len(data), _SEGMENT):
        lead = min(at, 15)  # the window of the first bytes begins in the segment before
        h = _GEAR[np.frombuffer(data[at - lead:at + _SEGMENT], np.uint8)]
        for step in (1, 2, 4, 8):
            if len(h) > step:
                h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        hits = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1 - lead
        found.append(hits[hits > 0] + at)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def cut(data: bytes) -> list[bytes]:
    """Content-defined chunks; their concatenation is ``data``."""
    if len(data) <= MIN_CHUNK:
        return [data] if data else []
    ends, start = [], 0
    for place in _cut_places(data).tolist():
        while place - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if place - start >= MIN_CHUNK:
            ends.append(place)
            start = place
    while len(data) - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < len(data):
        ends.append(len(data))
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def fingerprint(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - 2**63


def _recipes(hash_chunk: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for value in batch.column(1):
                text = normalise(as_bytes(value))
                shas.append(hashlib.sha256(text).hexdigest())
                lists.append([hash_chunk(c) for c in cut(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "text_sha256", "recipe"])
    return run


def _chunks(hash_chunk: Callable[[bytes], int], keyed: bool):
    """(fingerprint, content) of the chunks, each content once a batch; with
    ``keyed`` every chunk with its text's key and place instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            rows: list[tuple] = []
            held = 0
            for value in batch.column(0):
                text = normalise(as_bytes(value))
                sha = hashlib.sha256(text).hexdigest() if keyed else ""
                for seq, chunk in enumerate(cut(text)):
                    if keyed:
                        rows.append((sha, seq, hash_chunk(chunk), chunk))
                    elif chunk not in seen:
                        seen[chunk] = hash_chunk(chunk)
                    held += len(chunk)
                    if held > 8 << 20:
                        yield _chunk_batch(seen, rows, keyed)
                        seen, rows, held = {}, [], 0
            yield _chunk_batch(seen, rows, keyed)
    return run


def _chunk_batch(seen: dict, rows: list, keyed: bool) -> pa.RecordBatch:
    if not keyed:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen.values()), pa.int64()), pa.array(list(seen), pa.binary())],
            names=["h", "chunk"])
    cols = list(zip(*rows)) if rows else [(), (), (), ()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                      names=["text_sha256", "seq", "h", "chunk"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  hash_chunk: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """(doc_id, text_sha256, recipe): the ordered verified chunk identifiers
    of each text, as an array of longs; where a fingerprint has more than one
    content, the number of the content follows it in the array."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    recipes = written(source.mapInArrow(
        _recipes(hash_chunk), f"doc_id {id_type}, text_sha256 string, recipe array<bigint>"),
        "recipes")
    contents = (source.select("t").mapInArrow(_chunks(hash_chunk, False), "h bigint, chunk binary")
                .groupBy("h", "chunk").agg(F.lit(1).alias("n")))
    shared = written(contents.groupBy("h").agg(F.count("n").alias("n")).filter("n > 1").select("h"),
                     "shared-fingerprints")
    if shared.isEmpty():
        return recipes
    w = Window.partitionBy("h").orderBy("chunk")
    numbers = contents.join(shared, "h", "left_semi").select(
        "h", "chunk", F.row_number().over(w).alias("number"))
    spots = source.select("t").mapInArrow(
        _chunks(hash_chunk, True), "text_sha256 string, seq int, h bigint, chunk binary")
    fixes = (spots.join(shared, "h", "left_semi").join(numbers, ["h", "chunk"])
             .select("text_sha256", F.struct("seq", "number").alias("at")).distinct()
             .groupBy("text_sha256").agg(F.map_from_entries(F.collect_list("at")).alias("at")))
    number = lambda h, i: F.coalesce(F.col("at")[i], F.lit(0)).cast("long")
    fixed = F.flatten(F.transform("recipe", lambda h, i: F.array(h, number(h, i))))
    return (recipes.join(fixes, "text_sha256", "left")
            .withColumn("at", F.coalesce("at", F.create_map().cast("map<int,int>")))
            .select("doc_id", "text_sha256", fixed.alias("recipe")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                hash_chunk: Callable[[bytes], int] = fingerprint) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (smallest id among equal
    texts), ``group_size``, ``kept``, ``text_sha256``.

    Defined cases: a null text equals the empty one; rows that repeat both id
    and text are counted each and marked alike; ids that are null stand behind
    all others (a group of null ids only keeps null, and is kept); an empty
    table gives no rows. Only the two named columns are read. Group sizes and
    smallest ids are aggregated map side, and the way back is an equi-join
    whose hot recipes Spark splits.
    """
    recipes = chunk_recipes(docs, id_col, text_col, hash_chunk)
    groups = recipes.groupBy("recipe").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
