"""Near-duplicate documents by SetSketch registers.

Each document is its set of five-word shingles. A SetSketch keeps, per
register, the smallest of exponentially distributed values over the elements,
truncated to an exponentially spaced scale: registers are mergeable (maximum
of two), and the share of equal registers follows the Jaccard similarity.
Bands of registers find candidates, a joint likelihood over the registers of
two sets discards hopeless ones, and the full sets decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import as_bytes, quoted, whole_row, written
from evalspark.llm.components import components
from evalspark.llm.words import mix, shingle_sets

REGISTERS, BAND = 128, 4  # at similarity 0.85 the 32 bands miss a pair with chance 5e-11, at 0.8 with 5e-8
BASE, OFFSET = 1.001, 8192  # scale of the registers; 16 bits hold every set up to e**50 elements
TEXT_SLICE = 4 << 20
BLOCK_ROWS, BLOCK_SHINGLES = 768, 2 << 20  # of a candidate group, in one task
_LOG_BASE = np.log(BASE)
_SURE = np.log(REGISTERS) + 5.0


def _points(elements: np.ndarray, until: float) -> tuple[np.ndarray, np.ndarray]:
    """Times and registers of all points up to ``until``. Every element makes
    a Poisson process of rate 1 in each register, fixed by its hash alone."""
    times, registers = [], []
    alive, clock = elements, np.zeros(len(elements))
    step = max(2, int(REGISTERS * until / 2) + 1)
    k = 0
    with np.errstate(over="ignore"):
        while len(alive):
            salts = mix(np.arange(k + 1, k + step + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            h = mix(alive[:, None] ^ salts)
            gaps = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / REGISTERS
            at = clock[:, None] + np.cumsum(gaps, axis=1)
            inside = at <= until
            times.append(at[inside])
            registers.append((mix(h[inside]) % np.uint64(REGISTERS)).astype(np.int64))
            more = inside[:, -1]
            alive, clock = alive[more], at[more, -1]
            k += step
    return np.concatenate(times), np.concatenate(registers)


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers of a non-empty set of 64-bit hashes."""
    until = _SURE / len(elements)
    while True:
        times, registers = _points(elements, until)
        least = np.full(REGISTERS, np.inf)
        np.minimum.at(least, registers, times)
        if np.isfinite(least).all():
            level = np.floor(1 - np.log(least) / _LOG_BASE) + OFFSET
            return np.clip(level, 0, 65535).astype(np.uint16)
        until *= 2


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sketched sets."""
    return np.maximum(a, b)


def likely_similarity(higher: np.ndarray, lower: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of two sets of known sizes, from
    the number of registers in which the first is higher and lower.

    For a base near 1 a register is higher in U with chance u - vJ, lower with
    v - uJ and equal with J, where u and v are the sizes' shares; setting the
    derivative of the log-likelihood to zero gives a quadratic in J.
    """
    u = n_u / (n_u + n_v)
    v, m = 1 - u, REGISTERS
    equal = m - higher - lower
    s = u * u * (equal + lower) + v * v * (equal + higher)
    root = np.sqrt(np.maximum(s * s - 4 * (u * v) ** 2 * m * equal, 0))
    return (s - root) / (2 * u * v * m)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, sets in _sets(batches):
        known: dict[bytes, bytes] = {}
        digests, registers = [], []
        for s in sets:
            if len(s) == 0:
                digests.append(None)
                registers.append(None)
                continue
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            if digest not in known:
                known[digest] = sketch(s).astype("<u2").tobytes()
            digests.append(digest)
            registers.append(known[digest])
        yield pa.RecordBatch.from_arrays(
            [*keys, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
             pa.array(registers, pa.binary())], names=["doc_id", "n_shingles", "cls", "registers"])


def _sets(batches: Iterator[pa.RecordBatch]):
    """Slices of (the other columns, the shingle sets of the last column)."""
    for batch in batches:
        start, texts, held = 0, [], 0
        for i, value in enumerate(batch.column(batch.num_columns - 1)):
            texts.append(as_bytes(value))
            held += len(texts[-1])
            if held >= TEXT_SLICE or i + 1 == batch.num_rows:
                part = batch.slice(start, len(texts))
                yield part.columns[:-1], shingle_sets(texts)
                start, texts, held = i + 1, [], 0


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class, from a document whose set has the class's digest."""
    for (cls, reps, registers), sets in _sets(batches):
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        same = pa.array([a == b.as_py() for a, b in zip(digests, cls)], pa.bool_())
        raw = pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [cls, reps, registers, raw], names=["cls", "reps", "registers", "shingles"]).filter(same)


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 matrices over
    the shingles that more than one set has."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[column] > 1
    rows, column = rows[common], column[common]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _group_links(percent: int):
    """Links of one candidate group (or pair of its blocks): as many as join
    all that is linked in it. Every plausible pair is looked at."""
    floor = percent / 100 - 6 * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def plausible(registers: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), len(n)), bool)
        for i in range(len(n)):  # one set against the rest
            higher = (registers[i] > registers).sum(1)
            lower = (registers[i] < registers).sum(1)
            small = np.minimum(n[i], n) * 100 >= percent * np.maximum(n[i], n)
            out[i] = small & (likely_similarity(higher, lower, n[i], n) >= floor)
        np.fill_diagonal(out, False)
        return out

    def run(group: pa.Table) -> pa.Table:
        cls = group.column("cls").to_pylist()
        sets = [np.frombuffer(as_bytes(v), "<u8") for v in group.column("shingles")]
        registers = np.stack([np.frombuffer(as_bytes(v), "<u2") for v in group.column("registers")])
        n = np.array([len(s) for s in sets])
        hopeful = plausible(registers.astype(np.int32), n)
        some = np.flatnonzero(hopeful.any(1))
        u, v = [], []
        if len(some):
            shared = _shared_counts([sets[i] for i in some])
            union = n[some][:, None] + n[some][None, :] - shared
            linked = hopeful[np.ix_(some, some)] & (100 * shared >= percent * union)
            forest = _Forest(len(some))
            for a, b in zip(*np.nonzero(np.triu(linked, 1))):
                if forest.join(int(a), int(b)):
                    u.append(cls[some[a]])
                    v.append(cls[some[b]])
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id that links reach) and ``kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of
    their shingle sets. Documents of equal sets form a class (found by digest
    of the set) and go on as one. In each band, a class meets the smallest
    class of its bucket, so classes that share a bucket share a group named
    after that class; a class is in at most 32 groups. A large group is split
    into blocks, and each pair of blocks is a task of bounded size. A task
    returns no more links than join what is linked in it.

    Defined cases: null and empty texts, and texts without words, have an
    empty set and stand alone; fewer than five words are one shingle; rows of
    equal id are marked alike; null ids stand behind all others; an empty
    table gives no rows. Only the two named columns are read.
    """
    source = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("t"))
    kind = source.schema["doc_id"].dataType.simpleString()
    rows = written(source.mapInArrow(
        _sketches, f"doc_id {kind}, n_shingles bigint, cls binary, registers binary"), "sketches")
    classes = (rows.filter("cls is not null").groupBy("cls")
               .agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"),
                    F.first("registers").alias("registers")))

    width = 2 * BAND
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("registers", i * width + 1, width))
                      for i in range(REGISTERS // BAND)])
    banded = classes.select("cls", F.explode(bands).alias("bucket"))
    buckets = (banded.groupBy("bucket").agg(F.min("cls").alias("rep"), F.count(F.lit(1)).alias("n"))
               .filter("n > 1").drop("n"))
    members = (banded.join(buckets, "bucket").groupBy("cls")
               .agg(F.collect_set("rep").alias("reps")))
    wanted = written(classes.join(members, "cls"), "candidates")
    sets = (source.join(wanted.select("class_id", "cls", "reps", "registers"),
                        F.col("doc_id").eqNullSafe(F.col("class_id")))
            .select("cls", "reps", "registers", "t")
            .mapInArrow(_set_rows, "cls binary, reps array<binary>, registers binary, shingles binary"))
    size = wanted.select(F.explode("reps").alias("rep"), "n").groupBy("rep").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    blocks = size.select("rep", F.greatest(
        F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES))
        .cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    spread = (wanted.select("cls", F.explode("reps").alias("rep")).join(blocks, "rep")
              .select("cls", "rep", block.alias("own"),
                      F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
              .groupBy("cls").agg(F.collect_list(F.struct(
                  "rep", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")))
                  .alias("places")))
    tasks = (sets.drop("reps").dropDuplicates(["cls"]).join(spread, "cls")
             .select("cls", "registers", "shingles", F.explode("places").alias("p"))
             .select("cls", "registers", "shingles", "p.rep", "p.a", "p.b"))
    links = tasks.groupBy("rep", "a", "b").applyInArrow(_group_links(percent), "u binary, v binary")
    roots = components(links)

    linked = classes.select("cls", "class_id").join(
        roots.withColumnRenamed("node", "cls"), "cls")
    smallest = linked.groupBy("root").agg(F.min("class_id").alias("root_id"))
    found = linked.join(smallest, "root").select("cls", F.col("root_id").alias("linked_id"))
    of_class = classes.select("cls", "class_id").join(found, "cls", "left").select(
        "cls", F.coalesce("linked_id", "class_id").alias("component"))
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return (rows.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
            .select("doc_id", "n_shingles", component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         percent: int = 85) -> DataFrame:
    """The documents, columns unchanged, of which one stands for each group:
    that of the smallest id (rows without id stand behind all others).

    Rows are told apart by a written key, so of rows that share an id, or have
    none, one alone stays if they are near copies, and all stay if they aren't.
    """
    keyed = written(docs.select(F.monotonically_increasing_id().alias("at"), whole_row(docs).alias("row")), "rows")
    of_row = lambda name: F.col("row").getField(name)
    numbered = keyed.select(
        F.struct(of_row(id_col).isNull().alias("last"), of_row(id_col).alias("id"), "at").alias("key"),
        of_row(text_col).alias("t"))
    kept = near_duplicates(numbered, "key", "t", percent).filter("kept").select(F.col("doc_id.at").alias("at"))
    return keyed.join(kept, "at", "left_semi").select("row.*")
