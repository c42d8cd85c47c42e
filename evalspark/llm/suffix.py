"""Repeated passages by bucket-pointer refinement.

Every place of a text where a string of ``length`` bytes starts is one suffix;
it goes to the bucket of a q-gram that it contains: the one of smallest hash
among its q-grams. Equal strings pick the same q-gram at the same offset, so
only places of one bucket can match, and each run of neighbouring places with
the same q-gram travels as one short row. Buckets of one row are settled;
buckets of several different surroundings are refined in tasks of bounded size
by sorting on bucket pointers of later offsets, the pointers of one pass being
those the next pass reads. Buckets too large for a task are refined on
identifiers of longer cores by aggregation, which Spark combines map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm import words
from evalspark.llm.common import as_bytes, quoted, written

LENGTH, GRAM = 400, 128
SEGMENT = 1 << 20  # places of a text that are hashed at once
TASK_BYTES = 1 << 20  # of surroundings in one refinement task
HOT_BYTES = 1 << 19  # a bucket above this is refined by aggregation
PIECE = 32  # neighbouring places that share a core
_PLACE = np.uint64(21)  # bits of a place in a segment


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = words._powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(words._BYTE[data] * up[:len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Identifiers of the strings data[a:b]."""
    _, down = words._powers(len(sums))
    with np.errstate(over="ignore"):
        return words.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[np.ndarray, ...]]:
    """(first place, places, offset of the q-gram, repeats, bucket, surroundings)
    of each run of places with one q-gram. Equal neighbouring runs, as in
    text that repeats one character, are one row with their number."""
    out = []
    for at in range(0, len(text) - length + 1, SEGMENT):
        data = np.frombuffer(text, np.uint8, min(SEGMENT + length - 1, len(text) - at), at)
        sums = _sums(data)
        grams = np.arange(len(data) - gram + 1)
        h = _hash(sums, grams, grams + gram)
        least = _window_min((h >> _PLACE << _PLACE) | grams.astype(np.uint64), length - gram + 1)
        p = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(p, prepend=-1))
        n = np.diff(first, append=len(p))
        off, bucket = p[first] - first, h[p[first]]
        around = words.mix(_hash(sums, first, first + n + length - 1) ^ (off.astype(np.uint64) << np.uint64(32)))
        new = np.ones(len(first), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (around[1:] != around[:-1]) | (n[1:] != n[:-1])
        keep = np.flatnonzero(new)
        out.append((at + first[keep], n[keep], off[keep], np.diff(keep, append=len(first)),
                    bucket[keep].view(np.int64), around[keep].view(np.int64)))
    return out


_ANCHOR_ROW = "k binary, a bigint, n int, off int, times bigint, bucket bigint, around bigint"


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("k"), batch.column("t")):
                for cols in anchors(as_bytes(value), length, gram):
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()] * len(cols[0]), pa.binary()),
                         *(pa.array(c, k) for c, k in zip(cols, kinds))],
                        names=["k", "a", "n", "off", "times", "bucket", "around"])
    return run


_AROUND_ROW = ("bucket bigint, around bigint, k binary, a bigint, n int, off int, "
               "single boolean, size bigint, bytes binary")


def _around_rows(length: int):
    """The bytes around each wanted run of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = as_bytes(batch.column("t")[i])
                runs = pa.table({f.name: batch.column("runs")[i].values.field(f.name)
                                 for f in batch.column("runs").type.value_type})
                raw = [text[a:a + n + length - 1] for a, n in
                       zip(runs.column("a").to_pylist(), runs.column("n").to_pylist())]
                k = pa.array([batch.column("k")[i].as_py()] * len(raw), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [runs.column("bucket").combine_chunks(), runs.column("around").combine_chunks(), k,
                     *(runs.column(c).combine_chunks() for c in ("a", "n", "off", "single", "size")),
                     pa.array(raw, pa.binary())],
                    names=["bucket", "around", "k", "a", "n", "off", "single", "size", "bytes"])
    return run


def bucket_pointers(data: np.ndarray, length: int, gram: int = 8) -> np.ndarray:
    """For each place, where the bucket of its first ``length`` bytes begins.
    Starts from buckets of ``gram`` bytes, in suffix order up to 8 and by
    identifier beyond; each pass sorts the places of unsettled buckets on the
    pointers a depth further on, and the new pointers, twice as deep, serve
    the next pass. Places with fewer than ``gram`` > 8 bytes behind them
    share buckets with nobody.
    """
    size = len(data)
    depth = min(gram, length)
    keys = np.zeros(size, np.uint64)
    if depth <= 8:
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        for j in range(depth):
            keys = keys << np.uint64(8) | padded[j:j + size]
    else:
        keys = words.mix(np.arange(size, dtype=np.uint64) + np.uint64(1 << 40))
        whole = np.arange(max(0, size - depth + 1))
        keys[whole] = _hash(_sums(data), whole, whole + depth)
    order = np.argsort(keys)
    pointer = np.empty(size, np.int64)
    fresh = np.ones(size, bool)
    fresh[1:] = keys[order][1:] != keys[order][:-1]
    pointer[order] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
    while depth < length:
        step = min(depth, length - depth)
        active = np.flatnonzero(np.bincount(pointer, minlength=size)[pointer] > 1)
        if not len(active):
            break
        later = np.where(active + step < size, pointer[np.minimum(active + step, size - 1)] + 1, 0)
        order = np.argsort(pointer[active] * (size + 1) + later)
        old, far = pointer[active][order], later[order]
        place = np.arange(len(old))
        new_old, new = np.ones(len(old), bool), np.ones(len(old), bool)
        new_old[1:] = old[1:] != old[:-1]
        new[1:] = new_old[1:] | (far[1:] != far[:-1])
        shift = (np.maximum.accumulate(np.where(new, place, 0))
                 - np.maximum.accumulate(np.where(new_old, place, 0)))
        updated = pointer.copy()
        updated[active[order]] = old + shift
        pointer = updated
        depth += step
    return pointer


_RUN = pa.schema([("k", pa.binary()), ("a", pa.int64()), ("n", pa.int64())])


def _runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


def _refine(length: int):
    """Places of a group of buckets whose string occurs twice, as runs."""
    def run(group: pa.Table) -> pa.Table:
        raw = [as_bytes(v) for v in group.column("bytes")]
        pointer = bucket_pointers(np.frombuffer(b"".join(raw), np.uint8), length, length // 4)
        ends = np.cumsum([len(r) for r in raw])
        starts = ends - [len(r) for r in raw]
        valid = np.zeros(len(pointer) + 1, np.int64)
        np.add.at(valid, starts, 1)
        np.add.at(valid, ends - length + 1, -1)
        valid = np.cumsum(valid[:-1]) > 0
        count = np.bincount(pointer[valid], minlength=len(pointer))
        again = valid & (count[pointer] > 1)
        k, a, n = [], [], []
        places, single = group.column("a").to_pylist(), group.column("single").to_pylist()
        keys = group.column("k").to_pylist()
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            if single[i]:
                for x, m in zip(*_runs_of(again[s:e])):
                    k.append(keys[i])
                    a.append(places[i] + int(x))
                    n.append(int(m))
        return pa.table([pa.array(k, pa.binary()), pa.array(a, pa.int64()), pa.array(n, pa.int64())],
                        schema=_RUN)
    return run


def _pieces(length: int):
    """Runs cut into pieces aligned to the q-gram, each with the identifier of
    the core that all strings of the piece contain, and of its strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                sums = _sums(np.frombuffer(r["bytes"], np.uint8))
                low, n = -r["off"], r["n"]
                x = np.arange(n)
                ids = _hash(sums, x, x + length).view(np.int64)
                m = np.arange(low // PIECE, (low + n - 1) // PIECE + 1)
                cores = _hash(sums, (m + 1) * PIECE - 1 - low, m * PIECE + length - low).view(np.int64)
                a, b = np.maximum(m * PIECE - low, 0), np.minimum((m + 1) * PIECE - low, n)
                rows += [(r["bucket"], i, core, r["k"], r["a"] + p, r["single"], ids[p:q])
                         for i, core, p, q in zip(m.tolist(), cores.tolist(), a.tolist(), b.tolist())]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(),
                     pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)],
                names=["bucket", "m", "core", "k", "a", "single", "ids"])
    return run


def _refine_hot(hot: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size: cores that occur twice, then strings
    of those cores that occur twice; both are counts per identifier."""
    pieces = written(hot.mapInArrow(_pieces(length), "bucket bigint, m int, core bigint, k binary, "
                                    "a bigint, single boolean, ids array<bigint>"), "pieces")
    core = ["bucket", "m", "core"]
    twice = pieces.groupBy(*core).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    places = (pieces.join(twice, core)
              .select(*core, "k", "a", "single", F.posexplode("ids").alias("x", "id")))
    same = places.groupBy(*core, "id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return (places.filter("single").join(same, [*core, "id"])
            .select("k", (F.col("a") + F.col("x")).alias("a"), F.lit(1).cast("long").alias("n")))


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k, a, n): runs of places, per text (``k``: md5 of its bytes), at which
    a string of ``length`` bytes begins that begins somewhere else too. Runs
    may touch and repeat. Rows of equal text are one text with copies."""
    t = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    source = (docs.select(quoted(id_col).alias("id"), t.alias("t"))
              .filter(F.octet_length("t") >= length).withColumn("k", F.unhex(F.md5("t"))))
    rows = written(source.select("k", "t").mapInArrow(_anchor_rows(length, gram), _ANCHOR_ROW), "anchors")
    key = ["bucket", "around"]
    classes = written(rows.groupBy(*key).agg(
        F.sum("times").alias("copies"), F.min(F.struct("k", "a", "n", "off")).alias("r")), "classes")
    settled = (rows.join(classes.filter("copies > 1").select(*key), key)
               .select("k", "a", (F.col("n") * F.col("times")).alias("n")))

    variants = classes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("r.n") + (length - 1)).alias("size")).filter("c > 1")
    several = classes.join(variants, "bucket").select(
        *key, "r.*", (F.col("copies") == 1).alias("single"), "size")
    wanted = several.groupBy("k").agg(F.collect_list(
        F.struct("bucket", "around", "a", "n", "off", "single", "size")).alias("runs"))
    first = source.groupBy("k").agg(F.min("id").alias("id")).join(wanted, "k")
    text = source.withColumnRenamed("k", "tk").withColumnRenamed("id", "tid").join(
        first, (F.col("tk") == F.col("k")) & F.col("tid").eqNullSafe(F.col("id")))
    around = written(text.select("k", "t", "runs").mapInArrow(_around_rows(length), _AROUND_ROW)
                     .dropDuplicates(key), "around")
    cold, hot = around.filter(F.col("size") <= HOT_BYTES), around.filter(F.col("size") > HOT_BYTES)
    total = cold.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0)).alias("n")).first()["n"]
    groups = -(-total // TASK_BYTES) or 1
    group = F.pmod(F.xxhash64("bucket"), F.lit(groups))
    # As many partitions as groups: bytes that compress well aren't put together again.
    refined = (cold.select(group.alias("g"), "k", "a", "single", "bytes")
               .repartition(groups, "g").groupBy("g")
               .applyInArrow(_refine(length), "k binary, a bigint, n bigint"))
    return settled.unionByName(refined).unionByName(_refine_hot(hot, length))


def cut(text: bytes, runs: list[tuple[int, int]], length: int) -> tuple[list[tuple[int, int]], bytes]:
    """(removed spans, remaining bytes): every string that starts in a run goes."""
    spans: list[list[int]] = []
    for a, n in sorted(runs):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n + length - 1)
        else:
            spans.append([a, a + n + length - 1])
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return [(a, b) for a, b in spans], b"".join([*kept, text[at:]])


def _cut_rows(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, spans_out, digests, kept_out = [], [], [], [], []
            for value, runs, copied in zip(batch.column("t"), batch.column("runs"), batch.column("copied")):
                text = as_bytes(value)
                if copied.as_py():  # every string of the text begins in a copy too
                    pairs = [(0, len(text) - length + 1)] if len(text) >= length else []
                else:
                    pairs = [] if runs.values is None else list(zip(
                        runs.values.field("a").to_pylist(), runs.values.field("n").to_pylist()))
                spans, kept = cut(text, pairs, length)
                sizes.append(len(text))
                gone.append(len(text) - len(kept))
                spans_out.append(len(spans))
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_bytes:
                    kept_out.append(kept)
            cols = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(spans_out, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_bytes:
                cols, names = [*cols, pa.array(kept_out, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``
    and ``kept_sha256`` after removing every byte that a repeated string of
    ``length`` bytes covers; with ``with_bytes`` also the remaining bytes as
    ``kept`` (they may end inside a character).

    Defined cases: a null text is empty; texts shorter than ``length`` stay;
    repeated rows remove each other, whole; null ids pass through; an empty
    table gives no rows; other columns are not read.
    """
    if not 8 <= gram <= length - PIECE:
        raise ValueError("gram must be at least 8 and at most length - 32")
    runs = written(repeated_places(docs, id_col, text_col, length, gram).groupBy("k").agg(
        F.collect_list(F.struct("a", "n")).alias("runs")), "runs")
    t = F.coalesce(quoted(text_col).cast("binary"), F.lit(b""))
    texts = docs.select(quoted(id_col).alias("doc_id"), t.alias("t"), F.unhex(F.md5(t)).alias("k"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    # Texts with copies go whole: they meet a mark, not a list of runs for each copy.
    copied = texts.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k", F.lit(True).alias("copied"))
    told = runs.join(copied, "k", "full_outer").select(
        "k", F.when(F.col("copied").isNull(), F.col("runs")).alias("runs"), F.coalesce("copied", F.lit(False)).alias("copied"))
    return (texts.join(told, "k", "left").select("doc_id", "t", "runs", "copied").mapInArrow(
        _cut_rows(length, with_bytes),
        f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
        + (", kept binary" if with_bytes else "")))
