"""Benchmark decontamination with one Aho-Corasick automaton.

Items are cut into windows of consecutive normalised words. Every distinct
item word becomes one character, every window a short string of them, and one
automaton over the windows reads each document, written in the same
characters, once. Word places map back to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import as_bytes, quoted, written

WINDOW = 10
BLOCK_BYTES = 32 << 20  # benchmark text in one automaton
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
# Lower-cases A-Z and makes every byte outside the word class a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))
_OTHER = "\x01"  # a word that no item has
_FIRST, _SURROGATES = 2, range(0xD800, 0xE000)


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


SINGLES, TRAILS = 1_000_000, 50_000  # words written as one character; second characters of the others


def _letter(i: int) -> str:
    """The character of word ``i``, or for words beyond ``SINGLES`` two: one
    that only begins a pair and one that only ends one, so that no match can
    begin or end inside a word."""
    def char(k: int) -> str:
        code = _FIRST + k
        return chr(code if code < _SURROGATES.start else code + len(_SURROGATES))

    if i < SINGLES:
        return char(i)
    lead, trail = divmod(i - SINGLES, TRAILS)
    return char(SINGLES + TRAILS + lead) + char(SINGLES + trail)


class Matcher:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple], window: int):
        self.letters: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        sizes: dict[str, int] = {}
        for item, text in items:
            ws = words(text)
            for w in ws:
                if w not in self.letters:
                    self.letters[w] = _letter(len(self.letters))
            line = [self.letters[w] for w in ws]
            size = min(window, len(line))
            for i in range(len(line) - size + 1 if size else 0):
                key = "".join(line[i:i + size])
                owners.setdefault(key, set()).add(item)
                sizes[key] = size
        self.pairs = len(self.letters) > SINGLES
        self.automaton = ahocorasick.Automaton()
        for key, who in owners.items():
            self.automaton.add_word(key, (sizes[key], who))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def find(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered runs of word places (first, past the last) and the items met."""
        if self.empty:
            return [], set()
        get = self.letters.get
        line = [get(w, _OTHER) for w in ws]
        # Word of each character, where words may have two.
        owner_of = [i for i, c in enumerate(line) for _ in c] if self.pairs else range(len(line))
        found, who = [], set()
        for end, (size, owner) in self.automaton.iter("".join(line)):
            last = owner_of[end]
            found.append((last + 1 - size, last + 1))
            who |= owner
        return merged(found), who


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_BUILT: dict[str, Matcher] = {}  # one per Python worker


def _scan(items, key: str, window: int):
    """``items``: a Spark broadcast of (item_id, text) rows of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = Matcher(items.value, window)
        matcher = _BUILT[key]
        for batch in batches:
            counts, runs_out, items_out = [], [], []
            old_runs, old_items = batch.column("runs").to_pylist(), batch.column("items").to_pylist()
            for value, runs, ids in zip(batch.column("text"), old_runs, old_items):
                ws = words(as_bytes(value))
                got, who = matcher.find(ws)
                counts.append(len(ws))
                runs_out.append([x for r in merged([*zip(runs[::2], runs[1::2]), *got]) for x in r])
                items_out.append(sorted({*ids, *(str(i) for i in who if i is not None)}))
            cols = {n: batch.column(n) for n in batch.schema.names}
            cols |= {"n_words": pa.array(counts, pa.int64()),
                     "runs": pa.array(runs_out, pa.list_(pa.int64())),
                     "items": pa.array(items_out, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return run


def _benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text) of at most about ``block_bytes`` each. One block
    is on the driver at a time; its size is checked before it is fetched."""
    rows = benchmark.select(quoted(item_col).alias("item"), quoted(text_col).cast("binary").alias("t"))
    rows = rows.filter(F.col("t").isNotNull()).distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        # By text and id: one text under very many ids is dealt out as well.
        part = rows.filter(F.pmod(F.xxhash64("t", F.col("item").cast("string")), F.lit(n)) == k)
        yield [(r["item"], bytes(r["t"])) for r in part.orderBy("item", "t").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` (word places
    covered by occurrences: first, past the last, and so on), ``items`` (ids
    of the items met, sorted as strings), and the columns of ``docs`` named in
    ``keep`` inside the struct ``row``.

    The benchmark is a stated query set against all rows. Up to ``block_bytes``
    of it make one automaton; a larger one is read in blocks, one pass over
    the documents each, with the passes merged, so nothing unbounded is
    broadcast. Defined cases: a null text has no words; a null item text has
    no windows; windows of an item with null id count as hits but list no
    item; repeated rows are answered each; an empty benchmark hits nothing.
    """
    state = docs.select(
        quoted(id_col).alias("doc_id"), quoted(text_col).cast("binary").alias("text"),
        *([F.struct(*map(quoted, keep)).alias("row")] if keep else []),
        F.lit(0).cast("long").alias("n_words"), F.array().cast("array<bigint>").alias("runs"),
        F.array().cast("array<string>").alias("items"))
    sc = docs.sparkSession.sparkContext
    blocks = _benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    block = next(blocks)
    while block is not None:
        digest = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        state = state.mapInArrow(_scan(sc.broadcast(block), digest, window), state.schema)
        block = next(blocks, None)
        if block is not None:  # one automaton in memory at a time
            state = written(state, "decontaminate")
    return state


def offsets(text: str, runs: list[int]) -> list[tuple[int, int]]:
    """Character spans in the original text of runs of word places."""
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw.lower())]
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) if raw else None
    at = lambda b: int(chars[b - 1]) if b else 0
    return [(at(spans[a][0]), at(spans[b - 1][1])) for a, b in zip(runs[::2], runs[1::2])]


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, runs = batch.column("text"), batch.column("runs").to_pylist()
        out = [[{"start": a, "end": b} for a, b in offsets(as_bytes(t).decode("utf-8", "replace"), r)]
               if r else [] for t, r in zip(texts, runs)]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "runs")}
        cols["spans"] = pa.array(out, kind)
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``items`` and ``spans``: the character offsets,
    in the original text, of every covered passage."""
    state = contamination(docs, benchmark, **options)
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items() if n not in ("text", "runs"))
    return state.mapInArrow(_spans, schema + ", spans array<struct<start:bigint,end:bigint>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, columns unchanged, that share no window with the benchmark."""
    state = contamination(docs, benchmark, keep=tuple(docs.columns), **options)
    return state.filter(F.size("runs") == 0).select("row.*")


def contamination_digest(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The per-document counts of the query: words, hit words, items met."""
    state = contamination(docs, benchmark, **options)
    hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                      F.lit(0).cast("long"), lambda a, x: a + x)
    return state.select("doc_id", "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))
