"""Periodic runs of words, found with a suffix automaton and link-cut access.

The states of the automaton of a stretch of words form a tree by their suffix
links. Appending word i accesses the path from the state of the prefix that
ends at i up to the root, and recolours it with i. Before that, each piece of
one colour e on the path says: the longest suffix that last occurred at e is as
long as the piece's deepest state. Where that length is at least i - e, the
last words form a square of period i - e, and since no shorter distance has the
suffix, that period is the smallest. The piece's length fixes the square's
left end, and the last i that gives the same left end and period its right
end: the square is extended to its run. A link-cut tree (splayed preferred
paths, one colour a path) makes the pieces few.

Only stretches that can hold a run are searched. All five-word grams of a run
of four periods and six words occur twice in it, so a gram that occurs once in
its stretch ends the stretch; this is repeated until no stretch shrinks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import as_bytes
from evalspark.llm.words import mix

PERIODS = 4  # of the shortest run
LEAST = 6  # words of the shortest run
GRAM = 5  # words; every gram of a run occurs in it twice (PERIODS, LEAST)
TEXT_SLICE = 2 << 20

_RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


class _Codes(dict):
    """Numbers for words, by first use."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


# ------------------------------------------------------- automaton and access

def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest lengths, suffix links, state of each prefix); state 1 is the
    root, and the link 0 stands for none."""
    length, link, step, of_prefix = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for c in word:
        new = len(length)
        length.append(length[last] + 1)
        step.append({})
        at = last
        while at and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if not at:
            link.append(1)
        else:
            goal = step[at][c]
            if length[goal] == length[at] + 1:
                link.append(goal)
            else:
                copy = new + 1
                link.append(copy)
                length.append(length[at] + 1)
                link.append(link[goal])
                step.append(step[goal].copy())
                link[goal] = copy
                while at and step[at].get(c) == goal:
                    step[at][c] = copy
                    at = link[at]
        last = new
        of_prefix.append(new)
    return length, link, of_prefix


def last_occurrences(word: list[int]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each word i the pieces (length, distance) of the accessed path: the
    longest suffix ending at i that last occurred ``distance`` words before.

    ``up`` is a node's parent in its splay tree or, at a splay root, the
    suffix link of the path's top; ``left`` and ``right`` are by depth. All
    nodes of a splay tree have the colour that its root holds.
    """
    length, up, of_prefix = automaton(word)
    size = len(length)
    left, right, colour = [0] * size, [0] * size, [-1] * size
    for i, x in enumerate(of_prefix):
        below, pieces = 0, []
        while x:
            # Splay x to the root of its tree.
            p = up[x]
            if p and (left[p] == x or right[p] == x):
                while True:
                    g = up[p]
                    p_is_root = not g or (left[g] != p and right[g] != p)
                    if not p_is_root:
                        # Zig-zig turns p about g first; zig-zag turns x about p first.
                        y, z = (p, g) if (left[g] == p) == (left[p] == x) else (x, p)
                        top = up[z]
                        if left[z] == y:
                            t = right[y]
                            left[z], right[y] = t, z
                        else:
                            t = left[y]
                            right[z], left[y] = t, z
                        if t:
                            up[t] = z
                        up[z], up[y] = y, top
                        if top:
                            if left[top] == z:
                                left[top] = y
                            elif right[top] == z:
                                right[top] = y
                        if colour[z] != colour[y]:
                            colour[y] = colour[z]
                    p = up[x]
                    top = up[p]
                    if left[p] == x:
                        t = right[x]
                        left[p], right[x] = t, p
                    else:
                        t = left[x]
                        right[p], left[x] = t, p
                    if t:
                        up[t] = p
                    up[p], up[x] = x, top
                    colour[x] = colour[p]
                    if not top:
                        break
                    if left[top] == p:
                        left[top] = x
                    elif right[top] == p:
                        right[top] = x
                    else:
                        break
                    p = top
            e = colour[x]
            if e >= 0 and length[x]:
                pieces.append((length[x], i - e))
            deeper = right[x]
            if deeper:
                colour[deeper] = e  # a path of its own from now on
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
        yield i, pieces


def runs_of(word: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run in a sequence."""
    ends: dict[tuple[int, int], int] = {}
    for i, pieces in last_occurrences(word):
        for size, period in pieces:
            if size >= (PERIODS - 1) * period and size + period >= LEAST:
                ends[i - size - period + 1, period] = i
    return sorted((start, end - start + 1, period) for (start, period), end in ends.items())


# --------------------------------------------------------- stretches to search

def stretches(codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches that can hold a run. ``bounds``: where
    the texts begin. Grams are compared by hash: equal hashes of different
    grams leave a stretch longer than need be and lose nothing."""
    n = len(codes)
    if n < LEAST:
        return []
    with np.errstate(over="ignore"):
        salted, gram = mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + salted[k:n - GRAM + 1 + k]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(owner[:n - GRAM + 1] == owner[GRAM - 1:])
    block = owner[at]
    while len(at):
        with np.errstate(over="ignore"):
            key = mix(gram[at] ^ mix(block.astype(np.uint64) + np.uint64(7)))
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(at) + 1, bool)
        same[1:-1] = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order] = same[1:] | same[:-1]
        done = again.all()
        at, block = at[again], block[again]
        # A stretch ends where a gram was taken out or a text ends.
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(block) != 0)
        block = np.cumsum(new)
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return [(a, b + GRAM) for a, b in zip(at[first].tolist(), at[last].tolist())]


# ------------------------------------------------------------------ documents

def repeated_tail(key, words: list) -> list:
    """The words with a periodic tail, for one id in ten: where h = crc32 of
    the id as text ends in 0, words from a = g % n on repeat those of
    1 + (n - a) // (3 + g % 8), with g = h // 10. A null id changes nothing."""
    n = len(words)
    if key is None or not n:
        return words
    g, digit = divmod(zlib.crc32(str(key).encode()), 10)
    if digit:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // p + 1))[:n - a]


def _search(edit: Callable | None):
    def of_texts(keys: list, texts: list[bytes]) -> tuple[list, list, list]:
        words = [t.split() for t in texts]  # bytes.split cuts at the six ASCII blanks
        if edit is not None:
            words = [edit(k, w) for k, w in zip(keys, words)]
        number = _Codes()
        codes = np.fromiter((number[x] for w in words for x in w), np.int64)
        bounds = np.cumsum([0, *map(len, words)])
        runs: list[list] = [[] for _ in words]
        for a, b in stretches(codes, bounds):
            owner = int(np.searchsorted(bounds, a, "right")) - 1
            shift = a - int(bounds[owner])
            runs[owner] += [(start + shift, length, period)
                            for start, length, period in runs_of(codes[a:b].tolist())]
        kept = []
        for found, w in zip(runs, words):
            found.sort(key=lambda r: (r[0], r[2]))
            if found:
                gone = np.zeros(len(w) + 1, np.int64)
                for start, length, period in found:
                    gone[start + period] += 1
                    gone[start + length] -= 1
                w = [x for x, g in zip(w, np.cumsum(gone).tolist()) if not g]
            kept.append(b" ".join(w))
        return [len(w) for w in words], runs, kept

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column("doc_id"), 0
            texts = [as_bytes(v) for v in batch.column("t")]
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TEXT_SLICE):
                    size += len(texts[stop])
                    stop += 1
                n, runs, kept = of_texts(keys[at:stop].to_pylist(), texts[at:stop])
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                rows = [[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs]
                yield pa.RecordBatch.from_arrays(
                    [keys[at:stop], pa.array(n, pa.int64()), pa.array(rows, kind), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"])
                at = stop
    return search


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              edit: Callable | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``runs`` (start, length
    and smallest period in words, by start, then period) and ``collapsed``, the
    text with each run cut to its first period and its words joined by one
    space.

    A run is a longest stretch of words of smallest period q with at least
    max(6, 4 q) words. ``edit(id, words)`` may change the words (bytes) before
    the search. A document is searched in one task, without a shuffle.

    Defined cases: a null or empty text has no words, no runs and an empty
    collapsed text; repeated rows and null ids give a row each; an empty table
    gives no rows; other columns are not read. A text of one word over and
    over is one run of period 1.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_search(edit), f"doc_id {kind}, n_words bigint, runs {_RUN}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digest(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run and digests, from ``find_runs``."""
    run = F.col("runs")
    # The greatest of (length, -start, -period): smallest start and period on ties.
    best = F.array_max(F.transform(run, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform(run, lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n")))
    return (found.withColumn("best", best).select(
        "doc_id", F.size(run).cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
