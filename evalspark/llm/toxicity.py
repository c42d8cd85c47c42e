"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words (runs of letters, digits and non-ASCII bytes,
A-Z lower-cased) and the words' beginnings of several lengths, hashed into one
table. Beside a weight, each term has a short vector; two terms of a text add
the product of their vectors, so a pair can count for more, or less, than its
terms by themselves (an insult next to the mention of a group), also a pair
that was not seen together. Weights and vectors are learned by per-coordinate
gradient steps from a bounded sample of labelled rows; every text is scored
whole, in time linear in its terms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evalspark.llm import words
from evalspark.llm.common import as_bytes
from evalspark.llm.quality import in_fold

BITS = 18  # of the term table
FACTORS = 6  # length of a term's vector
SAMPLE = 8192  # labelled rows that are learned from, at most
EPOCHS = 4
RARE = 3.0  # what a toxic text counts for in training; they are few
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.0, 0.5  # of the weights' steps
START_V, RATE_V, SHRINK_V = 0.03, 0.03, 1e-4  # of the vectors'
STEMS = (4, 5, 6, 7, 8)  # bytes of the beginnings
POWER = 0.2  # of a text's size, by which its values are divided
TEXT_SLICE = 2 << 20
_BLANK = np.ones(256, bool)
_BLANK[48:58] = _BLANK[65:91] = _BLANK[97:123] = _BLANK[128:] = False


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors as (text, place, value), sorted by text. A term counts by
    the log of its number; the values of a longer text are a little lower.
    Terms are counted a segment at a time, so a long text costs no more memory
    than its distinct terms."""
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for group in words._segments(texts):
        starts, *hashes = words.hash_stems(b"\n".join(t for _, t in group).lower(), _BLANK, STEMS)
        first = np.cumsum([0] + [len(t) + 1 for _, t in group[:-1]])
        text = np.array([i for i, _ in group], np.uint64)[np.searchsorted(first, starts, "right") - 1]
        found = []
        for k, h in enumerate(hashes):
            own = h != 0
            place = words.mix(h[own] ^ np.uint64(k + 1)) & np.uint64((1 << BITS) - 1)
            found.append(text[own] << np.uint64(BITS) | place)
        for into, part in zip((keys, counts), np.unique(np.concatenate(found), return_counts=True)):
            into.append(part)
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = 1 + np.log(np.bincount(at, np.concatenate(counts), len(keys)))
    row = (keys >> np.uint64(BITS)).astype(np.int64)
    size = np.bincount(row, value, len(texts))
    return row, (keys & np.uint64((1 << BITS) - 1)).astype(np.int64), value / (size ** POWER)[row]


class FactorizationMachine:
    """Weights ``w`` and vectors ``v`` of the terms; the constant has the last
    weight. Weights learn by follow-the-regularised-leader steps, whose L1 part
    keeps at 0 what says little; only terms of non-zero weight use their
    vectors, which learn by AdaGrad. So terms never seen add nothing."""

    def __init__(self, size: int = 1 << BITS, factors: int = FACTORS, seed: int = 7):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.v = (np.random.default_rng(seed).standard_normal((size, factors)) * START_V).astype(np.float32)
        self.nv = np.ones((size, factors), np.float32)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, at: np.ndarray, x: np.ndarray, label: int, weight: float = 1.0) -> None:
        """One step for a text of distinct places."""
        w = self.weights(at)
        used = np.flatnonzero(w)
        places, xs = at[used], x[used]
        v = self.v[places]
        vx = v * xs[:, None]
        s = vx.sum(0)
        bias = len(self.z) - 1
        b = self.weights(slice(bias, None))[0]
        y = b + w @ x + 0.5 * float(s @ s - (vx * vx).sum())
        g = weight * (1 / (1 + np.exp(-np.clip(y, -35, 35))) - label)
        at, gx, w = np.append(at, bias), g * np.append(x, 1.0), np.append(w, b)
        n = self.n[at]
        self.n[at] = n + gx * gx
        self.z[at] += gx - (np.sqrt(n + gx * gx) - np.sqrt(n)) / ALPHA * w
        if len(places):
            gv = g * (xs[:, None] * s - xs[:, None] * vx) + SHRINK_V * v
            self.nv[places] += gv * gv
            self.v[places] = v - RATE_V * gv / np.sqrt(self.nv[places])

    def parameters(self) -> np.ndarray:
        """(terms + 1, 1 + factors): the weight, then the vector in use."""
        w = self.weights()
        v = np.vstack([self.v, np.zeros((1, self.v.shape[1]), np.float32)])
        v[w == 0] = 0
        return np.hstack([w[:, None], v]).astype(np.float32)


def margins(row: np.ndarray, at: np.ndarray, x: np.ndarray, texts: int, model: np.ndarray) -> np.ndarray:
    """The constant + w x + half of (sum v x)^2 - sum (v x)^2, of each text."""
    out = np.full(texts, float(model[-1, 0])) + np.bincount(row, model[at, 0] * x, texts)
    used = np.flatnonzero(model[at, 0])
    row, at, x = row[used], at[used], x[used]
    for k in range(1, model.shape[1]):
        vx = model[at, k] * x
        out += 0.5 * (np.bincount(row, vx, texts) ** 2 - np.bincount(row, vx * vx, texts))
    return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    model, order = FactorizationMachine(), np.random.default_rng(11)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, label = rows[i]
            model.update(at, x, label, RARE if label else 1.0)
    return model.parameters()


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about TEXT_SLICE bytes together."""
    at = 0
    while at < len(sizes):
        stop, held = at, 0
        while stop < len(sizes) and (stop == at or held + sizes[stop] <= TEXT_SLICE):
            held += sizes[stop]
            stop += 1
        yield at, stop
        at = stop


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        texts, labels = [as_bytes(v) for v in batch.column("t")], batch.column("label").to_pylist()
        for a, b in _slices([len(t) for t in texts]):
            row, place, value = vectors(texts[a:b])
            cuts = np.searchsorted(row, np.arange(b - a + 1)).tolist()
            rows += [(hashlib.sha256(texts[a + i]).digest(), place[x:y], value[x:y].astype(np.float32), labels[a + i])
                     for i, (x, y) in enumerate(zip(cuts, cuts[1:]))]
    rows.sort(key=lambda r: (r[0], r[3]))  # the order in which rows arrive must not matter
    model = train([r[1:] for r in rows])
    used = np.append(np.flatnonzero(model[:-1, 0]), len(model) - 1)
    yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()], pa.binary()), pa.array([model[used].tobytes()], pa.binary())],
                                     names=["places", "values"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE, folds: int = 5, held: int = 0) -> np.ndarray:
    """A model learned from at most ``sample`` labelled rows outside the
    held-out fold: those of smallest hash, so the choice is spread over the
    table and the same in every run. Their ids (bounded by ``sample``) are
    broadcast, and one task of bounded input makes the steps. Without a
    labelled row every score is one half."""
    key, label = F.col(f"`{id_col}`"), F.col(f"`{label_col}`").cast("int")
    chosen = (labels.select(key.alias("k"), label.alias("label"))
              .filter(F.col("k").isNotNull() & F.col("label").isin(0, 1))
              .filter(~in_fold(F.col("k"), folds, held)).distinct()
              .orderBy(F.xxhash64("k"), "k", "label").limit(sample))
    rows = (docs.select(key.alias("k"), F.col(f"`{text_col}`").cast("binary").alias("t"))
            .join(F.broadcast(chosen), "k").select("t", "label").repartition(1))
    got = rows.mapInArrow(_train, "places binary, values binary").first()
    model = np.zeros(((1 << BITS) + 1, 1 + FACTORS), np.float32)
    if got:
        model[np.frombuffer(got["places"], np.int64)] = np.frombuffer(got["values"], np.float32).reshape(-1, 1 + FACTORS)
    return model


def scores_of(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """The chance that each text is toxic."""
    out = [np.empty(0)]
    for a, b in _slices([len(t) for t in texts]):
        y = margins(*vectors(texts[a:b]), b - a, model)
        out.append(1 / (1 + np.exp(-np.clip(y, -35, 35))))
    return np.concatenate(out)


def _scored(docs: DataFrame, model: np.ndarray, text_col: str, **columns) -> DataFrame:
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], F.col(f"`{text_col}`").cast("binary").alias("t"))
    names = list(columns)
    schema = StructType([*(StructField(n, rows.schema[n].dataType) for n in names), StructField("score", DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 7 MiB, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            scores = scores_of([as_bytes(v) for v in batch.column("t")], table)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores, pa.float64())],
                                             names=[*names, "score"])

    return rows.mapInArrow(score, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    **options) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1) and
    ``predicted``.

    Defined cases: null and empty texts are scored by the constant alone;
    repeated rows are scored each; a null id is never held out and never has a
    label; labels other than 0 and 1 are passed over; without labels every
    score is one half; empty tables give no rows. No column but id and text is
    read from the documents, and the id only to choose the labelled rows.
    """
    folds, held = options.get("folds", 5), options.get("held", 0)
    scored = _scored(docs, fit(docs, labels, id_col, text_col, **options), text_col, doc_id=F.col(f"`{id_col}`"))
    return scored.select("doc_id", in_fold(F.col("doc_id"), folds, held).alias("held_out"),
                         "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """The documents, columns unchanged, that score below ``threshold``."""
    model = fit(docs, labels, id_col, text_col, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _scored(docs, model, text_col, row=row).filter(F.col("score") < threshold).select("row.*")
