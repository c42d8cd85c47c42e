"""Word and shingle hashes of many texts at once, in numpy.

A word's hash is a polynomial in an odd base modulo 2^64 over per-byte random
numbers, taken from prefix sums and mixed; a shingle's hash is a weighted sum
of its word hashes, mixed again. Texts are hashed in segments of bounded size,
cut between words, so memory doesn't grow with a text's length beyond its
words (eight bytes each).
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19
_RNG = np.random.default_rng(4_242)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(0, 2**62, dtype=np.int64)) * 2 + 1
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SEGMENT + 1024)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (murmur's finaliser)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def hash_segment(data: bytes, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a few texts run together;
    ``blank`` tells the bytes between words."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~blank[b]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[b] * up[:len(b)], out=sums[1:])
        return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_stems(data: bytes, blank: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """(starts, hashes) of a segment's words, then the hashes of their first
    ``sizes`` bytes, 0 for words that are no longer."""
    starts, ends, h = hash_segment(data, blank)
    b = np.frombuffer(data, np.uint8)
    up, down = _powers(len(b))
    sums, stems = np.zeros(len(b) + 1, np.uint64), []
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[b] * up[:len(b)], out=sums[1:])
        for size in sizes:
            stop = np.minimum(starts + size, ends)
            stem = mix((sums[stop] - sums[starts]) * down[starts] + np.uint64(size))
            stems.append(np.where(ends - starts > size, stem, np.uint64(0)))
    return (starts, h, *stems)


def _segments(texts: list[bytes]):
    """Lists of (text number, bytes) of about SEGMENT bytes together; a long
    text is cut after blanks."""
    held, size = [], 0
    for i, text in enumerate(texts):
        at = 0
        if held and len(text) > SEGMENT:
            yield held
            held, size = [], 0
        while len(text) - at > SEGMENT:
            stop = max(text.rfind(c, at, at + SEGMENT) for c in (b" ", b"\n"))
            if stop <= at:  # no blank nearby: go on to the next one
                later = [p for c in (b" ", b"\n") if (p := text.find(c, at + SEGMENT)) >= 0]
                if not later:
                    break
                stop = min(later)
            yield [(i, text[at:stop])]
            at = stop
        held.append((i, text[at:] if at else text))
        size += len(text) - at
        if size > SEGMENT:
            yield held
            held, size = [], 0
    if held:
        yield held


def per_word(texts: list[bytes], of_segment) -> tuple[list[np.ndarray], np.ndarray]:
    """Arrays over the words of all texts, text after text, and where each
    text's words begin (one more bound than texts). ``of_segment(data)`` gives
    the starts of a segment's words first, then the arrays."""
    parts, counts = [of_segment(b"")[1:]], np.zeros(len(texts) + 1, np.int64)
    for group in _segments(texts):
        places, *found = of_segment(b"\n".join(t for _, t in group))
        starts = np.cumsum([0] + [len(t) + 1 for _, t in group])
        np.add.at(counts, [i + 1 for i, _ in group], np.diff(np.searchsorted(places, starts)))
        parts.append(found)
    return [np.concatenate(x) for x in zip(*parts)], np.cumsum(counts)


def _folded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    starts, _, h = hash_segment(data.lower())
    return starts, h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of all words; A-Z are lower-cased."""
    (h,), bounds = per_word(texts, _folded)
    return h, bounds


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words
    has its whole sequence as one, a text without words none."""
    h, bounds = word_hashes(texts)
    weights = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(h)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, n - size + 1), np.uint64)
        for k in range(size):
            runs += h[k:k + len(runs)] * weights[k]
        runs = mix(runs)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= size:
                s = np.sort(runs[a:b - size + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                out.append(s[keep])
            elif b > a:
                part = (h[a:b] * weights[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                out.append(mix(np.array([part], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out
