"""Words and word shingles of many texts at once, as hashes in NumPy arrays.

A word is a run of ASCII letters, ASCII digits and characters outside ASCII, in
lower case. A shingle is five words in a row; a text of one to four words has
one shingle of all its words, a text without words has none. Two shingles are
taken as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WIDTH = 5
#: Bytes of text handled at once; bounds the memory of a task.
CHUNK_BYTES = 1 << 21

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = [U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunks(texts: Sequence[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Encoded texts in groups of about ``limit`` bytes, each with its first position."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_spans(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the word starts and ends in them, and the text number of each word."""
    joined = np.frombuffer(b"\n".join(data) + b"\n", dtype=np.uint8)
    inside = np.zeros(len(joined) + 1, dtype=np.int8)
    inside[1:] = _IS_WORD[joined]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    text_ends = np.cumsum([len(d) + 1 for d in data])
    return joined, starts, ends, np.searchsorted(text_ends, starts, side="right")


def span_hashes(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    n = len(joined)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((joined.astype(U64) + U64(1)) * _powers(_BASE, n), out=sums[1:])
    lengths = (ends - starts).astype(U64)
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts] + mix(lengths))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many words each text has."""
    joined, starts, ends, owner = word_spans(data)
    return span_hashes(joined, starts, ends), np.bincount(owner, minlength=len(data))


def shingle_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order, and how many each text has."""
    words, counts = word_hashes(data)
    return shingles_of(words, counts)


def shingles_of(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    if not n:
        return np.empty(0, dtype=U64), np.zeros(len(counts), dtype=np.int64)
    total = np.zeros(n, dtype=U64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words from here to the end of the text
    for k in range(min(width, n)):
        part = np.zeros(n, dtype=U64)
        part[: n - k] = words[k:] if k else words
        # Past the end of a short text nothing is added.
        part[left <= k] = 0
        total += part * _FACTORS[k % len(_FACTORS)]
    at = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
    keep = (left >= width) | (at == 0)
    total = mix(total + np.minimum(left, width).astype(U64))
    owner = np.repeat(np.arange(len(counts)), counts)
    return total[keep], np.bincount(owner[keep], minlength=len(counts))


def lowered(texts: Sequence[str | None]) -> list[str]:
    return [(t or "").lower() for t in texts]
