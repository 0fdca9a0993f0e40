"""Words and shingles of many texts as numpy arrays, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"][:n], _tables["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about max_bytes.

    A text over max_bytes makes a run of its own. Null is empty.
    """
    texts = pa.array(texts, pa.large_string()) if not isinstance(texts, pa.Array) else texts.cast(pa.large_string())
    if not len(texts):
        return
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        end = min(end, len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text) of the words; texts border on words."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    starts_here, ends_here = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    inner = offsets[1:-1]
    both = inside[inner] & inside[inner + 1]
    starts_here[inner[both]] = True
    ends_here[inner[both]] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, first word of each text). lower: of A-Z lower-cased."""
    starts, ends, first = words(data, offsets)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] if lower else data).astype(np.uint64) * up[:-1] + up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), first


def prefix_hashes(data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes (words, 1 + sizes), first word of each text): of each word, A-Z lower-cased, and of its first bytes."""
    starts, ends, first = words(data, offsets)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * up[:-1] + up[:-1], out=sums[1:])
    out = np.empty((len(starts), 1 + len(sizes)), np.uint64)
    for j, size in enumerate((None, *sizes)):
        stops = ends if size is None else np.minimum(ends, starts + size)
        out[:, j] = mix((sums[stops] - sums[starts]) * down[starts] + np.uint64(j))
    return out, first


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle of width words, first shingle of each text).

    A text of fewer words has one shingle, of all its words; an empty text none.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    starts = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(first[:-1] - starts[:-1], n) + np.arange(starts[-1])
    left = np.repeat(first[1:], n) - at
    out = np.zeros(starts[-1], np.uint64)
    padded = np.concatenate((hashes, np.zeros(width, np.uint64)))
    for k in range(width):
        here = padded[at + k]
        out = out * np.uint64(0xD6E8FEB86659FD93) + np.where(k < left, here, np.uint64(0)) + np.uint64(k + 1)
    return mix(out), starts
