"""Columnar helpers for Arrow tasks: a batch's texts as one byte array, its words as index ranges, their hashes.

Nothing here loops over rows or characters; a batch is cut into slices of bounded text so memory follows the slice,
or one document where that is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, LONG_BYTES = 2 << 20, 64
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        values = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        values[0] = 1
        _powers[key] = np.multiply.accumulate(values)
    return _powers[key][:n]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, most: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows of at most ``limit`` text bytes and ``most`` rows, one row where a row is longer. Null is empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = min(at + most, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1))
        yield batch.slice(at, end - at), raw[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every range, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte range: a polynomial over random byte keys, read off one running sum.

    Long ranges (over ``LONG_BYTES``) get a cryptographic digest: repetitive ones can meet under any polynomial modulo 2^64.
    """
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[data] * _power(_STEP, len(data)), out=running[1:])
    sums = (running[ends] - running[starts]) * _power(_BACK, len(data) + 1)[starts]
    out = mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > LONG_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]], digest_size=8).digest(), "little")
    return out


def edges(offsets: np.ndarray, size: int) -> np.ndarray:
    """True where a document starts."""
    out = np.zeros(size + 1, bool)
    out[offsets] = True
    return out[:size]


def space_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and the number of words before each document (one more at the end)."""
    inside = ~SPACE[data]
    first, opens, closes = edges(offsets, len(data)), inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:]
    closes[:-1] &= ~inside[1:] | first[1:]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every document, ascending within it, and the number before each document.

    Words are runs without ASCII white space, A-Z lower-cased. A document with fewer than ``width`` words has its
    whole sequence as one shingle, one without words has none.
    """
    lowered = LOWER[data]
    starts, ends, bounds = space_words(lowered, offsets)
    words = hash_ranges(lowered, starts, ends)
    counts = np.diff(bounds)
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = ranges(bounds[:-1], per_doc)
    span = np.repeat(np.minimum(counts, width), per_doc)
    hashes = np.full(len(first), 0x2545F4914F6CDD1D, np.uint64)
    for k in range(width):
        inside = k < span
        hashes = np.where(inside, mix(hashes * np.uint64(3) + words[np.minimum(first + k, len(words) - 1)]), hashes) if len(words) else hashes
    doc = np.repeat(np.arange(len(counts)), per_doc)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[fresh], np.concatenate([[0], np.cumsum(np.bincount(doc[fresh], minlength=len(counts)))]).astype(np.int64)
