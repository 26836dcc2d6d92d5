"""Frequencies of a slice's documents as bytes that compress: places as steps, 32-bit values as byte planes."""

from __future__ import annotations

import numpy as np


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values, all lowest bytes first: the upper ones are mostly zero and take no room once compressed."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def steps_of(places: np.ndarray, n_pairs: np.ndarray) -> np.ndarray:
    """Ascending places of every document as steps from the one before."""
    steps = np.diff(places, prepend=0)
    first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
    steps[first] = places[first]
    return steps


def places_of(steps: np.ndarray, n_pairs: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(steps)])
    return running[1:] - np.repeat(running[np.cumsum(n_pairs) - n_pairs], n_pairs)
