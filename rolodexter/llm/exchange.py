"""Counting keys over all documents and bringing each group of documents the counts of its own keys.

Documents are dealt into groups. A group sends its distinct 64-bit keys, sorted, in one packed array for each range
of the key space; the task of a range adds up the groups' arrays and answers each group in the order of its request. So a key
crosses the network once for each group that has it, however often it occurs, and nothing grows with how common a key is.
A range without keys gets no message, so there are never more messages than keys of groups, whatever the number of groups and ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Integers as differences, split into planes of bytes and compressed."""
    values = np.ascontiguousarray(values).astype(np.uint64, copy=False)
    step = values.copy()
    step[1:] -= values[:-1]
    planes = step.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


def ranges(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(range, slice) of sorted keys for those of ``parts`` equal ranges of the key space that have any, so that messages are never more than keys."""
    at = 0
    while at < len(keys):
        k = int(keys[at]) * parts >> 64
        to = int(np.searchsorted(keys, np.uint64(-(-(k + 1 << 64) // parts)))) if k + 1 < parts else len(keys)
        yield k, slice(at, to)
        at = to


def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, their summed values, for each input array the places of its keys among them)."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    distinct, place = np.unique(every, return_inverse=True)
    total = np.bincount(place, np.concatenate(values) if values else None, len(distinct)) if len(every) else np.zeros(0)
    return distinct, np.rint(total).astype(np.int64), np.split(place, np.cumsum([len(k) for k in keys])[:-1]) if keys else []
