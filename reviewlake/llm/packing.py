"""Numpy columns as list columns: one row per bucket instead of one per value, so that a shuffle carries little beside them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def lists(order: np.ndarray, cut: np.ndarray, columns: list[np.ndarray]) -> list[pa.ListArray]:
    """The columns in the given order, cut into lists that begin at ``cut``."""
    offsets = pa.array(np.append(cut, len(order)).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(c[order]))) for c in columns]


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where in it each bucket begins."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    return order, np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.empty(0, np.int64)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper 32 and lower 16 bits of 64-bit hashes; with the bucket number these tell hashes apart."""
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32), (x & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.view(np.uint32).astype(np.uint64) << np.uint64(16)) | low.view(np.uint16).astype(np.uint64)


def low_high(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper half of the bits of integers; apart, upper halves that are all alike compress to nothing."""
    half = {8: np.int32, 4: np.int16}[x.dtype.itemsize]
    both = np.ascontiguousarray(x).view(half).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def from_low_high(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    whole = {4: np.int64, 2: np.int32}[low.dtype.itemsize]
    return np.stack([low, high], axis=1).ravel().view(whole)


def flat(rows: list[dict], name: str) -> np.ndarray:
    """The lists of all rows, end to end."""
    return np.concatenate([r[name].values.to_numpy(zero_copy_only=False) for r in rows])


def groups(batches, key: str = "bucket"):
    """(key, rows) of rows that come in order of their key; rows are dicts of Arrow scalars."""
    now, rows = None, []
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(name)[at] for name in batch.schema.names}
            if row[key].as_py() != now and rows:
                yield now, rows
                rows = []
            now = row[key].as_py()
            rows.append(row)
    if rows:
        yield now, rows
