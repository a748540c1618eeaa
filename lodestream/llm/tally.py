"""Counts of 64-bit keys over all rows: tasks add up before the shuffle, and the keys that are common may be held by every worker.

A key is common if it makes up one in ``SHARE`` of all that is counted, so there
are at most SHARE of them whatever the data (16 bytes each). What isn't common is
left to a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1 << 21
#: Distinct keys at which a task hands on what it has.
MOST = 1 << 20


def summed(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, their counts, and what else belongs to each key."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    total = np.add.reduceat(counts[order], first) if len(k) else counts
    return k[first], total, *(m[order[first]] for m in more)


class Tally:
    """What one task has counted. ``add`` gives parts to hand on once there are very many keys."""

    def __init__(self, names: list[str], most: int = MOST):
        self.names, self.most, self.held, self.size = names, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(summed(keys, counts, *more))
        self.size += len(self.held[-1][0])
        if self.size > 2 * self.most:
            self._merge()
            if self.size > self.most:
                yield from self.rest()

    def _merge(self) -> None:
        self.held = [summed(*(np.concatenate(c) for c in zip(*self.held, strict=True)))]
        self.size = len(self.held[0][0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            part = self.held[0]
            self.held, self.size = [], 0
            for i in range(0, len(part[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in part], self.names)


class Common:
    """The common keys in order, their counts, and what else belongs to each."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, *more: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.more = [m[order] for m in more]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't common."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        distinct, inverse = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
        return np.where(self.keys[at] == distinct, at, -1)[inverse]


def common(counts: DataFrame, total: int, key: str = "h", n: str = "n", more: tuple[str, ...] = (), share: int = SHARE) -> Common:
    """``counts``: a stored (key, n) table with ``total`` in all. At most ``share`` rows reach the driver."""
    got = counts.filter(F.col(n) * F.lit(share) >= F.lit(total)).select(key, n, *more).toArrow()
    return Common(*(got.column(i).to_numpy() for i in range(got.num_columns)))


def lists(values: list[np.ndarray], row: np.ndarray, rows: int) -> list[pa.Array]:
    """A list of each row from values in the order of rows."""
    at = np.zeros(rows + 1, np.int32)
    np.cumsum(np.bincount(row, minlength=rows), out=at[1:])
    return [pa.ListArray.from_arrays(pa.array(at), pa.array(v)) for v in values]
