"""Repeated stretches of texts: content-chosen anchors that cut every text into cells.

A window of `length` units (words or bytes) has an anchor: the leftmost of its `part`-unit grams
with the smallest hash. Consecutive windows with the same anchor are a cell. Equal windows
have equal grams, so they have the same anchor at the same offset; a text has about
2 / (length - part + 2) cells per unit, and only cells whose anchor occurs again can hold a
repeated window. A cell also has the hash of all its units: where that occurs again, every
window of the cell does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, _powers, mix64


class Stretches:
    """Hashes of any stretch of a sequence of units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((units + np.uint64(1)) * _powers(_BASE, n)[:-1], out=self.total[1:])
        self.inverse = _powers(_INVERSE, n)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.total[stop] - self.total[start]) * self.inverse[start] + (stop - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.total) - size
        return mix64((self.total[size:] - self.total[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost of the smallest values in each run of `width` values."""
    n = len(values) - width + 1
    low = np.uint64((1 << 28) - 1)
    best = (values & ~low) | (np.arange(len(values), dtype=np.uint64) & low)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[:n], best[width - size : width - size + n])
    base = np.arange(n)
    return base + (((best & low).astype(np.int64) - base) & int(low))


def row_starts(firsts: np.ndarray, n: int) -> np.ndarray:
    """The row of each of `n` units, for rows that begin at `firsts`, its end included."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[:n]


def cells(grams: np.ndarray, rows: np.ndarray, length: int, part: int) -> tuple[np.ndarray, ...]:
    """(first, last, at) of each cell: positions in the units of its windows' first starts and of its anchor.

    `grams` are the hashes of all `part`-unit grams, `rows` the row of each unit.
    """
    n = len(rows) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none
    at = _leftmost_least(grams, length - part + 1)[:n]
    index = np.flatnonzero(rows[:n] == rows[length - 1 :])
    if not len(index):
        return none, none, none
    a, r = at[index], rows[index]
    new = np.ones(len(index), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    head = np.flatnonzero(new)
    tail = np.concatenate([head[1:], [len(index)]]) - 1
    return index[head], index[tail], a[head]


def merged(row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the unions of half-open spans within each row, in order; touching spans are one."""
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    base = row.astype(np.int64) << 40
    reach = np.maximum.accumulate(base + stop) if len(row) else base
    new = np.ones(len(row), bool)
    new[1:] = base[1:] + start[1:] > reach[:-1]
    head = np.flatnonzero(new)
    ends = np.concatenate([head[1:], [len(row)]]) - 1 if len(head) else head
    return row[head], start[head], reach[ends] - base[head]


def flat_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of a column of arrays of spans; null holds none."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    return np.repeat(np.arange(len(lengths)), lengths), flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), flat.field("stop").to_numpy(zero_copy_only=False).astype(np.int64)


def spans_by_doc(spans: DataFrame) -> DataFrame:
    """(id, tk, spans): the distinct spans (id, tk, start, stop) of each text, as arrays."""
    return spans.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
