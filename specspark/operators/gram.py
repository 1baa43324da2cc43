"""Distributed Gram matrices of rows z = (1, x, y) and what is solved from them.

Each task adds up its rows by key and sends matrix rows; a matrix row is summed in one group,
so what meets in a task is one row from each task. Solutions need the matrices only, never
the spectra: their size is that of the axis, whatever the number of spectra.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Bytes that one matrix may have, about 4,000 points: a few of them meet in a task or on the driver.
MATRIX_BYTES = 128 << 20


def gram_rows(df: DataFrame, key: str, x: str = "x", y: str = "y") -> DataFrame:
    """(key, i, row binary): row i of the sum of z z' over the rows of each key; `y` is an array of targets.

    A wider axis than MATRIX_BYTES allows raises; `operators.wide` fits those by passes.
    """
    kind, limit = dict(df.dtypes)[key], MATRIX_BYTES

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for k, part in pdf.groupby("key", sort=False):
                z = np.column_stack([np.ones(len(part)), np.stack(part.x.to_list()), np.stack(part.y.to_list())])
                if 8 * z.shape[1] ** 2 > limit:
                    raise ValueError(f"{z.shape[1]} columns are too many for a matrix of {limit} bytes: use operators.wide")
                sums[k] = sums.get(k, 0) + z.T @ z
        for k, g in sums.items():
            yield pd.DataFrame({"key": k, "i": range(len(g)), "row": [r.tobytes() for r in g]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(r) for r in pdf.row], axis=0)
        return pd.DataFrame({"key": pdf.key[:1], "i": pdf.i[:1], "row": [total.tobytes()]})

    schema = f"key {kind}, i int, row binary"
    sides = df.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"))
    return sides.mapInPandas(partial, schema).groupBy("key", "i").applyInPandas(add, schema)


def collect_grams(rows: DataFrame) -> dict:
    """The matrices on the driver: one of (1 + points + targets)^2 numbers a key. For a few keys only."""
    found: dict = {}
    for r in rows.collect():
        found.setdefault(r["key"], {})[r["i"]] = np.frombuffer(r["row"])
    return {k: np.stack([v[i] for i in range(len(v))]) for k, v in found.items()}


class Moments:
    """Centred statistics of a Gram matrix with q targets, for chosen columns of x."""

    def __init__(self, gram: np.ndarray, targets: int = 1, columns: np.ndarray | None = None):
        p = len(gram) - 1 - targets
        keep = np.arange(p) if columns is None else np.asarray(columns)
        rows = np.concatenate([[0], keep + 1, np.arange(p + 1, p + 1 + targets)])
        g = gram[np.ix_(rows, rows)]
        self.g, self.p, self.n = g, len(keep), g[0, 0]
        self.mean = g[0, 1:] / self.n
        centred = g[1:, 1:] - self.n * np.outer(self.mean, self.mean)
        self.xx, self.xy = centred[: self.p, : self.p], centred[: self.p, self.p :]
        self.yy = centred[self.p :, self.p :]

    def squared_error(self, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Sum of squared errors of each target on this matrix's own rows."""
        q = self.g.shape[0] - 1 - self.p
        v = np.vstack([-intercept[None, :], -coef, np.eye(q)])
        return np.maximum(np.einsum("ij,ik,kj->j", v, self.g, v), 0)


def pls(m: Moments, components: int, scaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients p x q, intercepts q) of partial least squares from moments.

    Weights are the normalised row sums of X'Y; x and y are deflated after each component.
    `scaled` gives unit sample variance to every column first. Stops early when nothing of X'Y
    or X'X is left.
    """
    sx = np.sqrt(np.diag(m.xx) / max(m.n - 1, 1)) if scaled else np.ones(m.p)
    sy = np.sqrt(np.diag(m.yy) / max(m.n - 1, 1)) if scaled else np.ones(m.xy.shape[1])
    sx, sy = np.where(sx > 0, sx, 1.0), np.where(sy > 0, sy, 1.0)
    xx, xy = m.xx / np.outer(sx, sx), m.xy / np.outer(sx, sy)
    floor = 1e-12 * max(np.trace(xx), 1e-300)
    w_all, p_all, q_all = [], [], []
    for _ in range(min(components, m.p)):
        w = xy.sum(axis=1)
        norm = np.linalg.norm(w)
        if norm <= 1e-14 * max(1.0, np.abs(m.xy).max(initial=0)):
            break
        w = w / norm
        gw = xx @ w
        tt = w @ gw
        if tt <= floor:
            break
        load, q = gw / tt, xy.T @ w / tt
        xx = xx - tt * np.outer(load, load)
        xy = xy - tt * np.outer(load, q)
        w_all.append(w)
        p_all.append(load)
        q_all.append(q)
    if not w_all:
        coef = np.zeros((m.p, m.xy.shape[1]))
    else:
        w, load, q = np.array(w_all).T, np.array(p_all).T, np.array(q_all)
        coef = (w @ np.linalg.solve(load.T @ w, q)) * sy[None, :] / sx[:, None]
    return coef, m.mean[m.p :] - m.mean[: m.p] @ coef


def principal_axes(gram: np.ndarray, targets: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes p x k, share of variance); the largest loading of each axis is positive."""
    m = Moments(gram, targets)
    values, vectors = np.linalg.eigh(m.xx / (m.n - 1))
    order = np.argsort(values)[::-1][:k]
    axes = vectors[:, order]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return m.mean[: m.p], axes, values[order] / values.sum()
