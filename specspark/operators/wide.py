"""Models of wide axes by passes over the rows: nothing as large as points by points is made.

A pass multiplies the rows by a few vectors and adds up what comes back; tasks add their own rows,
then stretches of points are added up in groups. The driver holds a few vectors of the axis.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a stretch; passes of the search for axes; its tolerance relative to the largest variance.
STRETCH, PASSES, TOLERANCE = 4096, 200, 1e-10


def _pass(rows: DataFrame, give: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over the `rows(x array, ys array)` of give(x, ys), an array [number, column] for a batch; None without rows."""

    def part(batches):
        total = None
        for pdf in batches:
            if len(pdf):
                found = give(np.stack(pdf.x.to_list()), np.stack(pdf.ys.to_list()))
                total = found if total is None else total + found
        if total is not None:
            cut = [total[k : k + STRETCH] for k in range(0, len(total), STRETCH)]
            yield pd.DataFrame({"k": range(len(cut)), "columns": total.shape[1], "sums": [np.ascontiguousarray(c).tobytes() for c in cut]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in pdf.sums], axis=0)
        return pd.DataFrame({"k": pdf.k[:1], "columns": pdf["columns"][:1], "sums": [total.tobytes()]})

    schema = "k int, columns int, sums binary"
    found = sorted(rows.select("x", "ys").mapInPandas(part, schema).groupBy("k").applyInPandas(add, schema).collect())
    return np.concatenate([np.frombuffer(r["sums"]).reshape(-1, r["columns"]) for r in found]) if found else None


def _moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, sum of squares less the mean, x'y less the means, means of y, their sums of squares less the means)."""

    def give(x, y):
        own = np.column_stack([x.sum(0), (x * x).sum(0), x.T @ y])
        return np.vstack([own, [len(x), 0.0, *y.sum(0)], [0.0, 0.0, *(y * y).sum(0)]])

    s = _pass(rows, give)
    if s is None:
        raise ValueError("no training rows")
    (n, _, *sums), (_, _, *squares), s = s[-2], s[-1], s[:-2]
    mean, level = s[:, 0] / n, np.array(sums) / n
    return int(n), mean, np.maximum(s[:, 1] - n * mean**2, 0), s[:, 2:] - np.outer(mean, sums), level, np.maximum(np.array(squares) - n * level**2, 0)


def fit_pls(rows: DataFrame, components: int, scaled: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients p x q, intercepts q) of partial least squares on `rows(x, ys)`: one pass for the moments, one a component.

    `scaled` gives unit sample variance to every point and target first. Rows with a null spectrum or
    target take no part; stops early when nothing of X'Y is left.
    """
    rows = rows.where("x is not null and not exists(ys, v -> v is null)").select("x", "ys")
    n, mean, squares, xy, level, spread = _moments(rows)
    varies = squares > 1e-12 * np.maximum(squares + n * mean**2, 1e-300)
    scale = np.where(varies, np.sqrt(squares / max(n - 1, 1)), 1.0) if scaled else np.ones(len(mean))
    y_scale = np.where(spread > 0, np.sqrt(spread / max(n - 1, 1)), 1.0) if scaled else np.ones(len(level))
    xy = np.where(varies[:, None], xy / scale[:, None] / y_scale, 0.0)
    floor, least = 1e-12 * max(float((squares / scale**2).sum()), 1e-300), 1e-14 * max(1.0, np.abs(xy).max(initial=0))
    coef, r_all, p_all = np.zeros_like(xy), [], []
    for _ in range(min(components, len(mean))):
        w = xy.sum(axis=1)
        norm = np.linalg.norm(w)
        if norm <= least:
            break
        r = w / norm
        for before, load in zip(r_all, p_all, strict=True):
            r = r - (load @ w / norm) * before
        weights = r / scale
        offset = float(mean @ weights)

        def give(x, y, weights=weights, offset=offset):
            t = x @ weights - offset
            return np.column_stack([np.concatenate([x.T @ t, [t @ t, t.sum()]])])

        s = _pass(rows, give)[:, 0]
        tt, g = s[-2], np.where(varies, (s[:-2] - mean * s[-1]) / scale, 0.0)
        if tt <= floor:
            break
        load, q = g / tt, xy.T @ r / tt
        xy = xy - tt * np.outer(load, q)
        coef = coef + np.outer(r, q)
        r_all.append(r)
        p_all.append(load)
    coef = coef / scale[:, None] * y_scale
    return coef, level - mean @ coef


def fit_pca(rows: DataFrame, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes p x k, share of variance) of `rows(x)`; the largest loading of each axis is positive.

    Block Krylov iteration: each pass multiplies the newest vectors by the covariance matrix,
    without making it; the axes are the best ones within all vectors so far, until they are
    axes of the matrix to the tolerance, or the vectors span the axis.
    """
    rows = rows.where("x is not null").select("x", F.array().cast("array<double>").alias("ys"))
    n, mean, squares, *_ = _moments(rows)
    points, width = len(mean), min(k + 5, len(mean))
    new, basis, image = np.random.default_rng(seed).normal(size=(points, width)), np.zeros((points, 0)), np.zeros((points, 0))
    for _ in range(PASSES):
        for _ in range(2):  # twice, against rounding
            new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        new = q[:, np.abs(np.diag(r)) > 1e-12 * max(np.abs(r).max(), 1e-300)]
        new = new[:, : points - basis.shape[1]]
        if not new.shape[1]:
            break

        def give(x, y, vectors=new):
            t = (x - mean) @ vectors
            return (x - mean).T @ t

        fresh = _pass(rows, give) / max(n - 1, 1)
        basis, image = np.hstack([basis, new]), np.hstack([image, fresh])
        values, vectors = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        top = np.argsort(values)[::-1][:k]
        values, vectors = values[top], vectors[:, top]
        off = np.linalg.norm(image @ vectors - (basis @ vectors) * values, axis=0)
        if len(values) == k and (off <= TOLERANCE * max(values[0], 1e-300)).all():
            break
        new = fresh
    axes = basis @ vectors
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return mean, axes, values * max(n - 1, 1) / squares.sum()
