"""Row-wise functions of spectra held as array<double>; all stay in the JVM but the filters.

A per-spectrum scalar reaches the lambda of an array function through array_repeat, so it is
computed once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def array_mean(x: Column) -> Column:
    return array_sum(x) / F.size(x)


def with_scalar(x: Column, scalar: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(x, F.array_repeat(scalar, F.size(x)), f)


def l2_normalize(x: Column) -> Column:
    """Unit Euclidean norm; an all-zero spectrum stays as it is."""
    norm = F.sqrt(array_sum(F.transform(x, lambda v: v * v)))
    return with_scalar(x, norm, lambda v, n: v / F.when(n == 0, 1.0).otherwise(n))


def snv(x: Column) -> Column:
    """Zero mean, unit population deviation; null for a constant spectrum."""
    return _scaled(with_scalar(x, array_mean(x), lambda v, m: v - m))


def _scaled(centred: Column) -> Column:
    deviation = F.sqrt(array_mean(F.transform(centred, lambda v: v * v)))
    scaled = with_scalar(centred, deviation, lambda v, s: v / s)
    return F.when(deviation > 0, scaled)


def emsc(x: Column, reference: np.ndarray) -> Column:
    """(x - b) / a for the least-squares line x = a * reference + b; null if a = 0."""
    ref = np.asarray(reference, dtype=float)
    centred = ref - ref.mean()
    weights = F.lit(centred / (centred @ centred))
    line = F.struct(array_sum(F.zip_with(x, weights, lambda v, w: v * w)).alias("a"), array_mean(x).alias("m"))
    return F.transform(F.array(line), lambda s: F.when(s["a"] != 0, with_scalar(x, s, lambda v, t: (v - t["m"]) / t["a"] + float(ref.mean()))))[0]


@lru_cache(maxsize=64)
def savgol_matrix(points: int, window: int, order: int, deriv: int) -> np.ndarray:
    """Rows of filter weights by output position; the first and last half windows take the polynomial of the edge window."""
    if points < window:
        raise ValueError(f"{points} points are fewer than the window of {window}")
    half = window // 2
    t = np.arange(window) - half
    design = np.vander(t, order + 1, increasing=True).astype(float)
    fit = np.linalg.pinv(design)  # coefficients of the window polynomial
    out = np.zeros((points, points))
    for i in range(points):
        centre = min(max(i, half), points - 1 - half)
        at = float(i - centre)
        row = np.array([np.prod(np.arange(k, k - deriv, -1, dtype=float)) * at ** (k - deriv) if k >= deriv else 0.0 for k in range(order + 1)])
        out[i, centre - half : centre + half + 1] = row @ fit
    return out


#: Numbers of a block of spectra that a filter takes at once.
BLOCK = 1 << 18


def _blockwise(f: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]):
    """Column function: `f` maps a block of spectra of one length to their results and to which are defined; null spectra stay null."""

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.maximum(sizes, 0))
            values, defined = batch.flatten().to_numpy(zero_copy_only=False), sizes >= 0
            out = np.empty(len(values))
            for size in np.unique(sizes[defined]).tolist():
                rows = np.flatnonzero(sizes == size)
                for k in range(0, len(rows), max(1, BLOCK // max(1, size))):
                    part = rows[k : k + max(1, BLOCK // max(1, size))]
                    at = (ends[part] - size)[:, None] + np.arange(size)
                    out[at], defined[part] = f(values[at])
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out), mask=pa.array(~defined))

    return run


def savgol(window: int, order: int, deriv: int):
    """Column function: Savitzky-Golay filter, a matrix product for each block of spectra."""
    return _blockwise(lambda x: (x @ savgol_matrix(x.shape[1], window, order, deriv).T, True))


def _row_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the rows in the order of `array_sum`."""
    return np.cumsum(x, axis=1)[:, -1:]


def _in_one_pass(steps: list[str], baseline_window: int):
    """Column function: a chain with several filters, so that a task needs one Python worker for all of them."""

    def run(x):
        defined, n = np.ones(len(x), bool), x.shape[1]
        for step in steps:
            if step == "baseline":
                x = x - x @ savgol_matrix(n, baseline_window, 3, 0).T
            elif step == "second_derivative":
                x = x @ savgol_matrix(n, 11, 2, 2).T
            elif step == "normalize":
                norm = np.sqrt(_row_sum(x * x))
                x = x / np.where(norm == 0, 1.0, norm)
            else:
                x = x - _row_sum(x) / n
                deviation = np.sqrt(_row_sum(x * x) / n)
                defined &= deviation[:, 0] > 0
                x = x / np.where(deviation > 0, deviation, 1.0)
        return x, defined

    return _blockwise(run)


def second_derivative(x: Column) -> Column:
    return savgol(11, 2, 2)(x)


def subtract_baseline(x: Column, window: int = 51, order: int = 3) -> Column:
    return F.zip_with(x, savgol(window, order, 0)(x), lambda v, b: v - b)


def mean_spectrum(df: DataFrame, column: str = "intensity") -> np.ndarray:
    """The mean over all spectra, as one array: as many numbers as a spectrum has points."""
    rows = df.select(F.posexplode(column).alias("idx", "x")).groupBy("idx").agg(F.avg("x").alias("x")).orderBy("idx").collect()
    return np.array([r["x"] for r in rows])


#: Names a preprocessing chain may use.
STEPS = ("emsc", "normalize", "snv", "second_derivative", "baseline")
#: Those that run in Python workers.
FILTERS = ("second_derivative", "baseline")


def baseline_between(steps: list[str]) -> list[str]:
    """The chain that subtracts the baseline first and again before every further step."""
    return [x for step in steps for x in ("baseline", step)] or ["baseline"]


def preprocess_chain(df: DataFrame, steps: list[str], column: str = "intensity", fit_on: Column | None = None, baseline_window: int = 51) -> DataFrame:
    """`df` with `column` replaced by the result of the steps in order.

    EMSC takes its reference from the rows where `fit_on` holds (all by default), as they are
    after the steps before it. Steps between two EMSC with more than one filter are one pass.
    Unknown names raise before any job runs.
    """
    for step in steps:
        if step not in STEPS:
            raise ValueError(f"unknown preprocessing step: {step}")
    plan = []
    for emsc_, run in groupby(steps, lambda x: x == "emsc"):
        run = list(run)
        plan += [run] if not emsc_ and sum(x in FILTERS for x in run) > 1 else run
    for step in plan:
        x = F.col(column)
        if isinstance(step, list):
            df = df.withColumn(column, _in_one_pass(step, baseline_window)(x))
        elif step == "emsc":
            df = df.withColumn(column, emsc(x, mean_spectrum(df.where(fit_on) if fit_on is not None else df, column)))
        elif step == "baseline":
            df = df.withColumn("_base", savgol(baseline_window, 3, 0)(x)).withColumn(column, F.zip_with(column, "_base", lambda v, b: v - b)).drop("_base")
        else:
            df = df.withColumn(column, {"normalize": l2_normalize, "snv": snv, "second_derivative": second_derivative}[step](x))
    return df
