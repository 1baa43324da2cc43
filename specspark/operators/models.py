"""Models as data jobs: PLS, interval search, trees, principal components.

A model table has columns spectrum_id, sample_id, x (array), y (double).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specspark.functions.spectral import array_sum

from .gram import Moments, collect_grams, gram_rows, pls, principal_axes
from .ranking import MAX_GRID
from .shared import discard, settled, shared_path
from .splits import group_folds


def targets_of(df: DataFrame, *columns: str) -> DataFrame:
    """The targets as one array `ys`; rows with a null target or an undefined spectrum (null `x`) are dropped.

    Every fit starts here, so a spectrum that a chain cannot define, such as a constant one under
    SNV, takes no part in any, and its prediction is null.
    """
    return df.na.drop(subset=["x", *columns]).withColumn("ys", F.array(*[F.col(c).cast("double") for c in columns]))


def fit_pls(train: DataFrame, components: int, scaled: bool = False, columns: list[int] | None = None, targets: tuple[str, ...] = ("y",)) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (p x q) and intercepts of `train(x, targets)`."""
    one = targets_of(train, *targets).withColumn("all", F.lit(0))
    grams = collect_grams(gram_rows(one, "all", "x", "ys"))
    if not grams:
        raise ValueError("no training rows")
    return pls(Moments(grams[0], len(targets), columns), components, scaled)


def predict(df: DataFrame, coef: np.ndarray, intercept: float, columns: list[int] | None = None, name: str = "pred") -> DataFrame:
    """`df` with the linear prediction; coefficients are an array literal as long as the axis."""
    full = coef
    if columns is not None:
        full = np.zeros(max(columns) + 1)
        full[list(columns)] = coef
    x = F.col("x") if columns is None else F.slice("x", 1, len(full))
    return df.withColumn(name, array_sum(F.zip_with(x, F.lit(np.asarray(full, float)), lambda a, b: a * b)) + F.lit(float(intercept)))


# ---- interval search -------------------------------------------------------------------


def interval_columns(intervals) -> list[int]:
    return [i for s, e in intervals for i in range(s, e)]


def bounds(points: int, intervals: int) -> list[tuple[int, int]]:
    return [(i * points // intervals, (i + 1) * points // intervals) for i in range(intervals)]


class FoldGrams:
    """Gram matrices of the folds of a training table, of its spectra and of its sample means."""

    def __init__(self, train: DataFrame, folds: int = 5, targets: tuple[str, ...] = ("y",)):
        self.spark, self.q = train.sparkSession, len(targets)
        rows = targets_of(train, *targets)
        rows = rows.join(group_folds(rows, folds), "sample_id")
        mean = rows.groupBy("sample_id", "fold").agg(F.array(*[F.avg(F.col("ys")[k]) for k in range(self.q)]).alias("ys"))
        means = rows.select("sample_id", F.posexplode("x").alias("i", "v")).groupBy("sample_id", "i").agg(F.avg("v").alias("v"))
        means = means.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
        self.spectra = collect_grams(gram_rows(rows, "fold", "x", "ys"))
        self.samples = collect_grams(gram_rows(means.join(mean, "sample_id"), "fold", "x", "ys"))
        if len(self.spectra) < 2:
            raise ValueError("fewer than two folds have rows")
        self.points = len(next(iter(self.spectra.values()))) - 1 - self.q


def score_folds(grams: FoldGrams, candidates: DataFrame, scaled: bool = False) -> DataFrame:
    """(candidate, fold, n_components, r2_spectrum, r2_sample, rmse_sample, error) for each candidate and fold.

    `candidates(candidate, n_components, intervals array<struct<s,e>>)`; all are scored in
    tasks from the broadcast matrices, whose size is that of the axis. A candidate that cannot
    be fitted has an error instead of scores.
    """
    shared = grams.spark.sparkContext.broadcast((grams.spectra, grams.samples, grams.q))
    schema = "candidate string, n_components int, fold int, r2_spectrum double, r2_sample double, rmse_sample double, error string"

    def run(batches):
        spectra, means, q = shared.value
        total = sum(spectra.values())
        for pdf in batches:
            out = []
            for c, a, intervals in zip(pdf.candidate, pdf.n_components, pdf.intervals, strict=True):
                columns = interval_columns([(i["s"], i["e"]) for i in intervals])
                for fold in sorted(spectra):
                    row = {"candidate": c, "n_components": a, "fold": fold, "r2_spectrum": None, "r2_sample": None, "rmse_sample": None, "error": None}
                    if len(columns) < a:
                        row["error"] = "fewer points than components"
                    else:
                        coef, base = pls(Moments(total - spectra[fold], q, columns), int(a), scaled)
                        held, mean = Moments(spectra[fold], q, columns), Moments(means[fold], q, columns)
                        for name, m in (("r2_spectrum", held), ("r2_sample", mean)):
                            spread = np.diag(m.yy)
                            row[name] = float(np.mean(1 - m.squared_error(coef, base) / spread)) if (spread > 0).all() else None
                        row["rmse_sample"] = float(np.sqrt(mean.squared_error(coef, base).mean() / mean.n))
                    out.append(row)
            yield pd.DataFrame(out, columns=["candidate", "n_components", "fold", "r2_spectrum", "r2_sample", "rmse_sample", "error"])

    return candidates.select("candidate", "n_components", "intervals").mapInPandas(run, schema)


def candidate_table(spark, combos: list, components: int, start: int = 0) -> DataFrame:
    """Candidates from lists of intervals, spread over tasks."""
    if len(combos) > MAX_GRID:
        raise ValueError(f"{len(combos)} candidates are more than {MAX_GRID}")
    rows = [(";".join(f"{s}-{e}" for s, e in c), components, [(int(s), int(e)) for s, e in c], start + k) for k, c in enumerate(combos)]
    df = spark.createDataFrame(rows, "candidate string, n_components int, intervals array<struct<s:int,e:int>>, ordinal long")
    return df.repartition(max(1, min(len(rows) // 16, 1000)))


def mean_scores(folds: DataFrame) -> DataFrame:
    return folds.where("error is null").groupBy("candidate", "n_components").agg(*[F.avg(c).alias(c) for c in ("r2_spectrum", "r2_sample", "rmse_sample")])


def sipls_search(grams: FoldGrams, components: int, intervals: int, most: int, top_k: int = 30, scaled: bool = False, by: str = "r2_sample"):
    """(best intervals, its scores, fold log): single intervals, the top k of them, all their combinations.

    Singles rank by spectrum-level R2, combinations by `by`; the first in order wins a tie.
    """
    from itertools import combinations

    singles = [[b] for b in bounds(grams.points, intervals) if b[1] > b[0]]
    table = candidate_table(grams.spark, singles, components)
    ranked = mean_scores(score_folds(grams, table, scaled)).join(table, ["candidate", "n_components"]).orderBy(F.desc("r2_spectrum"), "ordinal").limit(top_k)
    kept = sorted((r["intervals"][0]["s"], r["intervals"][0]["e"]) for r in ranked.select("intervals").collect())
    if sum(math.comb(len(kept), k) for k in range(1, most + 1)) > MAX_GRID:
        raise ValueError("too many combinations; lower top_k or most")
    combos = [list(c) for k in range(1, most + 1) for c in combinations(kept, k)]
    table = candidate_table(grams.spark, combos, components)
    log = score_folds(grams, table, scaled)
    order = F.asc("rmse_sample") if by == "rmse_sample" else F.desc(by)
    best = mean_scores(log).join(table, ["candidate", "n_components"]).orderBy(order, "ordinal").first()
    return ([(i["s"], i["e"]) for i in best["intervals"]] if best else None), best, log


# ---- trees and principal components --------------------------------------------------------


def points_of(intervals) -> Column:
    """The points of the intervals, as one array."""
    return F.concat(*[F.slice("x", s + 1, e - s) for s, e in intervals])


def _features(df: DataFrame, intervals) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(points_of(intervals)))


#: Rows of a task when trees are grown: each level of a tree is a job.
TREE_ROWS = 5000
#: Nodes of a forest that the driver holds at once, one tree at least: Spark grows trees there.
TREE_NODES = 100_000


def tree_groups(rows: int, trees: int, depth: int) -> list[int]:
    """How many trees of a forest are grown together, group by group; a tree has at most two nodes a row."""
    size = max(1, TREE_NODES // max(1, min(2 * rows, 2 ** (depth + 1))))
    return [min(size, trees - k) for k in range(0, trees, size)]


def tree_regression(kind: str, train: DataFrame, test: DataFrame, intervals, key: str = "spectrum_id", **options):
    """(`test` with `pred`, importance of each interval): random forest or boosted trees on the points of the intervals.

    Rows without a target or a defined spectrum take no part; those without a spectrum are not
    predicted. Rows keep the number of their node, so grown parts of trees are not sent to them
    again at each level. A forest of more nodes than TREE_NODES is grown in groups of trees: each group
    predicts `test`, whose rows `key` tells apart, and is let go before the next one grows.
    """
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    kept = _features(train.where("x is not null and y is not null"), intervals).select("features", "y").persist()
    n = kept.count()
    rows, on = kept.coalesce(n // TREE_ROWS + 1), _features(test.where("x is not null"), intervals)
    columns = {"featuresCol": "features", "labelCol": "y", "predictionCol": "pred"}
    groups = [1]
    if kind == "forest":
        default = RandomForestRegressor()
        trees = options.pop("numTrees", default.getNumTrees())
        groups = tree_groups(n, trees, options.get("maxDepth", default.getMaxDepth()))
        if trees > 1 and options.get("featureSubsetStrategy", "auto") == "auto":
            options["featureSubsetStrategy"] = "onethird"  # as "auto" is for a whole forest, also for a group of one tree
    points, path = 0.0, shared_path(train.sparkSession, "trees")
    for k, size in enumerate(groups):
        cls = RandomForestRegressor(numTrees=size, seed=42 + k, cacheNodeIds=True, **columns, **options) if kind == "forest" else GBTRegressor(seed=42, **columns, **options)
        model = cls.fit(rows)
        points = points + size * model.featureImportances.toArray()
        if len(groups) > 1:
            model.transform(on).select(key, F.lit(size).alias("trees"), "pred").write.mode("append").parquet(path)
    kept.unpersist()
    if len(groups) == 1:
        found = model.transform(on).drop("features")
    else:
        parts = train.sparkSession.read.parquet(path)
        parts.settled_at = path
        means = settled(parts.groupBy(key).agg((F.sum(F.col("trees") * F.col("pred")) / F.sum("trees")).alias("pred")), "forest")
        discard(parts)
        found = test.join(means, key)
    points, ends = points / sum(groups), np.cumsum([e - s for s, e in intervals])
    return found, [float(points[end - (e - s) : end].sum()) for (s, e), end in zip(intervals, ends, strict=True)]


def fit_pca(df: DataFrame, k: int):
    """(mean, axes, shares of variance) of `df(x)`."""
    one = df.select(F.lit(0).alias("all"), "x", F.array().cast("array<double>").alias("ys"))
    return principal_axes(collect_grams(gram_rows(one, "all", "x", "ys"))[0], 0, k)


def pca_scores(df: DataFrame, fitted) -> DataFrame:
    """`df` with PC1.. from a fitted mean and axes."""
    mean, axes, _ = fitted
    for k in range(axes.shape[1]):
        df = df.withColumn(f"PC{k + 1}", array_sum(F.zip_with("x", F.lit(axes[:, k]), lambda a, b: a * b)) - float(mean @ axes[:, k]))
    return df
