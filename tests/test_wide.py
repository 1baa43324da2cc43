"""Models by passes equal those from the matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.operators import gram, models, wide

from .test_spectral import table  # noqa: F401


@pytest.mark.parametrize("scaled", [False, True])
def test_pls_by_passes(table, scaled, monkeypatch):  # noqa: F811
    monkeypatch.setattr(wide, "STRETCH", 7)
    rows = models.targets_of(table.withColumn("z", F.col("y") * F.col("x")[5]), "y", "z")
    odd = rows.withColumn("x", F.when(F.col("spectrum_id") == 3, None).otherwise(F.col("x")))
    coef, base = wide.fit_pls(odd, 4, scaled)
    want, level = models.fit_pls(table.withColumn("z", F.col("y") * F.col("x")[5]).where("spectrum_id <> 3"), 4, scaled, targets=("y", "z"))
    assert np.allclose(coef, want) and np.allclose(base, level)


def test_axes_by_passes(spark, table):  # noqa: F811
    mean, axes, share = wide.fit_pca(table, 3)
    m, a, s = models.fit_pca(table, 3)
    assert np.allclose(mean, m) and np.allclose(axes, a, atol=1e-6) and np.allclose(share, s)


def test_too_wide_for_a_matrix(table, monkeypatch):  # noqa: F811
    monkeypatch.setattr(gram, "MATRIX_BYTES", 100)
    with pytest.raises(Exception, match="use operators.wide"):
        models.fit_pls(table, 1)
    assert wide.fit_pls(models.targets_of(table, "y"), 1)[0].shape == (20, 1)


def test_thousands_of_points(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) @ (rng.normal(size=(3, 6000)) * np.array([[9.0], [4.0], [2.0]])) + rng.normal(size=(40, 6000)) * 0.1
    y = x[:, 17] - x[:, 4000]
    rows = spark.createDataFrame([(v.tolist(), [float(t)]) for v, t in zip(x, y, strict=True)], "x array<double>, ys array<double>").repartition(3)
    values, vectors = np.linalg.eigh((x - x.mean(0)) @ (x - x.mean(0)).T)
    want = ((x - x.mean(0)).T @ vectors[:, ::-1][:, :2]) / np.sqrt(values[::-1][:2])
    _, axes, share = wide.fit_pca(rows, 2)
    assert np.allclose(np.abs((axes * want).sum(0)), 1) and np.allclose(share, values[::-1][:2] / values.sum())
    coef, base = wide.fit_pls(rows, 3)
    assert np.corrcoef(x @ coef[:, 0] + base[0], y)[0, 1] > 0.99
    with pytest.raises(ValueError, match="no training rows"):
        wide.fit_pls(rows.limit(0), 1)
