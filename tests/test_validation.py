"""Monte-Carlo validation by passes against plain fits of every cell."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.functions import spectral
from specspark.operators import splits, validation

from .test_spectral import plain_pls, table  # noqa: F401

CHAINS = [[], ["snv"], ["emsc"], ["normalize", "emsc", "second_derivative"], ["emsc", "snv"], ["emsc", "normalize"], ["snv", "second_derivative"]]


def direct(pdf, test, chain, components):
    """Predictions of the test spectra from a plain fit on the others, with the steps one by one."""
    pdf = pdf[~pdf.y.isna()]
    x, held, ok = np.stack(pdf.x), pdf.unit.isin(test).to_numpy(), np.ones(len(pdf), bool)
    for step in chain:
        if step == "emsc":
            ok &= x.std(1) > 0
            r = x[~held & ok].mean(0)
            fits = [np.polyfit(r, v, 1) if v.std() > 0 else (1.0, 0.0) for v in x]
            x = np.array([(v - b) / a for v, (a, b) in zip(x, fits, strict=True)])
        elif step == "snv":
            ok &= x.std(1) > 0
            x = (x - x.mean(1, keepdims=True)) / np.where(x.std(1, keepdims=True) > 0, x.std(1, keepdims=True), 1)
        elif step == "normalize":
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            x = x @ spectral.savgol_matrix(x.shape[1], 11, 2, 2).T
    tr, y = x[~held & ok], pdf.y[~held & ok]
    sx, sy = tr.std(0, ddof=1), y.std(ddof=1)
    b, _ = plain_pls((tr - tr.mean(0)) / sx, ((y - y.mean()) / sy).to_numpy()[:, None], components)
    p = np.where(ok, ((x - tr.mean(0)) / sx @ b)[:, 0] * sy + y.mean(), np.nan)
    return dict(zip(pdf.spectrum_id[held], p[held], strict=True))


def with_cases(rows):
    gap = F.when(F.col("spectrum_id") >= 27, F.col("y") * 2)
    return rows.withColumn("gap", gap).withColumn("cases", F.map_filter(F.create_map(F.lit("all"), F.col("y"), F.lit("some"), gap), lambda k, v: v.isNotNull()))


@pytest.mark.parametrize(("unit", "blocks", "rounds"), [("sample_id", 4096, 1 << 30), ("spectrum_id", 40, 1)])
def test_every_cell_equals_a_direct_fit(spark, table, unit, blocks, rounds, monkeypatch):  # noqa: F811
    monkeypatch.setattr(validation, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(validation, "ROUND_BYTES", rounds)
    monkeypatch.setattr(validation, "GROUP", 2 if rounds == 1 else 256)
    cases = with_cases(table.withColumn("x", F.transform("x", lambda v, i: v + i)))
    units = cases.select(unit, F.explode(F.map_keys("cases")).alias("case")).distinct()
    draws = splits.mc_splits(units, unit, 3, cases=("case",))
    got = validation.monte_carlo(cases, draws, CHAINS, unit, 3).toPandas()
    pdf, parts = cases.toPandas(), draws.toPandas()
    assert len(got.groupby(["chain", "case", "iter"])) == len(CHAINS) * 2 * 3
    for (chain, case, it), g in got.groupby(["chain", "case", "iter"]):
        test = set(parts[(parts.case == case) & (parts.iter == it) & (parts.part == "test")][unit])
        own = pdf.assign(y=pdf.y if case == "all" else pdf.gap, unit=pdf[unit])
        want = direct(own, test, [] if chain == "none" else chain.split("+"), 3)
        assert set(g.spectrum_id) == set(want) and np.allclose(g.prediction, [want[k] for k in g.spectrum_id], rtol=1e-6)


@pytest.mark.parametrize("chain", [["snv"], ["emsc"], ["emsc", "snv"]])
def test_undefined_spectra_in_training_and_test(spark, table, chain):  # noqa: F811
    rows = table.withColumn("x", F.transform("x", lambda v, i: v + i)).withColumn("x", F.when(F.col("spectrum_id").isin(4, 95), F.array_repeat(F.lit(2.0), 20)).otherwise(F.col("x")))
    cases = rows.withColumn("cases", F.create_map(F.lit("all"), F.col("y")))
    draws = splits.mc_splits(rows.select("sample_id").distinct().withColumn("case", F.lit("all")), "sample_id", 6, cases=("case",))
    got = validation.monte_carlo(cases, draws, [chain], "sample_id", 2).toPandas()
    pdf, parts = rows.toPandas(), draws.toPandas()
    seen = 0
    for it, g in got.groupby("iter"):
        test = set(parts[(parts.iter == it) & (parts.part == "test")].sample_id)
        # the reference is the mean of all training rows that are defined before EMSC, so also of constant ones
        if chain[0] == "emsc":
            assert g.prediction.isna().tolist() == g.spectrum_id.isin([4, 95]).tolist()
            assert np.isfinite(g.prediction.dropna().astype(float)).all()
        else:
            want = direct(pdf.assign(unit=pdf.sample_id), test, chain, 2)
            assert np.allclose(g.prediction.astype(float), [want[k] for k in g.spectrum_id], equal_nan=True)
        seen += int(g.prediction.isna().sum())
    assert seen > 0


def test_constant_points_and_targets_and_empty_tables(spark, table):  # noqa: F811
    rows = table.withColumn("x", F.transform("x", lambda v, i: F.when(i == 3, 7.0).otherwise(v)))
    cases = rows.withColumn("cases", F.create_map(F.lit("flat"), F.lit(1.5), F.lit("y"), F.col("y")))
    units = cases.select("sample_id", F.explode(F.map_keys("cases")).alias("case")).distinct()
    draws = splits.mc_splits(units, "sample_id", 2, cases=("case",))
    got = validation.monte_carlo(cases, draws, [[]], "sample_id", 4).toPandas()
    assert np.allclose(got[got.case == "flat"].prediction, 1.5) and np.isfinite(got.prediction).all()
    assert validation.monte_carlo(cases.limit(0), draws.limit(0), [[]], "sample_id").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        validation.monte_carlo(cases, draws, [["nope"]], "sample_id")


def test_no_table_of_draws_is_joined_by_broadcast(spark, table):  # noqa: F811
    units = spark.range(3000).select(F.concat(F.lit("S_"), "id").alias("sample_id"), F.lit("all").alias("case"))
    draws = splits.mc_splits(units, "sample_id", 40, cases=("case",))
    plan = draws._jdf.queryExecution().executedPlan().toString()
    hashed = [line for line in plan.split("\n") if "BroadcastExchange" in line]
    assert "SortMergeJoin" not in plan and hashed
    below = plan.split("BroadcastExchange")[1:]
    assert all("ends" in part.split("Scan parquet")[1].split("\n")[0] for part in below)
    found = draws.groupBy("iter", "part").count().toPandas()
    assert set(found[found.part == "test"]["count"]) == {600} and set(found[found.part == "train"]["count"]) == {2400}
    pdf = draws.toPandas()
    for it in (0, 39):
        own = pdf[pdf.iter == it]
        order = sorted(own.sample_id, key=lambda k: (hashlib.md5(f"{k}_{it + 42}".encode()).hexdigest(), k))
        assert set(own[own.part == "test"].sample_id) == set(order[:600])


@pytest.mark.parametrize("cells", [2, 256])
def test_summary_is_that_of_the_listed_predictions(spark, table, cells, monkeypatch):  # noqa: F811
    monkeypatch.setattr(validation, "GROUP", cells)
    rows = table.withColumn("x", F.when(F.col("spectrum_id").isin(4, 95), F.array_repeat(F.lit(2.0), 20)).otherwise(F.transform("x", lambda v, i: v + i)))
    cases = with_cases(rows)
    units = cases.select("spectrum_id", F.explode(F.map_keys("cases")).alias("case")).distinct()
    draws = splits.mc_splits(units, "spectrum_id", 9, cases=("case",))
    chains, keys = [["snv"], ["emsc", "snv"]], ["chain", "case", "spectrum_id", "sample_id"]
    listed = validation.monte_carlo(cases, draws, chains, "spectrum_id", 2).groupBy(*keys).agg(F.first("y").alias("y"), F.avg("prediction").alias("pred"), F.stddev_pop("prediction").alias("pred_std"))
    want = listed.toPandas().set_index(keys).sort_index()
    got = validation.monte_carlo_summary(cases, draws, chains, "spectrum_id", 2).toPandas().set_index(keys).sort_index()
    assert list(got.index) == list(want.index) and want.pred.isna().any() and len(want) > 300
    assert all(np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True, atol=1e-9) for c in ("y", "pred", "pred_std"))


def test_blocks_are_not_moved_again_for_the_groups_of_cells(spark, table):  # noqa: F811
    cases = table.withColumn("cases", F.create_map(F.lit("all"), F.col("y")))
    draws = splits.mc_splits(cases.select("sample_id").distinct().withColumn("case", F.lit("all")), "sample_id", 4, cases=("case",))
    plan = validation.monte_carlo(cases, draws, [[], ["snv"], ["emsc"]], "sample_id", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_spectra_of_a_sample_lie_in_one_block_unless_it_is_large(spark, table, monkeypatch):  # noqa: F811
    monkeypatch.setattr(validation, "BLOCK_ROWS", 80)
    odd = table.withColumn("sample_id", F.when(F.col("spectrum_id") < 63, "big").when(F.col("spectrum_id") >= 171, F.lit(None).cast("string")).otherwise(F.col("sample_id")))
    cases = odd.withColumn("cases", F.create_map(F.lit("all"), F.col("y")))
    tests = cases.select(F.col("spectrum_id").alias("unit"), F.create_map(F.lit("all"), F.array(F.lit(0))).alias("tests"))
    pdf = validation._blocks(cases, tests, [[], ["snv"]], "spectrum_id", ["all"], {"all": [0]}).select("block", "n", F.explode("sample_id").alias("s")).toPandas()
    spread = pdf.groupby("s").block.nunique()
    assert len(pdf) == 180 and pdf.s.isna().sum() == 9 and spread["big"] > 1 and set(spread.drop("big")) == {1}


def test_a_draw_of_many_units_counts_few_ranges_and_moves_no_draws(spark):
    units = spark.range(5000).select(F.concat(F.lit("S_"), "id").alias("sample_id"), F.lit("all").alias("case"))
    draws = splits.mc_splits(units, "sample_id", 2, cases=("case",))
    pdf = draws.toPandas()
    for it in (0, 1):
        order = sorted(pdf[pdf.iter == it].sample_id, key=lambda k: (hashlib.md5(f"{k}_{it + 42}".encode()).hexdigest(), k))
        assert set(pdf[(pdf.iter == it) & (pdf.part == "test")].sample_id) == set(order[:1000]) and len(order) == 5000
    grouped = draws.where("part = 'test'").groupBy("sample_id", "case").agg(F.collect_list("iter").alias("iters"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and "Window" not in plan  # the units by key, before they are drawn
