"""The interval search over numbered candidates against plain loops over the data."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.functions import spectral
from specspark.operators import models, search, splits
from specspark.operators.gram import Moments, pls
from specspark.plans import jobs

from .test_spectral import plain_pls, table  # noqa: F401


@pytest.fixture(scope="module")
def parts(spark, table):  # noqa: F811
    part = F.when(F.col("sample_id") < "s013", "fit").when(F.col("sample_id") < "s017", "held").otherwise("test")
    return table.withColumn("part", part).persist()


def tagged(rows, chain="none", steps=()):
    one = spectral.preprocess_chain(rows, list(steps), "x", F.col("part") == "fit")
    return one.select(F.lit(chain).alias("chain"), "part", "sample_id", "x", F.array("y").alias("ys"))


@pytest.fixture(scope="module")
def moments(parts):
    return search.SearchMoments(tagged(parts))


@pytest.mark.parametrize(("n", "most"), [(1, 1), (5, 2), (7, 4), (3, 4)])
def test_numbers_are_those_of_itertools(n, most):
    want = [c for k in range(1, most + 1) for c in combinations(range(n), k)]
    assert search.combinations_total(n, most) == len(want)
    got = {}
    for own, members in search.unrank_combinations(np.arange(len(want)), n, most):
        got |= {int(o): tuple(m.tolist()) for o, m in zip(own, members, strict=True)}
    assert [got[k] for k in range(len(want))] == want


def test_moves_are_in_order_and_clamped():
    s, e = search.unrank_moves(np.arange(search.moves_total(4, 1)), np.array([0, 5]), np.array([3, 8]), [0, 1], 1, 8)
    want = [(max(0, a), 3 + b, 5 + c, min(8, 8 + d)) for a, b, c, d in product((-1, 0, 1), repeat=4)]
    assert list(zip(s[:, 0], e[:, 0], s[:, 1], e[:, 1], strict=True)) == want


def test_one_path_has_the_coefficients_of_every_count():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(40, 9))
    z[:, 4] = z[:, 3]  # rank 6 in x
    m = Moments(np.column_stack([np.ones(40), z]).T @ np.column_stack([np.ones(40), z]), 2)
    coef = search.pls_paths(m.xx[None], m.xy[None], 7)[0]
    for c in range(1, 8):
        assert np.allclose(coef[c - 1], pls(m, c)[0], atol=1e-7)


def folds_of(parts):
    return {r[0]: r[1] for r in splits.group_folds(parts.where("part = 'fit'")).collect()}


def plain_scores(pdf, folds, intervals, components):
    cols, out = models.interval_columns(intervals), []
    fold = pdf.sample_id.map(folds)
    for k in sorted(set(folds.values())):
        tr, te = pdf[(fold != k) & fold.notna()], pdf[fold == k]
        b, a = plain_pls(np.stack(tr.x)[:, cols], tr[["y"]].to_numpy(), components)
        p = (np.stack(te.x)[:, cols] @ b + a)[:, 0]
        s = te.assign(p=p).groupby("sample_id")[["y", "p"]].mean()
        out.append((1 - ((te.y - p) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum(), 1 - ((s.y - s.p) ** 2).sum() / ((s.y - s.y.mean()) ** 2).sum(), np.sqrt(((s.y - s.p) ** 2).mean())))
    return np.mean(out, axis=0)


def test_ten_cells_equal_plain_fits(parts, moments, monkeypatch):
    monkeypatch.setattr(search, "RANGE", 7)
    counts, cells, most, top = (1, 2, 3, 5, 6), (4, 5), 3, 4
    got = {(r["n_components"], r["n_intervals"]): r for r in search.interval_grid(moments, counts, cells, most, top).collect()}
    assert len(got) == 10
    pdf, folds = parts.where("part = 'fit'").toPandas(), folds_of(parts)
    for (c, n), r in got.items():
        singles = models.bounds(20, n)
        rank = sorted(range(n), key=lambda i: (-plain_scores(pdf, folds, [singles[i]], min(c, singles[i][1] - singles[i][0]))[0], i))  # noqa: B023
        kept = [singles[i] for i in sorted(rank[:top])]
        combos = [x for k in range(1, most + 1) for x in combinations(kept, k) if len(models.interval_columns(x)) >= c]
        scores = [plain_scores(pdf, folds, x, c) for x in combos]
        best = int(np.argmax([x[1] for x in scores]))
        assert [(i["s"], i["e"]) for i in r["intervals"]] == list(combos[best]) and r["candidates"] == len(combos) and r["error"] is None
        assert np.allclose([r["r2_spectrum"], r["r2_sample"], r["rmse_sample"]], scores[best])


def test_a_cell_without_candidates_says_so(moments):
    r = search.interval_grid(moments, (9,), (20,), 2).first()
    assert r["error"] == "nothing could be fitted" and r["intervals"] is None and r["candidates"] == 0


def plain_error(pdf, intervals, c, fit="fit", on="held", by_sample=False):
    cols = models.interval_columns(intervals)
    tr, te = pdf[pdf.part.isin(fit.split())], pdf[pdf.part == on]
    b, a = plain_pls(np.stack(tr.x)[:, cols], tr[["y"]].to_numpy(), c)
    d = te.assign(p=(np.stack(te.x)[:, cols] @ b + a)[:, 0])
    d = d.groupby("sample_id")[["y", "p"]].mean() if by_sample else d
    return float(np.sqrt(((d.y - d.p) ** 2).mean()))


def test_refinement_on_held_rows_is_the_plain_loop(parts, moments, monkeypatch):
    monkeypatch.setattr(search, "RANGE", 10)
    pdf, now = parts.toPandas(), [(1, 4), (8, 12)]
    best = plain_error(pdf, now, 2)
    log = search.refine_on_held(moments, [("none", 2, now)], 3)
    for k, step in enumerate(log):
        found = (best - 1e-12, None)
        for a, b in product(range(-3, 4), repeat=2):
            move = (min(19, max(0, now[k][0] + a)), min(19, max(0, now[k][1] + b)))
            trial = [*now[:k], move, *now[k + 1 :]]
            if move[0] < move[1] and len(models.interval_columns(trial)) >= 2:
                error = plain_error(pdf, trial, 2)
                if error < found[0] - 1e-12:
                    found = (error, trial)
        if found[1]:
            best, now = found
        assert step["intervals"] == now and np.isclose(step["rmse"], best) and step["moved"] == bool(found[1])


def test_joint_refinement_is_the_plain_loop(parts, moments):
    pdf, folds, start = parts.where("part = 'fit'").toPandas(), folds_of(parts), [(2, 5), (10, 13)]
    trials = []
    for a, b, c, d in product((-1, 0, 1), repeat=4):
        trial = [(2 + a, 5 + b), (10 + c, 13 + d)]
        trials.append((plain_scores(pdf, folds, trial, 2)[2], trial))
    got, rmse = search.refine_on_folds(moments, "none", 2, start, 1)
    want = min(trials, key=lambda x: x[0])
    assert np.isclose(rmse, want[0]) and got == want[1]


def test_undefined_spectra_take_no_part(spark, parts):
    odd = parts.limit(0)
    for i, (part, sample) in enumerate((("fit", "s001"), ("held", "s014"), ("test", "s018"), ("fit", "zzz"))):
        odd = odd.unionByName(spark.createDataFrame([(900 + i, sample, [3.0] * 20, 1.0, part)], parts.schema))
    clean, dirty = (search.SearchMoments(tagged(d, "snv", ["snv"]).unionByName(tagged(d, "emsc", ["emsc"]))) for d in (parts, parts.unionByName(odd)))
    a, b = ({(r["chain"], r["stage"]): r for r in jobs.evaluate(m, (1, 2), (4,), 2, 1).collect()} for m in (clean, dirty))
    assert len(a) == 8 and a.keys() == b.keys()
    for key in a:  # under EMSC the constant spectra move the reference, so only SNV gives the same numbers
        if key[0] == "snv":
            assert a[key]["n"] == b[key]["n"] and np.isclose(a[key]["rmse"], b[key]["rmse"])
        assert b[key]["rmse"] is not None and np.isfinite(b[key]["rmse"])
    snv = spectral.preprocess_chain(parts.unionByName(odd), ["snv"], "x")
    coef, base = models.fit_pls(snv.where("part = 'fit'"), 2)
    assert np.allclose(coef, models.fit_pls(spectral.preprocess_chain(parts, ["snv"], "x").where("part = 'fit'"), 2)[0])
    p = models.predict(snv, coef[:, 0], base[0])
    assert {r["spectrum_id"] for r in p.where("pred is null").collect()} == {900, 901, 902, 903}


def test_stages_equal_plain_fits(parts, moments):
    got = {r["stage"]: r for r in jobs.evaluate(moments, (1, 2), (4, 5), 2, 1).collect()}
    pdf = parts.toPandas()
    at = lambda r: eval(r["intervals"])  # noqa: E731, S307
    for stage, fit, on in (("calibration", "fit", "held"), ("refined", "fit", "held"), ("blind test", "fit held", "test")):
        r = got[stage]
        assert np.isclose(r["rmse"], plain_error(pdf, at(r), r["n_components"], fit, on, True))
    assert got["retrained"]["n"] == 17 and got["blind test"]["n"] == 3
    spectrum = lambda r: plain_error(pdf, at(r), r["n_components"])
    assert spectrum(got["refined"]) <= spectrum(got["calibration"]) + 1e-9
