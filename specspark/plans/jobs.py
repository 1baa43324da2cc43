"""Queries of the models and of the jobs that compose them."""

from __future__ import annotations

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from specspark.functions import spectral
from specspark.operators import aggregates as agg
from specspark.operators import distances, metadata, models, ranking, search, splits, statistics, trees, validation, wide
from specspark.operators.shared import settled, shared_path
from specspark.plans import fixtures as fx
from specspark.plans import tables
from specspark.plans.fixtures import r6
from specspark.plans.tables import R, query
from specspark.sources import spectral_files as files

#: Steps of the default chain; intervals combined in the single searches.
CHAIN, COMBINED = ["snv"], 2
# Component counts, interval counts (as far as an axis of 64 points allows), combined
# intervals, shift of a bound and chains of the full search.
COMPONENTS, INTERVALS, MOST_COMBINED, SHIFT = (2, 3, 4, 5, 6, 7, 8, 9), (10, 15, 20, 30, 40, 50, 60), 4, 50
SEARCH_CHAINS = ([], ["emsc"], ["normalize"], ["snv"], ["second_derivative"])


def model_table(spark, sf_dir, steps=(), target="target_SI", where="true"):
    """(spectrum_id, sample_id, map_no, set, x, y): preprocessed spectra of DM1 and controls with the imputed target."""
    meta = metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control")))
    meta = metadata.drop_missing_target(meta, (target,)).where(where)
    joined = metadata.join_metadata(fx.spectra(spark, sf_dir).drop("sample_no"), meta)
    return spectral.preprocess_chain(joined, list(steps)).withColumn("x", F.col("intensity")).withColumn("y", F.col(target)).drop("intensity")


def _train_test(spark, sf_dir, steps=()):
    m = model_table(spark, sf_dir, steps)
    return m.where("set = 'Train'"), m.where("set = 'Test'")


_META = """meta as (select sample_id, set, case when type = 'Control' then 0 else "target_SI" end as y from samples where type in ('DM1', 'Control')),
tr as (select l.spectrum_id, l.sample_id, l.idx, l.x, m.y from spectra_long l join meta m using (sample_id) where m.set = 'Train'),
mx as (select idx, avg(x) as xm, {scale_x} as sx from tr group by 1), my as (select avg(y) as ym, {scale_y} as sy from (select distinct spectrum_id, y from tr)),
cov as (select idx, sum((x - xm) / sx * (y - ym) / sy) as c from tr join mx using (idx), my group by 1), w as (select idx, c / sqrt((select sum(c * c) from cov)) as w from cov),
t as (select spectrum_id, any_value((y - ym) / sy) as yc, sum((x - xm) / sx * w) as t from tr join mx using (idx) join w using (idx), my group by 1),
q as (select sum(t * yc) / sum(t * t) as q from t), beta as (select idx, xm, w * q * sy / sx as b from w join mx using (idx), q, my)"""
_PLS1 = _META.format(scale_x="1.0", scale_y="1.0")
_PLS1_SCALED = _META.format(scale_x="stddev_samp(x)", scale_y="stddev_samp(y)")
_PRED1 = "pr as (select l.spectrum_id, l.sample_id, any_value(m.y) as y, any_value(ym) + sum((l.x - xm) * b) as pred from spectra_long l join meta m using (sample_id) join beta using (idx), my where m.set = 'Test' group by 1, 2)"


def _coefficients(spark, coef):
    return spark.createDataFrame([(i, round(float(b), 6) + 0.0) for i, b in enumerate(coef[:, 0])], "idx int, beta double")


@query(f", {_PLS1} select idx, {R('b')} as beta from beta")
def pls_fit(spark, sf_dir):
    return _coefficients(spark, models.fit_pls(_train_test(spark, sf_dir)[0], 1)[0])


@query(f", {_PLS1_SCALED} select idx, {R('b')} as beta from beta")
def pls_scaled(spark, sf_dir):
    return _coefficients(spark, models.fit_pls(_train_test(spark, sf_dir)[0], 1, scaled=True)[0])


@query(f", {_PLS1_SCALED} select idx, {R('b')} as beta from beta")
def pls_wide(spark, sf_dir):
    """The scaled fit by passes over the rows, for axes whose matrix is too large."""
    return _coefficients(spark, wide.fit_pls(models.targets_of(_train_test(spark, sf_dir)[0], "y"), 1, scaled=True)[0])


def _predicted(spark, sf_dir, components=1, steps=()):
    train, test = _train_test(spark, sf_dir, steps)
    coef, base = models.fit_pls(train, components)
    return models.predict(test, coef[:, 0], base[0])


@query(f", {_PLS1}, {_PRED1} select spectrum_id, sample_id, {R('y')} as y, {R('pred')} as pred from pr")
def pls_predict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("spectrum_id", "sample_id", r6("y").alias("y"), r6("pred").alias("pred"))


@query(f", {_PLS1}, {_PRED1} select sample_id, {R('any_value(y)')} as y, {R('avg(pred)')} as pred_mean, {R('stddev_pop(pred)')} as pred_std, {R('any_value(y) - avg(pred)')} as residual from pr group by 1")
def parity_table(spark, sf_dir):
    s = agg.sample_predictions(_predicted(spark, sf_dir))
    return s.select("sample_id", r6("y").alias("y"), r6("pred_mean").alias("pred_mean"), r6("pred_std").alias("pred_std"), r6(F.col("y") - F.col("pred_mean")).alias("residual"))


@query()
def snv_pls_metrics(spark, sf_dir):
    """SNV, join, impute, PLS of two components, mean and deviation by sample, error and R2."""
    p = _predicted(spark, sf_dir, 2, CHAIN)
    by_sample = agg.sample_predictions(p).withColumn("pred", F.col("pred_mean"))
    both = agg.regression_metrics(p).withColumn("level", F.lit("spectrum")).unionByName(agg.regression_metrics(by_sample).withColumn("level", F.lit("sample")))
    return both.select("level", "n", r6("rmse").alias("rmse"), r6("r2").alias("r2"))


# ---- the same fits in SQL -------------------------------------------------------------------


def pls_sql(p: str, components: int) -> str:
    """Partial least squares by deflation for each (c, k), as common table expressions.

    From {p}x0(c, k, s, idx, x, train) and {p}y0(c, k, s, y, train), centred by the training
    rows, to {p}pred(c, k, s, v): the predictions of all rows, less the training mean.
    """
    out = []
    for a in range(1, components + 1):
        x, y, w, t, tt, q, load = (f"{p}{n}" for n in (f"x{a - 1}", f"y{a - 1}", f"w{a}", f"t{a}", f"tt{a}", f"q{a}", f"p{a}"))
        out += [
            f"{w} as (select c, k, idx, cov / sqrt(sum(cov * cov) over (partition by c, k)) as w from (select {x}.c, {x}.k, idx, sum(x * y) as cov from {x} join {y} on {x}.c = {y}.c and {x}.k = {y}.k and {x}.s = {y}.s where {x}.train group by 1, 2, 3))",
            f"{t} as materialized (select {x}.c, {x}.k, {x}.s, any_value(train) as train, sum(x * w) as t from {x} join {w} on {x}.c = {w}.c and {x}.k = {w}.k and {x}.idx = {w}.idx group by 1, 2, 3)",
            f"{tt} as (select c, k, sum(t * t) as tt from {t} where train group by 1, 2)",
            f"{q} as (select {t}.c, {t}.k, sum(t * y) / any_value(tt) as q from {t} join {y} on {t}.c = {y}.c and {t}.k = {y}.k and {t}.s = {y}.s join {tt} on {t}.c = {tt}.c and {t}.k = {tt}.k where {t}.train group by 1, 2)",
        ]
        if a < components:
            out += [
                f"{load} as (select {x}.c, {x}.k, idx, sum(x * t) / any_value(tt) as p from {x} join {t} on {x}.c = {t}.c and {x}.k = {t}.k and {x}.s = {t}.s join {tt} on {x}.c = {tt}.c and {x}.k = {tt}.k where {x}.train group by 1, 2, 3)",
                f"{p}x{a} as materialized (select {x}.c, {x}.k, {x}.s, {x}.idx, x - t * p as x, {x}.train from {x} join {t} on {x}.c = {t}.c and {x}.k = {t}.k and {x}.s = {t}.s join {load} on {x}.c = {load}.c and {x}.k = {load}.k and {x}.idx = {load}.idx)",
                f"{p}y{a} as (select {y}.c, {y}.k, {y}.s, y - t * q as y, {y}.train from {y} join {t} on {y}.c = {t}.c and {y}.k = {t}.k and {y}.s = {t}.s join {q} on {y}.c = {q}.c and {y}.k = {q}.k)",
            ]
    parts = " union all ".join(f"select {p}t{a}.c, {p}t{a}.k, s, t * q as v from {p}t{a} join {p}q{a} on {p}t{a}.c = {p}q{a}.c and {p}t{a}.k = {p}q{a}.k" for a in range(1, components + 1))
    return ", ".join([*out, f"{p}pred as (select c, k, s, sum(v) as v from ({parts}) group by 1, 2, 3)"])


_FOLDS = """meta as (select sample_id, set, case when type = 'Control' then 0 else "target_SI" end as y from samples where type in ('DM1', 'Control')),
folds as (select sample_id, (row_number() over (order by sample_id) - 1) % 5 as fold from (select distinct sample_id from spectra join meta using (sample_id) where set = 'Train' and y is not null)),
ly as (select spectrum_id as s, sample_id, y, fold from spectra join meta using (sample_id) join folds using (sample_id)),
lx as (select l.spectrum_id as s, idx, x, fold from spectra_long l join folds using (sample_id)), ks as (select unnest(range(0, 5)) as k),
mx as (select k, idx, avg(x) as xm from lx, ks where fold <> k group by 1, 2), my as (select k, avg(y) as ym from ly, ks where fold <> k group by 1),
bounds as (select i, cast(i * 64 // 10 as int) as s0, cast((i + 1) * 64 // 10 as int) as e0 from (select unnest(range(0, 10)) as i)),
singles as (select s0 || '-' || e0 as c, i as o, s0, e0, -1 as s1, -1 as e1 from bounds),
combos as (select * from singles union all select a.s0 || '-' || a.e0 || ';' || b.s0 || '-' || b.e0, 100 + a.i * 100 + b.i, a.s0, a.e0, b.s0, b.e0 from bounds a join bounds b on a.i < b.i)"""


def _fold_sql(candidates: str) -> str:
    return f"""{_FOLDS}, cand as (select c, o, idx from {candidates}, (select unnest(range(0, 64)) as idx) where (idx >= s0 and idx < e0) or (idx >= s1 and idx < e1)),
fx0 as materialized (select c, mx.k, s, lx.idx, x - xm as x, fold <> mx.k as train from lx join mx using (idx) join cand using (idx)),
fy0 as (select c, k, s, y - ym as y, fold <> k as train from ly, my, (select distinct c from cand)), {pls_sql('f', 2)},
held as (select p.c, p.k, ly.sample_id, y, ym + v as pred from fpred p join ly on ly.s = p.s and ly.fold = p.k join my on my.k = p.k),
held_means as (select c, k, sample_id, avg(y) as y, avg(pred) as pred from held group by 1, 2, 3),
log as (select h.c as candidate, cast(2 as int) as n_components, cast(h.k as int) as fold, r2_spectrum, r2_sample, rmse_sample from (select c, k, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) as r2_spectrum from held group by 1, 2) h
  join (select c, k, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(*)) as r2_sample, sqrt(avg((y - pred) ** 2)) as rmse_sample from held_means group by 1, 2) m on m.c = h.c and m.k = h.k),
scores as (select candidate, n_components, avg(r2_spectrum) as r2_spectrum, avg(r2_sample) as r2_sample, avg(rmse_sample) as rmse_sample from log group by 1, 2)"""


_SCORE_COLUMNS = ", ".join(f"{R(c)} as {c}" for c in ("r2_spectrum", "r2_sample", "rmse_sample"))
_REFIT = f"""best as (select candidate from scores join combos on combos.c = scores.candidate order by r2_sample desc, o limit 1),
points as (select idx from cand where c = (select candidate from best)), ry as (select spectrum_id as s, sample_id, y, set = 'Train' as train from spectra join meta using (sample_id) where y is not null),
rm as (select l.idx, avg(l.x) as xm from spectra_long l join ry on ry.s = l.spectrum_id where train group by 1), rym as (select avg(y) as ym from ry where train),
rx0 as materialized (select 0 as c, 0 as k, ry.s, l.idx, l.x - xm as x, train from spectra_long l join ry on ry.s = l.spectrum_id join rm using (idx) join points using (idx)), ry0 as (select 0 as c, 0 as k, s, y - ym as y, train from ry, rym), {pls_sql('r', 2)}"""


def axes_sql(rows: str, components: int, doublings: int = 15) -> str:
    """Principal axes of the table {rows}(s, idx, x): common table expressions up to axes(j, idx, v, share) and centre(idx, m).

    The covariance matrix is squared again and again, so that its first axis is all that is
    left of it; then that axis is taken out of the matrix.
    """
    out = [
        f"centre as (select idx, avg(x) as m from {rows} group by 1), cn as (select s, {rows}.idx, x - m as x from {rows} join centre using (idx))",
        "cov1 as materialized (select a.idx as i, b.idx as j, sum(a.x * b.x) / (count(*) - 1) as v from cn a join cn b on a.s = b.s group by 1, 2), total as (select sum(v) as v from cov1 where i = j)",
    ]
    for n in range(1, components + 1):
        last = f"cov{n}"
        for d in range(doublings):
            out.append(f"sq{n}_{d} as materialized (select i, j, v / max(abs(v)) over () as v from (select a.i as i, b.j as j, sum(a.v * b.v) as v from {last} a join {last} b on a.j = b.i group by 1, 2))")
            last = f"sq{n}_{d}"
        out.append(f"one{n} as (select i as idx, v / sqrt(sum(v * v) over ()) as v from {last} where j = (select i from {last} where i = j order by v desc limit 1))")
        out.append(f"axis{n} as materialized (select idx, v * sign((select v from one{n} order by abs(v) desc limit 1)) as v from one{n})")
        out.append(f"value{n} as (select sum(c.v * a.v * b.v) as v from cov{n} c join axis{n} a on a.idx = c.i join axis{n} b on b.idx = c.j)")
        if n < components:
            out.append(f"cov{n + 1} as materialized (select c.i, c.j, c.v - (select v from value{n}) * a.v * b.v as v from cov{n} c join axis{n} a on a.idx = c.i join axis{n} b on b.idx = c.j)")
    out.append("axes as (" + " union all ".join(f"select {n} as j, idx, v, (select v from value{n}) / (select v from total) as share from axis{n}" for n in range(1, components + 1)) + ")")
    return ", ".join(out)


_SNV_ALL = "snv_all as materialized (select spectrum_id as s, sample_id, idx, (x - avg(x) over w) / stddev_pop(x) over w as x from spectra_long window w as (partition by spectrum_id))"
_PCA = f"{_SNV_ALL}, snv_train as (select s, idx, x from snv_all join samples using (sample_id) where set = 'Train'), {axes_sql('snv_train', 3)}, pc as (select s, sample_id, " + ", ".join(f"sum((x - m) * v) filter (where j = {n}) as pc{n}" for n in (1, 2, 3)) + " from snv_all join centre using (idx) join axes using (idx) group by 1, 2)"
_PCS = ", ".join(f"{R(f'pc{n}')} as \"PC{n}\"" for n in (1, 2, 3))
_SMOOTH = tables._filter_sql("spectra_long", 64, 51, 3, 0)
_PC_CORR = f"raw_all as materialized (select spectrum_id as s, idx, x from spectra_long join samples using (sample_id)), {axes_sql('raw_all', 1)}, pc as (select s, sum((x - m) * v) as pc1 from raw_all join centre using (idx) join axes using (idx) group by 1), base as (select spectrum_id as s, avg(x) as b from ({_SMOOTH}) group by 1), co as (select count(*) as n, corr(b, pc1) as r from pc join base using (s)), ct as (select n, r, r * sqrt((n - 2) / (1 - r * r)) as t, n - 2 as df from co)"

# ---- interval search -----------------------------------------------------------------------


def _rounded(df):
    return df.select(*[r6(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(f", {_fold_sql('singles')} select candidate, n_components, {_SCORE_COLUMNS} from scores")
def interval_scores(spark, sf_dir):
    grams = models.FoldGrams(_train_test(spark, sf_dir)[0])
    table = models.candidate_table(spark, [[b] for b in models.bounds(grams.points, 10)], 2)
    return _rounded(models.mean_scores(models.score_folds(grams, table)))


def _search(spark, sf_dir):
    grams = models.FoldGrams(_train_test(spark, sf_dir)[0])
    return grams, models.sipls_search(grams, 2, 10, COMBINED)


@query(f", {_fold_sql('combos')} select candidate, n_components, fold, {_SCORE_COLUMNS}, cast(null as varchar) as error from log")
def sipls_fold_log(spark, sf_dir):
    return _rounded(_search(spark, sf_dir)[1][2])


@query(f", {_fold_sql('combos')} select candidate, n_components, {_SCORE_COLUMNS} from scores")
def sipls_search(spark, sf_dir):
    """All combinations with their mean scores."""
    return _rounded(models.mean_scores(_search(spark, sf_dir)[1][2]))


@query(f", {_fold_sql('combos')}, {_REFIT} select ry.s as spectrum_id, sample_id, {R('y')} as y, {R('ym + v')} as pred from rpred join ry using (s), rym where not ry.train")
def sipls_refit(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    best, *_ = models.sipls_search(models.FoldGrams(train), 2, 10, COMBINED)
    columns = models.interval_columns(best)
    coef, base = models.fit_pls(train, 2, columns=columns)
    return _rounded(models.predict(test, coef[:, 0], base[0], columns).select("spectrum_id", "sample_id", "y", "pred"))


def _search_moments(spark, sf_dir, chains, split=False):
    """Moments of the chains on the training rows, all in part `fit`, or split by distance on the raw spectra, with the test rows."""
    rows = model_table(spark, sf_dir).select("spectrum_id", "sample_id", "set", "x", "y").where("y is not null")
    if split:
        part = _spxy_parts(rows.where("set = 'Train'"))
        named = F.when(F.col("set") == "Test", "test").when(F.col("part") == "train", "fit").when(F.col("part") == "validation", "held")
        rows = rows.join(part, "sample_id", "left").withColumn("part", named).where("part is not null")
    else:
        rows = rows.where("set = 'Train'").withColumn("part", F.lit("fit"))
    rows, out = settled(rows, "rows"), None
    for steps in chains:
        one = spectral.preprocess_chain(rows, list(steps), "x", F.col("part") == "fit").select(F.lit("+".join(steps) or "none").alias("chain"), "part", "sample_id", "x", F.array("y").alias("ys"))
        out = one if out is None else out.unionByName(one)
    return search.SearchMoments(out)


def _as_text():
    return F.array_join(F.transform("intervals", lambda i: F.concat_ws("-", i["s"], i["e"])), ";").alias("intervals")


@query()
def sipls_grid(spark, sf_dir):
    """The best combination of every cell of component and interval counts, all in one job."""
    cells = search.interval_grid(_search_moments(spark, sf_dir, [[]]), COMPONENTS, INTERVALS, MOST_COMBINED)
    return _rounded(cells.select("n_components", "n_intervals", _as_text(), F.col("r2_sample").alias("r2"), F.col("rmse_sample").alias("rmse"), "candidates", "error"))


@query(f", {_fold_sql('combos')} select candidate as intervals, n_components, cast(10 as int) as n_intervals, {_SCORE_COLUMNS}, cast(55 as bigint) as candidates from scores join combos on combos.c = scores.candidate order by scores.r2_sample desc, o limit 1")
def sipls_grid_cell(spark, sf_dir):
    """One cell of the grid that SQL can follow: two components, ten intervals, up to two combined."""
    cells = search.interval_grid(_search_moments(spark, sf_dir, [[]]), (2,), (10,), COMBINED)
    return _rounded(cells.select(_as_text(), "n_components", "n_intervals", "r2_spectrum", "r2_sample", "rmse_sample", "candidates"))


def _spxy_parts(train):
    """(sample_id, part): the distance split of the sample means of `train`."""
    mean = agg.as_arrays(train.select("sample_id", F.posexplode("x").alias("idx", "x")).groupBy("sample_id", "idx").agg(F.avg("x").alias("x")))
    return splits.spxy_split(mean.join(train.select("sample_id", "y").distinct(), "sample_id")).select("sample_id", "part")


def _spxy(train):
    """Train and validation spectra by the distance split of the sample means."""
    joined = settled(train.join(_spxy_parts(train), "sample_id"), "split")
    return joined.where("part = 'train'"), joined.where("part = 'validation'")


@query()
def refine_intervals(spark, sf_dir):
    """The bounds of two intervals moved by up to 50 points each, one interval after the other, by the error on the validation spectra."""
    log = search.refine_on_held(_search_moments(spark, sf_dir, [[]], split=True), [("none", 2, [(6, 12), (38, 44)])], SHIFT)
    return _rounded(spark.createDataFrame([(x["step"], x["s"], x["e"], x["rmse"], x["moved"]) for x in log], "step int, s int, e int, rmse double, moved boolean"))


@query()
def refine_intervals_cv(spark, sf_dir):
    """All four bounds moved jointly by up to three points, by the mean error of the folds."""
    found, rmse = search.refine_on_folds(_search_moments(spark, sf_dir, [[]]), "none", 2, [(6, 12), (38, 44)], 3)
    return _rounded(spark.createDataFrame([(k, s, e, rmse) for k, (s, e) in enumerate(found)], "k int, s int, e int, rmse double"))


_MOVES = """(select s0 || '-' || e0 || ';' || s1 || '-' || e1 as c, row_number() over (order by s0, e0, s1, e1) as o, s0, e0, s1, e1
  from (select unnest(range(5, 8)) as s0), (select unnest(range(11, 14)) as e0), (select unnest(range(37, 40)) as s1), (select unnest(range(43, 46)) as e1))"""


@query(
    f", {_fold_sql(_MOVES)}, best as (select s0, e0, s1, e1, rmse_sample from scores join {_MOVES} m on m.c = scores.candidate order by rmse_sample, o limit 1) "
    f"select cast(0 as int) as k, cast(s0 as int) as s, cast(e0 as int) as e, {R('rmse_sample')} as rmse from best union all select 1, cast(s1 as int), cast(e1 as int), {R('rmse_sample')} from best"
)
def refine_cell(spark, sf_dir):
    """The joint moves that SQL can follow: four bounds by one point."""
    found, rmse = search.refine_on_folds(_search_moments(spark, sf_dir, [[]]), "none", 2, [(6, 12), (38, 44)], 1)
    return _rounded(spark.createDataFrame([(k, s, e, rmse) for k, (s, e) in enumerate(found)], "k int, s int, e int, rmse double"))


def evaluate(moments, components=COMPONENTS, interval_list=INTERVALS, most=MOST_COMBINED, shift=SHIFT):
    """(chain, stage, intervals, n_components, n, rmse, r2): grid on folds, calibration on the validation samples, refinement, retraining on all, blind test.

    All chains go through each step together; what comes to the driver is one row a chain.
    """
    cells = settled(search.interval_grid(moments, components, interval_list, most), "cells")
    scored = search.held_errors(moments, cells).withColumn("ordinal", F.array_position(F.array(*[F.lit(c) for c in components]), F.col("n_components")) * 1000 + F.col("n_intervals"))
    best = ranking.best_setting(scored, ("chain",), "held_rmse", "ordinal", ("n_components", "n_intervals", "intervals")).collect()
    start = [(r["chain"], r["n_components"], [(i["s"], i["e"]) for i in r["intervals"]]) for r in sorted(best, key=lambda r: r["chain"])]
    refined = {x["chain"]: x["intervals"] for x in search.refine_on_held(moments, start, shift)}
    stages = []
    for chain, c, intervals in start:
        stages += [(chain, "calibration", "fit", "held", c, intervals), (chain, "refined", "fit", "held", c, refined[chain]), (chain, "retrained", "all", "all", c, refined[chain]), (chain, "blind test", "all", "test", c, refined[chain])]
    return search.stage_metrics(moments, stages)


@query()
def sipls_evaluate(spark, sf_dir):
    """Five chains from one distance split to the blind test, over the full grid and shifts."""
    return _rounded(evaluate(_search_moments(spark, sf_dir, SEARCH_CHAINS, split=True)))


@query()
def sipls_multitarget(spark, sf_dir):
    """Intervals from a joint fit of the three targets, then one model each; errors of train and test samples."""
    meta = metadata.drop_missing_target(metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control"))), fx.TARGETS)
    table = metadata.join_metadata(fx.spectra(spark, sf_dir).drop("sample_no").withColumnRenamed("intensity", "x"), meta)
    train = table.where("set = 'Train'")
    best, *_ = models.sipls_search(models.FoldGrams(train, targets=fx.TARGETS), 2, 10, COMBINED)
    columns, out = models.interval_columns(best), None
    for target in fx.TARGETS:
        coef, base = models.fit_pls(train, 2, columns=columns, targets=(target,))
        s = agg.sample_predictions(models.predict(table.withColumn("y", F.col(target)), coef[:, 0], base[0], columns)).withColumn("pred", F.col("pred_mean"))
        part = agg.regression_metrics(s.join(meta.select("sample_id", "set"), "sample_id"), ("set",)).withColumns({"target": F.lit(target), "intervals": F.lit(str(best))})
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


_SPLIT_SQL = tables.ORACLE["spxy_split"]


@query()
def split_log(spark, sf_dir):
    s = tables.spxy_split(spark, sf_dir)
    return s.join(fx.samples(spark, sf_dir), "sample_id").select("sample_id", "part", "pick", "type", r6("target_SI").alias("target_si"))


tables.ORACLE["split_log"] = _SPLIT_SQL.replace("select distinct d.a as sample_id", """, spl as (select distinct d.a as sample_id""", 1).replace("from d, last_", """from d, last_) select spl.sample_id, part, pick, type, round("target_SI", 6) + 0.0 as target_si from spl join samples using (sample_id)""").replace("limit 1)\n    , spl", "limit 1), spl")


# The settings that are tried for each model.
SETTINGS = {
    "pls": [{"components": c} for c in COMPONENTS],
    "forest": [{"numTrees": 100, "maxDepth": 30}, {"numTrees": 200, "maxDepth": 10}],  # 30 is the deepest that Spark's trees go
    "boosted": [{"maxIter": 100, "stepSize": 0.1}, {"maxIter": 200, "stepSize": 0.05}],
    "neighbours": [{"k": 3}, {"k": 7}],
}


def _fitted(kind, train, intervals, settings, every):
    """For each setting of a model a function from rows of `every` to rows with `pred`, fitted on `train`."""
    columns = models.interval_columns(intervals)
    pick = lambda df: metadata.select_intervals(df, intervals, "x").withColumnRenamed("spectrum_id", "id")
    pointed = lambda df: df.withColumn("features", models.points_of(intervals))

    def linear(setting):
        coef, base = models.fit_pls(train, setting["components"], columns=columns)
        return lambda on: models.predict(on, coef[:, 0], base[0], columns)

    def nearest(setting):
        return lambda on: on.join(distances.knn_predict(pick(on), pick(train), setting["k"]).withColumnRenamed("id", "spectrum_id"), "spectrum_id")

    def found(preds):
        return lambda on: on.join(preds, "spectrum_id")

    if kind == "boosted":
        all_settings = trees.boosted(pointed(train), pointed(every), [(s["maxIter"], s["stepSize"]) for s in settings])
        return [found(all_settings.select("spectrum_id", F.col("preds")[k].alias("pred"))) for k in range(len(settings))]
    if kind == "forest":
        return [found(trees.forest(pointed(train), pointed(every), s["numTrees"], s["maxDepth"])) for s in settings]
    return [{"pls": linear, "neighbours": nearest}[kind](s) for s in settings]


def _error(rows):
    """(n, rmse, r2) of the sample means of `rows(sample_id, y, pred)`."""
    return agg.regression_metrics(agg.sample_predictions(rows.select("sample_id", "y", "pred")).withColumn("pred", F.col("pred_mean"))).first()


@query()
def multi_model_eval(spark, sf_dir):
    """The same intervals under each model and setting: errors on validation samples, and, for the best setting of each model, on the blind test.

    Boosted trees are many short jobs, one after the other; the other models are fitted beside them.
    """
    from concurrent.futures import ThreadPoolExecutor

    train, test = _train_test(spark, sf_dir, CHAIN)
    fit, held = _spxy(train)
    test = settled(test, "test")
    every = held.select("spectrum_id", "x").unionByName(test.select("spectrum_id", "x"))
    best, *_ = models.sipls_search(models.FoldGrams(fit), 2, 10, COMBINED)

    def scores(kinds):
        out = {}
        for kind in kinds:
            scored, rows = [], []
            for k, (setting, model) in enumerate(zip(SETTINGS[kind], _fitted(kind, fit, best, SETTINGS[kind], every), strict=True)):
                m = _error(model(held))
                scored.append((m["rmse"], k, model))
                rows.append((kind, str(setting), "validation", m["n"], m["rmse"], m["r2"]))
            _, k, model = min(scored, key=lambda x: x[:2])
            m = _error(model(test))
            out[kind] = [*rows, (kind, str(SETTINGS[kind][k]), "blind test", m["n"], m["rmse"], m["r2"])]
        return out

    with ThreadPoolExecutor(2) as pool:
        boosted, others = pool.map(inheritable_thread_target(spark)(scores), (["boosted"], [k for k in SETTINGS if k != "boosted"]))
    rows = [r for kind in SETTINGS for r in (boosted | others)[kind]]
    return _rounded(spark.createDataFrame(rows, "model string, setting string, stage string, n long, rmse double, r2 double"))


def _trees(spark, sf_dir, kind, **options):
    train, test = _train_test(spark, sf_dir)
    p, importance = models.tree_regression(kind, train, test, models.bounds(fx.POINTS, 16), **options)
    return _rounded(p.select("spectrum_id", "sample_id", "y", "pred", F.lit(int(max(range(16), key=importance.__getitem__))).alias("top_interval")))


@query()
def rf_regress(spark, sf_dir):
    return _trees(spark, sf_dir, "forest", numTrees=20, maxDepth=6)


@query()
def gbt_regress(spark, sf_dir):
    return _trees(spark, sf_dir, "boosted", maxIter=10, maxDepth=3)


# ---- principal components --------------------------------------------------------------------


def _pca(spark, sf_dir):
    table = metadata.join_metadata(spectral.preprocess_chain(fx.spectra(spark, sf_dir).drop("sample_no"), CHAIN), fx.samples(spark, sf_dir)).withColumnRenamed("intensity", "x")
    return table, models.fit_pca(table.where("set = 'Train'"), 3)


tables.ORACLE["snv_pls_metrics"] = fx.SQL + f""", meta as (select sample_id, set, case when type = 'Control' then 0 else "target_SI" end as y from samples where type in ('DM1', 'Control')), {_SNV_ALL},
ry as (select spectrum_id as s, sample_id, y, set = 'Train' as train from spectra join meta using (sample_id) where y is not null),
rm as (select idx, avg(x) as xm from snv_all join ry using (s) where train group by 1), rym as (select avg(y) as ym from ry where train),
rx0 as materialized (select 0 as c, 0 as k, ry.s, idx, x - xm as x, train from snv_all join ry using (s) join rm using (idx)), ry0 as (select 0 as c, 0 as k, s, y - ym as y, train from ry, rym), {pls_sql('r', 2)},
spectrum as (select sample_id, y, ym + v as pred from rpred join ry using (s), rym where not train), sample as (select sample_id, any_value(y) as y, avg(pred) as pred from spectrum group by 1)
select 'spectrum' as level, {tables._METRICS} from spectrum union all select 'sample', {tables._METRICS} from sample"""


@query(f", {_PCA} select s as spectrum_id, sample_id, type, {_PCS} from pc join samples using (sample_id) where set = 'Train'")
def pca_scores(spark, sf_dir):
    table, fitted = _pca(spark, sf_dir)
    return _rounded(models.pca_scores(table.where("set = 'Train'"), fitted).select("spectrum_id", "sample_id", "type", "PC1", "PC2", "PC3"))


@query(f", {_PCA} select distinct cast(j as int) as component, {R('100 * share')} as percent from axes")
def pca_explained(spark, sf_dir):
    _, (_, _, share) = _pca(spark, sf_dir)
    return spark.createDataFrame([(k + 1, round(100 * float(v), 6)) for k, v in enumerate(share)], "component int, percent double")


@query(f", {_PCA} select distinct cast(j as int) as component, {R('100 * share')} as percent from axes")
def pca_wide(spark, sf_dir):
    """Explained variance by passes over the rows, for axes whose matrix is too large."""
    table = spectral.preprocess_chain(fx.spectra(spark, sf_dir).drop("sample_no"), CHAIN)
    train = metadata.join_metadata(table, fx.samples(spark, sf_dir)).where("set = 'Train'").withColumnRenamed("intensity", "x")
    share = wide.fit_pca(settled(train.select("x"), "train"), 3)[2]
    return spark.createDataFrame([(k + 1, round(100 * float(v), 6)) for k, v in enumerate(share)], "component int, percent double")


@query(f", {_PCA} select s as spectrum_id, sample_id, set, type, {R(chr(34) + 'target_SI' + chr(34))} as target_si, {_PCS} from pc join samples using (sample_id)")
def pca_project(spark, sf_dir):
    """Train scores and the projection of the test set, with class and target."""
    table, fitted = _pca(spark, sf_dir)
    return _rounded(models.pca_scores(table, fitted).select("spectrum_id", "sample_id", "set", "type", F.col("target_SI").alias("target_si"), "PC1", "PC2", "PC3"))


@query(f", {_PC_CORR} select n, {R('r')} as r, {R('t')} as t, {R(tables.tail_sql('1', 'df', 'abs(t) / sqrt(df)'))} as p from ct")
def baseline_pc_corr(spark, sf_dir):
    """Correlation of the smoothed baseline mean with the first component."""
    raw = metadata.join_metadata(fx.spectra(spark, sf_dir).drop("sample_no"), fx.samples(spark, sf_dir)).withColumnRenamed("intensity", "x")
    scored = models.pca_scores(raw, models.fit_pca(raw, 1)).withColumn("smooth", spectral.savgol(51, 3, 0)("x"))
    both = scored.select("PC1", spectral.array_mean(F.col("smooth")).alias("baseline"))
    found = agg.correlation(both, "baseline", "PC1").withColumn("df", F.col("n") - 2)
    return _rounded(statistics.with_t_p(found).drop("df"))


# ---- Monte-Carlo validation ------------------------------------------------------------------

# The preprocessing chains of the two jobs, and their numbers of iterations.
MCCV_CHAINS = ([], ["normalize"], ["snv"], ["emsc"], ["second_derivative"], ["normalize", "snv"], ["normalize", "second_derivative"], ["emsc", "second_derivative"], ["snv", "second_derivative"], ["normalize", "emsc"], ["normalize", "emsc", "second_derivative"])
MAP_CHAINS = ([], ["emsc"], ["normalize"], ["snv"], ["second_derivative"], ["emsc", "normalize"], ["emsc", "snv"], ["emsc", "second_derivative"])
MCCV_ITERATIONS, MAP_ITERATIONS = 500, 200


def _validated(spectra, cases, chains, unit, iterations, components=5, job=validation.monte_carlo):
    """Predictions of all cells of chains, cases and iterations, or what another job of them gives; `cases` has a column for each case, null where a spectrum is not in it."""
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in cases]), F.array(*[F.col(c).cast("double") for c in cases]))
    table = spectra.select("spectrum_id", "sample_id", F.col("intensity").alias("x"), F.map_filter(named, lambda k, v: v.isNotNull()).alias("cases"))
    units = table.select(unit, F.explode(F.map_keys("cases")).alias("case")).distinct()
    draws = splits.mc_splits(units, unit, iterations, cases=("case",))
    return job(table, draws, list(chains), unit, components)


def _mccv(spark, sf_dir, iterations=MCCV_ITERATIONS, chains=MCCV_CHAINS, targets=fx.TARGETS, components=5):
    """(preprocessing, target, sample_id, iter, y, prediction): mean prediction of a sample in each iteration that tested it."""
    meta = metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control")))
    joined = metadata.join_metadata(fx.spectra(spark, sf_dir).drop("sample_no"), meta)
    p = _validated(joined, targets, chains, "sample_id", iterations, components)
    return p.groupBy("chain", "case", "sample_id", "iter").agg(F.first("y").alias("y"), F.avg("prediction").alias("prediction")).withColumnsRenamed({"chain": "preprocessing", "case": "target"})


# The cells that SQL can follow: four iterations of three chains, one target, two components.
_CELLS = f"""meta as (select sample_id, case when type = 'Control' then 0 else "target_SI" end as y from samples where type in ('DM1', 'Control')), {_SNV_ALL},
ks as (select unnest(range(0, 4)) as k), units as (select sample_id, y from meta where y is not null),
dr as (select k, sample_id, y, row_number() over (partition by k order by md5(sample_id || '_' || (k + 42)), sample_id) > ceil(0.2 * (select count(*) from units)) as train from units, ks),
raw as (select dr.k, l.spectrum_id as s, sample_id, idx, x, y, train from spectra_long l join dr using (sample_id)),
ref as (select k, idx, avg(x) as r from raw where train group by 1, 2), refm as (select k, avg(r) as rm, sum(r * r) - sum(r) * sum(r) / count(*) as rr from ref group by 1),
line as (select raw.k, s, avg(x) as m, sum(x * (r - rm)) / any_value(rr) as a from raw join ref using (k, idx) join refm on refm.k = raw.k group by 1, 2),
base as (select 'none' as c, k, s, sample_id, idx, x, y, train from raw union all select 'snv', raw.k, raw.s, raw.sample_id, raw.idx, v.x, y, train from raw join snv_all v on v.s = raw.s and v.idx = raw.idx
  union all select 'emsc', raw.k, raw.s, sample_id, idx, (x - m) / a + rm, y, train from raw join line on line.k = raw.k and line.s = raw.s join refm on refm.k = raw.k),
vm as (select c, k, idx, avg(x) as xm, stddev_samp(x) as xs from base where train group by 1, 2, 3),
vy as (select distinct c, k, s, sample_id, y, train from base), vym as (select c, k, avg(y) as ym from vy where train group by 1, 2),
vx0 as materialized (select base.c, base.k, s, base.idx, (x - xm) / xs as x, train from base join vm on vm.c = base.c and vm.k = base.k and vm.idx = base.idx),
vy0 as (select vy.c, vy.k, s, y - ym as y, train from vy join vym on vym.c = vy.c and vym.k = vy.k), {pls_sql('v', 2)},
cells as (select p.c as preprocessing, 'target_SI' as target, sample_id, cast(p.k as int) as iter, any_value(y) as y, avg(ym + v) as prediction from vpred p join vy on vy.c = p.c and vy.k = p.k and vy.s = p.s join vym on vym.c = p.c and vym.k = p.k where not vy.train group by all)"""


def _cells(spark, sf_dir):
    return _mccv(spark, sf_dir, 4, ([], ["snv"], ["emsc"]), ("target_SI",), 2)


@query(f", {_CELLS} select preprocessing, target, sample_id, iter, {R('y')} as y, {R('prediction')} as prediction from cells")
def mccv_cells(spark, sf_dir):
    """The validation job on the few cells that SQL can follow."""
    return _rounded(_cells(spark, sf_dir))


@query(f", {_CELLS}, tested as (select distinct preprocessing, target, sample_id from cells) select t.preprocessing, t.target, t.sample_id, cast(k as int) as iter, {R('prediction')} as prediction from tested t join ks on true left join cells on cells.preprocessing = t.preprocessing and cells.sample_id = t.sample_id and cells.iter = k")
def prediction_matrix(spark, sf_dir):
    """Predictions written as a matrix of samples by iterations for each chain and target, and read again."""
    files.write_matrices(_cells(spark, sf_dir), path := shared_path(spark, "matrices"), ("preprocessing", "target"), "sample_id", "iter", "prediction", 4)
    rows = files.read_matrices(spark, path, "preprocessing string, target string, sample_id string")
    return _rounded(rows.select("preprocessing", "target", "sample_id", F.posexplode("values").alias("iter", "prediction")))


@query()
def mccv_predictions(spark, sf_dir):
    return _rounded(_mccv(spark, sf_dir))


@query()
def mccv_outliers(spark, sf_dir):
    """Mean, deviation, error and flags by sample, with the rank of the error in its chain and target; a sample that no iteration tested has no rank."""
    p = _mccv(spark, sf_dir)
    meta = metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control")))
    known = ranking.unpivot(meta, ("sample_id",), fx.TARGETS, "target", "y").where("y is not null")
    chains = spark.createDataFrame([("+".join(c) or "none",) for c in MCCV_CHAINS], "preprocessing string")
    s = ranking.grid(known, chains).join(agg.mccv_summary(p, ("preprocessing", "target", "sample_id")), ["preprocessing", "target", "sample_id"], "left")
    s = statistics.outlier_flags(s.withColumn("n_tested", F.coalesce("n_tested", F.lit(0))))
    ranked = ranking.top_per_group(s.where("n_tested > 0"), ("preprocessing", "target"), 10, F.desc("abs_error"), "sample_id")
    return _rounded(ranked.unionByName(s.where("n_tested = 0").withColumn("r", F.lit(None).cast("int"))))


@query()
def map_comparison(spark, sf_dir):
    """Error and R2 of repeated spectrum-wise validation for each set of maps and chain, spectra that no iteration tested, and the three-sigma samples."""
    from itertools import combinations

    meta = metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control")), "si_if_null").where("target_SI is not null")
    joined = metadata.join_metadata(fx.spectra(spark, sf_dir).drop("sample_no"), meta)
    sets = [maps for k in (1, 2, 3) for maps in combinations((1, 2, 3), k)]
    cases = {"Map" + "+".join(map(str, maps)): F.when(F.col("map_no").isin(*maps), F.col("target_SI")) for maps in sets}
    per = _validated(joined.withColumns(cases), tuple(cases), MAP_CHAINS, "spectrum_id", MAP_ITERATIONS, job=validation.monte_carlo_summary)
    per = settled(per.withColumnsRenamed({"chain": "preprocessing", "case": "maps"}), "per")
    keys = ("preprocessing", "maps")
    metrics = agg.regression_metrics(per, keys)
    sizes = joined.select(F.explode(F.array(*[F.when(F.col("map_no").isin(*maps), F.lit(name)) for name, maps in zip(cases, sets, strict=True)])).alias("maps")).where("maps is not null").groupBy("maps").agg(F.count("*").alias("spectra"))
    by_sample = per.groupBy(*keys, "sample_id").agg(F.avg("pred_std").alias("pred_std"))
    odd = statistics.sigma_outliers(by_sample, "pred_std", 3, False, keys).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("sample_id")), ",").alias("outliers"))
    out = metrics.join(sizes, "maps").withColumn("untested", F.col("spectra") - F.col("n")).drop("spectra").join(odd, list(keys), "left")
    return _rounded(out.withColumn("outliers", F.coalesce("outliers", F.lit(""))))
