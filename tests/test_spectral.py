import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.functions import spectral, tails
from specspark.operators import aggregates as agg
from specspark.operators import distances, metadata, models, ranking, splits, statistics
from specspark.operators.gram import Moments, pls
from specspark.operators.models import FoldGrams, bounds, candidate_table, mean_scores, score_folds, sipls_search
from specspark.operators.shared import numbered
from specspark.plans import fixtures as fx
from specspark.sources import spectral_files as files


def arrays(df, column):
    return np.array([r[0] for r in df.select(column).collect()])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(180, 20))
    rows = [(i, f"s{i // 9:03d}", x[i].tolist(), float(x[i // 9 * 9 : i // 9 * 9 + 9, 3].mean() * 6 + 0.01 * (i // 9))) for i in range(180)]
    return spark.createDataFrame(rows, "spectrum_id long, sample_id string, x array<double>, y double").persist()


def test_row_functions_have_their_invariants(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 64)).cumsum(axis=1) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [2.0] * 64), (100, [0.0] * 64)], "id long, x array<double>")
    snv = df.select("id", spectral.snv(F.col("x")).alias("v")).collect()
    assert [r["v"] for r in snv if r["id"] >= 99] == [None, None]
    v = np.array([r["v"] for r in snv if r["id"] < 99])
    assert np.allclose(v.mean(axis=1), 0) and np.allclose(v.std(axis=1), 1)
    n = arrays(df.where("id < 99").select(spectral.l2_normalize(F.col("x")).alias("v")), "v")
    assert np.allclose((n**2).sum(axis=1), 1)
    ref = x.mean(axis=0)
    line = spark.createDataFrame([((3 * ref + 2).tolist(),)], "x array<double>")
    assert np.allclose(arrays(line.select(spectral.emsc(F.col("x"), ref).alias("v")), "v")[0], ref)


def test_filters_reproduce_polynomials():
    t = np.arange(64.0)
    assert np.allclose(spectral.savgol_matrix(64, 11, 2, 2) @ (3 * t * t - t + 1), 6)
    assert np.allclose(spectral.savgol_matrix(64, 51, 3, 0) @ (t**3 - 2 * t), t**3 - 2 * t)
    assert np.allclose(spectral.savgol_matrix(64, 11, 2, 2)[20, 15:26] * 429, [15, 6, -1, -6, -9, -10, -9, -6, -1, 6, 15])
    with pytest.raises(ValueError):
        spectral.savgol_matrix(9, 11, 2, 0)


def test_unknown_step_raises_before_any_job(spark):
    with pytest.raises(ValueError, match="unknown"):
        spectral.preprocess_chain(None, ["snv", "nope"])


def plain_pls(x, y, components):
    xm, ym = x.mean(0), y.mean(0)
    xc, yc, ws, ps, qs = x - xm, y - ym, [], [], []
    for _ in range(components):
        w = (xc.T @ yc).sum(axis=1)
        w /= np.linalg.norm(w)
        t = xc @ w
        p, q = xc.T @ t / (t @ t), yc.T @ t / (t @ t)
        xc, yc = xc - np.outer(t, p), yc - np.outer(t, q)
        ws.append(w), ps.append(p), qs.append(q)
    w, p, q = np.array(ws).T, np.array(ps).T, np.array(qs)
    b = w @ np.linalg.inv(p.T @ w) @ q
    return b, ym - xm @ b


@pytest.mark.parametrize("components", [1, 3, 6])
def test_gram_pls_equals_data_pls(spark, table, components):
    coef, base = models.fit_pls(table, components)
    pdf = table.orderBy("spectrum_id").toPandas()
    b, a = plain_pls(np.stack(pdf.x), pdf[["y"]].to_numpy(), components)
    assert np.allclose(coef, b) and np.allclose(base, a)


def test_full_rank_pls_is_least_squares(table):
    coef, base = models.fit_pls(table, 20)
    pdf = table.toPandas()
    x = np.column_stack([np.ones(len(pdf)), np.stack(pdf.x)])
    assert np.allclose(np.concatenate([base, coef[:, 0]]), np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0], atol=1e-6)
    assert np.allclose(models.fit_pls(table, 20, scaled=True)[0], coef, atol=1e-6)


def test_partitioning_does_not_matter(table):
    a, _ = models.fit_pls(table.repartition(7), 2)
    b, _ = models.fit_pls(table.coalesce(1), 2)
    assert np.allclose(a, b)


def test_fold_grams_add_up_and_scores_are_those_of_the_data(spark, table):
    grams = FoldGrams(table)
    pdf = table.toPandas()
    z = np.column_stack([np.ones(len(pdf)), np.stack(pdf.x), pdf.y])
    assert np.allclose(sum(grams.spectra.values()), z.T @ z)
    combo = [(2, 6), (10, 12)]
    got = {r["fold"]: r for r in score_folds(grams, candidate_table(spark, [combo], 2)).collect()}
    folds = {r[0]: r[1] for r in splits.group_folds(table).collect()}
    pdf["fold"] = pdf.sample_id.map(folds)
    cols = models.interval_columns(combo)
    for k, r in got.items():
        tr, te = pdf[pdf.fold != k], pdf[pdf.fold == k]
        b, a = plain_pls(np.stack(tr.x)[:, cols], tr[["y"]].to_numpy(), 2)
        p = (np.stack(te.x)[:, cols] @ b + a)[:, 0]
        assert np.isclose(r["r2_spectrum"], 1 - ((te.y - p) ** 2).sum() / ((te.y - te.y.mean()) ** 2).sum())
        s = te.assign(p=p).groupby("sample_id")[["y", "p"]].mean()
        assert np.isclose(r["r2_sample"], 1 - ((s.y - s.p) ** 2).sum() / ((s.y - s.y.mean()) ** 2).sum())


def test_too_narrow_candidates_have_an_error(spark, table):
    scored = score_folds(FoldGrams(table), candidate_table(spark, [[(0, 2)]], 5))
    assert {r["error"] for r in scored.collect()} == {"fewer points than components"} and mean_scores(scored).count() == 0


def test_search_finds_the_interval_that_carries_the_signal(spark, table):
    best, score, _ = sipls_search(FoldGrams(table), 1, 10, 2)
    assert (2, 4) in best


def brute_spxy(ids, x, y, n_train, scaled=False):
    dx, dy = np.linalg.norm(x[:, None] - x[None], axis=-1), np.abs(y[:, None] - y[None])
    d = dx / dx.max() + dy / dy.max() if scaled else dx + dy
    picked = [min(range(len(ids)), key=lambda i: (-round(d[i].max(), 9), ids[i]))]
    while len(picked) < n_train:
        picked.append(min((i for i in range(len(ids)) if i not in picked), key=lambda i: (-round(d[i, picked].min(), 9), ids[i])))
    return {ids[i]: (("train", picked.index(i)) if i in picked else ("validation", None)) for i in range(len(ids))}


@pytest.mark.parametrize("candidates", [2, 5, 64])
@pytest.mark.parametrize("scaled", [False, True])
def test_spxy_is_the_greedy_split(spark, monkeypatch, candidates, scaled):
    monkeypatch.setattr(splits, "CANDIDATES", candidates)
    monkeypatch.setattr(distances, "BLOCK", 6)
    monkeypatch.setattr(distances, "PIVOTS", 3)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(21, 4)), rng.normal(size=21)
    x[5], y[5] = x[6], y[6]  # a tie
    ids = [f"s{i:02d}" for i in rng.permutation(21)]
    df = spark.createDataFrame([(ids[i], x[i].tolist(), float(y[i])) for i in range(21)], "sample_id string, x array<double>, y double")
    got = {r[0]: (r[1], r[2]) for r in splits.spxy_split(df, scaled=scaled).collect()}
    assert got == brute_spxy(ids, x, y, 16, scaled)


def test_positions_and_quantiles(spark):
    rng = np.random.default_rng(7)
    values = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(f"k{i % 3}", float(v), i) for i, v in enumerate(values)] + [("k0", None, 999), ("one", 5.0, 1000)], "k string, v double, i long").repartition(6)
    got = [r["position"] for r in numbered(df, "i").orderBy("i").collect()]
    assert got == list(range(502))
    assert numbered(df.limit(0), "i").count() == 0
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.75, "e": 1.0}
    for r in agg.quantiles(df, ("k",), "v", shares).collect():
        own = [5.0] if r["k"] == "one" else values[int(r["k"][1]) :: 3]
        assert np.allclose([r[n] for n in shares], np.quantile(own, list(shares.values())))


def test_statistics_have_p_and_decisions(spark):
    rows = [("m", g, float(v)) for g, base in (("a", 0), ("b", 1), ("c", 8)) for v in (base - 1, base, base + 1, base + 2, base - 2)]
    df = spark.createDataFrame(rows, "metric string, map string, value double")
    t = {(r["a"], r["b"]): r for r in statistics.with_bonferroni(statistics.pairwise_t(df)).collect()}
    # two groups of five with variance 2.5: t = 1 for a difference of 1, with 8 degrees of freedom
    assert np.isclose(abs(t["a", "b"]["t"]), 1) and abs(t["a", "b"]["p"] - 0.34659351) < 1e-7 and np.isclose(t["a", "b"]["p_bonferroni"], 3 * t["a", "b"]["p"])
    tukey = {(r["a"], r["b"]): r for r in statistics.with_tukey_interval(statistics.tukey_hsd(df)).collect()}
    half = 3.7729 * np.sqrt(2.5 / 5)  # critical value of 3 groups and 12 degrees of freedom
    assert not tukey["a", "b"]["reject"] and tukey["a", "c"]["reject"]
    assert abs(tukey["a", "c"]["lower"] - (8 - half)) < 5e-3 and abs(tukey["a", "c"]["upper"] - (8 + half)) < 5e-3
    f = statistics.with_f_p(statistics.anova_f(df)).first()
    assert np.isclose(f["f"], 38) and (f["df_between"], f["df_within"]) == (2, 12) and f["p"] < 1e-5


def test_pca_scores_are_centred_with_eigenvalue_variance(table):
    mean, axes, share = models.fit_pca(table, 3)
    s = np.array([list(r) for r in models.pca_scores(table, (mean, axes, share)).select("PC1", "PC2", "PC3").collect()])
    total = np.stack(table.toPandas().x).var(axis=0, ddof=1).sum()
    assert np.allclose(s.mean(0), 0) and np.allclose(s.var(0, ddof=1), share * total)


def test_distances_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 4)
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(11, 3)), rng.normal(size=11)
    df = spark.createDataFrame([(f"s{i:02d}", x[i].tolist(), float(y[i])) for i in range(11)], "sample_id string, x array<double>, y double")
    got = distances.pairwise_distance(df).collect()
    assert len(got) == 55
    for r in got:
        i, j = int(r["a"][1:]), int(r["b"][1:])
        assert np.isclose(r["d"], np.linalg.norm(x[i] - x[j]) + abs(y[i] - y[j]))
    close = distances.pairwise_distance(df, within=2.0).collect()
    assert sorted((r["a"], r["b"]) for r in close) == sorted((r["a"], r["b"]) for r in got if r["d"] <= 2.0) != []
    ids = df.withColumnRenamed("sample_id", "id")
    near = distances.knn_predict(ids, ids, 3).collect()
    for r in near:
        i = int(r["id"][1:])
        assert np.isclose(r["pred"], y[np.argsort(np.linalg.norm(x - x[i], axis=1))[:3]].mean())


def clustered(spark, n, points, seed=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, points))[rng.integers(0, 12, n)] * 20 + rng.normal(size=(n, points)) + 100
    x[n // 2] = x[0]  # a tie
    y = rng.normal(size=n)
    rows = [(f"s{i:05d}", x[i].tolist(), float(y[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "sample_id string, x array<double>, y double")


@pytest.mark.parametrize(("n", "points"), [(400, 7), (60, 1731)])
def test_neighbours_and_farthest_of_clusters(spark, monkeypatch, n, points):
    monkeypatch.setattr(distances, "BLOCK", 16)
    x, y, df = clustered(spark, n, points)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) if points < 10 else np.array([np.linalg.norm(x - v, axis=1) for v in x])
    ids = df.withColumnRenamed("sample_id", "id")
    got = {(r["id"], r["r"]): r["neighbour"] for r in distances.nearest_neighbours(ids, ids, 4).collect()}
    for i in range(n):
        want = sorted(range(n), key=lambda j: (round(d[i, j], 9), j))[:4]  # noqa: B023
        assert [got[f"s{i:05d}", r] for r in range(1, 5)] == [f"s{j:05d}" for j in want]
    blocks = distances.blocks_of(ids)
    pairs = distances._bounds(blocks, blocks, False).withColumn("k", F.when(F.col("near") > 0, 1).otherwise(0)).agg(F.sum("k"), F.count("*")).first()
    assert points > 10 or pairs[0] > pairs[1] / 2  # most pairs of blocks have a bound that tells them apart
    total = d + np.abs(y[:, None] - y[None])
    far = {r["sample_id"]: r["d"] for r in distances.farthest(blocks).collect()}
    i, j = np.unravel_index(total.argmax(), total.shape)
    assert set(far) == {f"s{i:05d}", f"s{j:05d}"} and np.allclose(list(far.values()), total.max())


def test_spxy_of_clusters_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(distances, "BLOCK", 32)
    monkeypatch.setattr(splits, "CANDIDATES", 40)
    x, y, df = clustered(spark, 200, 5)
    got = {r[0]: (r[1], r[2]) for r in splits.spxy_split(df).collect()}
    assert got == brute_spxy([f"s{i:05d}" for i in range(200)], x, y, 160)


def test_distances_of_no_or_undefined_rows(spark):
    empty = spark.createDataFrame([], "sample_id string, x array<double>, y double")
    assert splits.spxy_split(empty).count() == 0 and distances.pairwise_distance(empty).count() == 0
    some = spark.createDataFrame([("a", [0.0, 1.0], 0.0), ("b", None, 1.0), ("c", [3.0, 5.0], 1.0), ("d", [3.0, 4.0], 2.0)], "sample_id string, x array<double>, y double")
    got = {r[0]: r[2] for r in splits.spxy_split(some, 0.7).collect()}
    assert got["b"] is None and sorted(v for v in got.values() if v is not None) == [0, 1]
    ids = some.withColumnRenamed("sample_id", "id")
    assert {r["id"] for r in distances.nearest_neighbours(ids, ids, 2).collect()} == {"a", "c", "d"}


def test_files_are_scanned_or_rejected(spark, tmp_path):
    head = "axis\t1\t2\t3\t4\t5"
    row = "x\t1.5\t2\t3\t4\t5"
    for name, body in {
        "DM1_001_Map1_a_01.txt": [head, row, row, row],
        "DM1_001_Map2_a_01.txt": [head, "", row, row, "  ", row],
        "DM1_002_Map1_a_01.txt": [head, row, row],
        "AdCo_003_Map1_a_01.txt": [head, row, row, "x\t1\t2"],
        "AdCo_004_Map1_a_01.txt": [head, row, row, "x\t1\t2\tbad\t4\t5"],
    }.items():
        (tmp_path / name).write_text("\n".join(body) + "\n")
    texts = files.read_texts(spark, str(tmp_path))
    assert files.scan_spectra(texts, 5).count() == 6
    assert {r[0].split("_Map")[0]: r[1] for r in files.rejected_files(texts, 5).collect()} == {"DM1_002": "wrong number of rows", "AdCo_003": "wrong number of points", "AdCo_004": "not a number"}
    assert files.scan_spectra(texts, strict=False).count() == 3 + 3 + 2 + 3
    assert [r["wavenumber"] for r in files.wavenumber_axis(texts, 5).orderBy("idx").collect()] == [1, 2, 3, 4, 5]
    assert files.parse_map_files(texts).count() == 5
    with pytest.raises(ValueError):
        files.spectra_for_maps(files.parse_map_files(texts), [3])


def test_metadata_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿Sample_ID,Type,age,sex,a,b,c\n007,Control,,F,,,\nDM1_1,DM1,40,M,0.5,60,70\n".encode())
    got = {r["sample_id"]: r for r in files.scan_metadata(spark, str(tmp_path / "m.csv")).collect()}
    assert got["007"]["age"] is None and got["DM1_1"]["target_SI"] == 0.5


def test_write_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "target string, v double")
    files.write_table(df, str(tmp_path / "t"), ("target",))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("target", "v").collect())) == [("a", 1.0), ("b", 2.0)]


def test_guards(spark):
    empty = spark.createDataFrame([], "sample_id string, file_name string")
    with pytest.raises(ValueError):
        metadata.semi_join_valid(empty, empty)
    with pytest.raises(ValueError):
        metadata.alignment_check(empty, empty)
    with pytest.raises(ValueError):
        ranking.joint_shift_grid([(0, 5)] * 4, 20, 63)
    assert bounds(10, 3) == [(0, 3), (3, 6), (6, 10)]


def test_theta_and_key_substring_joins_agree(spark):
    f = fx.spectra(spark, "/root/testdata/sf0.001").select("file_name").distinct()
    ids = fx.samples(spark, "/root/testdata/sf0.001").where("type = 'DM1'")
    assert metadata.substring_join(f, ids).count() == metadata.substring_join(f, ids, theta=True).count() > 0


def test_substring_join_finds_ids_that_begin_other_ids(spark):
    names = ["S_10001_Map1_x.txt", "S_2000_Map1_x.txt", "S_20001_Map1_x.txt", "copy of S_1000_x.txt", "S", None]
    files, ids = spark.createDataFrame([(n,) for n in names], "file_name string"), spark.createDataFrame([("S_1000",), ("S_20001",), (None,)], "sample_id string")
    want = ["S_10001_Map1_x.txt", "S_20001_Map1_x.txt", "copy of S_1000_x.txt"]
    assert sorted(r[0] for r in metadata.substring_join(files, ids).collect()) == want
    assert sorted(r[0] for r in metadata.substring_join(files, ids, theta=True).collect()) == want
    assert metadata.substring_join(files, ids.where("false")).count() == 0
    assert metadata.substring_join(files, spark.createDataFrame([("",)], "sample_id string")).count() == 5


def test_pairs_of_two_blocks_come_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(f"S_{k:03d}", rng.normal(size=6).tolist(), float(k % 7)) for k in range(90)]
    df = spark.createDataFrame(rows, "sample_id string, x array<double>, y double")
    monkeypatch.setattr(distances, "PAIRS", 500)
    got = {(r["a"], r["b"]): r["dx"] for r in distances.pairwise_distance(df).collect()}
    x = {r[0]: np.array(r[1]) for r in rows}
    assert len(got) == 90 * 89 // 2
    assert all(abs(d - np.linalg.norm(x[a] - x[b])) < 1e-9 for (a, b), d in got.items())


def test_tails():
    assert abs(tails.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(tails.f_upper(4.0, 2, 20) - 0.03457161) < 1e-7
    assert abs(tails.kolmogorov(0.3, 50, 50) - 0.02222) < 1e-3
    assert abs(tails.studentised_range_critical(0.05, 3, 20) - 3.578) < 5e-3
    assert abs(tails.studentised_range_critical(0.05, 3, 10_000) - 3.314) < 5e-3


def test_pls_of_constant_columns():
    z = np.column_stack([np.ones(6), np.ones(6), np.arange(6.0), np.arange(6.0) * 2])
    coef, base = pls(Moments(z.T @ z), 2)
    assert np.allclose(coef[:, 0], [0, 2]) and np.allclose(base, 0)


def test_a_deep_forest_is_grown_in_groups_of_trees(table, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor

    grown, fit = [], RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, *a: grown.append((self.getNumTrees(), self.getSeed())) or fit(self, *a))
    rows = table.withColumn("x", F.when(F.col("spectrum_id") != 7, F.col("x")))
    forest = lambda **o: models.tree_regression("forest", rows, rows, [(0, 5), (10, 20)], maxDepth=30, **o)
    forest(numTrees=6)
    assert grown == [(6, 42)]
    monkeypatch.setattr(models, "TREE_NODES", 800)  # a tree of 179 rows has 358 nodes at most
    found, importance = forest(numTrees=5)
    assert grown[1:] == [(2, 42), (2, 43), (1, 44)] and np.isclose(sum(importance), 1) and len(importance) == 2
    got = {r["spectrum_id"]: r["pred"] for r in found.collect()}
    assert set(got) == set(range(180)) - {7} and set(found.columns) == {*rows.columns, "pred"}
    vectors = models._features(rows.where("x is not null"), [(0, 5), (10, 20)])
    total = np.zeros(180)
    for trees, seed in grown[1:]:
        one = fit(RandomForestRegressor(labelCol="y", numTrees=trees, seed=seed, maxDepth=30, featureSubsetStrategy="onethird"), vectors.select("features", "y").coalesce(1))
        for r in one.transform(vectors).collect():
            total[r["spectrum_id"]] += trees * r["prediction"] / 5
    assert all(np.isclose(v, total[k]) for k, v in got.items())


def test_chain_of_filters_is_one_python_pass_with_the_same_result(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 64)).cumsum(axis=1) + 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, [0.0] * 64), (91, None), (92, rng.normal(size=70).tolist()), (93, [float(k * k) for k in range(64)])]
    df = spark.createDataFrame(rows, "id long, intensity array<double>").coalesce(1)
    raw = {r["id"]: r["intensity"] for r in df.collect()}
    for steps in (["baseline", "snv", "baseline", "second_derivative"], ["baseline", "normalize", "second_derivative"], ["normalize", "baseline", "snv", "second_derivative", "emsc", "baseline"]):
        step_by_step = df
        for step in steps:  # one step at a time: each filter by itself
            step_by_step = spectral.preprocess_chain(step_by_step, [step])
        whole = spectral.preprocess_chain(df, steps)
        want = {r["id"]: r["intensity"] for r in step_by_step.collect()}
        got = {r["id"]: r["intensity"] for r in whole.collect()}
        assert set(got) == set(raw) and got[91] is None
        for k in raw:
            assert (got[k] is None) == (want[k] is None), (steps, k)
            assert got[k] is None or np.allclose(got[k], want[k], atol=1e-9), (steps, k)
    one = spectral.preprocess_chain(df, ["baseline", "snv", "baseline", "second_derivative"])._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("ArrowEvalPython") == 1
    block = spectral.BLOCK
    spectral.BLOCK = 200  # blocks of a few spectra, in this process
    try:
        import pyarrow as pa

        f = spectral.savgol(11, 2, 2).func
        (out,) = f(iter([pa.array([raw[k] for k in raw], pa.list_(pa.float64())).slice(3)]))
        for k, y in zip(list(raw)[3:], out.to_pylist(), strict=True):
            assert y is None if raw[k] is None else np.allclose(y, spectral.savgol_matrix(len(raw[k]), 11, 2, 2) @ raw[k])
    finally:
        spectral.BLOCK = block
