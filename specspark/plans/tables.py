"""Queries of the sources, relational, statistical and spectral operators, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from specspark.functions import spectral, tails
from specspark.functions.spectral import savgol_matrix
from specspark.operators import aggregates as agg
from specspark.operators import distances, metadata, ranking, splits, statistics
from specspark.operators.shared import shared_path
from specspark.plans import fixtures as fx
from specspark.plans.fixtures import r6
from specspark.sources import spectral_files as files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, prelude: bool = True):
    """Register a function of (spark, sf_dir) under its name, with the SQL that follows the fixtures."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = (fx.SQL if prelude else "") + sql
        return f

    return add


def R(x: str) -> str:  # noqa: N802
    return f"round({x}, 6) + 0.0"


def long_of(df, *keys):
    """Array column `intensity` as one row a point, rounded."""
    return df.select(*keys, F.posexplode("intensity").alias("idx", "x")).select(*keys, "idx", r6("x").alias("x"))


def map_texts(spark, sf_dir):
    """(file_name, content): a spectral text file for each sample and map, made from the spectra."""
    s = fx.spectra(spark, sf_dir)
    head = fx.axis(spark, sf_dir).agg(F.concat_ws("\t", F.array_sort(F.collect_list(F.struct("idx", "wavenumber")))["wavenumber"].cast("array<string>")).alias("head"))
    rows = s.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("rep_no", F.concat_ws("\t", F.col("intensity").cast("array<string>")).alias("row")))).alias("rows"))
    line = F.concat_ws("\n", F.transform("rows", lambda r: F.concat(F.lit("x\t"), r["row"])))
    return rows.join(head).select("file_name", F.concat(F.lit("axis\t"), "head", F.lit("\n\n"), line, F.lit("\n")).alias("content"))


# ---- sources -----------------------------------------------------------------------


@query("select file_name, sample_id, rep_no, idx, round(x, 6) + 0.0 as x from spectra_long join (select spectrum_id, file_name from spectra) using (spectrum_id) where file_name in (select file_name from spectra group by 1 having count(*) = 3)")
def scan_spectra(spark, sf_dir):
    return long_of(files.scan_spectra(map_texts(spark, sf_dir)), "file_name", "sample_id", "rep_no")


@query("select file_name, 'wrong number of rows' as reason from spectra group by 1 having count(*) <> 3")
def scan_rejects(spark, sf_dir):
    return files.rejected_files(map_texts(spark, sf_dir))


def written_texts(spark, sf_dir):
    """(file_name, content) of real files: those of `map_texts`, some with a cell that is no number, written one by one and read again."""
    texts = map_texts(spark, sf_dir)
    bad = F.col("file_name").rlike("4_Map2_x[.]txt$")
    files.write_texts(texts.withColumn("content", F.when(bad, F.regexp_replace("content", r"\t[^\t\n]*\n$", "\tbad\n")).otherwise(F.col("content"))), path := shared_path(spark, "texts"))
    return files.read_texts(spark, path)


_FILE_ROWS = "select file_name, sample_id, rep_no, idx, round(x, 6) + 0.0 as x from spectra_long join (select spectrum_id, file_name from spectra) using (spectrum_id) where not ends_with(file_name, '4_Map2_x.txt')"


@query(f"{_FILE_ROWS} and file_name in (select file_name from spectra group by 1 having count(*) = 3)")
def scan_files(spark, sf_dir):
    """The strict scan of files on disk."""
    return long_of(files.scan_spectra(written_texts(spark, sf_dir), fx.POINTS), "file_name", "sample_id", "rep_no")


@query(_FILE_ROWS.replace("rep_no, idx", "cast(row_number() over (partition by file_name, idx order by rep_no) as int) as rep_no, idx"))
def scan_files_lenient(spark, sf_dir):
    """The lenient scan of the same files: any number of spectra in a file."""
    return long_of(files.scan_spectra(written_texts(spark, sf_dir), strict=False), "file_name", "sample_id", "rep_no")


@query("select file_name, strict, case when strict and n <> 3 then 'wrong number of rows' else 'not a number' end as reason from (select file_name, count(*) as n from spectra group by 1), (select unnest([true, false]) as strict) where (strict and n <> 3) or ends_with(file_name, '4_Map2_x.txt')")
def reject_files(spark, sf_dir):
    """Files on disk that the strict and the lenient scan reject."""
    texts = written_texts(spark, sf_dir)
    sides = [files.rejected_files(texts, fx.POINTS if strict else None, strict).withColumn("strict", F.lit(strict)) for strict in (True, False)]
    return sides[0].unionByName(sides[1]).select("file_name", "strict", "reason")


@query("select idx, wavenumber, cast(1 as bigint) as n_axes from axis")
def wavenumber_axis(spark, sf_dir):
    return files.wavenumber_axis(map_texts(spark, sf_dir))


@query(f'select sample_id, type, age, sex, {R(chr(34) + "target_SI" + chr(34))} as si, {R(chr(34) + "HGS_pp_avg" + chr(34))} as hgs, {R(chr(34) + "ADF_pp_avg" + chr(34))} as adf from samples')
def scan_metadata(spark, sf_dir):
    """The metadata written as CSV into the shared folder and scanned."""
    path = shared_path(spark, "metadata")
    fx.samples(spark, sf_dir).select(*files.METADATA.names).write.option("header", True).csv(path)
    return files.scan_metadata(spark, path).select("sample_id", "type", "age", "sex", r6("target_SI").alias("si"), r6("HGS_pp_avg").alias("hgs"), r6("ADF_pp_avg").alias("adf"))


@query("select cast(row_number() over (order by sample_no) - 1 as varchar) as sample_id, sample_no from samples")
def number_rows(spark, sf_dir):
    return files.number_rows(fx.samples(spark, sf_dir), "sample_no").select("sample_id", "sample_no")


@query("select distinct file_name, split_part(file_name, '_', 1) || '_' || split_part(file_name, '_', 2) as sample_id from spectra")
def file_sample_key(spark, sf_dir):
    return fx.spectra(spark, sf_dir).select("file_name", files.sample_key(F.col("file_name")).alias("sample_id")).distinct()


@query("select sample_id, string_agg(file_name, ',' order by file_name) as files from (select distinct sample_id, file_name from spectra) group by 1")
def group_files(spark, sf_dir):
    return files.group_files(fx.spectra(spark, sf_dir)).select("sample_id", F.array_join("files", ",").alias("files"))


@query("select distinct sample_id, map_no, file_name from spectra")
def parse_map_files(spark, sf_dir):
    return files.parse_map_files(fx.spectra(spark, sf_dir).select("file_name").distinct(), r"^(S_\d+)_Map(\d)_")


@query("select spectrum_id, sample_id, map_no, rep_no, file_name, len(intensity) as n_points, round(list_sum(intensity), 6) + 0.0 as total from spectra")
def load_spectra(spark, sf_dir):
    s = fx.spectra(spark, sf_dir)
    return s.select("spectrum_id", "sample_id", "map_no", "rep_no", "file_name", F.size("intensity").cast("long").alias("n_points"), r6(spectral.array_sum(F.col("intensity"))).alias("total"))


@query("select spectrum_id, sample_id, 'Map' || map_no as map from spectra where map_no in (1, 3)")
def spectra_for_maps(spark, sf_dir):
    return files.spectra_for_maps(fx.spectra(spark, sf_dir), [1, 3]).select("spectrum_id", "sample_id", "map")


@query("select sample_id, type, 'all' as origin from samples union all select sample_id, type, 'test' from samples where set = 'Test'")
def combine_datasets(spark, sf_dir):
    m = fx.samples(spark, sf_dir)
    return files.combine([m.withColumn("origin", F.lit("all")), m.where("set = 'Test'").withColumn("origin", F.lit("test"))]).select("sample_id", "type", "origin")


# ---- projections, filters ------------------------------------------------------------


@query("select sample_id, type from samples where type in ('DM1', 'Control')")
def filter_type(spark, sf_dir):
    return metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control")).select("sample_id", "type")


@query("select sample_id, case when type = 'Control' then 'AdCo_' else 'DM1_' end || split_part(sample_id, '_', 2) as file_prefix from samples")
def file_prefix(spark, sf_dir):
    return metadata.file_prefix(fx.samples(spark, sf_dir)).select("sample_id", "file_prefix")


@query(
    """select 'all' as rule, sample_id, round(case when type = 'Control' then 0 else "target_SI" end, 6) + 0.0 as si, round(case when type = 'Control' then 100 else "HGS_pp_avg" end, 6) + 0.0 as hgs, round(case when type = 'Control' then 100 else "ADF_pp_avg" end, 6) + 0.0 as adf from samples
    union all select rule, sample_id, round(case when type = 'Control' then 0 else "target_SI" end, 6) + 0.0, round("HGS_pp_avg", 6) + 0.0, round("ADF_pp_avg", 6) + 0.0 from samples, (values ('si'), ('si_if_null')) r(rule)"""
)
def impute_controls(spark, sf_dir):
    m, out = fx.samples(spark, sf_dir), None
    for rule in ("all", "si", "si_if_null"):
        part = metadata.impute_controls(m, rule).select(F.lit(rule).alias("rule"), "sample_id", r6("target_SI").alias("si"), r6("HGS_pp_avg").alias("hgs"), r6("ADF_pp_avg").alias("adf"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""select sample_id from samples where case when type = 'Control' then 100 else "ADF_pp_avg" end is not null""")
def drop_missing_target(spark, sf_dir):
    return metadata.drop_missing_target(metadata.impute_controls(fx.samples(spark, sf_dir))).select("sample_id")


@query("select sample_id, cast(age as double) as score from samples where sample_no % 5 <> 0")
def coerce_numeric(spark, sf_dir):
    m = fx.samples(spark, sf_dir).select("sample_id", F.when(F.col("sample_no") % 5 == 0, "n/a").otherwise(F.col("age").cast("string")).alias("score"))
    return metadata.coerce_numeric(m, "score")


@query("select spectrum_id, sample_id from spectra where sample_id in (select sample_id from spectra group by 1 having count(*) = 9)")
def complete_samples(spark, sf_dir):
    return metadata.complete_samples(fx.spectra(spark, sf_dir)).select("spectrum_id", "sample_id")


@query("select spectrum_id, idx, wavenumber, round(x, 6) + 0.0 as x from spectra_long join axis using (idx) where wavenumber <= 1000 or wavenumber >= 2400")
def region_mask(spark, sf_dir):
    return metadata.region_mask(fx.spectra_long(spark, sf_dir), fx.axis(spark, sf_dir), 1000.0, 2400.0).select("spectrum_id", "idx", "wavenumber", r6("x").alias("x"))


@query("select spectrum_id, cast(case when idx < 12 then idx - 6 else idx - 38 + 6 end as int) as idx, round(x, 6) + 0.0 as x from spectra_long where (idx >= 6 and idx < 12) or (idx >= 38 and idx < 44)")
def select_intervals(spark, sf_dir):
    return long_of(metadata.select_intervals(fx.spectra(spark, sf_dir), [(6, 12), (38, 44)]), "spectrum_id")


@query("select sample_id, b.bound, cast((select arg_min(idx, row(abs(wavenumber - b.bound), idx)) from axis) as int) as idx from (select sample_id, 500 + 50.0 * age as bound from samples) b")
def nearest_wavenumber(spark, sf_dir):
    bounds = fx.samples(spark, sf_dir).select("sample_id", (500 + 50.0 * F.col("age")).alias("bound"))
    near = metadata.nearest_wavenumber(bounds.select("bound").distinct(), fx.axis(spark, sf_dir))
    return bounds.join(near, "bound").select("sample_id", "bound", "idx")


_INTERVALS = "intervals as (select cast(i as int) as i, cast(i * p // 16 as int) as s, cast((i + 1) * p // 16 as int) as e from (select count(*) as p from axis), (select unnest(range(0, 16)) as i))"


def _intervals(spark, sf_dir):
    return ranking.uniform_intervals(fx.axis(spark, sf_dir).agg(F.count("*").alias("p")), 16)


@query(f", {_INTERVALS} select i, s, e from intervals")
def uniform_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir)


@query(f", {_INTERVALS} select i, s, e, a.wavenumber as from_wavenumber, b.wavenumber as to_wavenumber from intervals join axis a on a.idx = s join axis b on b.idx = e - 1")
def interval_labels(spark, sf_dir):
    return metadata.interval_labels(_intervals(spark, sf_dir), fx.axis(spark, sf_dir)).select("i", "s", "e", "from_wavenumber", "to_wavenumber")


@query("select sample_id, set as part, 'snv' as preprocessing, 'reference' as origin from samples")
def tag_sets(spark, sf_dir):
    return metadata.tag(fx.samples(spark, sf_dir).withColumnRenamed("set", "part"), preprocessing="snv", origin="reference").select("sample_id", "part", "preprocessing", "origin")


@query("select distinct file_name, regexp_replace(regexp_replace(lower(file_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name from spectra")
def safe_names(spark, sf_dir):
    return fx.spectra(spark, sf_dir).select("file_name", metadata.safe_name(F.col("file_name")).alias("name")).distinct()


@query("select (select count(*) from spectra) as n_spectra, (select count(*) from samples) as n_samples, (select count(*) from spectra where sample_id not in (select sample_id from samples)) as n_unlabelled, (select count(*) from samples where sample_id not in (select sample_id from spectra)) as n_without_spectra")
def alignment_check(spark, sf_dir):
    return metadata.alignment_check(fx.spectra(spark, sf_dir), fx.samples(spark, sf_dir))


# ---- joins ---------------------------------------------------------------------------


@query("select spectrum_id, sample_id, type, set from spectra join samples using (sample_id)")
def join_metadata(spark, sf_dir):
    return metadata.join_metadata(fx.spectra(spark, sf_dir), fx.samples(spark, sf_dir).drop("sample_no")).select("spectrum_id", "sample_id", "type", "set")


@query("select distinct sample_id, file_name from spectra where sample_id in (select sample_id from samples where type = 'DM1')")
def semi_join_valid(spark, sf_dir):
    return metadata.semi_join_valid(fx.spectra(spark, sf_dir).select("sample_id", "file_name").distinct(), fx.samples(spark, sf_dir).where("type = 'DM1'"))


@query("select distinct file_name from spectra where exists (select 1 from samples where type <> 'DM2' and contains(file_name, samples.sample_id))")
def substring_join(spark, sf_dir):
    return metadata.substring_join(fx.spectra(spark, sf_dir).select("file_name").distinct(), fx.samples(spark, sf_dir).where("type <> 'DM2'"))


@query("select distinct file_name from (select distinct replace(file_name, 'S_', 'copy of S_') as file_name from spectra) f where exists (select 1 from samples where type <> 'DM2' and contains(f.file_name, samples.sample_id))")
def substring_theta_join(spark, sf_dir):
    """Files whose name holds the id of a sample anywhere, not only at its start."""
    names = fx.spectra(spark, sf_dir).select(F.regexp_replace("file_name", "S_", "copy of S_").alias("file_name")).distinct()
    return metadata.substring_join(names, fx.samples(spark, sf_dir).where("type <> 'DM2'"))


@query("select spectrum_id, case when sample_id in (select sample_id from samples where set = 'Train') then 'train' else 'validation' end as part from spectra")
def split_membership(spark, sf_dir):
    return metadata.split_membership(fx.spectra(spark, sf_dir), fx.samples(spark, sf_dir).where("set = 'Train'")).select("spectrum_id", "part")


@query("select sample_id from spectra where map_no in (1, 2, 3) group by 1 having count(distinct map_no) = 3")
def samples_with_all_maps(spark, sf_dir):
    return metadata.samples_with_all_maps(fx.spectra(spark, sf_dir), [1, 2, 3])


@query("""select spectrum_id, sample_id, map_no, round("target_SI", 6) + 0.0 as y from spectra join samples using (sample_id) where map_no in (1, 2) and "target_SI" is not null""")
def expand_labels(spark, sf_dir):
    return metadata.expand_labels(fx.spectra(spark, sf_dir), fx.samples(spark, sf_dir), "target_SI", [1, 2]).withColumn("y", r6("y"))


_XY = """xy as (select sample_id, idx, avg(x) as x, any_value(case when type = 'Control' then 0 else "target_SI" end) as y from spectra_long join samples using (sample_id) where type in ('DM1', 'Control') group by 1, 2)"""


def sample_xy(spark, sf_dir, where="true"):
    """(sample_id, x, y): mean spectrum and imputed target of the modelled samples."""
    meta = metadata.impute_controls(metadata.filter_type(fx.samples(spark, sf_dir), ("DM1", "Control"))).where(where)
    mean = agg.as_arrays(agg.sample_mean_spectra(fx.spectra_long(spark, sf_dir)))
    return mean.join(meta.select("sample_id", F.col("target_SI").alias("y"), "set"), "sample_id")


@query(f", {_XY}, p as (select a.sample_id as a, b.sample_id as b, sqrt(sum((a.x - b.x) ** 2)) as dx, any_value(abs(a.y - b.y)) as dy from xy a join xy b on a.idx = b.idx and a.sample_id < b.sample_id group by 1, 2) select a, b, {R('dx')} as dx, {R('dy')} as dy, {R('dx + dy')} as d from p")
def pairwise_distance(spark, sf_dir):
    return distances.pairwise_distance(sample_xy(spark, sf_dir)).select("a", "b", r6("dx").alias("dx"), r6("dy").alias("dy"), r6("d").alias("d"))


@query(
    f", {_XY}, d as (select t.sample_id as id, r.sample_id as neighbour, any_value(r.y) as y, round(sqrt(sum((t.x - r.x) ** 2)), 9) as d from xy t join xy r on t.idx = r.idx where t.sample_id in (select sample_id from samples where set = 'Test') and r.sample_id in (select sample_id from samples where set = 'Train') group by 1, 2), k as (select *, row_number() over (partition by id order by d, neighbour) as r from d) select id, {R('avg(y)')} as pred from k where r <= 5 group by 1"
)
def knn_predict(spark, sf_dir):
    xy = sample_xy(spark, sf_dir).withColumnRenamed("sample_id", "id")
    return distances.knn_predict(xy.where("set = 'Test'"), xy.where("set = 'Train'"), 5).select("id", r6("pred").alias("pred"))


# ---- aggregates ----------------------------------------------------------------------


@query(f"select sample_id, idx, {R('avg(x)')} as x from spectra_long group by 1, 2")
def sample_mean_spectra(spark, sf_dir):
    return agg.sample_mean_spectra(fx.spectra_long(spark, sf_dir)).select("sample_id", "idx", r6("x").alias("x"))


@query(f"select idx, {R('avg(x)')} as x from spectra_long group by 1")
def mean_spectrum(spark, sf_dir):
    return agg.sample_mean_spectra(fx.spectra_long(spark, sf_dir), ()).select("idx", r6("x").alias("x"))


@query(f"select sample_id, {R('any_value(y)')} as y, {R('avg(pred)')} as pred_mean, {R('stddev_pop(pred)')} as pred_std, count(*) as n from predictions group by 1")
def sample_predictions(spark, sf_dir):
    p = agg.sample_predictions(fx.predictions(spark, sf_dir))
    return p.select("sample_id", r6("y").alias("y"), r6("pred_mean").alias("pred_mean"), r6("pred_std").alias("pred_std"), "n")


def _iterations(spark, sf_dir):
    """Each replicate as an iteration; every fifth was not tested."""
    p = fx.predictions(spark, sf_dir)
    return p.select("sample_id", (F.col("map_no") * 3 + F.col("rep_no")).alias("iter"), "y", F.when(F.col("spectrum_id") % 5 != 0, F.col("pred")).alias("prediction"))


@query(f"select sample_id, count(p) as n_tested, {R('avg(p)')} as pred_mean, {R('stddev_pop(p)')} as pred_std from (select sample_id, case when spectrum_id % 5 <> 0 then pred end as p from predictions) group by 1")
def mccv_summary(spark, sf_dir):
    s = agg.mccv_summary(_iterations(spark, sf_dir))
    return s.select("sample_id", "n_tested", r6("pred_mean").alias("pred_mean"), r6("pred_std").alias("pred_std"))


@query(f"select sample_id, {R('avg(m)')} as pred_mean, {R('avg(s)')} as pred_std from (select sample_id, map_no, avg(pred) as m, stddev_pop(pred) as s from predictions group by 1, 2) group by 1")
def sample_stats(spark, sf_dir):
    per = fx.predictions(spark, sf_dir).groupBy("sample_id", "map_no").agg(F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"))
    return agg.sample_stats(per).select("sample_id", r6("pred_mean").alias("pred_mean"), r6("pred_std").alias("pred_std"))


@query(f"select n_components, {R('avg(rmse)')} as rmse, count(*) as n from (select map_no as n_components, rep_no, sqrt(avg((y - pred) ** 2)) as rmse from predictions group by 1, 2) group by 1")
def rmse_by_components(spark, sf_dir):
    scores = agg.regression_metrics(fx.predictions(spark, sf_dir), ("map_no", "rep_no")).withColumnRenamed("map_no", "n_components")
    return agg.rmse_by_components(scores).select("n_components", r6("rmse").alias("rmse"), "n")


_METRICS = "count(*) as n, round(sqrt(avg((y - pred) ** 2)), 6) + 0.0 as rmse, round(1 - sum((y - pred) ** 2) / (var_pop(y) * count(y)), 6) + 0.0 as r2"


@query(f"select 'spectrum' as level, {_METRICS} from predictions union all select 'sample', {_METRICS} from (select sample_id, any_value(y) as y, avg(pred) as pred from predictions group by 1)")
def regression_metrics(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    by_sample = agg.sample_predictions(p).withColumn("pred", F.col("pred_mean"))
    both = agg.regression_metrics(p).withColumn("level", F.lit("spectrum")).unionByName(agg.regression_metrics(by_sample).withColumn("level", F.lit("sample")))
    return both.select("level", "n", r6("rmse").alias("rmse"), r6("r2").alias("r2"))


@query(f"select map_no, {R('avg(b)')} as mean_baseline, {R('stddev_pop(b)')} as std_baseline, row_number() over (order by avg(b) desc, map_no) as rank from (select map_no, list_avg(intensity) as b from spectra) group by 1")
def map_baseline(spark, sf_dir):
    return agg.map_baseline(fx.spectra(spark, sf_dir)).select("map_no", r6("mean_baseline").alias("mean_baseline"), r6("std_baseline").alias("std_baseline"), F.col("rank").cast("long").alias("rank"))


@query(f"select spectrum_id, sample_id, map_no, {R('list_avg(intensity[1:20])')} as baseline from spectra")
def head_baseline(spark, sf_dir):
    return agg.head_baseline(fx.spectra(spark, sf_dir), 20).withColumn("baseline", r6("baseline"))


@query("select metric, set, " + ", ".join(f"round(quantile_cont(value, {p}), 6) + 0.0 as {n}" for p, n in ((0.0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1.0, "high"))) + " from scores_long group by 1, 2")
def box_summary(spark, sf_dir):
    return agg.box_summary(fx.scores_long(spark, sf_dir), ("metric", "set"), "value").select("metric", "set", *[r6(c).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "select metric, cast(bin as int) as bin, coalesce(n, 0) as n from (select metric, unnest(range(0, 20)) as bin from (select distinct metric from scores_long)) left join (select metric, case when hi = lo then 0 else least(19, floor((value - lo) / (hi - lo) * 20)) end as bin, count(*) as n from scores_long join (select metric, min(value) as lo, max(value) as hi from scores_long group by 1) using (metric) group by 1, 2) using (metric, bin)"
)
def residual_histogram(spark, sf_dir):
    return agg.histogram(fx.scores_long(spark, sf_dir), "value", 20, ("metric",))


@query(
    f"select metric, cast(k as int) as k, {R('any_value(g)')} as at, {R('sum(exp(-0.5 * ((g - value) / h) * ((g - value) / h))) / 2.5066282746310002 / any_value(n * h)')} as density from (select metric, value, n, h, k, lo + (hi - lo) * k / 19 as g from (select metric, count(*) as n, power(count(*), -0.2) * stddev_samp(value) as h, min(value) as lo, max(value) as hi from scores_long group by 1) join scores_long using (metric), (select unnest(range(0, 20)) as k)) group by 1, 2"
)
def density_grid(spark, sf_dir):
    return agg.density_grid(fx.scores_long(spark, sf_dir), "metric", "value").select("metric", "k", r6("at").alias("at"), r6("density").alias("density"))


@query("select distinct type from samples")
def distinct_types(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("type").distinct()


# ---- statistics ----------------------------------------------------------------------


@query(f"select metric, set, count(*) as n, {R('avg(value)')} as mean, {R('stddev_samp(value)')} as std, {R('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)')} as iqr from scores_long group by 1, 2")
def shift_summary(spark, sf_dir):
    return statistics.shift_summary(fx.scores_long(spark, sf_dir)).select("metric", "set", "n", r6("mean").alias("mean"), r6("std").alias("std"), r6("iqr").alias("iqr"))


@query(f"select metric, set, {R('skewness(value)')} as skewness, {R('kurtosis(value)')} as kurtosis from scores_long group by 1, 2")
def shift_shape(spark, sf_dir):
    return statistics.shift_shape(fx.scores_long(spark, sf_dir)).select("metric", "set", r6("skewness").alias("skewness"), r6("kurtosis").alias("kurtosis"))


#: Points of Simpson's rule in the SQL of tail probabilities.
_STEPS = 20_000


def tail_sql(d1: str, d2: str, tangent: str) -> str:
    """P(F > f) with d1 and d2 degrees of freedom, where tangent = sqrt(d1 * f / d2); with d1 = 1 and |t| / sqrt(df) the two-sided p of t."""
    weight = f"case when i = 0 or i = {_STEPS} then 1 when i % 2 = 1 then 4 else 2 end"
    area = lambda low: f"(({math.pi / 2!r}e0 - {low}) * list_sum(list_transform(range(0, {_STEPS + 1}), lambda i: {weight} * pow(cos({low} + ({math.pi / 2!r}e0 - {low}) * i / {_STEPS}), {d2} - 1) * pow(sin({low} + ({math.pi / 2!r}e0 - {low}) * i / {_STEPS}), {d1} - 1))))"
    return f"({area(f'atan({tangent})')} / {area('0e0')})"


def ks_tail_sql(d: str, n: str, m: str) -> str:
    z2 = f"({d} * {d} * {n} * {m} / ({n} + {m}))"
    return f"case when {z2} < 0.04 then 1.0 else least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * {z2}))))) end"


_KS = "c as (select metric, value, count(*) filter (where set = 'Train') as a, count(*) filter (where set <> 'Train') as b from scores_long group by 1, 2), f as (select metric, abs(sum(a) over w / (sum(a) over (partition by metric)) - sum(b) over w / (sum(b) over (partition by metric))) as gap from c window w as (partition by metric order by value))"


@query(f", {_KS}, k as (select metric, (select count(*) from scores_long s where s.metric = f.metric and set = 'Train') as n_first, (select count(*) from scores_long s where s.metric = f.metric and set <> 'Train') as n_second, max(gap) as d from f group by 1) select metric, n_first, n_second, {R('d')} as d, {R(ks_tail_sql('d', 'n_first', 'n_second'))} as p from k")
def ks_two_sample(spark, sf_dir):
    k = statistics.with_ks_p(statistics.ks_two_sample(fx.scores_long(spark, sf_dir)))
    return k.select("metric", "n_first", "n_second", r6("d").alias("d"), r6("p").alias("p"))


_TWO = "two as (select metric, count(*) filter (where set = 'Train') as n1, avg(value) filter (where set = 'Train') as m1, var_samp(value) filter (where set = 'Train') as v1, count(*) filter (where set <> 'Train') as n2, avg(value) filter (where set <> 'Train') as m2, var_samp(value) filter (where set <> 'Train') as v2 from scores_long group by 1)"


_WELCH = "welch as (select metric, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) as t, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) as df from two)"
_T_P = tail_sql("1", "df", "abs(t) / sqrt(df)")


@query(f", {_TWO}, {_WELCH} select metric, {R('t')} as t, {R('df')} as df, {R(_T_P)} as p from welch")
def welch_t(spark, sf_dir):
    w = statistics.with_t_p(statistics.welch_t(fx.scores_long(spark, sf_dir)))
    return w.select("metric", r6("t").alias("t"), r6("df").alias("df"), r6("p").alias("p"))


@query(f", {_TWO} select metric, {R('(m1 - m2) / sqrt((v1 + v2) / 2)')} as cohen_d from two")
def cohen_d(spark, sf_dir):
    return statistics.cohen_d(fx.scores_long(spark, sf_dir)).select("metric", r6("cohen_d").alias("cohen_d"))


_GROUPS = "g as (select metric, map, count(*) as n, avg(value) as mean, var_samp(value) as var from scores_long group by 1, 2), e as (select metric, sum((n - 1) * var) as ssw, sum(n) as n, count(*) as k, sum(n * mean) / sum(n) as grand from g group by 1)"


@query(f", {_GROUPS}, a as (select e.metric, sum(g.n * (g.mean - grand) ** 2) / (any_value(k) - 1) / (any_value(ssw) / (any_value(e.n) - any_value(k))) as f, any_value(k) - 1 as d1, cast(any_value(e.n) - any_value(k) as bigint) as d2 from g join e using (metric) group by 1) select metric, {R('f')} as f, d1 as df_between, d2 as df_within, {R(tail_sql('d1', 'd2', 'sqrt(d1 * f / d2)'))} as p from a")
def anova_f(spark, sf_dir):
    a = statistics.with_f_p(statistics.anova_f(fx.scores_long(spark, sf_dir)))
    return a.select("metric", r6("f").alias("f"), "df_between", "df_within", r6("p").alias("p"))


_AB = "ab as (select a.metric, a.map as a, b.map as b, a.n as n1, a.mean as m1, a.var as v1, b.n as n2, b.mean as m2, b.var as v2 from g a join g b on a.metric = b.metric and a.map < b.map)"


@query(f", {_GROUPS}, {_AB}, tt as (select metric, a, b, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) as t, n1 + n2 - 2 as df from ab), pp as (select *, {_T_P} as p from tt) select metric, a, b, {R('t')} as t, df, {R('p')} as p, {R('p * count(*) over (partition by metric)')} as p_bonferroni, p * count(*) over (partition by metric) < 0.05 as reject from pp")
def pairwise_t(spark, sf_dir):
    """Pooled t tests of each two maps with p, p times the number of pairs, and the decision at 5 %."""
    t = statistics.with_bonferroni(statistics.pairwise_t(fx.scores_long(spark, sf_dir))).withColumn("reject", F.col("p_bonferroni") < 0.05)
    return t.select("metric", "a", "b", r6("t").alias("t"), "df", r6("p").alias("p"), r6("p_bonferroni").alias("p_bonferroni"), "reject")


@query(f", {_GROUPS}, {_AB} select ab.metric, a, b, {R('m2 - m1')} as diff, {R('abs(m2 - m1) / sqrt(ssw / (n - k) / 2 * (1 / n1 + 1 / n2))')} as q from ab join e on e.metric = ab.metric")
def tukey_hsd(spark, sf_dir):
    return statistics.tukey_hsd(fx.scores_long(spark, sf_dir)).select("metric", "a", "b", r6("diff").alias("diff"), r6("q").alias("q"))


def _critical_sql(shapes: str, alpha: float = 0.05) -> str:
    """Critical values of the studentised range as common table expressions, from {shapes}(k, df) to critical(k, df, q): the sums and halvings of `tails`."""

    def cdf(x):
        a = f"(abs({x}) / sqrt(2.0))"
        t = f"(1 / (1 + 0.5 * {a}))"
        fit = str(tails.ERFC[-1])
        for c in tails.ERFC[-2::-1]:
            fit = f"({c} + {t} * {fit})"
        half = f"0.5 * {t} * exp(-{a} * {a} + {fit})"
        return f"case when {x} >= 0 then 1 - {half} else {half} end"

    n = tails.STEPS
    weight = f"case when i in (0, {n}) then 1.0 when i % 2 = 1 then 4.0 else 2.0 end"
    log_c = "df / 2.0 * ln(df) - lgamma(df / 2.0) - (df / 2.0 - 1) * ln(2.0)"
    out = [
        f"steps as (select unnest(range(0, {n + 1})) as i)",
        f"normal as materialized (select z, {cdf('z')} as pz, {weight} * 16.0 / {n} / 3 * exp(-z * z / 2) / sqrt(2 * pi()) as wz from (select i, -8.0 + 16.0 * i / {n} as z from steps))",
        f"spans as (select k, df, greatest(1e-6, 1 - 8 / sqrt(2.0 * df)) as lo, 1 + 8 / sqrt(2.0 * df) + case when df < 4 then 2.0 else 0.0 end as hi from {shapes})",
        f"points as (select k, df, i, lo, hi, lo + (hi - lo) * i / {n} as s from spans, steps where df <= {tails.SCALED_DF})",
        f"scales as materialized (select k, df, s, {weight} * (hi - lo) / {n} / 3 * exp({log_c} + (df - 1) * ln(s) - df * s * s / 2) as ws from points union all select k, df, 1.0, 1.0 from spans where df > {tails.SCALED_DF})",
        f"half0 as (select k, df, 0.0 as lo, cast({tails.TOP} as double) as hi from {shapes})",
    ]
    for h in range(tails.HALVINGS):
        upper = f"greatest(0.0, 1 - sum(ws * wz * b.k * power(pz - ({cdf('(z - mid * s)')}), b.k - 1)))"
        tail = f"select b.k, b.df, lo, hi, mid, {upper} as p from (select *, (lo + hi) / 2 as mid from half{h}) b join scales on scales.k = b.k and scales.df = b.df, normal group by b.k, b.df, lo, hi, mid"
        out.append(f"half{h + 1} as materialized (select k, df, case when p > {alpha} then mid else lo end as lo, case when p > {alpha} then hi else mid end as hi from ({tail}))")
    return ", ".join([*out, f"critical as (select k, df, (lo + hi) / 2 as q from half{tails.HALVINGS})"])


@query(
    f", {_GROUPS}, {_AB}, shapes as (select distinct k, n - k as df from e), {_critical_sql('shapes')}, tu as (select ab.metric, a, b, m2 - m1 as diff, sqrt(ssw / (n - k) / 2 * (1 / n1 + 1 / n2)) as se, k, n - k as df from ab join e on e.metric = ab.metric) "
    f"select metric, a, b, {R('diff')} as diff, {R('abs(diff) / se')} as q, {R('diff - q * se')} as lower, {R('diff + q * se')} as upper, abs(diff) / se > q as reject from tu join critical c on c.k = tu.k and c.df = tu.df"
)
def tukey_decisions(spark, sf_dir):
    """Tukey-Kramer comparisons with the simultaneous 95 % interval and the decision."""
    t = statistics.with_tukey_interval(statistics.tukey_hsd(fx.scores_long(spark, sf_dir)))
    return t.select("metric", "a", "b", *[r6(c).alias(c) for c in ("diff", "q", "lower", "upper")], "reject")


@query(f", {_GROUPS}, {_AB}, tt as (select metric, a, b, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) as t, n1 + n2 - 2 as df from ab), pp as (select *, {_T_P} as p from tt) select metric || ': ' || a || ' - ' || b as line, {R('t')} as t, {R('p')} as p from pp")
def report_of_tests(spark, sf_dir):
    """The pairwise tests written as a tab-separated text report, and the report read again."""
    t = statistics.with_t_p(statistics.pairwise_t(fx.scores_long(spark, sf_dir)))
    lines = t.select(F.concat("metric", F.lit(": "), "a", F.lit(" - "), "b").alias("line"), r6("t").alias("t"), r6("p").alias("p"))
    files.write_report(lines, path := shared_path(spark, "report"), "line")
    return spark.read.csv(path, sep="\t", header=True, schema="line string, t double, p double")


@query(f"select type, sample_id, {R('y')} as y, {R('m')} as pred_mean, {R('s')} as pred_std from (select sample_id, any_value(y) as y, avg(pred) as m, stddev_pop(pred) as s from predictions group by 1) join samples using (sample_id)")
def write_results(spark, sf_dir):
    """The result table by sample through the sink, in a folder for each type, and the table read again."""
    s = agg.sample_predictions(fx.predictions(spark, sf_dir)).join(fx.samples(spark, sf_dir).select("sample_id", "type"), "sample_id")
    files.write_table(s.select("type", "sample_id", r6("y").alias("y"), r6("pred_mean").alias("pred_mean"), r6("pred_std").alias("pred_std")), path := shared_path(spark, "results"), ("type",))
    return spark.read.schema("sample_id string, y double, pred_mean double, pred_std double, type string").parquet(path).select("type", "sample_id", "y", "pred_mean", "pred_std")


_STATS = "st as (select sample_id, any_value(y) as y, avg(pred) as m, stddev_pop(pred) as s from predictions group by 1)"


@query(f", {_STATS} select sample_id, {R('abs(y - m)')} as abs_error, s > 0.07 as high_std, abs(y - m) > 0.3 as high_error, s > 0.07 and abs(y - m) > 0.3 as outlier from st")
def outlier_flags(spark, sf_dir):
    s = statistics.outlier_flags(agg.sample_predictions(fx.predictions(spark, sf_dir)))
    return s.select("sample_id", r6("abs_error").alias("abs_error"), "high_std", "high_error", "outlier")


@query(f"select row_id, metric, {R('value')} as value from scores_long join (select metric, avg(value) + 3 * stddev_samp(value) as lim from scores_long group by 1) using (metric) where value > lim")
def three_sigma_outliers(spark, sf_dir):
    return statistics.sigma_outliers(fx.scores_long(spark, sf_dir), "value", 3, False, ("metric",)).select("row_id", "metric", r6("value").alias("value"))


@query(f"select row_id, metric, {R('value')} as value from scores_long, (select avg(value) + 2 * stddev_pop(value) as lim from scores_long) where value > lim")
def two_sigma_outliers(spark, sf_dir):
    return statistics.sigma_outliers(fx.scores_long(spark, sf_dir), "value", 2, True).select("row_id", "metric", r6("value").alias("value"))


def _side(tag, name):
    q = "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"
    cols = (("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("iqr", q), ("skewness", "skewness(value)"), ("kurtosis", "kurtosis(value)"))
    return f"{tag} as (select metric, count(*) as {tag}_n, " + ", ".join(f"{R(x)} as {tag}_{n}" for n, x in cols) + f" from scores_long where set = '{name}' group by 1)"


@query(f", {_side('train', 'Train')}, {_side('test', 'Test')}, {_KS}, {_TWO}, {_WELCH}, k as (select metric, max(gap) as ks from f group by 1) select train.*, test.* exclude (metric), {R('k.ks')} as ks, {R(ks_tail_sql('k.ks', 'train_n', 'test_n'))} as ks_p, {R('t')} as t, {R(_T_P)} as t_p, {R('(m1 - m2) / sqrt((v1 + v2) / 2)')} as cohen_d from train left join test using (metric) left join k using (metric) left join two using (metric) left join welch using (metric)")
def domain_shift_report(spark, sf_dir):
    d = statistics.domain_shift_report(fx.scores_long(spark, sf_dir)).drop("df")
    return d.select(*[r6(c).alias(c) if k == "double" else F.col(c) for c, k in d.dtypes])


# ---- ranking, reshapes, grids ----------------------------------------------------------

_SCORES = f""", {_INTERVALS}, pr as (select idx, corr(x, "target_SI") ** 2 as r2 from spectra_long join samples using (sample_id) where set = 'Train' and "target_SI" is not null group by 1),
scored as (select i, s, e, avg(r2) as r2 from intervals join pr on pr.idx >= s and pr.idx < e group by all)"""


def interval_scores_by_correlation(spark, sf_dir):
    """(i, s, e, r2): mean squared correlation of an interval's points with the target, on train spectra."""
    long = fx.spectra_long(spark, sf_dir).join(fx.samples(spark, sf_dir).where("set = 'Train' and target_SI is not null").select("sample_id", "target_SI"), "sample_id")
    points = long.groupBy("idx").agg(F.pow(F.corr("x", "target_SI"), 2).alias("r2"))
    cut = _intervals(spark, sf_dir).select("i", "s", "e", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("idx"))
    return cut.join(points, "idx").groupBy("i", "s", "e").agg(F.avg("r2").alias("r2"))


@query(f"{_SCORES} select i, s, e, {R('r2')} as r2 from scored order by scored.r2 desc, i limit 5")
def topk_intervals(spark, sf_dir):
    return ranking.top_k(interval_scores_by_correlation(spark, sf_dir), 5, F.desc("r2"), "i").select("i", "s", "e", r6("r2").alias("r2"))


@query(f"select map_no, sample_id, {R('err')} as abs_error, r from (select *, row_number() over (partition by map_no order by err desc, sample_id) as r from (select map_no, sample_id, abs(any_value(y) - avg(pred)) as err from predictions group by 1, 2)) where r <= 10")
def top10_outliers(spark, sf_dir):
    e = fx.predictions(spark, sf_dir).groupBy("map_no", "sample_id").agg(F.abs(F.first("y") - F.avg("pred")).alias("err"))
    return ranking.top_per_group(e, ("map_no",), 10, F.desc("err"), "sample_id").select("map_no", "sample_id", r6("err").alias("abs_error"), F.col("r").cast("long").alias("r"))


@query(f"select map_no, rep_no, {R('r2')} as r2 from (select map_no, rep_no, 1 - sum((y - pred) ** 2) / (var_pop(y) * count(y)) as r2 from predictions group by 1, 2) t order by t.r2 desc, map_no, rep_no limit 3")
def top3_settings(spark, sf_dir):
    m = agg.regression_metrics(fx.predictions(spark, sf_dir), ("map_no", "rep_no"))
    return ranking.top_k(m, 3, F.desc("r2"), "map_no", "rep_no").select("map_no", "rep_no", r6("r2").alias("r2"))


@query(f"select map_no, rep_no, {R('rmse')} as rmse from (select *, row_number() over (partition by map_no order by rmse, rep_no) as r from (select map_no, rep_no, sqrt(avg((y - pred) ** 2)) as rmse from predictions group by 1, 2)) where r = 1")
def best_setting(spark, sf_dir):
    m = agg.regression_metrics(fx.predictions(spark, sf_dir), ("map_no", "rep_no"))
    return ranking.best_setting(m, ("map_no",), "rmse", "rep_no", ("rep_no",)).select("map_no", "rep_no", r6("rmse").alias("rmse"))


@query("select row_id, metric, map, round(value, 6) + 0.0 as value from scores_long order by value desc, row_id")
def sorted_log(spark, sf_dir):
    return fx.scores_long(spark, sf_dir).orderBy(F.desc("value"), "row_id").select("row_id", "metric", "map", r6("value").alias("value"))


@query("select sample_id, 'Train' as part from samples where set = 'Train' union all select sample_id, 'Test' from samples where set = 'Test'")
def union_sets(spark, sf_dir):
    m = fx.samples(spark, sf_dir)
    return metadata.tag(m.where("set = 'Train'"), part="Train").unionByName(metadata.tag(m.where("set = 'Test'"), part="Test")).select("sample_id", "part")


@query("""select sample_id, metric, round(value, 6) + 0.0 as value from (select sample_id, "target_SI", "HGS_pp_avg", "ADF_pp_avg" from samples) unpivot include nulls (value for metric in ("target_SI", "HGS_pp_avg", "ADF_pp_avg"))""")
def melt_targets(spark, sf_dir):
    return ranking.unpivot(fx.samples(spark, sf_dir), ("sample_id",), fx.TARGETS).select("sample_id", "metric", r6("value").alias("value"))


@query("select spectrum_id, sample_id, map_no, rep_no, idx, round(x, 6) + 0.0 as x from spectra_long")
def spectra_long(spark, sf_dir):
    return fx.spectra_long(spark, sf_dir).withColumn("x", r6("x"))


@query("select sample_id, idx, " + ", ".join(f"round(max(x) filter (where (map_no - 1) * 3 + rep_no = {i}), 6) + 0.0 as r{i}" for i in range(1, 10)) + " from spectra_long group by 1, 2")
def spectra_wide(spark, sf_dir):
    return ranking.wide_replicates(fx.spectra_long(spark, sf_dir)).select("sample_id", "idx", *[r6(f"r{i}").alias(f"r{i}") for i in range(1, 10)])


@query("select type, map_no, n_components from (select distinct type from samples), (select distinct map_no from spectra), (select unnest(range(1, 4)) as n_components)")
def param_grid(spark, sf_dir):
    types, maps = fx.samples(spark, sf_dir).select("type").distinct(), fx.spectra(spark, sf_dir).select("map_no").distinct()
    return ranking.grid(types, maps, spark.range(1, 4).withColumnRenamed("id", "n_components"))


_TOP4 = "top4 as (select *, row_number() over (order by r2 desc, i) as o from scored order by r2 desc, i limit 4)"


@query(
    f"{_SCORES}, {_TOP4} select 1 as k, cast(i as varchar) as members from top4 union all select 2, a.i || ',' || b.i from top4 a join top4 b on a.o < b.o union all select 3, a.i || ',' || b.i || ',' || c.i from top4 a join top4 b on a.o < b.o join top4 c on b.o < c.o"
)
def interval_combos(spark, sf_dir):
    from pyspark.sql import Window

    top = ranking.top_k(interval_scores_by_correlation(spark, sf_dir), 4, F.desc("r2"), "i")
    items = top.select(F.row_number().over(Window.orderBy(F.desc("r2"), "i")).alias("ordinal"), F.col("i").alias("item"))
    return ranking.combinations(items, 3).select("k", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"{_SCORES}, {_TOP4} select s, e, ds, de, s2, e2 from (select s, e, cast(ds as int) as ds, cast(de as int) as de, cast(greatest(0, least(63, s + ds)) as int) as s2, cast(greatest(0, least(63, e + de)) as int) as e2 from top4, (select unnest(range(-3, 4)) as ds), (select unnest(range(-3, 4)) as de)) where s2 < e2")
def shift_grid(spark, sf_dir):
    top = ranking.top_k(interval_scores_by_correlation(spark, sf_dir), 4, F.desc("r2"), "i")
    return ranking.shift_grid(top, 3, fx.POINTS - 1)


# ---- spectral functions ----------------------------------------------------------------

_POINTS = "select spectrum_id, idx, round(x, 6) + 0.0 as x from "
_SNV = "select spectrum_id, sample_id, idx, (x - avg(x) over w) / stddev_pop(x) over w as x from {0} window w as (partition by spectrum_id)"
_NORM = "select spectrum_id, sample_id, idx, x / sqrt(sum(x * x) over (partition by spectrum_id)) as x from {0}"
_EMSC = "select l.spectrum_id, l.sample_id, l.idx, (l.x - f.b) / f.a as x from {0} l join (select spectrum_id, regr_slope(x, r) as a, regr_intercept(x, r) as b from {0} join (select idx, avg(x) as r from {0} {1} group by 1) using (idx) group by 1) f using (spectrum_id)"


def _filter_sql(source: str, points: int, window: int, order: int, deriv: int) -> str:
    m = savgol_matrix(points, window, order, deriv)
    values = ", ".join(f"({i}, {j}, {m[i, j]!r})" for i, j in zip(*np.nonzero(m), strict=True)).replace("np.float64(", "").replace("))", ")")
    return f"select s.spectrum_id, any_value(s.sample_id) as sample_id, cast(c.i as int) as idx, sum(c.w * s.x) as x from {source} s join (values {values}) c(i, j, w) on c.j = s.idx group by 1, 3"


@query(_POINTS + f"({_EMSC.format('spectra_long', '')})")
def emsc(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), ["emsc"]), "spectrum_id")


@query(_POINTS + f"({_NORM.format('spectra_long')})")
def l2_normalize(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), ["normalize"]), "spectrum_id")


@query(_POINTS + f"({_SNV.format('spectra_long')})")
def snv(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), ["snv"]), "spectrum_id")


@query(_POINTS + f"({_filter_sql('spectra_long', 64, 11, 2, 2)})")
def savgol_d2(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), ["second_derivative"]), "spectrum_id")


@query(f"select l.spectrum_id, l.idx, {R('l.x - b.x')} as x from spectra_long l join ({_filter_sql('spectra_long', 64, 51, 3, 0)}) b on b.spectrum_id = l.spectrum_id and b.idx = l.idx")
def baseline_sg51(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), ["baseline"]), "spectrum_id")


_TWICE = "twice as (select spectrum_id, sample_id, idx, x from spectra_long union all select spectrum_id, sample_id, idx + 64, x + 32 from spectra_long)"


@query(f", {_TWICE} select l.spectrum_id, l.idx, {R('l.x - b.x')} as x from twice l join ({_filter_sql('twice', 128, 101, 3, 0)}) b on b.spectrum_id = l.spectrum_id and b.idx = l.idx")
def baseline_sg101(spark, sf_dir):
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir, 128), ["baseline"], baseline_window=101), "spectrum_id")


@query(f"select spectrum_id, {R('avg(x)')} as baseline from ({_filter_sql('spectra_long', 64, 51, 3, 0)}) group by 1")
def sg_baseline_mean(spark, sf_dir):
    smooth = fx.spectra(spark, sf_dir).select("spectrum_id", spectral.savgol(51, 3, 0)("intensity").alias("s"))
    return smooth.select("spectrum_id", r6(spectral.array_mean(F.col("s"))).alias("baseline"))


@query(
    f", c1 as ({_SNV.format('spectra_long')}), c2 as ({_NORM.format('spectra_long')}), d1 as ({_filter_sql('c1', 64, 11, 2, 2)}), e2 as ({_EMSC.format('c2', '')}) select 'snv+second_derivative' as chain, spectrum_id, idx, {R('x')} as x from d1 union all select 'normalize+emsc', spectrum_id, idx, {R('x')} from e2"
)
def preprocess_chain(spark, sf_dir):
    out = None
    for chain in (["snv", "second_derivative"], ["normalize", "emsc"]):
        part = long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), chain), "spectrum_id").select(F.lit("+".join(chain)).alias("chain"), "spectrum_id", "idx", "x")
        out = part if out is None else out.unionByName(part)
    return out


@query(f", b1 as (select l.spectrum_id, l.sample_id, l.idx, l.x - b.x as x from spectra_long l join ({_filter_sql('spectra_long', 64, 51, 3, 0)}) b on b.spectrum_id = l.spectrum_id and b.idx = l.idx), c1 as ({_SNV.format('b1')}), b2 as (select l.spectrum_id, l.sample_id, l.idx, l.x - b.x as x from c1 l join ({_filter_sql('c1', 64, 51, 3, 0)}) b on b.spectrum_id = l.spectrum_id and b.idx = l.idx), d1 as ({_filter_sql('b2', 64, 11, 2, 2)}) select spectrum_id, idx, {R('x')} as x from d1")
def baseline_between_steps(spark, sf_dir):
    """The chain that takes the baseline off first and again between its steps."""
    return long_of(spectral.preprocess_chain(fx.spectra(spark, sf_dir), spectral.baseline_between(["snv", "second_derivative"])), "spectrum_id")


@query(_POINTS + f"({_EMSC.format('spectra_long', chr(39).join(['where sample_id in (select sample_id from samples where set = ', 'Train', ')']))})")
def emsc_train_ref(spark, sf_dir):
    s = fx.spectra(spark, sf_dir).join(fx.samples(spark, sf_dir).select("sample_id", "set"), "sample_id", "left")
    return long_of(spectral.preprocess_chain(s, ["emsc"], fit_on=F.col("set") == "Train"), "spectrum_id")


# ---- splits ------------------------------------------------------------------------------


@query(
    f""", recursive_none as (select 1), {_XY}, d as (select a.sample_id as a, b.sample_id as b, round(sqrt(sum((a.x - b.x) ** 2)) + any_value(abs(a.y - b.y)), 9) as d from xy a join xy b on a.idx = b.idx group by 1, 2),
    size_ as (select count(distinct a) as n, cast(floor(0.8 * count(distinct a)) as bigint) as n_train from d), start_ as (select a from (select a, max(d) as m from d group by 1) order by m desc, a limit 1),
    picks as (select 0 as pick, [a] as chosen from start_ union all
      select pick + 1, list_append(chosen, (select a from (select a, min(d) as m from d where list_contains(picks.chosen, d.b) and not list_contains(picks.chosen, d.a) group by a) order by m desc, a limit 1)) from picks where pick + 1 < (select n_train from size_)),
    last_ as (select chosen from picks order by pick desc limit 1)
    select distinct d.a as sample_id, case when list_contains(chosen, d.a) then 'train' else 'validation' end as part, coalesce(list_position(chosen, d.a) - 1, -1) as pick from d, last_""".replace("recursive_none as (select 1), ", "")
)
def spxy_split(spark, sf_dir):
    return splits.spxy_split(sample_xy(spark, sf_dir)).select("sample_id", "part", F.coalesce(F.col("pick").cast("int"), F.lit(-1)).alias("pick"))


ORACLE["spxy_split"] = ORACLE["spxy_split"].replace("\nwith v as", "\nwith recursive v as", 1)


@query("select sample_id, cast((dense_rank() over (order by sample_id) - 1) % 5 as int) as fold from (select distinct sample_id from spectra)")
def group_folds(spark, sf_dir):
    return splits.group_folds(fx.spectra(spark, sf_dir))


@query(
    "select cast(iter as int) as iter, sample_id, case when r <= ceil(0.2 * (select count(*) from samples)) then 'test' else 'train' end as part from (select iter, sample_id, row_number() over (partition by iter order by md5(sample_id || '_' || (iter + 42)), sample_id) as r from samples, (select unnest(range(0, 20)) as iter))"
)
def mc_splits(spark, sf_dir):
    return splits.mc_splits(fx.samples(spark, sf_dir), "sample_id", 20)
