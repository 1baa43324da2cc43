"""Spectral tables derived from the driver's tables, in Spark and as DuckDB SQL.

spectra(spectrum_id, sample_no, sample_id, map_no, rep_no, file_name, intensity),
axis(idx, wavenumber), samples(sample_id, sample_no, type, set, age, sex, target_SI,
HGS_pp_avg, ADF_pp_avg), predictions(spectrum_id, sample_id, map_no, rep_no, y, pred),
scores_long(row_id, metric, set, map, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of a derived spectrum.
POINTS = 64
REPLICATES = 9
TARGETS = ("target_SI", "HGS_pp_avg", "ADF_pp_avg")


def r6(x: Column | str) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("spectrum_id"), F.floor(F.col("vec_id") / 9).alias("sample_no"), F.col("embedding").cast("array<double>").alias("e")
    )


def _sample_id() -> Column:
    number = F.col("sample_no").cast("string")
    return F.concat(F.lit("S_"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def spectra(spark: SparkSession, sf_dir: str, points: int = POINTS) -> DataFrame:
    """Points beyond the vector repeat it, one period of 64 higher by 32."""
    v = _vectors(spark, sf_dir).select(
        "spectrum_id",
        "sample_no",
        _sample_id().alias("sample_id"),
        (F.floor((F.col("spectrum_id") % 9) / 3) + 1).cast("int").alias("map_no"),
        (F.col("spectrum_id") % 3 + 1).cast("int").alias("rep_no"),
        F.transform("e", lambda x, i: 10 + 0.5 * i + 4 * x).alias("intensity"),
    )
    if points > POINTS:
        v = v.withColumn("intensity", F.concat("intensity", F.transform("intensity", lambda x: x + 32)))
    file_name = F.concat("sample_id", F.lit("_Map"), "map_no", F.lit("_x.txt"))
    return v.select("spectrum_id", "sample_no", "sample_id", "map_no", "rep_no", file_name.alias("file_name"), "intensity")


def spectra_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra(spark, sf_dir).select("spectrum_id", "sample_id", "map_no", "rep_no", F.posexplode("intensity").alias("idx", "x"))


def axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per point of the longest spectrum."""
    n = _vectors(spark, sf_dir).agg(F.max(F.size("e")).alias("n"))
    points = n.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    return points.select("idx", F.when(F.col("idx") < 32, 500 + 40.0 * F.col("idx")).otherwise(1160 + 40.0 * F.col("idx")).alias("wavenumber"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _vectors(spark, sf_dir).groupBy("sample_no").agg(F.count("*").alias("n"), *[F.avg(F.col("e")[i]).alias(f"m{i}") for i in (10, 11, 20, 30, 40)]).where(F.col("n") == 9)
    k = F.col("sample_no")
    kind = F.when(k % 8 == 0, "Control").when(k % 8 == 7, "DM2").otherwise("DM1")
    dm1 = kind == "DM1"
    return m.select(
        _sample_id().alias("sample_id"),
        "sample_no",
        kind.alias("type"),
        F.when(k % 4 == 3, "Test").otherwise("Train").alias("set"),
        (20 + k % 50).cast("int").alias("age"),
        F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(dm1, 0.5 + F.col("m10") + F.col("m11") - F.col("m40")).alias("target_SI"),
        F.when(dm1, 50 + 100 * F.col("m20")).alias("HGS_pp_avg"),
        F.when(dm1 & (k % 13 != 5), 60 + 100 * F.col("m30")).alias("ADF_pp_avg"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction of target_SI from each spectrum of a sample that has one."""
    v = _vectors(spark, sf_dir).select("spectrum_id", _sample_id().alias("sample_id"), (0.5 + F.col("e")[10] + 0.9 * F.col("e")[11] - F.col("e")[41]).alias("pred"))
    place = spectra(spark, sf_dir).select("spectrum_id", "map_no", "rep_no")
    return v.join(samples(spark, sf_dir).where("target_SI is not null").select("sample_id", F.col("target_SI").alias("y")), "sample_id").join(place, "spectrum_id")


def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("metric"),
        F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), "Train").otherwise("Test").alias("set"),
        F.concat(F.lit("Map"), (F.col("user_id") % 3 + 1).cast("int")).alias("map"),
        F.col("value").cast("double").alias("value"),
    )


#: The same tables as DuckDB common table expressions; a query's SQL follows this text.
SQL = """
with v as (select vec_id as spectrum_id, vec_id // 9 as sample_no, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings),
named as (select *, 'S_' || case when sample_no < 10000 then lpad(cast(sample_no as varchar), 4, '0') else cast(sample_no as varchar) end as sample_id from v),
spectra as (select spectrum_id, sample_no, sample_id, cast((spectrum_id % 9) // 3 + 1 as int) as map_no, cast(spectrum_id % 3 + 1 as int) as rep_no,
  sample_id || '_Map' || ((spectrum_id % 9) // 3 + 1) || '_x.txt' as file_name,
  list_transform(range(0, len(e)), lambda i: 10 + 0.5 * i + 4 * e[i + 1]) as intensity from named),
spectra_long as (select spectrum_id, sample_id, map_no, rep_no, cast(unnest(range(0, len(intensity))) as int) as idx, unnest(intensity) as x from spectra),
axis as (select cast(i as int) as idx, case when i < 32 then 500 + 40.0 * i else 1160 + 40.0 * i end as wavenumber from (select unnest(range(0, (select max(len(e)) from v))) as i)),
means as (select sample_no, sample_id, avg(e[11]) m10, avg(e[12]) m11, avg(e[21]) m20, avg(e[31]) m30, avg(e[41]) m40 from named group by all having count(*) = 9),
kinds as (select *, case when sample_no % 8 = 0 then 'Control' when sample_no % 8 = 7 then 'DM2' else 'DM1' end as type from means),
samples as (select sample_id, sample_no, type, case when sample_no % 4 = 3 then 'Test' else 'Train' end as set, cast(20 + sample_no % 50 as int) as age,
  case when sample_no % 2 = 0 then 'F' else 'M' end as sex,
  case when type = 'DM1' then 0.5 + m10 + m11 - m40 end as "target_SI", case when type = 'DM1' then 50 + 100 * m20 end as "HGS_pp_avg",
  case when type = 'DM1' and sample_no % 13 <> 5 then 60 + 100 * m30 end as "ADF_pp_avg" from kinds),
predictions as (select n.spectrum_id, n.sample_id, s.map_no, s.rep_no, m."target_SI" as y, 0.5 + n.e[11] + 0.9 * n.e[12] - n.e[42] as pred
  from named n join samples m using (sample_id) join spectra s on s.spectrum_id = n.spectrum_id where m."target_SI" is not null),
scores_long as (select event_id as row_id, event_type as metric, case when ts < timestamp '2024-01-20' then 'Train' else 'Test' end as set,
  'Map' || cast(user_id % 3 + 1 as int) as map, cast(value as double) as value from events)
"""
