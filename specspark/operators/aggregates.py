"""Aggregates of spectra, predictions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_mean_spectra(long: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Mean of the replicates at each point: (keys, idx, x), summed before the shuffle."""
    return long.groupBy(*keys, "idx").agg(F.avg("x").alias("x"))


def as_arrays(long: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    return long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]).alias("x"))


def sample_predictions(predictions: DataFrame) -> DataFrame:
    """Mean and population deviation of a sample's predictions."""
    return predictions.groupBy("sample_id").agg(F.first("y").alias("y"), F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"), F.count("*").alias("n"))


def mccv_summary(predictions: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Null-skipping mean and deviation over the iterations that tested a sample."""
    return predictions.groupBy(*keys).agg(F.count("prediction").alias("n_tested"), F.avg("prediction").alias("pred_mean"), F.stddev_pop("prediction").alias("pred_std"))


def sample_stats(spectrum_stats: DataFrame) -> DataFrame:
    return spectrum_stats.groupBy("sample_id").agg(F.avg("pred_mean").alias("pred_mean"), F.avg("pred_std").alias("pred_std"))


def rmse_by_components(scores: DataFrame) -> DataFrame:
    return scores.groupBy("n_components").agg(F.avg("rmse").alias("rmse"), F.count("*").alias("n"))


def regression_metrics(predictions: DataFrame, keys: tuple[str, ...] = (), y: str = "y", pred: str = "pred") -> DataFrame:
    """n, rmse and r2 in one pass; r2 is null for a constant truth."""
    e2 = F.pow(F.col(y) - F.col(pred), 2)
    whole = F.var_pop(y) * F.count(y)
    return predictions.where(F.col(y).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e2)).alias("rmse"), F.when(whole > 0, 1 - F.sum(e2) / whole).alias("r2")
    )


def map_baseline(spectra: DataFrame) -> DataFrame:
    """Mean and deviation over a map's spectra of their mean intensity, and the rank of the map."""
    per = spectra.select("map_no", (F.aggregate("intensity", F.lit(0.0), lambda a, v: a + v) / F.size("intensity")).alias("b"))
    by_map = per.groupBy("map_no").agg(F.avg("b").alias("mean_baseline"), F.stddev_pop("b").alias("std_baseline"))
    return by_map.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_baseline"), "map_no")))


def head_baseline(spectra: DataFrame, points: int = 200) -> DataFrame:
    head = F.slice("intensity", 1, points)
    return spectra.select("spectrum_id", "sample_id", "map_no", (F.aggregate(head, F.lit(0.0), lambda a, v: a + v) / F.size(head)).alias("baseline"))


def quantiles(df: DataFrame, keys: tuple[str, ...], value: str, shares: dict[str, float], blocks: int = 64) -> DataFrame:
    """(keys, one column a share): exact quantiles with linear interpolation.

    Equal values are counted together; ranks come from the counts of blocks of the value range
    and the order within a block, so the values of one key are spread over many tasks.
    """
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    ends = counted.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("c").alias("n"))
    placed = counted.join(ends, keys).withColumn("block", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * blocks)).otherwise(0))
    sums = placed.groupBy(*keys, "block").agg(F.sum("c").alias("s"))
    sums = sums.select(*keys, "block", (F.sum("s").over(Window.partitionBy(*keys).orderBy("block")) - F.col("s")).alias("before"))
    inside = Window.partitionBy(*keys, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(sums, [*keys, "block"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    at = {name: (F.col("n") - 1) * p for name, p in shares.items()}
    picks = []
    for name, place in at.items():
        for tag, rank in (("a", F.floor(place)), ("b", F.ceil(place))):
            picks.append(F.min(F.when(F.col("upto") > rank, F.col("v"))).alias(f"{name}_{tag}"))
    found = ranked.groupBy(*keys).agg(F.first("n").alias("n"), *picks)
    return found.select(*keys, *[(F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (place - F.floor(place))).alias(name) for name, place in at.items()])


def box_summary(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Minimum, quartiles (linear) and maximum."""
    return quantiles(df, keys, value, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def histogram(df: DataFrame, value: str, bins: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bin, n): equal-width bins from minimum to maximum, the last closed; empty bins have n 0."""
    edges = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    joined = df.join(edges, list(keys)) if keys else df.join(edges)
    place = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).cast("int")
    counted = joined.where(F.col(value).isNotNull()).select(*keys, place.alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    spine = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def density_grid(df: DataFrame, key: str, value: str, points: int = 20) -> DataFrame:
    """(key, k, at, density): Gaussian kernel density on an even grid; bandwidth n^(-1/5) times the sample deviation."""
    stats = df.groupBy(key).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi")).where("s > 0")
    stats = stats.withColumn("h", F.pow("n", F.lit(-0.2)) * F.col("s"))
    at = [F.col("lo") + (F.col("hi") - F.col("lo")) * k / (points - 1) for k in range(points)]
    kernel = lambda k: F.exp(-F.pow((at[k] - F.col(value)) / F.col("h"), 2) / 2) / F.lit(2.5066282746310002)
    sums = df.join(stats, key).where(F.col(value).isNotNull()).groupBy(key).agg(*[F.sum(kernel(k)).alias(f"d{k}") for k in range(points)])
    grid = F.array(*[F.struct(F.lit(k).alias("k"), at[k].alias("at"), (F.col(f"d{k}") / (F.col("n") * F.col("h"))).alias("density")) for k in range(points)])
    return sums.join(stats, key).select(key, F.explode(grid).alias("g")).select(key, "g.*")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, r and its t statistic with n - 2 degrees of freedom."""
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    return one.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def moments(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def rounded(c: Column | str) -> Column:
    return F.round(c, 6)
