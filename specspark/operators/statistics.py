"""Two-sample and many-sample statistics, outlier rules. Values are reduced to moments or counts first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specspark.functions.tails import f_p, ks_p, range_critical, t_p

from .aggregates import moments, quantiles


def shift_summary(df: DataFrame, keys=("metric", "set"), value: str = "value") -> DataFrame:
    known = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    q = quantiles(df, tuple(keys), value, {"q1": 0.25, "q3": 0.75})
    return known.join(q, list(keys)).select(*keys, "n", "mean", "std", (F.col("q3") - F.col("q1")).alias("iqr"))


def shift_shape(df: DataFrame, keys=("metric", "set"), value: str = "value") -> DataFrame:
    """Bias-corrected skewness and excess kurtosis; null below 3 and 4 values."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n")
    return g.select(
        *keys,
        F.when(n >= 3, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n >= 4, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurtosis"),
    )


def ks_two_sample(df: DataFrame, key: str = "metric", value: str = "value", part: str = "set", first: str = "Train", blocks: int = 64) -> DataFrame:
    """(key, n_first, n_second, d): largest distance of the two distribution functions.

    Equal values are counted together; running counts come from blocks of the value range, so
    one key's values are spread over many tasks.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count(F.when(F.col(part) == first, 1)).alias("a"), F.count(F.when(F.col(part) != first, 1)).alias("b"))
    ends = counted.groupBy(key).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    placed = counted.join(ends, key).withColumn("block", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * blocks)).otherwise(0))
    before = Window.partitionBy(key).orderBy("block")
    sums = placed.groupBy(key, "block").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    sums = sums.select(key, "block", (F.sum("sa").over(before) - F.col("sa")).alias("pa"), (F.sum("sb").over(before) - F.col("sb")).alias("pb"))
    inside = Window.partitionBy(key, "block").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    fa = (F.col("pa") + F.sum("a").over(inside)) / F.col("na")
    fb = (F.col("pb") + F.sum("b").over(inside)) / F.col("nb")
    return placed.join(sums, [key, "block"]).withColumn("gap", F.abs(fa - fb)).groupBy(key).agg(F.first("na").alias("n_first"), F.first("nb").alias("n_second"), F.max("gap").alias("d"))


def with_ks_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", ks_p(F.col("d"), F.col("n_first").cast("double"), F.col("n_second").cast("double")))


def _two(df: DataFrame, key: str, value: str, part: str, first: str) -> DataFrame:
    m = moments(df, (key, part), value)
    a = m.where(F.col(part) == first).select(key, F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = m.where(F.col(part) != first).select(key, F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    return a.join(b, key)


def welch_t(df: DataFrame, key: str = "metric", value: str = "value", part: str = "set", first: str = "Train") -> DataFrame:
    """(key, t, df) of means with unequal variances."""
    two = _two(df, key, value, part, first)
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    return two.select(key, ((F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)).alias("t"), (F.pow(s1 + s2, 2) / (F.pow(s1, 2) / (F.col("n1") - 1) + F.pow(s2, 2) / (F.col("n2") - 1))).alias("df"))


def with_t_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", t_p(F.col("t"), F.col("df").cast("double")))


def cohen_d(df: DataFrame, key: str = "metric", value: str = "value", part: str = "set", first: str = "Train") -> DataFrame:
    """Difference of means over the root of the mean variance."""
    return _two(df, key, value, part, first).select(key, ((F.col("m1") - F.col("m2")) / F.sqrt((F.col("v1") + F.col("v2")) / 2)).alias("cohen_d"))


def anova_f(df: DataFrame, group: str = "map", value: str = "value", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, f, df_between, df_within) of a one-way analysis of variance, from the moments of the groups."""
    m = moments(df, (*keys, group), value)
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.sum("n") * grand * grand
    within = F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0)))
    one = m.groupBy(*keys).agg(between.alias("ssb"), within.alias("ssw"), F.count("*").alias("k"), F.sum("n").alias("n"))
    return one.select(*keys, (F.col("ssb") / (F.col("k") - 1) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def with_f_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", f_p(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double")))


def _pairs(df: DataFrame, group: str, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Moments of each two groups of a key; groups are few."""
    m = moments(df, (*keys, group), value)
    a = m.select(*keys, F.col(group).alias("a"), F.col("n").alias("n1"), F.col("mean").alias("m1"), F.col("var").alias("v1"))
    b = m.select(*keys, F.col(group).alias("b"), F.col("n").alias("n2"), F.col("mean").alias("m2"), F.col("var").alias("v2"))
    return a.join(b, list(keys)).where("a < b")


def pairwise_t(df: DataFrame, group: str = "map", value: str = "value", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, a, b, t, df) of pooled two-sample t tests between groups."""
    p = _pairs(df, group, value, keys)
    n1, n2 = F.col("n1"), F.col("n2")
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2)
    return p.select(*keys, "a", "b", ((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("t"), (n1 + n2 - 2).alias("df"))


def with_bonferroni(df: DataFrame, keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """p times the number of pairs of its key, not clipped."""
    return with_t_p(df).withColumn("p_bonferroni", F.col("p") * F.count("*").over(Window.partitionBy(*keys)))


def tukey_hsd(df: DataFrame, group: str = "map", value: str = "value", keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """(keys, a, b, diff, q, se, groups, df) of Tukey-Kramer comparisons."""
    m = moments(df, (*keys, group), value)
    error = m.groupBy(*keys).agg((F.sum((F.col("n") - 1) * F.col("var")) / F.sum(F.col("n") - 1)).alias("mse"), F.sum(F.col("n") - 1).alias("df"), F.count("*").alias("groups"))
    p = _pairs(df, group, value, keys).join(error, list(keys))
    p = p.withColumn("se", F.sqrt(F.col("mse") / 2 * (1 / F.col("n1") + 1 / F.col("n2")))).withColumn("diff", F.col("m2") - F.col("m1"))
    return p.select(*keys, "a", "b", "diff", (F.abs("diff") / F.col("se")).alias("q"), "se", "groups", "df")


def with_tukey_interval(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Interval and decision; the critical value of each number of groups and degrees of freedom is found once, in a task."""
    critical = df.select("groups", "df").distinct().withColumn("critical", range_critical(F.lit(alpha), "groups", "df"))
    out = df.join(critical, ["groups", "df"])
    half = F.col("critical") * F.col("se")
    return out.withColumns({"lower": F.col("diff") - half, "upper": F.col("diff") + half, "reject": F.col("q") > F.col("critical")}).drop("critical")


def outlier_flags(stats: DataFrame, std_limit: float = 0.07, error_limit: float = 0.3) -> DataFrame:
    """`stats(.., y, pred_mean, pred_std)` with abs_error and the three flags."""
    high, wrong = F.col("pred_std") > std_limit, F.abs(F.col("y") - F.col("pred_mean")) > error_limit
    return stats.withColumns({"abs_error": F.abs(F.col("y") - F.col("pred_mean")), "high_std": high, "high_error": wrong, "outlier": high & wrong})


def sigma_outliers(df: DataFrame, value: str, factor: float, population: bool, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows above mean + factor * deviation, with that limit."""
    dev = F.stddev_pop(value) if population else F.stddev_samp(value)
    limit = df.groupBy(*keys).agg((F.avg(value) + factor * dev).alias("limit"))
    joined = df.join(limit, list(keys)) if keys else df.join(limit)
    return joined.where(F.col(value) > F.col("limit"))


def domain_shift_report(df: DataFrame) -> DataFrame:
    """One row a metric of `df(metric, set, value)`: both summaries and the two-sample statistics; metrics without training values are skipped."""
    s = shift_summary(df).join(shift_shape(df), ["metric", "set"])
    side = lambda name, tag: s.where(F.col("set") == name).select("metric", *[F.col(c).alias(f"{tag}_{c}") for c in ("n", "mean", "std", "iqr", "skewness", "kurtosis")])
    ks = with_ks_p(ks_two_sample(df)).select("metric", F.col("d").alias("ks"), F.col("p").alias("ks_p"))
    tests = ks.join(with_t_p(welch_t(df)).withColumnRenamed("p", "t_p"), "metric").join(cohen_d(df), "metric")
    return side("Train", "train").join(side("Test", "test"), "metric", "left").join(tests, "metric", "left")
