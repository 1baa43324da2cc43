"""Rankings, selections, reshapes and parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most rows that a joint grid of shifts may have.
MAX_GRID = 2_000_000


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, keys: tuple[str, ...], k: int, *order) -> DataFrame:
    return df.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("r") <= k)


def best_setting(df: DataFrame, keys: tuple[str, ...], score: str, ordinal: str, columns: tuple[str, ...], largest: bool = False) -> DataFrame:
    """The row with the best score of each key; the first by `ordinal` among equals."""
    signed = -F.col(score) if largest else F.col(score)
    return df.groupBy(*keys).agg(F.min_by(F.struct(score, *columns), F.struct(signed.alias("s"), F.col(ordinal).alias("o"))).alias("b")).select(*keys, "b.*")


def unpivot(df: DataFrame, ids: tuple[str, ...], values: tuple[str, ...], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def wide_replicates(long: DataFrame, replicates: int = 9) -> DataFrame:
    """One row a sample and point with its replicates in a fixed order: (sample_id, idx, r1..)."""
    pos = ((F.col("map_no") - 1) * 3 + F.col("rep_no")).cast("int")
    return long.groupBy("sample_id", "idx").agg(*[F.max(F.when(pos == i, F.col("x"))).alias(f"r{i}") for i in range(1, replicates + 1)])


def grid(*axes: DataFrame) -> DataFrame:
    """Every combination of the rows of small parameter tables."""
    out = axes[0]
    for a in axes[1:]:
        out = out.join(a)
    return out


def combinations(items: DataFrame, most: int) -> DataFrame:
    """(k, members): all sets of 1 to `most` of `items(ordinal, item)`, members in order."""
    one = items.select(F.col("ordinal").alias("last"), F.array("item").alias("members"), F.lit(1).alias("k"))
    out, level = one, one
    step = items.select(F.col("ordinal").alias("next"), "item")
    for k in range(2, most + 1):
        level = level.join(step, F.col("next") > F.col("last")).select(F.col("next").alias("last"), F.concat("members", F.array("item")).alias("members"), F.lit(k).alias("k"))
        out = out.unionByName(level)
    return out.select("k", "members")


def uniform_intervals(points: DataFrame, intervals: int) -> DataFrame:
    """(i, s, e) of `points(p)` cut into `intervals` parts, bounds truncated to integers."""
    cut = points.select("p", F.explode(F.sequence(F.lit(0), F.lit(intervals - 1))).alias("i"))
    return cut.select("i", F.floor(F.col("i") * F.col("p") / intervals).cast("int").alias("s"), F.floor((F.col("i") + 1) * F.col("p") / intervals).cast("int").alias("e"))


def shift_grid(intervals: DataFrame, shift: int, top: int) -> DataFrame:
    """(s, e, ds, de, s2, e2): both bounds of each interval moved by -shift..shift, clamped to 0..top, empty ones dropped."""
    moves = F.sequence(F.lit(-shift), F.lit(shift))
    g = intervals.select("s", "e", F.explode(moves).alias("ds")).select("s", "e", "ds", F.explode(moves).alias("de"))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(top), c))
    return g.select("s", "e", "ds", "de", clamp(F.col("s") + F.col("ds")).alias("s2"), clamp(F.col("e") + F.col("de")).alias("e2")).where("s2 < e2")


def joint_shift_grid(intervals: list[tuple[int, int]], shift: int, top: int) -> list[list[tuple[int, int]]]:
    """All joint moves of the bounds of a combination; more than MAX_GRID raises."""
    if (2 * shift + 1) ** (2 * len(intervals)) > MAX_GRID:
        raise ValueError(f"a joint grid over {len(intervals)} intervals with shift {shift} is too large")
    out = [[]]
    for s, e in intervals:
        moved = {(max(0, min(top, s + a)), max(0, min(top, e + b))) for a in range(-shift, shift + 1) for b in range(-shift, shift + 1)}
        out = [[*x, m] for x in out for m in sorted(moved) if m[0] < m[1]]
    return out
