"""Filters, projections and joins of spectra and sample metadata. All matching is by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = ("target_SI", "HGS_pp_avg", "ADF_pp_avg")


def filter_type(meta: DataFrame, types: tuple[str, ...] = ("DM1",)) -> DataFrame:
    return meta.where(F.col("type").isin(*types))


def file_prefix(meta: DataFrame) -> DataFrame:
    """AdCo_ for controls and DM1_ for others, with the second token of the sample id."""
    token = F.split("sample_id", "_")[1]
    return meta.withColumn("file_prefix", F.concat(F.when(F.col("type") == "Control", "AdCo_").otherwise("DM1_"), token))


def impute_controls(meta: DataFrame, rule: str = "all") -> DataFrame:
    """all: SI 0 and the two percentages 100 for controls; si: SI 0; si_if_null: SI 0 where it is null."""
    control = F.col("type") == "Control"
    values = {"all": {"target_SI": 0.0, "HGS_pp_avg": 100.0, "ADF_pp_avg": 100.0}, "si": {"target_SI": 0.0}, "si_if_null": {"target_SI": 0.0}}[rule]
    if rule == "si_if_null":
        control = control & F.col("target_SI").isNull()
    return meta.withColumns({c: F.when(control, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def drop_missing_target(meta: DataFrame, columns: tuple[str, ...] = ("ADF_pp_avg",)) -> DataFrame:
    return meta.na.drop(subset=list(columns))


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """The column as a number; rows with other text are dropped."""
    return df.withColumn(column, F.col(column).try_cast("double")).where(F.col(column).isNotNull())


def complete_samples(spectra: DataFrame, replicates: int = 9) -> DataFrame:
    """Spectra of the samples with exactly `replicates` spectra."""
    full = spectra.groupBy("sample_id").agg(F.count("*").alias("n")).where(F.col("n") == replicates).select("sample_id")
    return spectra.join(full, "sample_id", "left_semi")


def region_mask(long: DataFrame, axis: DataFrame, low: float = 1800.0, high: float = 2400.0) -> DataFrame:
    """Points of `long(.., idx, x)` up to `low` or from `high` on, with their wavenumber. The axis has one row a point."""
    kept = axis.where((F.col("wavenumber") <= low) | (F.col("wavenumber") >= high))
    return long.join(kept, "idx")


def select_intervals(spectra: DataFrame, intervals: list[tuple[int, int]], column: str = "intensity") -> DataFrame:
    """Half-open index intervals of each spectrum, one after the other."""
    parts = [F.slice(column, s + 1, e - s) for s, e in intervals]
    return spectra.withColumn(column, F.concat(*parts))


def nearest_wavenumber(bounds: DataFrame, axis: DataFrame) -> DataFrame:
    """(bound, idx): the index of the wavenumber nearest to each `bounds(bound)`, the lower index on a tie.

    The axis is sorted into one array, a row as long as a spectrum; each bound searches it.
    """
    line = axis.agg(F.array_sort(F.collect_list(F.struct("idx", "wavenumber"))).alias("axis"))
    found = F.array_min(F.transform("axis", lambda p: F.struct(F.abs(p["wavenumber"] - F.col("bound")).alias("d"), p["idx"].alias("idx"))))
    return bounds.join(line).select("bound", found["idx"].alias("idx"))


def interval_labels(intervals: DataFrame, axis: DataFrame) -> DataFrame:
    """`intervals(s, e)` with the wavenumbers of their first and last point."""
    first = axis.select(F.col("idx").alias("s"), F.col("wavenumber").alias("from_wavenumber"))
    last = axis.select((F.col("idx") + 1).alias("e"), F.col("wavenumber").alias("to_wavenumber"))
    return intervals.join(first, "s").join(last, "e")


def tag(df: DataFrame, **tags: str) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in tags.items()})


def safe_name(x: Column) -> Column:
    """Lower case, runs of other characters than letters and digits become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def alignment_check(spectra: DataFrame, meta: DataFrame, required: tuple[str, ...] = ("sample_id", "type")) -> DataFrame:
    """One row: spectra, samples, spectra without metadata, samples without spectra. A missing column raises."""
    missing = [c for c in required if c not in meta.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    counts = spectra.groupBy("sample_id").agg(F.count("*").alias("n"))
    both = counts.join(meta.select("sample_id", F.lit(1).alias("known")), "sample_id", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_spectra"),
        F.count("known").alias("n_samples"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("n_unlabelled"),
        F.count(F.when(F.col("n").isNull(), 1)).alias("n_without_spectra"),
    )


def join_metadata(spectra: DataFrame, meta: DataFrame) -> DataFrame:
    return spectra.join(meta, "sample_id")


def semi_join_valid(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files of known samples; none at all raises."""
    out = files.join(meta.select("sample_id"), "sample_id", "left_semi")
    if not out.head(1):
        raise ValueError("no file belongs to a known sample")
    return out


def substring_join(files: DataFrame, ids: DataFrame, theta: bool = False) -> DataFrame:
    """Files whose name holds a sample id at any place, so an id that begins another one counts too.

    Joined by key: a name has one piece for each place and each length that an id has. With
    `theta` every name is compared with every id, which is for short lists.
    """
    ids = ids.select(F.col("sample_id").alias("_id")).where("_id is not null").distinct()
    if theta:
        return files.join(ids, F.col("file_name").contains(F.col("_id")), "left_semi")
    lengths = [r[0] for r in ids.select(F.length("_id")).distinct().collect()]  # at most the length of the longest id
    size, none = F.length("file_name"), F.array().cast("array<string>")

    def pieces(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))
        return F.when(size >= n, F.transform(starts, lambda i: F.substring(F.col("file_name"), i, F.lit(n)))).otherwise(none)

    names = files.select("file_name").where("file_name is not null").distinct()
    held = names.select("file_name", F.explode(F.array_distinct(F.concat(none, *map(pieces, lengths)))).alias("_id")).join(ids, "_id", "left_semi").select("file_name").distinct()
    return files.join(held, "file_name", "left_semi")


def split_membership(everything: DataFrame, train: DataFrame) -> DataFrame:
    """`everything(sample_id, ..)` with part: train or validation."""
    known = train.select("sample_id").distinct().withColumn("_in", F.lit(True))
    return everything.join(known, "sample_id", "left").withColumn("part", F.when(F.col("_in"), "train").otherwise("validation")).drop("_in")


def samples_with_all_maps(spectra: DataFrame, maps: list[int]) -> DataFrame:
    """Relational division: samples that have every one of the maps."""
    return spectra.where(F.col("map_no").isin(maps)).groupBy("sample_id").agg(F.count_distinct("map_no").alias("n")).where(F.col("n") == len(set(maps))).select("sample_id")


def expand_labels(spectra: DataFrame, meta: DataFrame, target: str, maps: list[int]) -> DataFrame:
    """One row with the sample's target for each spectrum of the chosen maps."""
    return spectra.where(F.col("map_no").isin(maps)).join(meta.where(F.col(target).isNotNull()).select("sample_id", F.col(target).alias("y")), "sample_id").select("spectrum_id", "sample_id", "map_no", "y")
