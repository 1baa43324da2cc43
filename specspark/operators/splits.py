"""Splits of samples: by distance, by group folds, by repeated random draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, numbered, settled, shared_path

#: Rows from which one round picks; they are compared with the picks of their round on the driver.
CANDIDATES = 1024


def spxy_split(samples: DataFrame, ratio: float = 0.8, scaled: bool = False) -> DataFrame:
    """(sample_id, part, pick): `samples(sample_id, x array, y)` split by max-min distance in x plus y.

    int(ratio * n) samples are train, in the order of `pick`; the rest is validation with null
    pick, and so are samples with a null spectrum, which are not counted in n. Ties go to the
    smaller sample_id. `scaled` divides both distances by their largest.

    The first pick is the sample of the largest distance. From then on each sample keeps its
    least distance to the picks, a number in a table of its own beside the packed spectra, which
    are written once. Least distances only fall, so the CANDIDATES samples with the largest ones
    hold the next picks as long as their own stay above those of all others: each round brings
    these rows to the driver, picks as many as that proves, and appends them to the table of picks.
    """
    from .distances import blocks_of, far_rows

    spark, kind = samples.sparkSession, dict(samples.dtypes)["sample_id"]
    rows = settled(samples.select(F.col("sample_id").alias("id"), "x", F.col("y").cast("double").alias("y")), "samples")
    blocks = blocks_of(rows)
    n, low, high = blocks.agg(F.sum("n"), F.min("low"), F.max("high")).first()
    n_train = int(ratio * (n or 0))
    path, picked, new, state = shared_path(spark, "picks"), 0, [], None
    picks_schema = f"sample_id {kind}, pick long"
    wx, wy = 1.0, 1.0
    if n_train:
        if scaled:
            far = far_rows(blocks, 1.0, 0.0).agg(F.max("d")).first()[0]
            wx, wy = 1.0 / (far or 1.0), 1.0 / ((high - low) or 1.0)
        first = far_rows(blocks, wx, wy).orderBy(F.desc(F.round("d", 9)), "sample_id").first()
        new = _rows_of(blocks, [first["sample_id"]])
    while new:
        spark.createDataFrame([(r["id"], picked + k) for k, r in enumerate(new)], picks_schema).coalesce(1).write.mode("append").parquet(path)
        picked += len(new)
        if picked == n_train:
            break
        last, state = state, settled(_lowered(blocks, state, new, wx, wy, kind), "state")
        if last is not None:
            discard(last)
        top = state.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc(F.round("least", 9)), "id").limit(CANDIDATES + 1).collect()
        bound = (-round(top[-1]["least"], 9), top[-1]["id"]) if len(top) > CANDIDATES else (np.inf, "")  # all others come after it
        least = {r["id"]: r["least"] for r in top[:CANDIDATES]}
        pool = sorted(_rows_of(blocks, list(least)), key=lambda r: r["id"])
        x, y, far_off = np.array([r["x"] for r in pool]), np.array([r["y"] for r in pool]), np.array([least[r["id"]] for r in pool], float)
        new = []
        while picked + len(new) < n_train and len(new) < len(pool):
            k = int(np.argmax(np.round(far_off, 9)))
            if new and (-round(float(far_off[k]), 9), pool[k]["id"]) > bound:
                break
            new.append(pool[k])
            far_off = np.minimum(far_off, wx * np.sqrt(((x - x[k]) ** 2).sum(axis=1)) + wy * np.abs(y - y[k]))
            far_off[k] = -np.inf
    found = spark.read.schema(picks_schema).parquet(path) if picked else spark.createDataFrame([], picks_schema)
    part = F.when(F.col("pick").isNotNull(), "train").otherwise("validation").alias("part")
    return rows.select(F.col("id").alias("sample_id")).join(found, "sample_id", "left").select("sample_id", part, "pick")


def _rows_of(blocks: DataFrame, ids: list) -> list:
    """The rows (id, x, y) of `blocks` with these ids, at most CANDIDATES."""
    kind = dict(blocks.dtypes)["ids"][6:-1]
    wanted = blocks.sparkSession.sparkContext.broadcast(set(ids))

    def pick(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                at = [k for k, i in enumerate(row.ids) if i in wanted.value]
                if at:
                    x, y = np.frombuffer(row.x).reshape(row.n, -1), np.frombuffer(row.y)
                    yield pd.DataFrame({"id": [row.ids[k] for k in at], "x": list(x[at]), "y": y[at]})

    return blocks.select("n", "ids", "x", "y").mapInPandas(pick, f"id {kind}, x array<double>, y double").collect()


def _lowered(blocks: DataFrame, state: DataFrame | None, picks: list, wx: float, wy: float, kind: str) -> DataFrame:
    """(block, least binary, top): the least distances of the rows of each block to all picks so far, and the largest of them.

    A picked row has none. The product form tells which of the new picks can be the nearest
    one or be nearer than all before; only those distances are computed from the differences.
    """
    from .distances import _distance, _exact

    shared = blocks.sparkSession.sparkContext.broadcast((np.array([r["x"] for r in picks], float), np.array([r["y"] for r in picks], float), {r["id"] for r in picks}))

    def lower(batches):
        px, py, ids = shared.value
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, y = np.frombuffer(row.x).reshape(row.n, -1), np.frombuffer(row.y)
                least = np.full(row.n, np.inf) if row.least is None else np.frombuffer(row.least).copy()
                dx, off = _distance(x, px)
                d = wx * dx + wy * np.abs(y[:, None] - py[None, :])
                i, j = np.nonzero(d <= np.minimum(d.min(axis=1), least)[:, None] + 2 * wx * off)
                np.minimum.at(least, i, wx * _exact(x, px, i, j) + wy * np.abs(y[i] - py[j]))
                least[[k for k, v in enumerate(row.ids) if v in ids]] = -np.inf
                order = np.argsort(-np.round(least, 9), kind="stable")[: CANDIDATES + 1]  # the rows of a block are in order of their ids
                top = [(float(least[k]), row.ids[k]) for k in order if least[k] > -np.inf]
                yield pd.DataFrame({"block": [row.block], "least": [least.tobytes()], "top": [top]})

    before = blocks.select("block", "n", "ids", "x", "y")
    before = before.withColumn("least", F.lit(None).cast("binary")) if state is None else before.join(state.select("block", "least"), "block")
    return before.mapInPandas(lower, f"block long, least binary, top array<struct<least:double,id:{kind}>>")


def group_folds(spectra: DataFrame, folds: int = 5) -> DataFrame:
    """(sample_id, fold): all spectra of a sample are in one fold; samples go round in order of their id."""
    return numbered(spectra.select("sample_id").distinct(), "sample_id").select("sample_id", (F.col("position") % folds).cast("int").alias("fold"))


def mc_splits(units: DataFrame, key: str, iterations: int, test_share: float = 0.2, seed: int = 42, cases: tuple[str, ...] = ()) -> DataFrame:
    """(cases, iter, key, part): in each iteration the ceil(share * n) units with the smallest md5 of key and seed are test.

    `cases` are columns of `units` that are drawn by themselves. Hashes are counted by their first
    digits; only the units of the range in which the draw ends are sorted, which gives the last test
    unit. So what tasks share is a row for each case and iteration, a unit is compared with it in
    place, and no table of all draws is joined, gathered or moved.
    """
    units = settled(units.select(*cases, key).na.drop(subset=list(cases)) if cases else units.select(key), "units")
    sizes = units.groupBy(*cases).agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    digits = 1
    while 16**digits * (256 if digits < 2 else 65536) < largest:  # each task has a count for each range and iteration
        digits += 1
    tasks = 2 * units.sparkSession.sparkContext.defaultParallelism  # a narrow table in one file is a row for each iteration of each unit
    drawn = units.repartition(tasks, key).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    drawn = drawn.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit("_"), (F.col("iter") + seed).cast("string"))))
    ranged = drawn.withColumn("range", F.substring("h", 1, digits))
    by = [*cases, "iter"]
    ranges = ranged.groupBy(*by, "range").agg(F.count("*").alias("in_range"))
    own = Window.partitionBy(*by)
    ranges = ranges.withColumn("before", F.sum("in_range").over(own.orderBy("range")) - F.col("in_range")).withColumn("wanted", F.ceil(F.lit(test_share) * F.sum("in_range").over(own)))
    ends = ranges.where((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("in_range"))).select(*by, "range", (F.col("wanted") - F.col("before")).alias("left"))
    r = F.row_number().over(Window.partitionBy(*by).orderBy("h", key))
    last = ranged.join(F.broadcast(settled(ends, "ranges")), [*by, "range"]).withColumn("r", r).where("r = left")
    last = settled(last.select(*by, F.col("h").alias("last_h"), F.col(key).alias("last_key")), "ends")
    # an iteration without a last one has no test unit
    met = drawn.join(F.broadcast(last), by, "left")
    test = (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.col(key) <= F.col("last_key")))
    return met.select(*by, key, F.when(test, "test").otherwise("train").alias("part"))
