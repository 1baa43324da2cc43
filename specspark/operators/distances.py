"""Distances between samples, farthest and nearest ones, by pairs of blocks that bounds cannot rule out.

Rows are dealt to the nearest of a few pivots and packed in blocks of bounded size. A block knows its
centre, its radius and its range of targets, so the triangle inequality bounds all distances
between two blocks; only pairs of blocks that can hold what is asked for meet in a task, as one
matrix product. The product form is a filter: what it leaves close is computed again from the differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

#: Rows and bytes of a block; pivots; numbers that one step of exact distances takes; pairs that a task gives at once.
BLOCK, BLOCK_BYTES, PIVOTS, EXACT, PAIRS = 2048, 4 << 20, 256, 1 << 22, 1 << 17


def _distance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Euclidean distances in product form, and how far they may be off."""
    centre = x.mean(axis=0) if len(x) else 0.0
    x, y = x - centre, y - centre
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d2 = xx[:, None] + yy[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(d2, 0)), float(np.sqrt(1e-14 * (xx.max(initial=0) + yy.max(initial=0)))) + 1e-12


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of x[i] and y[j] from their differences."""
    out, step = np.empty(len(i)), max(1, EXACT // max(1, x.shape[1]))
    for k in range(0, len(i), step):
        d = x[i[k : k + step]] - y[j[k : k + step]]
        out[k : k + step] = np.sqrt((d * d).sum(1))
    return out


def blocks_of(rows: DataFrame) -> DataFrame:
    """(block, n, ids, x, y, centre, radius, low, high): `rows(id, x array, y)` in blocks around pivots; x and y as bytes.

    Rows with a null spectrum are in no block. The pivots, PIVOTS rows at most, are on the driver.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    if not hasattr(rows, "settled_at"):
        rows = settled(rows.select("id", "x", F.col("y").cast("double").alias("y")), "samples")
    rows = rows.where("x is not null")
    n, points = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, points or 1))))
    wanted = min(PIVOTS, -(-n // most))
    pivots = rows.select("x", F.xxhash64("id").alias("h")).orderBy("h").limit(wanted).collect() if wanted > 1 else []
    shared = spark.sparkContext.broadcast(np.array([r["x"] for r in pivots], float))

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                cell = _distance(np.stack(pdf.x.to_list()), shared.value)[0].argmin(axis=1)
                yield pdf.assign(cell=cell.astype(np.int32))

    dealt = rows if len(pivots) < 2 else rows.mapInPandas(deal, f"id {kind}, x array<double>, y double, cell int")
    dealt = dealt if len(pivots) > 1 else dealt.withColumn("cell", F.lit(0))
    parts = dealt.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = dealt.join(F.broadcast(parts), "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, y = np.stack(pdf.x.to_list()), pdf.y.to_numpy(float)
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1)).max())
        row = {"block": (int(key[0]) << 32) | int(key[1]), "n": len(pdf), "ids": pdf.id.to_numpy(), "x": x.tobytes(), "y": y.tobytes(), "centre": centre, "radius": radius, "low": float(np.nanmin(y)) if not np.isnan(y).all() else 0.0, "high": float(np.nanmax(y)) if not np.isnan(y).all() else 0.0}
        return pd.DataFrame([row])

    schema = f"block long, n int, ids array<{kind}>, x binary, y binary, centre array<double>, radius double, low double, high double"
    return settled(dealt.groupBy("cell", "sub").applyInPandas(pack, schema), "blocks")


def _bounds(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
    """(i, j, n, near, far, dy): bounds of the distances between blocks, from one row a block; of one table each pair once."""
    side = lambda df, k: df.select(*[F.col(c).alias(f"{k}_{c}") for c in ("block", "n", "centre", "radius", "low", "high")])
    pairs = side(left, "l").join(side(right, "r"), F.col("l_block") <= F.col("r_block") if same else F.lit(True))
    gap = F.sqrt(F.aggregate(F.zip_with("l_centre", "r_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v))
    both = F.col("l_radius") + F.col("r_radius")
    dy = F.greatest(F.col("l_high") - F.col("r_low"), F.col("r_high") - F.col("l_low"))
    return pairs.select(F.col("l_block").alias("i"), F.col("r_block").alias("j"), F.col("r_n").alias("n"), F.greatest(F.lit(0.0), gap - both - 1e-9).alias("near"), (gap + both + 1e-9).alias("far"), dy.alias("dy"))


def _met(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs (i, j) with the rows of both blocks, spread over tasks by their bytes."""
    side = lambda df, k, key: df.select(F.col("block").alias(key), *[F.col(c).alias(f"{k}_{c}") for c in ("n", "ids", "x", "y")])
    return pairs.select("i", "j").join(side(left, "l", "i"), "i").join(side(right, "r", "j"), "j").repartition("i", "j")


def _sides(row):
    """(ids, x, y) of both blocks of a pair."""
    for k in ("l", "r"):
        n = getattr(row, f"{k}_n")
        yield np.asarray(getattr(row, f"{k}_ids")), np.frombuffer(getattr(row, f"{k}_x")).reshape(n, -1), np.frombuffer(getattr(row, f"{k}_y"))


def pairwise_distance(samples: DataFrame, x: str = "x", y: str = "y", within: float | None = None) -> DataFrame:
    """(a, b, dx, dy, d) for all a < b of `samples(sample_id, x array, y double)`; d = dx + dy, unscaled Euclidean.

    With `within` only pairs with d up to it, and only blocks that can hold such; without it the
    result has a row for every pair of samples.
    """
    blocks = blocks_of(samples.select(F.col("sample_id").alias("id"), F.col(x).alias("x"), F.col(y).alias("y")))
    pairs = _bounds(blocks, blocks, True)
    pairs = pairs if within is None else pairs.where(F.col("near") <= within)

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                (li, lx, ly), (ri, rx, ry) = _sides(row)
                step = max(1, PAIRS // len(ri))
                for lo in range(0, len(li), step):
                    x, y, ids = lx[lo : lo + step], ly[lo : lo + step], li[lo : lo + step]
                    dx, off = _distance(x, rx)
                    dy = np.abs(y[:, None] - ry[None, :])
                    keep = np.ones(dx.shape, bool) if within is None else dx + dy <= within + off
                    i, j = np.nonzero(keep & (np.arange(lo, lo + len(x))[:, None] < np.arange(len(ri))[None, :])) if row.i == row.j else np.nonzero(keep)
                    found = dx[i, j]
                    close = found <= 100 * off
                    found[close] = _exact(x, rx, i[close], j[close])
                    a, b = ids[i], ri[j]
                    swap = a > b
                    out = pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "dx": found, "dy": dy[i, j]})
                    yield out if within is None else out[out.dx + out.dy <= within]

    got = _met(pairs, blocks, blocks).mapInPandas(solve, "a string, b string, dx double, dy double")
    return got.withColumn("d", F.col("dx") + F.col("dy"))


def farthest(blocks: DataFrame, wx: float = 1.0, wy: float = 1.0) -> DataFrame:
    """(sample_id, d): the samples of `blocks` that have the largest of all distances wx * dx + wy * dy, or one within 1e-8 of it."""
    got = settled(far_rows(blocks, wx, wy), "farthest")
    top = got.agg(F.max("d")).first()[0]
    return got.where(F.col("d") >= F.lit(top) - 1e-8) if top is not None else got


def far_rows(blocks: DataFrame, wx: float, wy: float) -> DataFrame:
    """(sample_id, d): the samples of `farthest` and others with large distances.

    A distance that some rows reach, found from one row of each block, rules out most pairs of blocks.
    """
    spark, kind = blocks.sparkSession, dict(blocks.dtypes)["ids"][6:-1]
    own = blocks.select("block", "centre", F.substring("x", 1, 8 * F.size("centre")).alias("x"), F.substring("y", 1, 8).alias("y"))
    reached = 0.0
    if blocks.count() > 1:
        some = own.orderBy(F.xxhash64("block")).limit(PIVOTS).collect()
        px, py = np.stack([np.frombuffer(r["x"]) for r in some]), np.array([np.frombuffer(r["y"])[0] for r in some])
        pivots = spark.sparkContext.broadcast((px, py))

        def reach(batches):
            for pdf in batches:
                best = 0.0
                for row in pdf.itertuples(index=False):
                    dx, off = _distance(np.frombuffer(row.x).reshape(row.n, -1), pivots.value[0])
                    best = max(best, float((wx * (dx - off) + wy * np.abs(np.frombuffer(row.y)[:, None] - pivots.value[1][None, :])).max()))
                yield pd.DataFrame({"d": [best]})

        reached = blocks.select("n", "x", "y").mapInPandas(reach, "d double").agg(F.max("d")).first()[0] or 0.0
    pairs = _bounds(blocks, blocks, True).where(wx * F.col("far") + wy * F.col("dy") >= reached - 1e-8)

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                (li, lx, ly), (ri, rx, ry) = _sides(row)
                dx, off = _distance(lx, rx)
                d = wx * dx + wy * np.abs(ly[:, None] - ry[None, :])
                i, j = np.nonzero(d >= max(float(d.max()), reached) - 1e-8 - 2 * wx * off)
                exact = wx * _exact(lx, rx, i, j) + wy * np.abs(ly[i] - ry[j])
                yield pd.DataFrame({"sample_id": np.concatenate([li[i], ri[j]]), "d": np.concatenate([exact, exact])})

    return _met(pairs, blocks, blocks).mapInPandas(solve, f"sample_id {kind}, d double").groupBy("sample_id").agg(F.max("d").alias("d"))


def nearest_neighbours(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, y, d, r): the k nearest rows of `train(id, x, y)` to each row of `test(id, x)`, ties by id.

    A pair of blocks is left out if it is farther off than blocks that hold k rows for every row of the test block.
    """
    left, right = blocks_of(test.select("id", "x", F.lit(None).cast("double").alias("y"))), blocks_of(train.select("id", "x", "y"))
    pairs = settled(_bounds(left, right, False), "bounds")
    held = F.sum("n").over(Window.partitionBy("i").orderBy("far", "j"))
    enough = pairs.withColumn("held", held).where(F.col("held") >= k).groupBy("i").agg(F.min("far").alias("enough"))
    pairs = pairs.join(enough, "i", "left").where(F.col("enough").isNull() | (F.col("near") <= F.col("enough")))

    def solve(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                (li, lx, _), (ri, rx, ry) = _sides(row)
                d, off = _distance(lx, rx)
                most = min(k, len(ri))
                i, j = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1 : most] + 2 * off + 1e-8)
                exact = _exact(lx, rx, i, j)
                order = np.lexsort((j, np.round(exact, 9), i))  # the rows of a block are in order of their ids
                i, j, exact = i[order], j[order], exact[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pd.DataFrame({"id": li[i[keep]], "neighbour": ri[j[keep]], "y": ry[j[keep]], "d": exact[keep]})

    kind = dict(test.dtypes)["id"], dict(train.dtypes)["id"]
    found = _met(pairs, left, right).mapInPandas(solve, f"id {kind[0]}, neighbour {kind[1]}, y double, d double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("d", 9), "neighbour"))
    return found.withColumn("r", rank).where(F.col("r") <= k)


def knn_predict(test: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(id, pred): mean target of the k nearest neighbours."""
    return nearest_neighbours(test, train, k).groupBy("id").agg(F.avg("y").alias("pred"))
