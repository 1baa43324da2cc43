"""Monte-Carlo validation by passes over blocks of rows, for any number of rows and points.

A cell is a chain, a case and an iteration. Its model needs sums over its training rows only: means
and variances of the points, then for each component what one weight vector gives. One pass
over the rows makes the sums of many cells at once, each a few matrix products of a block of rows
and the cells' vectors; tasks add up what their blocks give, and the sums of a pass, as large as the
axis times the cells of a round, make the next vectors. No task holds the table and no matrix
of points by points or rows by rows is made.

EMSC depends on the cell, as its reference is the mean of the cell's training rows. But it changes a
row x by an offset and a factor only: x becomes a * u + b * e with u and e the same for all
cells, and so does every step after it. The factors are what a pass computes anew for each cell.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specspark.functions.spectral import STEPS, preprocess_chain, savgol_matrix

from .shared import settled

#: Rows and bytes of a block, and rows that are worth one of their own; cells of a group; bytes of the vectors of one round.
BLOCK_ROWS, BLOCK_BYTES, LEAST_ROWS, GROUP, ROUND_BYTES = 4096, 16 << 20, 64, 256, 64 << 20


def name_of(chain: list[str]) -> str:
    return "+".join(chain) or "none"


def _before(chain: list[str]) -> list[str]:
    """The steps that do not depend on the cell."""
    return chain[: chain.index("emsc")] if "emsc" in chain else chain


def _blocks(spectra: DataFrame, tests: DataFrame, chains: list[list[str]], unit: str, cases: list[str], iterations: dict[str, list]) -> DataFrame:
    """(block, n, x<v> binary, defined<v> binary, y<j> binary, test<j> binary, spectrum_id, sample_id): rows in blocks, once.

    x<v>: the rows after the steps of start v of a chain. y<j>: targets of case j, nan where it has
    none; test<j>: a bit for each row and iteration of case j. The spectra of a sample lie together,
    but for samples of more than an eighth of a block; few rows lie in blocks enough for all cores.
    """
    # merge joins: a map of iterations is far larger than what Spark takes it for before it has run
    rows = settled(spectra.select("spectrum_id", "sample_id", F.col(unit).alias("unit"), "x", "cases").join(tests.hint("merge"), "unit", "left"), "rows")
    shape = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, shape[1] or 1))))
    tasks = 2 * spectra.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(-(-shape[0] // most), min(tasks, -(-shape[0] // LEAST_ROWS))) or 1
    large = rows.groupBy("sample_id").agg(F.count("*").alias("large")).where(F.col("large") > max(1, most // 8))
    together = F.col("large").isNull() & F.col("sample_id").isNotNull()
    place = F.when(together, F.xxhash64("sample_id")).otherwise(F.xxhash64("spectrum_id"))
    dealt = rows.join(F.broadcast(large), "sample_id", "left").withColumn("block", F.pmod(place, F.lit(n_blocks)).cast("int"))
    dealt = dealt.drop("large", "unit").repartition(max(tasks, n_blocks // 8), "block")  # before the steps: only x as it is moves
    variants, points = sorted({tuple(_before(c)) for c in chains}), shape[1] or 0
    for v, steps in enumerate(variants):
        dealt = preprocess_chain(dealt.withColumn(f"x{v}", F.col("x")), list(steps), f"x{v}")
    dealt, kinds = dealt.drop("x"), dict(spectra.dtypes)

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"block": key[0], "n": len(pdf), "spectrum_id": pdf.spectrum_id.to_numpy(), "sample_id": pdf.sample_id.to_numpy()}
        for v in range(len(variants)):
            own = pdf[f"x{v}"]
            defined = own.notna().to_numpy()
            x = np.zeros((len(pdf), points))
            if defined.any():
                x[defined] = np.stack(own[defined].to_list())
            row |= {f"x{v}": x.tobytes(), f"defined{v}": defined.tobytes()}
        for j, case in enumerate(cases):
            at = {it: k for k, it in enumerate(iterations[case])}
            held = np.zeros((len(pdf), len(at)), bool)
            for i, own in enumerate(pdf.tests):
                mine = dict(own).get(case) if own is not None else None
                if mine is not None:
                    held[i, [at[it] for it in mine]] = True
            known = [dict(c).get(case) for c in pdf.cases]
            row |= {f"y{j}": np.array([np.nan if v is None else v for v in known], float).tobytes(), f"test{j}": np.packbits(held, axis=1).tobytes()}
        return pd.DataFrame([row])

    per_start = ", ".join(f"x{v} binary, defined{v} binary" for v in range(len(variants)))
    per_case = ", ".join(f"y{j} binary, test{j} binary" for j in range(len(cases)))
    schema = f"block int, n int, spectrum_id array<{kinds['spectrum_id']}>, sample_id array<{kinds['sample_id']}>, {per_start}, {per_case}"
    return settled(dealt.groupBy("block").applyInPandas(pack, schema), "blocks")


class _Rows:
    """The rows `of` a block that have a target under the cells of a group: every row is a * u + b * e."""

    def __init__(self, row, group: dict, reference: np.ndarray | None):
        n, j, v = int(row.n), group["case_no"], group["variant"]
        y = np.frombuffer(getattr(row, f"y{j}"))
        self.of = np.nonzero(~np.isnan(y))[0]
        x = np.frombuffer(getattr(row, f"x{v}")).reshape(n, -1)[self.of]
        width = group["iterations"]
        self.test = np.unpackbits(np.frombuffer(getattr(row, f"test{j}"), np.uint8).reshape(n, -1)[self.of], axis=1)[:, :width].astype(bool)[:, group["lo"] : group["hi"]]
        self.defined = np.repeat(np.frombuffer(getattr(row, f"defined{v}"), bool)[self.of, None], self.test.shape[1], axis=1)
        self.u, self.e, self.y = x, np.zeros(x.shape[1]), y[self.of]
        self.a = self.b = None
        if reference is not None:
            self._emsc(reference, group["after"])
        self.train = (~self.test & self.defined).astype(float)

    def _emsc(self, reference: np.ndarray, after: list[str]) -> None:
        u, e = self.u - self.u.mean(axis=1, keepdims=True), np.ones(self.u.shape[1])
        level = reference.mean(axis=1)
        centred = reference - level[:, None]
        spread = (centred * centred).sum(axis=1)
        slope = u @ (centred / np.where(spread > 0, spread, 1.0)[:, None]).T
        self.defined &= (slope != 0) & (spread > 0)[None, :]
        a, b = 1 / np.where(self.defined, slope, 1.0), np.repeat(level[None, :], len(u), axis=0)
        for step in after:
            if step in ("second_derivative", "baseline"):
                size = len(e)
                linear = savgol_matrix(size, 11, 2, 2) if step == "second_derivative" else np.eye(size) - savgol_matrix(size, 51, 3, 0)
                u, e = u @ linear.T, linear @ e
                continue
            if step == "emsc":
                raise ValueError("a chain may have one emsc step")
            if step == "snv":
                u, e = u - u.mean(axis=1, keepdims=True), e - e.mean()
            square = a * a * (u * u).sum(axis=1)[:, None] + 2 * a * b * (u @ e)[:, None] + b * b * (e @ e)
            norm = np.sqrt(np.maximum(square, 0) / (len(e) if step == "snv" else 1))
            if step == "snv":
                self.defined &= norm > 0
            norm = np.where(norm > 0, norm, 1.0)
            a, b = a / norm, b / norm
        self.u, self.e, self.a, self.b = u, e, a, b

    def times(self, vectors: np.ndarray) -> np.ndarray:
        """Each row times the vector of each cell."""
        dot = self.u @ vectors.T
        return dot if self.a is None else self.a * dot + self.b * (vectors @ self.e)[None, :]

    def total(self, weights: np.ndarray) -> np.ndarray:
        """[cell, point]: the sum of the rows by the weights [row, cell]."""
        if self.a is None:
            return weights.T @ self.u
        return (weights * self.a).T @ self.u + (weights * self.b).sum(axis=0)[:, None] * self.e[None, :]

    def squares(self, weights: np.ndarray) -> np.ndarray:
        if self.a is None:
            return weights.T @ (self.u * self.u)
        cross = 2 * (weights * self.a * self.b).T @ self.u * self.e[None, :]
        return (weights * self.a**2).T @ (self.u * self.u) + cross + (weights * self.b**2).sum(axis=0)[:, None] * (self.e**2)[None, :]


def _sums(blocks: DataFrame, groups: list[dict], vectors: list[dict], kind: str) -> list[np.ndarray]:
    """What one pass over the rows gives for each group: an array [cell, numbers]."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((groups, vectors))

    def part(row, group, own):
        rows = _Rows(row, group, own.get("reference"))
        w = rows.train
        if kind == "reference":
            return np.column_stack([w.sum(axis=0), rows.total(w)])
        if kind == "moments":
            y = rows.y[:, None]
            return np.column_stack([w.sum(axis=0), (w * y).sum(axis=0), (w * y * y).sum(axis=0), rows.total(w), rows.squares(w), rows.total(w * y)])
        t = (rows.times(own["weights"]) - own["offset"][None, :]) * w
        return np.column_stack([(t * t).sum(axis=0), t.sum(axis=0), rows.total(t)])

    def run(batches):
        all_groups, all_vectors = shared.value
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                for k, (group, own) in enumerate(zip(all_groups, all_vectors, strict=True)):
                    found = part(row, group, own)
                    sums[k] = sums[k] + found if k in sums else found
        yield pd.DataFrame({"group": list(sums), "sums": [x.tobytes() for x in sums.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"group": pdf.group[:1], "sums": [np.sum([np.frombuffer(x) for x in pdf.sums], axis=0).tobytes()]})

    schema = "group int, sums binary"
    # each task has sums of every group, so there are only as many tasks as cores
    found = blocks.coalesce(spark.sparkContext.defaultParallelism).mapInPandas(run, schema).groupBy("group").applyInPandas(add, schema).collect()
    shared.unpersist()
    out: list = [None] * len(groups)
    for r in found:
        out[r["group"]] = np.frombuffer(r["sums"]).reshape(groups[r["group"]]["hi"] - groups[r["group"]]["lo"], -1)
    return out


def _rounds(groups: list[dict], points: int):
    """Groups whose vectors together have ROUND_BYTES at most, one group at least."""
    most = max(GROUP, ROUND_BYTES // (8 * 4 * max(1, points)))
    own, cells = [], 0
    for g in groups:
        if own and cells + g["hi"] - g["lo"] > most:
            yield own
            own, cells = [], 0
        own.append(g)
        cells += g["hi"] - g["lo"]
    if own:
        yield own


def _models(blocks: DataFrame, groups: list[dict], components: int) -> list[dict]:
    """For each group the vectors and offsets that give the predictions: partial least squares on auto-scaled rows.

    The driver holds the vectors of one round; each component is one pass.
    """
    vectors: list[dict] = [{} for _ in groups]
    needs = [k for k, g in enumerate(groups) if g["emsc"]]
    if needs:
        found = _sums(blocks, [groups[k] for k in needs], [{} for _ in needs], "reference")
        for k, s in zip(needs, found, strict=True):
            vectors[k]["reference"] = s[:, 1:] / np.maximum(s[:, :1], 1)
    state = []
    for s in _sums(blocks, groups, vectors, "moments"):
        p = (s.shape[1] - 3) // 3
        n, sy, syy = s[:, 0], s[:, 1], s[:, 2]
        sx, sxx, sxy = s[:, 3 : 3 + p], s[:, 3 + p : 3 + 2 * p], s[:, 3 + 2 * p :]
        safe = np.maximum(n, 1)[:, None]
        mean, level = sx / safe, sy / safe[:, 0]
        square = sxx - safe * mean**2
        varies = square > 1e-12 * np.maximum(sxx, 1e-300)
        scale = np.where(varies, np.sqrt(np.maximum(square, 0) / np.maximum(safe - 1, 1)), 1.0)
        xy = np.where(varies, (sxy - mean * sy[:, None]) / scale, 0.0)
        deviation = np.sqrt(np.maximum(syy - safe[:, 0] * level**2, 0) / np.maximum(safe[:, 0] - 1, 1))
        floor = 1e-12 * np.maximum(np.where(varies, square / scale**2, 0.0).sum(axis=1), 1e-300)
        least = 1e-12 * np.maximum(safe[:, 0] * deviation, 1e-300)
        state.append({"n": n, "mean": mean, "level": level, "scale": scale, "varies": varies, "xy": xy, "floor": floor, "least": least, "going": n > 1, "coef": np.zeros_like(mean), "r": [], "p": []})
    for _ in range(components):
        for s, v in zip(state, vectors, strict=True):
            norm = np.linalg.norm(s["xy"], axis=1)
            s["going"] = s["going"] & (norm > s["least"])
            r = s["xy"] / np.where(s["going"], norm, 1.0)[:, None]
            for p, before in zip(s["p"], s["r"], strict=True):
                r = r - (p * r).sum(axis=1)[:, None] * before
            s["now"] = r * s["going"][:, None]
            v["weights"] = s["now"] / s["scale"]
            v["offset"] = (v["weights"] * s["mean"]).sum(axis=1)
        if not any(s["going"].any() for s in state):
            break
        for s, sums in zip(state, _sums(blocks, groups, vectors, "component"), strict=True):
            tt, t = sums[:, 0], sums[:, 1]
            s["going"] = s["going"] & (tt > s["floor"])
            safe = np.where(s["going"], tt, 1.0)
            g = np.where(s["varies"], (sums[:, 2:] - s["mean"] * t[:, None]) / s["scale"], 0.0)
            r = s["now"] * s["going"][:, None]
            load, y = g / safe[:, None] * s["going"][:, None], (r * s["xy"]).sum(axis=1) / safe
            s["xy"] = s["xy"] - load * (safe * y)[:, None]
            s["coef"] = s["coef"] + r * y[:, None]
            s["r"].append(r)
            s["p"].append(load)
    out = []
    for s, v in zip(state, vectors, strict=True):
        weights = s["coef"] / s["scale"]
        out.append({"reference": v.get("reference"), "weights": weights, "offset": (weights * s["mean"]).sum(axis=1) - s["level"], "fitted": s["n"] > 1})
    return out


def monte_carlo(spectra: DataFrame, draws: DataFrame, chains: list[list[str]], unit: str, components: int = 5) -> DataFrame:
    """(chain, case, iter, spectrum_id, sample_id, y, prediction) of the test spectra of every cell of chains, cases and iterations.

    `spectra(spectrum_id, sample_id, x, cases map<string,double>)`: the targets of a spectrum by
    case; a case that it has no value for leaves it out. `draws(case, iter, <unit>, part)`. EMSC
    takes its reference from the training rows as they are after the steps before it. A spectrum
    that a chain leaves undefined (constant under SNV, slope 0 under EMSC) takes no part in
    training, and its prediction is null; a cell with fewer than two training rows has no rows.
    """

    def listed(row, group, rows, p, tested, iters):
        i, c = np.nonzero(tested)
        prediction = pd.Series(p[i, c]).astype(object).where(np.isfinite(p[i, c]), None)
        return {"iter": iters[c], "spectrum_id": row.spectrum_id[rows.of[i]], "sample_id": row.sample_id[rows.of[i]], "y": rows.y[i], "prediction": prediction}

    kinds = dict(spectra.dtypes)
    schema = f"chain string, case string, iter {dict(draws.dtypes)['iter']}, spectrum_id {kinds['spectrum_id']}, sample_id {kinds['sample_id']}, y double, prediction double"
    return _predicted(spectra, draws, chains, unit, components, schema, listed)


def monte_carlo_summary(spectra: DataFrame, draws: DataFrame, chains: list[list[str]], unit: str, components: int = 5) -> DataFrame:
    """(chain, case, spectrum_id, sample_id, y, pred, pred_std) of every spectrum that an iteration tested: mean and deviation of its predictions in `monte_carlo`.

    The predictions are summed up where they are made, so no row for each of them is moved; only
    iterations that do not fit one group of cells meet in a shuffle.
    """

    def summed(row, group, rows, p, tested, iters):
        valid = tested & np.isfinite(p)
        n, safe = valid.sum(axis=1), np.where(valid, p, 0.0)
        mean = safe.sum(axis=1) / np.maximum(n, 1)
        off = (np.where(valid, p - mean[:, None], 0.0) ** 2).sum(axis=1)
        i = np.nonzero(tested.any(axis=1))[0]
        return {"spectrum_id": row.spectrum_id[rows.of[i]], "sample_id": row.sample_id[rows.of[i]], "y": rows.y[i], "n": n[i], "mean": mean[i], "off": off[i]}

    kinds = dict(spectra.dtypes)
    schema = f"chain string, case string, spectrum_id {kinds['spectrum_id']}, sample_id {kinds['sample_id']}, y double, n long, mean double, off double"
    found = _predicted(spectra, draws, chains, unit, components, schema, summed)
    keys, n = ("chain", "case", "spectrum_id", "sample_id"), F.col("n")
    if draws.select("iter").distinct().count() > GROUP:
        # squares about the common mean: those about the own ones and those of the means
        met = found.groupBy(*keys).agg(F.first("y").alias("y"), F.sum("n").alias("n"), F.sum(n * F.col("mean")).alias("s"), F.sum("off").alias("off"), F.collect_list(F.struct("n", "mean")).alias("each"))
        met = met.withColumn("mean", F.col("s") / F.greatest(n, F.lit(1)))
        between = F.aggregate("each", F.lit(0.0), lambda a, g: a + g["n"] * (g["mean"] - F.col("mean")) * (g["mean"] - F.col("mean")))
        found = met.withColumn("off", F.col("off") + between)
    return found.select(*keys, "y", F.when(n > 0, F.col("mean")).alias("pred"), F.when(n > 0, F.sqrt(F.col("off") / n)).alias("pred_std"))


def _predicted(spectra: DataFrame, draws: DataFrame, chains: list[list[str]], unit: str, components: int, schema: str, rows_of) -> DataFrame:
    """What `rows_of` makes of the predictions of each block and group of cells."""
    spark = spectra.sparkSession
    for chain in chains:
        for step in chain:
            if step not in STEPS:
                raise ValueError(f"unknown preprocessing step: {step}")
    tests = draws.where("part = 'test'").groupBy(F.col(unit).alias("unit"), "case").agg(F.collect_list("iter").alias("iters"))
    tests = settled(tests.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("case", "iters"))).alias("tests")), "tests")
    found: dict[str, list] = {}
    for r in tests.select(F.explode("tests").alias("case", "iters")).select("case", F.explode("iters").alias("iter")).distinct().collect():
        found.setdefault(r["case"], []).append(r["iter"])
    cases, iterations = sorted(found), {c: sorted(x) for c, x in found.items()}
    if not cases:
        return spark.createDataFrame([], schema)
    blocks = _blocks(spectra, tests, chains, unit, cases, iterations)
    variants = sorted({tuple(_before(c)) for c in chains})
    groups = []
    for chain in chains:
        start = _before(chain)
        for j, case in enumerate(cases):
            for lo in range(0, len(iterations[case]), GROUP):
                hi = min(lo + GROUP, len(iterations[case]))
                groups.append({"chain": name_of(chain), "variant": variants.index(tuple(start)), "emsc": "emsc" in chain, "after": chain[len(start) + 1 :], "case": case, "case_no": j, "iterations": len(iterations[case]), "lo": lo, "hi": hi})
    first = blocks.select(F.max(F.length("x0") / (8 * F.col("n")))).first()[0]
    out = None
    for own in _rounds(groups, int(first or 1)):
        models = _models(blocks, own, components)
        shared = spark.sparkContext.broadcast((own, models))

        def run(batches, shared=shared):
            for pdf in batches:
                for row in pdf.itertuples(index=False):
                    for group, model in zip(*shared.value, strict=True):
                        rows = _Rows(row, group, model["reference"])
                        tested = rows.test & model["fitted"][None, :]
                        if tested.any():
                            p = np.where(rows.defined, rows.times(model["weights"]) - model["offset"][None, :], np.nan)
                            iters = np.array(iterations[group["case"]][group["lo"] : group["hi"]])
                            yield pd.DataFrame({"chain": group["chain"], "case": group["case"], **rows_of(row, group, rows, p, tested, iters)})

        part = blocks.mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
