"""Interval search over whole candidate spaces, for many chains, interval counts and component counts at once.

A space is a set of candidates that are numbered, not listed: the combinations of some intervals, or
all moves of their bounds. Spark deals ranges of numbers to tasks, which unrank them (combinatorial
number system, mixed radix), score them in batches and give back the best of the range. Scores
come from moments, the Gram matrices of folds, of validation spectra and of sample means, whose size
is that of the axis. One pass of weights gives the coefficients of every component count.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gram import Moments, collect_grams, gram_rows
from .splits import group_folds

#: Candidates of a range, and of a batch of array operations by their points squared.
RANGE, BATCH = 2048, 1 << 20
#: Matrices of all chains that a task may hold, in bytes.
MOMENT_BYTES = 1 << 30
_INTERVALS = "array<struct<s:int,e:int>>"


# ---- one pass for all component counts ------------------------------------------------------


def pls_paths(xx: np.ndarray, xy: np.ndarray, components: int) -> np.ndarray:
    """Coefficients [candidate, count, point, target] of partial least squares with 1 to `components` components.

    Centred xx [candidate, point, point] and xy [candidate, point, target]. Only xy is deflated:
    the weights of a component are made orthogonal to the loadings before it, so that they
    apply to the undeflated x. A candidate of which nothing is left keeps its coefficients.
    """
    b, m, q = xy.shape
    xy, coef = xy.copy(), np.zeros((b, m, q))
    out, r_all, p_all = np.zeros((b, components, m, q)), [], []
    floor = 1e-12 * np.maximum(np.trace(xx, axis1=1, axis2=2), 1e-300)
    least = 1e-14 * np.maximum(1.0, np.abs(xy).max(axis=(1, 2), initial=0))
    going = np.ones(b, bool)
    for a in range(components):
        w = xy.sum(axis=2)
        norm = np.linalg.norm(w, axis=1)
        going &= (norm > least) & (a < m)
        w = w / np.where(going, norm, 1.0)[:, None]
        if r_all:
            inner = np.einsum("abm,bm->ab", np.array(p_all), w)
            w = w - np.einsum("ab,abm->bm", inner, np.array(r_all))
        g = np.matmul(xx, w[:, :, None])[:, :, 0]
        tt = (w * g).sum(axis=1)
        going &= tt > floor
        safe = np.where(going, tt, 1.0)
        w, g = np.where(going[:, None], w, 0.0), np.where(going[:, None], g, 0.0)
        load, y = g / safe[:, None], np.einsum("bm,bmq->bq", w, xy) / safe[:, None]
        xy = xy - (safe[:, None] * load)[:, :, None] * y[:, None, :]
        coef = coef + w[:, :, None] * y[:, None, :]
        r_all.append(w)
        p_all.append(load)
        out[:, a] = coef
    return out


def _errors(coef: np.ndarray, train: Moments, held: Moments, columns: np.ndarray) -> np.ndarray:
    """Sums of squared errors [candidate, count, target] on the rows of `held`."""
    b, a, m, q = coef.shape
    xx, xy = held.xx[columns[:, :, None], columns[:, None, :]], held.xy[columns]
    c = coef.transpose(0, 2, 1, 3).reshape(b, m, a * q)
    square = (np.matmul(xx, c) * c).sum(axis=1).reshape(b, a, q)
    cross = np.einsum("bamq,bmq->baq", coef, xy)
    shift = (held.mean[columns] - train.mean[columns])[:, None, :, None]
    off = (held.mean[held.p :] - train.mean[train.p :])[None, None, :] - (coef * shift).sum(axis=2)
    return np.maximum(np.diag(held.yy)[None, None, :] - 2 * cross + square + held.n * off**2, 0)


def _batches(starts: np.ndarray, ends: np.ndarray):
    """(candidates, their points [candidate, point]) in batches of one number of points."""
    sizes = (ends - starts).sum(axis=1)
    for m in np.unique(sizes):
        own = np.flatnonzero(sizes == m)
        for part in np.array_split(own, max(1, int(len(own) * m * m) // BATCH)):
            lengths = (ends[part] - starts[part]).ravel()
            before = np.cumsum(lengths) - lengths
            flat = np.repeat(starts[part].ravel() - before, lengths) + np.arange(lengths.sum())
            yield part, flat.reshape(len(part), m)


def fold_scores(folds: list[tuple[Moments, Moments, Moments]], starts: np.ndarray, ends: np.ndarray, components: int) -> dict[str, np.ndarray]:
    """Mean r2_spectrum, r2_sample, rmse_sample over (train, held, held means) folds, each [candidate, count]; nan where a candidate has fewer points."""
    out = {c: np.full((len(starts), components), np.nan) for c in ("r2_spectrum", "r2_sample", "rmse_sample")}
    for part, columns in _batches(starts, ends):
        most = min(components, columns.shape[1])
        found = {c: [] for c in out}
        for train, held, means in folds:
            coef = pls_paths(train.xx[columns[:, :, None], columns[:, None, :]], train.xy[columns], most)
            for name, m in (("r2_spectrum", held), ("r2_sample", means)):
                error, spread = _errors(coef, train, m, columns), np.diag(m.yy)
                if (spread > 0).all():
                    found[name].append((1 - error / spread).mean(axis=2))
                if m is means:
                    found["rmse_sample"].append(np.sqrt(error.mean(axis=2) / m.n))
        for name, values in found.items():
            if values:
                out[name][part, :most] = np.mean(values, axis=0)
    return out


def held_rmse(train: Moments, held: Moments, starts: np.ndarray, ends: np.ndarray, components: int) -> np.ndarray:
    """Root mean squared error on `held` [candidate, count] of models of `train`."""
    out = np.full((len(starts), components), np.nan)
    for part, columns in _batches(starts, ends):
        most = min(components, columns.shape[1])
        coef = pls_paths(train.xx[columns[:, :, None], columns[:, None, :]], train.xy[columns], most)
        out[part, :most] = np.sqrt(_errors(coef, train, held, columns).mean(axis=2) / held.n)
    return out


# ---- numbered candidates ----------------------------------------------------------------------


def combinations_total(n: int, most: int) -> int:
    return sum(comb(n, k) for k in range(1, most + 1))


def unrank_combinations(ordinals: np.ndarray, n: int, most: int):
    """(places in `ordinals`, members [candidate, k]) for each size k of the sets with these numbers, in the order of itertools."""
    base = 0
    for k in range(1, most + 1):
        size = comb(n, k)
        own = np.flatnonzero((ordinals >= base) & (ordinals < base + size))
        rank, low, members = ordinals[own] - base, np.zeros(len(own), np.int64), []
        for left in range(k - 1, -1, -1):  # sets that begin with a member before i, over members from `low` on
            upto = np.concatenate([[0], np.cumsum([comb(n - 1 - i, left) for i in range(n)])])
            at = np.searchsorted(upto, rank + upto[low], side="right") - 1
            rank = rank - (upto[at] - upto[low])
            members.append(at)
            low = at + 1
        base += size
        if len(own):
            yield own, np.stack(members, axis=1)


def moves_total(bounds: int, shift: int) -> int:
    return (2 * shift + 1) ** bounds


def unrank_moves(ordinals: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: list[int], shift: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) [candidate, interval]: the bounds of the intervals `which` moved by -shift..shift, the last bound fastest, clamped to 0..top."""
    width, rest = 2 * shift + 1, ordinals.copy()
    s, e = np.tile(starts, (len(ordinals), 1)), np.tile(ends, (len(ordinals), 1))
    for k in reversed(which):
        for side in (e, s):
            side[:, k] = np.clip(side[:, k] + rest % width - shift, 0, top)
            rest = rest // width
    return s, e


def _ranges(spaces: DataFrame, total: Column) -> DataFrame:
    """`spaces` with lo, hi: every number below `total` in ranges, dealt to tasks."""
    dealt = spaces.withColumn("total", total).where("total > 0").withColumn("lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(RANGE).cast("long"))))
    dealt = dealt.withColumn("hi", F.least("total", F.col("lo") + RANGE))
    n = spaces.select(F.sum(F.ceil(total / RANGE))).first()[0] or 1
    return dealt.repartition(int(min(max(1, n), 20_000)))


# ---- moments ------------------------------------------------------------------------------------


def sample_means(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, x, ys): mean spectrum and targets of each group of `rows(keys, x, ys)`."""
    points = rows.select(*keys, F.posexplode("x").alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("v"))
    points = points.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
    width = F.sequence(F.lit(0), F.size("ys") - 1)
    targets = rows.select(*keys, F.explode(width).alias("k"), "ys").groupBy(*keys, "k").agg(F.avg(F.get("ys", F.col("k"))).alias("v"))
    targets = targets.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("ys"))
    return points.join(targets, list(keys))


class SearchMoments:
    """Gram matrices, by chain, of the rows of a model table: of its folds, of its parts, and of the means of their samples.

    `rows(chain, part, sample_id, x, ys)`: rows without a defined spectrum or target take no part.
    Part `fit` is cut into folds of whole samples, the same for all chains.
    """

    def __init__(self, rows: DataFrame, folds: int = 5, targets: int = 1):
        self.spark, self.q = rows.sparkSession, targets
        rows = rows.where("x is not null and not exists(ys, v -> v is null)")
        fold = group_folds(rows.where("part = 'fit'"), folds).select("sample_id", F.concat(F.lit("fold"), "fold").alias("fold"))
        named = rows.join(fold, "sample_id", "left").withColumn("part", F.when(F.col("part") == "fit", F.col("fold")).otherwise(F.col("part")))
        named = named.select(F.concat_ws("|", "chain", "part").alias("key"), "sample_id", "x", "ys")
        means = sample_means(named, "key", "sample_id").select(F.concat("key", F.lit("|means")).alias("key"), "x", "ys")
        grams = collect_grams(gram_rows(named.select("key", "x", "ys").unionByName(means), "key", "x", "ys"))
        if not grams:
            raise ValueError("no rows with a defined spectrum and target")
        if sum(g.nbytes for g in grams.values()) > MOMENT_BYTES:
            raise ValueError(f"the matrices of the chains have more than {MOMENT_BYTES} bytes: search fewer chains at once")
        self.points = len(next(iter(grams.values()))) - 1 - targets
        self.chains = sorted({k.split("|")[0] for k in grams})
        self.shared = self.spark.sparkContext.broadcast(grams)


class _Parts:
    """Moments of the parts of chains, made from the matrices of `SearchMoments` when a task first needs them."""

    def __init__(self, grams: dict, targets: int):
        self.grams, self.q, self.known = grams, targets, {}

    def matrix(self, chain: str, part: str, means: bool = False) -> np.ndarray:
        """The matrix of a part; `fit` is the sum of its folds, `all` of everything but the test."""
        own = [k for k in self.grams if k.split("|")[0] == chain and k.endswith("|means") == means]
        wanted = {"fit": lambda p: p.startswith("fold"), "all": lambda p: p != "test"}.get(part, lambda p: p == part)
        found = [self.grams[k] for k in own if wanted(k.split("|")[1])]
        if not found:
            raise ValueError(f"no rows in part {part} of chain {chain}")
        return sum(found)

    def part(self, chain: str, part: str, means: bool = False) -> Moments:
        if (key := (chain, part, means)) not in self.known:
            self.known[key] = Moments(self.matrix(*key), self.q)
        return self.known[key]

    def folds(self, chain: str) -> list[tuple[Moments, Moments, Moments]]:
        """(training, held, means of held) of each fold."""
        names = sorted({k.split("|")[1] for k in self.grams if k.startswith(f"{chain}|fold")})
        if len(names) < 2:
            raise ValueError("fewer than two folds have rows")
        for name in names:
            if (key := (chain, name)) not in self.known:
                self.known[key] = Moments(self.matrix(chain, "fit") - self.matrix(chain, name), self.q)
        return [(self.known[chain, name], self.part(chain, name), self.part(chain, name, True)) for name in names]


# ---- searches -------------------------------------------------------------------------------------


def interval_grid(moments: SearchMoments, components: tuple[int, ...], interval_counts: tuple[int, ...], most: int, top_k: int = 30) -> DataFrame:
    """(chain, n_components, n_intervals, intervals, r2_spectrum, r2_sample, rmse_sample, candidates, error) of every cell.

    In a cell the single intervals rank by their spectrum-level R2, the first `top_k` make all
    combinations of up to `most`, and of those with at least as many points as components the best
    sample-level R2 wins, the first in order among equals. All cells are one table of ranges: the combinations of the intervals that any
    component count has kept are scored once for all counts, each count among its own.
    """
    spark, shared, points, q, most_components = moments.spark, moments.shared, moments.points, moments.q, max(components)
    cuts = [(n, i, i * points // n, (i + 1) * points // n) for n in interval_counts for i in range(n)]
    singles = spark.createDataFrame([(c, n, i, s, e) for c in moments.chains for n, i, s, e in cuts if e > s], "chain string, n_intervals int, i int, s int, e int")

    def score_singles(batches):
        parts = _Parts(shared.value, q)
        for pdf in batches:
            for chain, part in pdf.groupby("chain", sort=False):
                found = fold_scores(parts.folds(chain), part.s.to_numpy()[:, None], part.e.to_numpy()[:, None], most_components)["r2_spectrum"]
                for c in components:  # an interval of fewer points has as many components as points
                    r2 = found[np.arange(len(part)), np.minimum(c, part.e - part.s) - 1]
                    yield part[~np.isnan(r2)].assign(n_components=c, r2=r2[~np.isnan(r2)])

    scored = singles.repartition("chain").mapInPandas(score_singles, singles.schema.simpleString()[7:-1].replace(":", " ") + ", n_components int, r2 double")
    rank = F.row_number().over(Window.partitionBy("chain", "n_intervals", "n_components").orderBy(F.desc("r2"), "i"))
    kept = scored.withColumn("rank", rank).where(F.col("rank") <= top_k)
    kept = kept.groupBy("chain", "n_intervals", "i", "s", "e").agg(F.collect_set("n_components").alias("counts"))
    spaces = kept.groupBy("chain", "n_intervals").agg(F.array_sort(F.collect_list(F.struct("i", "s", "e", "counts"))).alias("kept"))
    totals = F.array(*[F.lit(combinations_total(n, most)).cast("long") for n in range(1, max(interval_counts) + 1)])

    def search(batches):
        parts = _Parts(shared.value, q)
        for pdf in batches:
            rows = []
            for chain, n, kept, lo, hi in zip(pdf.chain, pdf.n_intervals, pdf.kept, pdf.lo, pdf.hi, strict=True):
                folds = parts.folds(chain)
                s, e = np.array([x["s"] for x in kept]), np.array([x["e"] for x in kept])
                allowed = np.array([[c in set(x["counts"]) for c in components] for x in kept])
                best = {}
                ordinals = np.arange(lo, hi)
                for own, members in unrank_combinations(ordinals, len(kept), most):
                    some = allowed[members].all(axis=1).any(axis=1)
                    own, members = own[some], members[some]
                    if not len(own):
                        continue
                    found, fits = fold_scores(folds, s[members], e[members], most_components), allowed[members].all(axis=1)
                    for k, c in enumerate(components):
                        value = np.where(fits[:, k] & ~np.isnan(found["r2_sample"][:, c - 1]), found["r2_sample"][:, c - 1], -np.inf)
                        at = int(value.argmax())
                        n_scored = int((value > -np.inf).sum())
                        if n_scored:
                            had = best.get(c)
                            row = (float(value[at]), [(int(a), int(b)) for a, b in zip(s[members[at]], e[members[at]], strict=True)], int(ordinals[own[at]]), *[float(found[x][at, c - 1]) for x in ("r2_spectrum", "rmse_sample")])
                            best[c] = (row if had is None or row[0] > had[0][0] else had[0], n_scored + (had[1] if had else 0))
                rows += [(chain, n, c, i, o, a, r, b, scored) for c, ((r, i, o, a, b), scored) in best.items()]
            yield pd.DataFrame(rows, columns=["chain", "n_intervals", "n_components", "intervals", "ordinal", "r2_spectrum", "r2_sample", "rmse_sample", "candidates"])

    schema = f"chain string, n_intervals int, n_components int, intervals {_INTERVALS}, ordinal long, r2_spectrum double, r2_sample double, rmse_sample double, candidates long"
    found = _ranges(spaces, F.element_at(totals, F.size("kept"))).select("chain", "n_intervals", "kept", "lo", "hi").mapInPandas(search, schema)
    order = F.struct((-F.col("r2_sample")).alias("loss"), "ordinal")
    best = found.groupBy("chain", "n_intervals", "n_components").agg(F.min_by(F.struct("intervals", "r2_spectrum", "r2_sample", "rmse_sample"), order).alias("b"), F.sum("candidates").alias("candidates"))
    cells = spark.createDataFrame([(c, k, n) for c in moments.chains for k in components for n in interval_counts], "chain string, n_components int, n_intervals int")
    return cells.join(best, ["chain", "n_components", "n_intervals"], "left").select(
        "chain", "n_components", "n_intervals", "b.*", F.coalesce("candidates", F.lit(0).cast("long")).alias("candidates"), F.when(F.col("b").isNull(), "nothing could be fitted").alias("error")
    )


def held_errors(moments: SearchMoments, cells: DataFrame) -> DataFrame:
    """`cells(chain, n_components, n_intervals, intervals)` with `held_rmse`: error of the models of `fit` on the sample means of `held`."""
    shared, q = moments.shared, moments.q

    def run(batches):
        parts = _Parts(shared.value, q)
        for pdf in batches:
            out = []
            for chain, c, intervals in zip(pdf.chain, pdf.n_components, pdf.intervals, strict=True):
                s, e = np.array([[x["s"] for x in intervals]]), np.array([[x["e"] for x in intervals]])
                out.append(held_rmse(parts.part(chain, "fit"), parts.part(chain, "held", True), s, e, int(c))[0, c - 1])
            yield pdf[["chain", "n_components", "n_intervals"]].assign(held_rmse=out)

    errors = cells.where("intervals is not null").select("chain", "n_components", "n_intervals", "intervals")
    errors = errors.mapInPandas(run, "chain string, n_components int, n_intervals int, held_rmse double")
    return cells.join(errors, ["chain", "n_components", "n_intervals"])


def _best_moves(moments: SearchMoments, spaces: DataFrame, shift: int, score) -> DataFrame:
    """(chain, rmse, ordinal, intervals): the best move of each row of `spaces(chain, n_components, intervals, which array<int>)`.

    `score(parts, chain, starts, ends, components)` gives an error for each candidate; empty
    intervals and candidates of too few points are no candidates.
    """
    shared, q, top = moments.shared, moments.q, moments.points - 1

    def run(batches):
        parts = _Parts(shared.value, q)
        for pdf in batches:
            rows = []
            for chain, c, intervals, which, lo, hi in zip(pdf.chain, pdf.n_components, pdf.intervals, pdf.which, pdf.lo, pdf.hi, strict=True):
                ordinals = np.arange(lo, hi)
                s, e = unrank_moves(ordinals, np.array([x["s"] for x in intervals]), np.array([x["e"] for x in intervals]), list(which), shift, top)
                ok = np.flatnonzero((s < e).all(axis=1) & ((e - s).sum(axis=1) >= c))
                if len(ok):
                    # equal candidates, which clamping makes, are scored once: the first of them
                    _, first = np.unique(np.concatenate([s[ok], e[ok]], axis=1), axis=0, return_index=True)
                    ok = ok[np.sort(first)]
                    error = score(parts, chain, s[ok], e[ok], int(c))
                    at = int(np.nanargmin(error))
                    rows.append((chain, float(error[at]), int(ordinals[ok[at]]), [(int(a), int(b)) for a, b in zip(s[ok[at]], e[ok[at]], strict=True)]))
            yield pd.DataFrame(rows, columns=["chain", "rmse", "ordinal", "intervals"])

    total = F.pow(F.lit(2 * shift + 1), 2 * F.size("which")).cast("long")
    found = _ranges(spaces, total).select("chain", "n_components", "intervals", "which", "lo", "hi").mapInPandas(run, f"chain string, rmse double, ordinal long, intervals {_INTERVALS}")
    return found.groupBy("chain").agg(F.min_by(F.struct("rmse", "ordinal", "intervals"), F.struct("rmse", "ordinal")).alias("b")).select("chain", "b.*")


def refine_on_held(moments: SearchMoments, start: list[tuple[str, int, list]], shift: int) -> list[dict]:
    """Steps (chain, step, s, e, rmse, moved, intervals): the bounds of one interval after the other, all chains at once.

    `start`: (chain, n_components, intervals), one row a chain. Of all moves of an interval the one
    with the smallest error on the spectra of `held` is kept if it gains. The driver holds one row a chain.
    """

    def score(parts, chain, s, e, c):
        return held_rmse(parts.part(chain, "fit"), parts.part(chain, "held"), s, e, c)[:, c - 1]

    state, log, here = {}, [], _Parts(moments.shared.value, moments.q)
    for chain, c, intervals in start:
        now = [(int(s), int(e)) for s, e in intervals]
        first = score(here, chain, *(np.array([[x[k] for x in now]]) for k in (0, 1)), c)
        state[chain] = [c, now, float(first[0])]
    for k in range(max(len(x[1]) for x in state.values())):
        rows = [(chain, c, now, [k]) for chain, (c, now, _) in state.items() if k < len(now)]
        spaces = moments.spark.createDataFrame(rows, f"chain string, n_components int, intervals {_INTERVALS}, which array<int>")
        best = {r["chain"]: r for r in _best_moves(moments, spaces, shift, score).collect()}
        for chain, *_ in rows:
            found, own = best.get(chain), state[chain]
            gain = found is not None and found["rmse"] < own[2] - 1e-12
            if gain:
                own[1], own[2] = [(i["s"], i["e"]) for i in found["intervals"]], found["rmse"]
            log.append({"chain": chain, "step": k, "s": own[1][k][0], "e": own[1][k][1], "rmse": own[2], "moved": gain, "intervals": list(own[1])})
    return log


def refine_on_folds(moments: SearchMoments, chain: str, n_components: int, intervals: list, shift: int = 1):
    """(intervals, mean fold error): all bounds moved jointly, the smallest mean fold error of sample means wins, the first among equals."""

    def score(parts, chain, s, e, c):
        return fold_scores(parts.folds(chain), s, e, c)["rmse_sample"][:, c - 1]

    row = [(chain, n_components, [(int(s), int(e)) for s, e in intervals], list(range(len(intervals))))]
    spaces = moments.spark.createDataFrame(row, f"chain string, n_components int, intervals {_INTERVALS}, which array<int>")
    best = _best_moves(moments, spaces, shift, score).first()
    return [(i["s"], i["e"]) for i in best["intervals"]], best["rmse"]


def stage_metrics(moments: SearchMoments, stages: list[tuple[str, str, str, str, int, list]]) -> DataFrame:
    """(chain, stage, intervals, n_components, n, rmse, r2) of sample means for rows (chain, stage, trained on, tested on, n_components, intervals)."""
    shared, q = moments.shared, moments.q
    rows = [(c, stage, a, b, n, [(int(s), int(e)) for s, e in i]) for c, stage, a, b, n, i in stages]
    table = moments.spark.createDataFrame(rows, f"chain string, stage string, train string, test string, n_components int, intervals {_INTERVALS}")

    def run(batches):
        parts = _Parts(shared.value, q)
        for pdf in batches:
            out = []
            for chain, train, test, c, intervals in zip(pdf.chain, pdf.train, pdf.test, pdf.n_components, pdf.intervals, strict=True):
                fit, on = parts.part(chain, train), parts.part(chain, test, True)
                s, e = np.array([[x["s"] for x in intervals]]), np.array([[x["e"] for x in intervals]])
                rmse = held_rmse(fit, on, s, e, int(c))[0, c - 1]
                spread = float(np.trace(on.yy))
                out.append((int(on.n), float(rmse), 1 - rmse**2 * on.n * q / spread if spread > 0 else None))
            text = ["[" + ", ".join(f"({x['s']}, {x['e']})" for x in i) + "]" for i in pdf.intervals]
            n, rmse, r2 = zip(*out, strict=True) if out else ((), (), ())
            yield pdf[["chain", "stage", "n_components"]].assign(intervals=text, n=n, rmse=rmse, r2=r2)

    return table.mapInPandas(run, "chain string, stage string, n_components int, intervals string, n long, rmse double, r2 double")
