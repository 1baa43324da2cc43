"""An interpolated modified Kneser-Ney model of word pairs.

Counts are made in Spark: each task counts its own pairs, the counts meet in buckets of the
first word (a frequent first word is spread over many buckets), and each bucket is stored as a
sorted array of 64-bit pair hashes with its counts in the shared folder. Workers map those
arrays into memory and score texts by binary search. The model's size follows the corpus; the
driver holds totals, discounts and the frequent words (at most HOT of them).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import ArrayStore, find
from .common import Words, mix64, release, shared_dir, signed, text_steps, written

#: Hashes of the end of a text (a token) and of its start (only ever a first word).
END, START = np.uint64(0x5BF0_3635_1A2C_77E1), np.uint64(0xA0761D6478BD642F)
#: Tokens that a task counts before it sends; tokens per bucket of pairs; words per array of words.
SEND, BUCKET, WORDS_PER_ARRAY = 2_000_000, 1_500_000, 1_000_000
#: First words with more than 1/HOT of all tokens are spread over SPREAD buckets.
HOT, SPREAD = 400, 64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (words, then the end) of all texts, the hash before each, and the row of each."""
    words = Words(column, lower=True)
    n = words.counts()
    rows = np.repeat(np.arange(len(n)), n + 1)
    out = np.full(len(rows), END, np.uint64)
    ends = np.cumsum(n + 1) - 1
    is_word = np.ones(len(rows), bool)
    is_word[ends] = False
    out[is_word] = words.hashes()
    before = np.concatenate([[START], out[:-1]]) if len(out) else out
    before[ends[:-1] + 1] = START
    return out, before, rows


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0xD6E8FEB86659FD93) + second)


def _bucket(first: np.ndarray, second: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    salt = np.where(find(hot, first) >= 0, mix64(second) % np.uint64(SPREAD) + np.uint64(1), np.uint64(0))
    return (mix64(first + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of items seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(x if 0 < x < k else k / 2 for k, x in zip((1, 2, 3), d, strict=True))


@dataclass
class Model:
    store: ArrayStore
    total: int  # N
    types: int  # V
    buckets: int
    word_arrays: int
    hot: np.ndarray
    discounts: tuple[float, float, float]
    unseen: float  # probability of a word that was never seen
    starts: int


def _word_counts(docs: DataFrame) -> DataFrame:
    def count(batches):
        held, n = [], 0

        def send():
            w, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c)], names=["w", "c"])

        for batch in batches:
            for step in text_steps(batch):
                held.append(tokens(step.column(0))[0])
                n += len(held[-1])
                if n >= SEND:
                    yield send()
                    held, n = [], 0
        if n:
            yield send()

    return docs.select("text").mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _pair_buckets(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, firsts, runs, seconds, n): counted pairs of one task and bucket, sorted by first word."""

    def count(batches):
        held, size = [], 0

        def send():
            second, first = (np.concatenate(x) for x in zip(*held, strict=True))
            _, at, n = np.unique(_pair(first, second), return_index=True, return_counts=True)
            first, second = first[at], second[at]
            where = _bucket(first, second, hot, buckets)
            order = np.lexsort((first, where))
            first, second, n, where = first[order], second[order], n[order].astype(np.uint32), where[order]
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                lo, hi = cuts[b], cuts[b + 1]
                new = np.flatnonzero(np.concatenate([[True], first[lo + 1 : hi] != first[lo : hi - 1]]))
                runs = np.diff(np.concatenate([new, [hi - lo]])).astype(np.uint32)
                yield int(b), first[lo:hi][new].tobytes(), runs.tobytes(), second[lo:hi].tobytes(), n[lo:hi].tobytes()

        def rows(parts):
            parts = list(parts)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*parts, strict=True), kinds, strict=True)], names=["bucket", "firsts", "runs", "seconds", "n"])

        for batch in batches:
            for step in text_steps(batch):
                t, before, _ = tokens(step.column(0))
                held.append((t, before))
                size += len(t)
                if size >= SEND:
                    yield rows(send())
                    held, size = [], 0
        if size:
            yield rows(send())

    return docs.select("text").mapInArrow(count, "bucket long, firsts binary, runs binary, seconds binary, n binary")


def _store_pairs(sent: DataFrame, store: ArrayStore, hot: np.ndarray, buckets: int) -> DataFrame:
    """Write the arrays of each bucket; return (w, kind, n): what words and discounts need of them.

    kind 0: texts of different first words before w; 1, 2, 3: pairs (w, .) seen once, twice,
    more often; -1: number of pairs seen w times, w up to 4.
    """

    def merge(bucket, parts):
        first = np.concatenate([np.repeat(np.frombuffer(f, np.uint64), np.frombuffer(r, np.uint32)) for f, r, _, _ in parts])
        second = np.concatenate([np.frombuffer(s, np.uint64) for _, _, s, _ in parts])
        n = np.concatenate([np.frombuffer(c, np.uint32) for _, _, _, c in parts]).astype(np.int64)
        key = _pair(first, second)
        order = np.argsort(key, kind="stable")
        key, first, second, n = key[order], first[order], second[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, first, second, n = key[new], first[new], second[new], np.add.reduceat(n, new)
        many = np.flatnonzero(n >= 255)
        store.save(f"pairs-{bucket}-key", key)
        store.save(f"pairs-{bucket}-n", np.minimum(n, 255).astype(np.uint8))
        store.save(f"pairs-{bucket}-many", np.stack([many, n[many]]))
        w, c = np.unique(second, return_counts=True)
        out = [(w, np.zeros(len(w), np.int64), c)]
        kind = np.minimum(n, 3)
        for k in (1, 2, 3):
            w, c = np.unique(first[kind == k], return_counts=True)
            out.append((w, np.full(len(w), k), c))
        few = np.bincount(np.minimum(n, 5), minlength=5)[1:5]
        out.append((np.arange(1, 5, dtype=np.uint64), np.full(4, -1), few))
        return [np.concatenate(x) for x in zip(*out, strict=True)]

    def reduce(batches):
        bucket, parts = None, []

        def close():
            w, kind, n = merge(bucket, parts)
            return pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(kind.astype(np.int8)), pa.array(n.astype(np.int64))], names=["w", "kind", "n"])

        for batch in batches:
            for b, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket and parts:
                    yield close()
                    parts = []
                bucket = b
                parts.append(part)
        if parts:
            yield close()

    return sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(reduce, "w long, kind byte, n long")


def train(docs: DataFrame) -> Model:
    """Count `docs(text)` and store the model. No rows: a model that knows nothing."""
    spark = docs.sparkSession
    store = ArrayStore(shared_dir(spark) + "/model")
    counts = written(_word_counts(docs), "words")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    if not total:
        return Model(store, 0, 0, 0, 0, np.zeros(0, np.uint64), (0.5, 1.0, 1.5), 1.0, 0)
    release(spark)
    hot = np.array(sorted(int(np.int64(r[0]).view(np.uint64)) for r in counts.where(F.col("c") > total / HOT).select("w").collect()) + [int(START)], np.uint64)
    hot = np.unique(hot)
    buckets = max(8, math.ceil(total / BUCKET))
    parts = written(_store_pairs(_pair_buckets(docs, hot, buckets), store, hot, buckets), "parts")
    release(spark)
    few = {r["w"]: r["n"] for r in parts.where("kind = -1").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    discounts = _discounts([few.get(k, 0) for k in (1, 2, 3, 4)])
    by_word = parts.where("kind >= 0").groupBy("w").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(4)])
    words = written(by_word.join(counts, "w", "full").select("w", F.coalesce("c", F.lit(0)).alias("c"), *[F.coalesce(f"k{k}", F.lit(0)).alias(f"k{k}") for k in range(4)]), "by_word")
    release(spark)
    left = {r[0]: r[1] for r in words.where("k0 > 0").groupBy(F.least("k0", F.lit(5))).count().collect()}
    pairs = words.agg(F.sum("k0")).first()[0]
    low = _discounts([left.get(k, 0) for k in (1, 2, 3, 4)])
    spare = (low[0] * left.get(1, 0) + low[1] * left.get(2, 0) + low[2] * sum(v for k, v in left.items() if k > 2)) / pairs
    unseen = spare / (types + 1)
    starts = counts.where(F.col("w") == int(np.uint64(END).view(np.int64))).first()["c"]
    arrays = 1 << max(0, math.ceil(math.log2(max(1, types / WORDS_PER_ARRAY))))

    def save(batches):
        at, held = None, []

        def close():
            w, c, k0, k1, k2, k3 = (np.concatenate(x) for x in zip(*held, strict=True))
            w = w.view(np.uint64)
            order = np.argsort(w)
            low_d = np.array([0.0, *low])[np.minimum(k0, 3)]
            seen_as = np.maximum(k0 - low_d, 0) / pairs + unseen
            follow = np.where(w == START, starts, c)
            keep = np.minimum(1.0, (discounts[0] * k1 + discounts[1] * k2 + discounts[2] * k3) / np.maximum(follow, 1))
            keep[k1 + k2 + k3 == 0] = 1.0  # nothing follows it
            for name, x in (("key", w), ("c", c), ("seen", seen_as), ("keep", keep)):
                store.save(f"words-{at}-{name}", x[order])
            return pa.RecordBatch.from_arrays([pa.array([len(w)])], names=["n"])

        for batch in batches:
            b = batch.column(0).to_numpy()
            cols = [c.to_numpy() for c in batch.columns[1:]]
            for start, stop in zip((e := np.concatenate([[0], np.flatnonzero(b[1:] != b[:-1]) + 1, [len(b)]]))[:-1], e[1:], strict=True):
                if start == stop:
                    continue
                if b[start] != at and held:
                    yield close()
                    held = []
                at = int(b[start])
                held.append([c[start:stop] for c in cols])
        if held:
            yield close()

    bits = int(math.log2(arrays))
    top = F.shiftrightunsigned("w", 64 - bits) if bits else F.lit(0).cast("long")
    words.select(top.alias("b"), "w", "c", "k0", "k1", "k2", "k3").repartition(arrays, "b").sortWithinPartitions("b").mapInArrow(save, "n long").agg(F.sum("n")).collect()
    return Model(store, total, types, buckets, arrays, hot, discounts, unseen, starts)


class Scorer:
    """Looks tokens up in the mapped arrays of a model."""

    def __init__(self, model: Model):
        self.m = model

    def words(self, unique: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Values of sorted distinct words: count c, lower-order probability, share kept for it."""
        m = self.m
        out = [np.full(len(unique), {"c": 0.0, "seen": m.unseen, "keep": 1.0}[x]) for x in names]
        shift = np.uint64(64 - int(math.log2(m.word_arrays))) if m.word_arrays > 1 else None
        where = (unique >> shift).astype(np.int64) if shift is not None else np.zeros(len(unique), np.int64)
        for b in np.unique(where) if m.total else []:
            part = np.flatnonzero(where == b)
            try:
                at = find(m.store.load(f"words-{b}-key"), unique[part])
            except FileNotFoundError:  # no word falls into this array
                continue
            hit = at >= 0
            for o, x in zip(out, names, strict=True):
                o[part[hit]] = m.store.load(f"words-{b}-{x}")[at[hit]]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of pairs."""
        m, out = self.m, np.zeros(len(first), np.int64)
        if not m.total:
            return out
        key, where = _pair(first, second), _bucket(first, second, m.hot, m.buckets)
        order = np.lexsort((key, where))
        cuts = np.searchsorted(where[order], np.arange(m.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[b] : cuts[b + 1]]
            try:
                at = find(m.store.load(f"pairs-{b}-key"), key[part])
            except FileNotFoundError:  # no pair falls into this bucket
                continue
            hit = at >= 0
            n = m.store.load(f"pairs-{b}-n")[at[hit]].astype(np.int64)
            if (n == 255).any():
                many = m.store.load(f"pairs-{b}-many")
                n[n == 255] = many[1][np.searchsorted(many[0], at[hit][n == 255])]
            out[part[hit]] = n
        return out

    def score(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base log10 score, model log10 score."""
        m, n_rows = self.m, len(column)
        t, before, rows = tokens(column)
        unique, at = np.unique(t, return_inverse=True)
        c, seen = (x[at] for x in self.words(unique, ("c", "seen")))
        unique_before, at = np.unique(before, return_inverse=True)
        count_before, keep = (x[at] for x in self.words(unique_before, ("c", "keep")))
        follow = np.where(before == START, m.starts, count_before)
        _, at, back = np.unique(_pair(before, t), return_index=True, return_inverse=True)
        n = self.pairs(before[at], t[at])[back]
        d = np.array([0.0, *m.discounts])[np.minimum(n, 3)]
        p = np.maximum(n - d, 0) / np.maximum(follow, 1) + keep * seen
        base = np.log10((c + 0.1) / (m.total + 0.1 * (m.types + 1)))
        total = lambda x: np.bincount(rows, weights=x, minlength=n_rows)
        return np.bincount(rows, minlength=n_rows), total(c > 0).astype(np.int64), total(base), total(np.log10(p))


def score(docs: DataFrame, model: Model, keep: list[str | Column]) -> DataFrame:
    """Columns `keep` of `docs` and n_tokens, n_known, base_score, score, perplexity of each text.

    Null counts as the empty text, which is one token, its end. A model without training text
    gives every token the same probability, 1. Repeated rows give repeated results.
    """
    side = docs.select(*keep, "text")
    names = [*side.columns[:-1], "n_tokens", "n_known", "base_score", "score", "perplexity"]

    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for step in text_steps(batch):
                n, known, base, value = scorer.score(step.column(step.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*step.columns[:-1], pa.array(n), pa.array(known), pa.array(base), pa.array(value), pa.array(10.0 ** np.minimum(300, -value / n))], names=names)

    from pyspark.sql import types as T

    fields = [*side.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names[-3:]]]
    return side.mapInArrow(run, T.StructType(fields))


def train_and_score(docs: DataFrame, trained_on: Column) -> DataFrame:
    """doc_id, held_out (not trained on), n_tokens, n_known, train_tokens, base_score, score, perplexity of each row.

    Rows where `trained_on` is null, as where doc_id is, are scored but not trained on; their
    held_out is null.
    """
    model = train(docs.where(trained_on).select("text"))
    return score(docs, model, ["doc_id", (~trained_on).alias("held_out")]).withColumn("train_tokens", F.lit(model.total).cast("long"))
