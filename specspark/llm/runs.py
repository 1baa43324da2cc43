"""Runs of repeated word sequences by online catching of squares over dyadic blocks.

A run is a maximal stretch with smallest period q that is at least twice as long as q. Words are
appended to a sequence; every completed block of 2^k words, at a multiple of 2^k, becomes a
catcher for the periods from 2^(k+1) - 1 to 2^(k+2) - 2: the first half of any square of such a
period holds one of these blocks. Each appended word completes one window of 2^k words a level,
which is compared with the two catchers of the level in whose reach it lies. Where they agree, the
comparison of the suffixes before both and of the words after both goes on as far as the words
are equal: a common stretch as long as the period is a square, and all squares of one stretch
are one run. A comparison that reaches the end of the sequence stays alive and goes on with
the words appended next.

Any number of words can be appended at once; all steps are array operations over these words.
Windows are compared by hashes that are built by doubling, window of 2^(k+1) from two of 2^k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import _BASE, Words, mix64, text_steps

SHORTEST = 12


def _prime_factors(values: np.ndarray) -> np.ndarray:
    """The smallest prime factor of each value from 2 on."""
    top = int(values.max(initial=2))
    least = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if least[p] == p:
            multiples = least[p * p :: p]
            np.minimum(multiples, p, out=multiples)
    return least[values]


class Catchers:
    """The runs of a growing sequence of 64-bit units; `longest` bounds the length of a run."""

    def __init__(self, shortest: int = SHORTEST, longest: int | None = None):
        self.shortest, self.longest = shortest, longest
        self.n, self.hashes, self.windows = 0, [np.zeros(1024, np.uint64)], []
        none = np.zeros(0, np.int64)
        self.alive = (none, none, none)  # period, start, stop of comparisons that have reached the end
        self.done = (none, none, none)

    def _store(self, k: int, at: int, values: np.ndarray) -> None:
        if k == len(self.hashes):
            self.hashes.append(np.zeros(len(self.hashes[0]), np.uint64))
        if at + len(values) > len(self.hashes[k]):
            grown = np.zeros(max(2 * len(self.hashes[k]), at + len(values)), np.uint64)
            grown[:at] = self.hashes[k][:at]
            self.hashes[k] = grown
        self.hashes[k][at : at + len(values)] = values

    def _ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many units from x and from y > x on agree."""
        x, y = x.copy(), y.copy()
        start, top = x.copy(), len(self.hashes) - 1
        going = np.arange(len(x))
        while len(going):  # whole windows of the top level, as long as they agree
            fits = going[y[going] + (1 << top) <= self.n]
            going = fits[self.hashes[top][x[fits]] == self.hashes[top][y[fits]]]
            x[going] += 1 << top
            y[going] += 1 << top
        for k in range(top - 1, -1, -1):
            fits = np.flatnonzero(y + (1 << k) <= self.n)
            same = fits[self.hashes[k][x[fits]] == self.hashes[k][y[fits]]]
            x[same] += 1 << k
            y[same] += 1 << k
        return x - start

    def _behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many units before x and before y > x agree."""
        x, y = x.copy(), y.copy()
        start, top = x.copy(), len(self.hashes) - 1
        going = np.arange(len(x))
        while len(going):
            fits = going[x[going] >= 1 << top]
            going = fits[self.hashes[top][x[fits] - (1 << top)] == self.hashes[top][y[fits] - (1 << top)]]
            x[going] -= 1 << top
            y[going] -= 1 << top
        for k in range(top - 1, -1, -1):
            fits = np.flatnonzero(x >= 1 << k)
            same = fits[self.hashes[k][x[fits] - (1 << k)] == self.hashes[k][y[fits] - (1 << k)]]
            x[same] -= 1 << k
            y[same] -= 1 << k
        return start - x

    def append(self, units: np.ndarray) -> None:
        self.n += len(units)
        longest = min(self.n, self.longest or self.n)
        caught, k = [], 0
        while True:
            size = 1 << k
            if k and (2 * size - 1) * 2 > longest:
                break  # no square of this level's periods fits
            at = self.windows[k] if k < len(self.windows) else 0
            if at + size > self.n:
                break
            self.windows[k:] = [self.n - size + 1, *self.windows[k + 1 :]]
            if k == 0:
                self._store(0, at, units)
            else:
                low, half = self.hashes[k - 1], size >> 1
                self._store(k, at, mix64(low[at : self.n - size + 1] * np.uint64(_BASE) + low[at + half : self.n - half + 1] + np.uint64(size)))
            level = self.hashes[k]
            window = np.arange(at, self.n - size + 1)
            nearest = ((window - 2 * size + 1) >> k) << k
            for catcher in (nearest, nearest - size):
                first = int(np.searchsorted(catcher, 0))  # catchers ascend
                hit = np.flatnonzero(level[catcher[first:]] == level[at + first : self.n - size + 1]) + first
                if len(hit):
                    caught.append((window[hit] - catcher[hit], catcher[hit], np.full(len(hit), size)))
            k += 1
        period, start, stop = self.alive
        if caught:
            q, s, size = (np.concatenate(x) for x in zip(*caught, strict=True))
            order = np.lexsort((s, q))  # a period belongs to one level
            q, s, size = q[order], s[order], size[order]
            head = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] - s[:-1] != size[1:])]))
            tail = np.concatenate([head[1:], [len(q)]]) - 1
            q, a, b = q[head], s[head], s[tail] + size[tail]  # blocks in a row agree with the words q after them
            a = a - self._behind(a, a + q)
            period, start, stop = np.concatenate([period, q]), np.concatenate([start, a]), np.concatenate([stop, b])
        stop = stop + self._ahead(stop, stop + period)
        order = np.lexsort((stop, start, period))
        period, start, stop = period[order], start[order], stop[order]
        one = np.ones(len(order), bool)
        one[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1])
        period, start, stop = period[one], start[one], stop[one]
        open_ = stop + period == self.n
        self.alive = period[open_], start[open_], stop[open_]
        closed = ~open_ & self._long(period, start, stop)
        self.done = tuple(np.concatenate([x, y[closed]]) for x, y in zip(self.done, (period, start, stop), strict=True))

    def _long(self, period: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (stop - start >= period) & (stop - start + period >= self.shortest)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of the runs of the sequence so far, by start, then period."""
        period, start, stop = (np.concatenate(x) for x in zip(self.done, self.alive, strict=True))
        keep = self._long(period, start, stop)
        period, start, stop = period[keep], start[keep], stop[keep]
        order = np.lexsort((stop, period, start))
        period, start, stop = period[order], start[order], stop[order]
        one = np.ones(len(order), bool)
        one[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1])
        # the period is the smallest unless the stretch also has a period that is it over a prime
        rest = period.copy()
        while len(more := np.flatnonzero(one & (rest > 1))):
            prime = _prime_factors(rest[more])
            smaller = period[more] // prime
            one[more] = self._ahead(start[more], start[more] + smaller) < period[more] - smaller
            while len(again := np.flatnonzero(rest[more] % prime == 0)):
                rest[more[again]] //= prime[again]
                more, prime = more[again], prime[again]
        return start[one], (stop - start + period)[one], period[one]


def find_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period), collapsed (string) of each row of `docs(doc_id, text)`.

    Runs have at least `shortest` words and twice their period, are numbered from word 0 and
    ordered by start, then period. A word that any run holds after its first period is left out
    of `collapsed`, the kept words joined by one space. Null and empty texts have no words and no
    runs; repeated rows and null doc_ids are rows like all others; other columns are ignored;
    an empty table gives an empty result. Whole texts are searched; the task holds about 8 bytes
    a word and level, and no run crosses texts. Words are compared by 64-bit hashes.
    """

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                words = Words(step.column(1))
                n, counts = len(words.start), words.counts()
                # texts one after the other, a unit of its own after each
                own = words.doc + np.arange(n)
                units = mix64(np.arange(n + len(counts), dtype=np.uint64) + np.uint64(1 << 63))
                units[own] = words.hashes()
                catchers = Catchers(shortest, int(counts.max(initial=0)))
                catchers.append(units)
                start, length, period = catchers.runs()
                doc = words.doc[np.searchsorted(own, start)] if len(start) else start
                first = words.first[:-1] + np.arange(len(counts))
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))]).astype(np.int32)
                fields = [pa.array(x.astype(np.int64)) for x in (start - first[doc], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                change = np.zeros(len(units) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.flatnonzero(np.cumsum(change)[own] == 0)
                sizes = (words.end - words.start)[kept]
                flat, place = _joined(words.raw, words.start[kept], sizes), np.concatenate([[0], np.cumsum(sizes + 1)])
                ends = np.searchsorted(kept, words.first)
                texts = [flat[place[a] : max(place[a], place[b] - 1)] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([step.column(0), pa.array(counts.astype(np.int64)), runs, pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _joined(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """The stretches of bytes one after the other, a space after each."""
    total = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(total[-1]), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[total[1:] - 1] = False
    out[inside] = raw[np.arange(len(out))[inside] - np.repeat(total[:-1] - start, size)]
    return out.tobytes()
