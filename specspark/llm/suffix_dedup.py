"""Suffix-array deduplication of byte strings by a common-prefix interval tree.

Suffixes that start at content-chosen anchors are sorted, anchor by anchor, with the common
prefix of each two neighbours; a stack scan of those gives the tree of intervals that share a
prefix. For each interval the texts before the anchors are put in order too: neighbours there
show how far an occurrence extends to the left together with another, and where the extensions
differ. An interval with a left extension that reaches the wanted length is a maximal repeat,
given with all its occurrences.

Cells (see `repeats`) with the same anchor and the same bytes are one weighted suffix: it is
sorted once, stands in the tree as two equal suffixes if it has two members or more, and what
the tree finds for it holds for all its members. An anchor with more than GROUP different
suffixes is not gathered in one task: there the intervals of the wanted length, which are
classes of equal windows, are told by hash; that gives the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, release, signed, text_bytes, text_steps, with_row_keys, written
from .repeats import Stretches, cells, flat_spans, merged, row_starts, spans_by_doc

#: Bytes of a string that is removed where it repeats; bytes of an anchor; suffixes of an anchor that a task gathers.
BYTES, ANCHOR, GROUP = 400, 64, 20_000


def _cell_table(docs: DataFrame, length: int, part: int) -> DataFrame:
    """(anchor, body, id, tk, first, at, stop) of each cell of `docs(id, tk, text)`: its bytes and the place of its anchor."""

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                raw, offsets = text_bytes(step.column(2))
                units = raw.astype(np.uint64)
                s, rows = Stretches(units), row_starts(offsets, len(units))
                grams = s.grams(part)
                first, last, at = cells(grams, rows, length, part)
                stop = last + length
                row = np.searchsorted(offsets, first, side="right") - 1
                base, at_row = offsets[row], pa.array(row)
                body = mix64(s(first, stop) + (at - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                places = [pa.array((x - base).astype(np.int32)) for x in (first, at, stop)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams[at])), pa.array(signed(body)), step.column(0).take(at_row), step.column(1).take(at_row), *places], names=["anchor", "body", "id", "tk", "first", "at", "stop"])

    return docs.select("id", "tk", "text").mapInArrow(run, "anchor long, body long, id long, tk binary, first int, at int, stop int")


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    return int((np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)).argmax())


def intervals(lcp: list[int]):
    """(common prefix, first, last) of each interval of the enhanced suffix array, inner before outer; lcp[i] is between i and i + 1."""
    stack = [(0, 0)]
    for i, h in enumerate([*lcp, 0]):
        left = i
        while stack[-1][0] > h:
            top, left = stack.pop()
            yield top, left, i
        if stack[-1][0] < h:
            stack.append((h, left))


def maximal_repeats(before: list[bytes], after: list[bytes], length: int):
    """(members, starts, stop) of the maximal repeats of at least `length` bytes across anchors.

    before[i] and after[i] are the bytes up to and from anchor i; starts (one per member,
    negative) and stop count from the anchor. An occurrence that an inner interval has already
    covered further is not given again.
    """
    n = len(after)
    order = sorted(range(n), key=after.__getitem__)
    lcp = [_common(after[a], after[b]) for a, b in zip(order, order[1:])]  # noqa: B905
    left = [x[::-1] for x in before]
    by_left = sorted(range(n), key=left.__getitem__)
    left_lcp = np.array([_common(left[a], left[b]) for a, b in zip(by_left, by_left[1:])], np.int64)  # noqa: B905
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    by_left, order_ = np.array(by_left), np.array(order)
    best = np.full(n, -1, np.int64)
    longest = max(map(len, left), default=0)
    for prefix, lo, hi in intervals(lcp):
        if prefix + longest < length:
            continue
        s = np.sort(rank[order_[lo : hi + 1]])
        shared = np.minimum.reduceat(left_lcp[: s[-1]], s[:-1]) if len(s) > 1 else np.zeros(0, np.int64)
        reach = np.zeros(len(s), np.int64)
        reach[1:] = shared
        reach[:-1] = np.maximum(reach[:-1], shared)
        member = by_left[s]
        gain = (reach + prefix >= length) & (reach > best[member])
        if not gain.any():
            continue
        best[member[gain]] = reach[gain]
        cut = np.flatnonzero(np.concatenate([[True], shared + prefix < length, [True]]))
        for a, b in zip(cut[:-1], cut[1:], strict=True):  # runs whose left extensions reach the length
            if b - a > 1 and gain[a:b].any():
                yield member[a:b], -reach[a:b], prefix


_SUFFIX = "anchor long, body long, n long, to_left int, to_right int, before binary, after binary"
_SPAN = "anchor long, body long, repeat int, start int, stop int"


def _with_bytes(docs: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Weighted suffixes with the bytes up to and from their anchors, taken from one member of each."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows += [(c["anchor"], c["body"], c["n"], c["at"] - c["first"], c["stop"] - c["at"], raw[c["first"] : c["at"]], raw[c["at"] : c["stop"]]) for c in own]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "body", "n", "to_left", "to_right", "before", "after"])

    by_text = suffixes.groupBy("id", "tk").agg(F.collect_list(F.struct("anchor", "body", "n", "first", "at", "stop")).alias("own"))
    return docs.dropDuplicates(["id", "tk"]).join(by_text, ["id", "tk"]).select("text", "own").mapInArrow(run, _SUFFIX)


def _tree(length: int):
    """Spans, relative to the anchor, of the maximal repeats of each anchor; its suffixes come one after the other."""

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor", "body", "repeat", "start", "stop"])

    def solve(anchor, rows, out):
        twice = [i for i, r in enumerate(rows) for _ in range(min(r[1], 2))]
        found = [{} for _ in rows]  # repeat by start and stop
        for k, (members, starts, stop) in enumerate(maximal_repeats([rows[i][4] for i in twice], [rows[i][5] for i in twice], length)):
            for m, s in zip(members.tolist(), starts.tolist(), strict=True):
                found[twice[m]].setdefault((s, -stop), k)
        for row, own in zip(rows, found, strict=True):
            reach = None
            for (s, stop), k in sorted(own.items()):  # an occurrence inside a longer one is left out
                if reach is None or -stop > reach:
                    out.append((anchor, row[0], k, s, -stop))
                    reach = -stop

    def run(batches):
        anchor, rows, out = None, [], []
        for batch in batches:
            for a, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != anchor:
                    if rows:
                        solve(anchor, rows, out)
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
                    anchor, rows = a, []
                rows.append(row)
        if rows:
            solve(anchor, rows, out)
        if out:
            yield batch_of(out)

    return run


def _window_spans(suffixes: DataFrame, length: int) -> DataFrame:
    """The same by hashes of single windows, for anchors with too many different suffixes."""

    def run(batches):
        for batch in batches:
            for a, b, before, after in zip(*(batch.column(k).to_pylist() for k in ("anchor", "body", "before", "after")), strict=True):
                h = Stretches(np.frombuffer(before + after, np.uint8).astype(np.uint64)).grams(length)
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(np.full(len(h), a)), pa.array(np.full(len(h), b)), pa.array((np.arange(len(h)) - len(before)).astype(np.int32))], names=["window", "anchor", "body", "start"])

    whole = suffixes.where("n > 1").select("anchor", "body", F.lit(-1).alias("repeat"), (-F.col("to_left")).alias("start"), F.col("to_right").alias("stop"))
    windows = written(suffixes.mapInArrow(run, "window long, anchor long, body long, start int"), "windows")
    # equal windows have the same anchor at the same offset; a place lies in one suffix of an anchor at one offset
    again = written(windows.groupBy("anchor", "start", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    return whole.unionByName(windows.join(again, ["anchor", "start", "window"]).select("anchor", "body", F.lit(-1).alias("repeat"), "start", (F.col("start") + length).alias("stop")))


def repeated_spans(docs: DataFrame, length: int = BYTES, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """(anchor, repeat, id, tk, start, stop), in bytes: occurrences of repeats of at least `length` bytes in `docs(id, tk, text)`.

    The occurrences of one repeat share (anchor, repeat); repeat -1 is a window of a large group.
    A repeat that is longer than a cell comes in pieces, one for each anchor in it.
    """
    spark = docs.sparkSession
    table = written(_cell_table(docs, length, anchor), "cells")
    again = written(table.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "again")
    level = written(table.join(again, "anchor"), "repeated")
    discard(table, again)
    release(spark)
    member = F.min(F.struct("id", "tk", "first", "at", "stop")).alias("m")
    suffixes = written(level.groupBy("anchor", "body").agg(F.count("*").alias("n"), member), "suffixes")
    sizes = written(suffixes.groupBy("anchor").agg(F.count("*").alias("texts")), "sizes")
    fetched = written(_with_bytes(docs, suffixes.select("anchor", "body", "n", "m.*")), "bytes")
    discard(suffixes)
    release(spark)
    parts, columns = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), fetched.columns
    many = sizes.where(F.col("texts") > group).select("anchor")
    large = bool(many.head(1))
    few = fetched.join(many.hint("merge"), "anchor", "left_anti").select(*columns) if large else fetched
    found = few.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_tree(length), _SPAN)
    if large:
        found = found.unionByName(_window_spans(written(fetched.join(many, "anchor").select(*columns), "large"), length))
    found = written(found, "found")
    discard(fetched, sizes)
    release(spark)
    return level.select("anchor", "body", "id", "tk", "at").join(found, ["anchor", "body"]).select("anchor", "repeat", "id", "tk", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("stop")).alias("stop"))


def deduplicate(docs: DataFrame, length: int = BYTES, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of each row of `docs(doc_id, text)`.

    Every byte of a string of `length` bytes that also starts elsewhere is removed, in all its
    occurrences. Null counts as the empty text. Every row is a text
    of its own, with or without a doc_id of its own: equal rows are two places, so what reaches
    the length goes from both, and rows that share a doc_id but not a text are told apart (by
    the id and 128 bits of the text's hash). Shorter texts stay whole; other columns are ignored;
    an empty table gives an empty result. Cells are compared by 64-bit hashes, differing ones by
    their bytes.
    """
    keyed = with_row_keys(docs)
    spans = written(spans_by_doc(repeated_spans(keyed.select("id", "tk", "text"), length, group=group)), "spans")
    release(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            at, a, b = merged(*flat_spans(batch.column(2)))
            removed, runs = np.bincount(at, weights=b - a, minlength=n).astype(np.int64), np.bincount(at, minlength=n)
            cuts, sizes, kept = np.searchsorted(at, np.arange(n + 1)), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw, end, parts = (text or "").encode("utf-8", "surrogatepass"), 0, []
                for k in range(cuts[i], cuts[i + 1]):
                    parts.append(raw[end : a[k]])
                    end = int(b[k])
                kept.append(b"".join(parts) + raw[end:] if parts else raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)], pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return keyed.join(spans, ["id", "tk"], "left").select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def oracle(length: int = BYTES) -> str:
    """The digest query over a `documents` view, in DuckDB SQL: every window of every text, by its hash."""

    def runs(name: str, size: int) -> str:
        return f"""{name}_w as (select doc_id, i, hash(substr(h, 2 * i + 1, {2 * size})) as m from (select doc_id, h, unnest(range(0, n - {size - 1})) as i from d where n >= {size})),
{name}_r as (select doc_id, i from {name}_w where m in (select m from {name}_w group by m having count(*) > 1)),
{name}_g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from (select doc_id, i, case when i - {size} <= lag(i) over (partition by doc_id order by i) then 0 else 1 end as new from {name}_r)),
{name} as (select doc_id, g, min(i) as a, max(i) + {size} as b from {name}_g group by 1, 2)"""

    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
{runs("gone", length)},
pieces as (select doc_id, a as place, substr(h, 2 * coalesce(lag(b) over w, 0) + 1, 2 * (a - coalesce(lag(b) over w, 0))) as piece from gone join d using (doc_id) window w as (partition by doc_id order by a)
  union all select doc_id, n, substr(h, 2 * last + 1) from d join (select doc_id, max(b) as last from gone group by 1) using (doc_id)),
kept as (select doc_id, string_agg(piece, '' order by place) as h from pieces group by 1),
g as (select doc_id, sum(b - a) as removed, count(*) as spans from gone group by 1)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id left join g on g.doc_id = d.doc_id"""
