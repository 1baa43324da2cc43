"""Substring deduplication by level-wise doubling of repeated word windows.

Level one looks at short windows, and only at those that the content chooses as anchors of the
wanted windows (see `repeats`). Windows that repeat across documents at one length, and those
alone, are extended to twice that length, until the wanted length is reached or no candidate
survives: 13, 25 and 50 words. The hashes of all levels are made in one pass over the texts, the
shorter window always lying inside the longer one, so a level costs narrow rows of survivors
only. At the wanted length all windows of a cell are first compared at once, by the hash of the
whole cell; where cells differ, each window is compared by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, release, signed, text_steps, window_hashes, with_row_keys, written
from .repeats import Stretches, _leftmost_least, cells, flat_spans, merged, row_starts, spans_by_doc

WORDS, SHORTEST = 50, 12


def levels(length: int = WORDS, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the shortest level up: each is at most twice the one before, the last is `length`."""
    out = [length]
    while out[0] > 1 and -(-out[0] // 2) >= min(shortest, length // 2):
        out.insert(0, -(-out[0] // 2))
    return out


def _cell_table(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(g0, g1, .., body, id, tk, first, last) of each cell of `docs(id, tk, text)`: window hashes of all levels but the last, hash of the whole cell."""
    length, part = sizes[-1], sizes[-2]
    names = [*[f"g{k}" for k in range(len(sizes) - 1)], "body", "id", "tk", "first", "last"]

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                words = Words(step.column(2))
                s = Stretches(words.hashes())
                grams = s.grams(part)
                first, last, at = cells(grams, row_starts(words.first, len(words.start)), length, part)
                found, inner, size = [grams[at]], at, part
                for smaller in sizes[-3::-1]:
                    grams = s.grams(smaller)
                    inner = _leftmost_least(grams, size - smaller + 1)[inner] if len(inner) else inner
                    found.insert(0, grams[inner])
                    size = smaller
                row = np.searchsorted(words.first, first, side="right") - 1
                base, at_row = words.first[row], pa.array(row)
                arrays = [*[pa.array(signed(x)) for x in (*found, s(first, last + length))], step.column(0).take(at_row), step.column(1).take(at_row), *[pa.array((x - base).astype(np.int32)) for x in (first, last)]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    hashes = ", ".join(f"{x} long" for x in names[: len(sizes)])
    return docs.select("id", "tk", "text").mapInArrow(run, f"{hashes}, id long, tk binary, first int, last int")


def _window_table(docs: DataFrame, ranges: DataFrame, length: int) -> DataFrame:
    """(window, id, tk, start): hash of each window that starts in `ranges(id, tk, spans)`."""

    def run(batches):
        for batch in batches:
            for step in text_steps(batch):
                words = Words(step.column(2))
                h = window_hashes(words.hashes(), length)
                out = []
                for i, rs in enumerate(step.column(3).to_pylist()):
                    at = np.unique(np.concatenate([np.arange(r["start"], r["stop"]) for r in rs]))
                    out.append((h[words.first[i] + at], np.full(len(at), i), at))
                if out:
                    w, row, at = (np.concatenate(x) for x in zip(*out, strict=True))
                    row = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w)), step.column(0).take(row), step.column(1).take(row), pa.array(at.astype(np.int32))], names=["window", "id", "tk", "start"])

    return docs.join(ranges, ["id", "tk"]).select("id", "tk", "text", "spans").mapInArrow(run, "window long, id long, tk binary, start int")


def surviving_cells(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """(anchor, body, id, tk, first, last, least, one): cells whose windows of every level below `length` occur in two documents.

    least: the smallest id that has the anchor, the window of the last level; one: all cells
    of the anchor are equal. What repeats is written before it is joined, so that Spark can
    split the join where one window has many rows.
    """
    sizes = levels(length)
    if len(sizes) < 2:
        raise ValueError("windows have two words at least")
    level = written(_cell_table(docs, sizes), "cells")
    for k in range(len(sizes) - 1):
        key, last = f"g{k}", k == len(sizes) - 2
        both = [F.min("id").alias("least"), F.max("id").alias("most"), *([F.min("body").alias("b0"), F.max("body").alias("b1")] if last else [])]
        again = level.groupBy(key).agg(*both).where("least < most")
        again = written(again.select(F.col(key), "least", (F.col("b0") == F.col("b1")).alias("one")) if last else again.select(key), "again")
        kept = written(level.join(again, key).drop(key) if not last else level.join(again, key).withColumnRenamed(key, "anchor"), "level")
        discard(level, again)
        release(docs.sparkSession)
        level = kept
        if not last and not level.head(1):  # no candidate survives
            return level.select(F.col(f"g{len(sizes) - 2}").alias("anchor"), "body", "id", "tk", "first", "last", F.lit(0).cast("long").alias("least"), F.lit(True).alias("one"))
    return level


def repeated_spans(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """(id, tk, start, stop), in words: stretches made of windows that also start in a document with a smaller id, for `docs(id, tk, text)`."""
    spark = docs.sparkSession
    level = surviving_cells(docs, length)
    whole = F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    found = level.where("one and id > least").select("id", "tk", whole.alias("s"))
    several = level.where("not one")
    bodies = written(several.groupBy("anchor", "body").agg(F.min("id").alias("least")), "least")
    several = written(several.drop("least").join(bodies, ["anchor", "body"]).select("id", "tk", "first", "last", "least"), "bodies")
    discard(bodies)
    found = found.unionByName(several.where("id > least").select("id", "tk", whole.alias("s"))).select("id", "tk", "s.start", "s.stop")
    open_ = several.where("id = least").select("id", "tk", F.col("first").alias("start"), (F.col("last") + 1).alias("stop"))
    windows = written(_window_table(docs, spans_by_doc(open_), length), "windows")
    release(spark)
    shared = written(windows.groupBy("window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("window", "least"), "shared")
    single = windows.join(shared, "window").where("id > least").select("id", "tk", "start", (F.col("start") + length).alias("stop"))
    return found.unionByName(single)


def deduplicate(docs: DataFrame, length: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of each row of `docs(doc_id, text)`: kept words joined by one space.

    Of each repeated window the document with the smallest doc_id keeps its words. Null or
    empty text: no words. A null doc_id counts as smaller than all others. Rows that share a
    doc_id lose nothing to each other, whatever their texts, as neither is smaller; equal rows
    get equal results. Texts shorter than a window stay whole; other columns are ignored; an
    empty table gives an empty result. Windows are compared by 64-bit hashes.
    """
    keyed = with_row_keys(docs)
    spans = written(spans_by_doc(repeated_spans(keyed.select("id", "tk", "text"), length)), "spans")
    release(docs.sparkSession)

    def cut(batches):
        for batch in batches:
            row, start, stop = merged(*flat_spans(batch.column(2)))
            removed = np.bincount(row, weights=stop - start, minlength=batch.num_rows).astype(np.int64)
            cuts, n_words, texts = np.searchsorted(row, np.arange(batch.num_rows + 1)), [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                kept, end = [], 0
                for k in range(cuts[i], cuts[i + 1]):
                    kept += words[end : start[k]]
                    end = int(stop[k])
                texts.append(b" ".join(kept + words[end:] if end else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    kind = dict(docs.dtypes)["doc_id"]
    return keyed.join(spans, ["id", "tk"], "left").select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def oracle(length: int = WORDS) -> str:
    """The digest query over a `documents` view, in DuckDB SQL."""
    body = r"trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))"
    return f"""
with d as (select doc_id, case when {body} = '' then cast([] as varchar[]) else string_split({body}, ' ') end as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1 : i + {length}], ' ')) as h from (select doc_id, w, unnest(range(0, len(w) - {length} + 1)) as i from d where len(w) >= {length})),
least_ as (select h, min(doc_id) as d0 from win group by h),
hit as (select distinct doc_id, unnest(range(i, i + {length})) as pos from win join least_ using (h) where d0 < doc_id),
words as (select doc_id, unnest(range(0, len(w))) as pos, unnest(w) as word from d),
kept as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by words.pos) as body from words left join hit on hit.doc_id = words.doc_id and hit.pos = words.pos where hit.pos is null group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(body, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id"""
