"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Splitters between shards are found by
counting the exact bytes below many candidate boundaries at once and refining the candidates
around each wanted share until the count is within the tolerance; then every row gets its
shard from the splitters and all rows move once. Equal texts share a hash, so they stay in
one shard unless their group has more than GROUP_SHARE of a shard's bytes and a boundary falls
into it; only then doc_id splits it. So a shard is off its share by at most half of GROUP_SHARE
at either end, or by half a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 16
#: Candidate boundaries per splitter and round; tolerance as a share of one shard's bytes.
PROBES = 128
TOLERANCE = 0.001
#: Groups of equal texts with up to this share of one shard's bytes stay whole.
GROUP_SHARE = 1 / 8
#: Rows per block when rows of a shard are numbered.
BLOCK_ROWS = 4096
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _below(rows: DataFrame, column: str, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with column < probe, for each of the sorted probes."""
    edges = np.array(probes, dtype=np.int64)

    def count(batches):
        sizes, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(), side="right")
            np.add.at(sizes, at, b.column(1).to_numpy())
            n += np.bincount(at, minlength=len(n))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int64)), pa.array(sizes[full]), pa.array(n[full])], names=["slot", "bytes", "n"])

    got = rows.select(column, "size").mapInArrow(count, "slot long, bytes long, n long").groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    sizes, n = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in got:
        sizes[r["slot"]], n[r["slot"]] = r["bytes"], r["n"]
    return np.cumsum(sizes)[:-1].tolist(), np.cumsum(n)[:-1].tolist()


def _refine(rows: DataFrame, column: str, wanted: dict[int, int], tolerance: float) -> dict[int, tuple[int, int, int, int]]:
    """For each wanted byte count: the boundary nearest to it, its bytes, and the lower end of the values that hold the wanted count with the bytes below it.

    A splitter is done when its boundary is within the tolerance, or when its interval holds
    one value or one row, which no finer boundary can split.
    """
    state = {j: (_LOW, 0, 0, _HIGH) for j in wanted}
    best: dict[int, tuple[int, int]] = {}
    open_ = set(wanted)
    while open_:
        probes = set()
        for j in open_:
            lo, _, _, hi = state[j]
            probes |= set(range(lo, hi, max(1, (hi - lo) // (PROBES + 1)))[1:]) | {hi}
        probes = sorted(probes)
        sizes, counts = _below(rows, column, probes)
        for j in list(open_):
            lo, lo_bytes, lo_rows, hi = state[j]
            k = int(np.searchsorted(sizes, wanted[j], side="right"))  # the first probe with more bytes than wanted
            if k and probes[k - 1] > lo:
                lo, lo_bytes, lo_rows = probes[k - 1], sizes[k - 1], counts[k - 1]
            ends = [(abs(lo_bytes - wanted[j]), lo, lo_bytes)]
            held = None
            if k < len(probes):
                hi, held = min(hi, probes[k]), counts[k] - lo_rows
                ends.append((abs(sizes[k] - wanted[j]), probes[k], sizes[k]))
            state[j] = (lo, lo_bytes, lo_rows, hi)
            off, *best[j] = min(ends)
            if off <= tolerance or hi - lo <= 1 or held == 1:
                open_.discard(j)
    return {j: (*best[j], state[j][0], state[j][1]) for j in wanted}


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """`shards - 1` lower bounds (key, id) of shards 1.. over rows(key, id, size)."""
    total = rows.agg(F.sum("size")).first()[0]
    if not total:
        return [(_HIGH, _HIGH)] * (shards - 1)
    allowed = tolerance * total / shards
    wanted = {j: total * j // shards for j in range(1, shards)}
    found = _refine(rows, "key", wanted, allowed)
    out = {j: (p, _LOW) for j, (p, *_) in found.items()}
    inside: dict[int, list[int]] = {}
    for j, (_, n, lo, _) in found.items():
        if abs(n - wanted[j]) > allowed:
            inside.setdefault(lo, []).append(j)  # the wanted count lies within the rows of one key
    for key, those in inside.items():
        base = found[those[0]][3]
        group = rows.where(F.col("key") == F.lit(key))
        if (group.agg(F.sum("size")).first()[0] or 0) <= GROUP_SHARE * total / shards:
            continue
        for j, (p, n, *_) in _refine(group, "id", {j: wanted[j] - base for j in those}, allowed).items():
            if abs(base + n - wanted[j]) < abs(found[j][1] - wanted[j]):
                out[j] = (key, p)
    return [out[j] for j in range(1, shards)]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, columns: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `docs(doc_id, text)` with its shard: sizes of the shards are near equal.

    Columns: doc_id, size (UTF-8 bytes + 1), text_crc32, shard (0..shards-1), slot (0.. without
    gaps within the shard). Null text counts as empty; null doc_id orders first. Repeated rows
    are rows of their own and get slots of their own; slots follow blocks of (id, key), then id, key and
    size, and rows equal in all of these may change places. An empty table gives an empty result; a
    text larger than a shard makes its shard larger. `columns` of `docs` come along, all others
    are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = (
        docs.select(
            "doc_id",
            *columns,
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("key"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("id"),
        )
    )
    rows = written(keyed.select("doc_id", "size", "text_crc32", "key", "id"), "keys")
    cuts = splitters(rows, shards, tolerance)
    number = F.lit(0)
    for key, id_ in cuts:
        number = number + F.when((F.col("key") > F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("id") >= F.lit(id_))), 1).otherwise(0)
    blocks = max(1, rows.count() // BLOCK_ROWS)
    number, block = number.cast("int").alias("shard"), F.pmod(F.xxhash64("id", "key"), F.lit(blocks)).alias("block")
    before = (
        rows.select(number, block)
        .groupBy("shard", "block")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n"))
        .drop("n")
    )
    line = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "key", "size")) - 1
    placed = (keyed if columns else rows).select("*", number, block)
    return placed.join(before, ["shard", "block"]).withColumn("slot", (F.col("before") + line).cast("long")).select("doc_id", *columns, "size", "text_crc32", "shard", "slot")
