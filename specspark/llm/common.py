"""What the text operators share: shared-folder tables, token arrays, columns of documents."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Word separators: the ASCII white space characters.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes; a longer text is a step of its own.
STEP_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local session may go without that setting; it gets a temporary folder. Anywhere else
    executors could not read what the driver sees, so a missing setting raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    if ":" not in base.split("/")[0]:
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


#: Rows of a narrow table that are worth a task of their own.
TASK_ROWS = 20_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """`df`, a narrow table of about `rows` rows, in as many tasks as it has TASK_ROWS, at most what it has."""
    return df.coalesce(rows // TASK_ROWS + 1)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once all that reads them is written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no living DataFrame needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: The id that stands for null inside the operators: it orders first.
NO_ID = -(1 << 63)


def row_key() -> list[Column]:
    """(id, tk): doc_id, and 128 bits of the SHA-256 of the text and of what is null; `id` is never null.

    So rows of one doc_id, or without one, are told apart by their texts, null from empty, and
    a missing doc_id from the smallest one, which only share their place in the order of ids.
    """
    nulls = F.concat(F.when(F.col("doc_id").isNull(), "-").otherwise("+"), F.when(F.col("text").isNull(), "-").otherwise("+"))
    whole = F.sha2(F.concat(nulls, F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.unhex(F.substring(whole, 1, 32)).alias("tk")]


def with_row_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, text, id, tk): (id, tk) tells apart rows that share a doc_id but not a text (see `row_key`)."""
    return docs.select("doc_id", "text", *row_key())


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))


def word_array(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    clean = stripped(text)
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, SPACE_RUN))


def word_count(text: Column) -> Column:
    clean = stripped(text)
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, SPACE_RUN))).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII characters alone need no look-up of each character."""
    letters = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(letters)


def doc_remainder(modulus: int) -> Column:
    """crc32 of the decimal doc_id modulo `modulus`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


# ---- vectorised tokens inside tasks -------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_steps(batch: pa.RecordBatch, limit: int = STEP_BYTES):
    """Cut a batch into runs of rows of about `limit` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts (null: none) and the offset of each text."""
    flat = pa.array(column).cast(pa.large_binary()) if not isinstance(column, pa.Array) else column.cast(pa.large_binary())
    flat = pc.fill_null(flat, b"")
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, dtype=np.uint64)]))


class Words:
    """Words of consecutive texts as arrays: where each starts and ends, its text, its 64-bit hash."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, offsets = text_bytes(column)
        self.raw = _LOWER[raw] if lower else raw
        self.offsets, n = offsets, len(raw)
        inside = ~_IS_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]]) if n else inside
        after = np.concatenate([inside[1:], [False]]) if n else inside
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))  # word index where each text begins

    def hashes(self) -> np.ndarray:
        n = len(self.raw)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)[:-1], out=total[1:])
        return mix64((total[self.end] - total[self.start]) * _powers(_INVERSE, n)[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Hash of units[i:i+length] for each i, by doubling; empty if there are too few units."""
    if len(units) < length:
        return np.zeros(0, np.uint64)
    part, size, out, done = units, 1, None, 0
    n = len(units) - length + 1
    while True:
        if length & size:
            piece = part[done : done + n]
            out = mix64(piece + np.uint64(1)) if out is None else mix64(out * np.uint64(_BASE) + piece)
            done += size
        if done == length:
            return out
        part = mix64(part[:-size] * np.uint64(_BASE) + part[size:] + np.uint64(size))
        size *= 2


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
