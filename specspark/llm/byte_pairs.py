"""Byte-level BPE over a global shuffle of distinct words; decoding from the token-byte table.

Texts are cut into pre-tokens (words below). Words are not moved once for each place they stand
at: a task numbers the distinct words of a block of texts, keeps the texts as positions in that
numbering, and explodes the numbered words alone. The global shuffle by word brings equal words
together, each distinct word is encoded once, its ids go back to (block, number), and the ids
of a text are put together by position. The positions, the larger side of that last step, are
written in buckets by block, so they never move.
"""

from __future__ import annotations

import base64
import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, text_steps

#: Text bytes and distinct words at which a block is closed; characters that are cut into words at once.
BLOCK_BYTES, BLOCK_WORDS, PIECE = 32 << 20, 500_000, 4 << 20
#: Words of one row of a block's numbered words.
ROW_WORDS = 2048


def ranks_of(path: str) -> dict[bytes, int]:
    """The rank of each token of a rank file: lines of base64 bytes and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _words(text: str, pattern):
    """Lists of the pre-tokens of a text, in order; a long text gives several."""
    if len(text) <= PIECE:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while part := list(itertools.islice(found, 1 << 20)):
        yield part


@functools.cache
def _zstd():
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(numbers: np.ndarray) -> bytes:
    """int32 numbers, compressed: the first bytes of all, then all second bytes and so on."""
    return _zstd()[0].compress(numbers.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def _numbered(docs: DataFrame, pattern: str, kind: str) -> DataFrame:
    """Rows of two forms: texts (block, ids, counts, positions) and distinct words (block, first, words).

    counts: pre-tokens of each text; positions: their words' numbers in the block, packed.
    """
    schema = f"block long, ids array<{kind}>, counts array<int>, positions binary, first int, words array<string>"

    def run(batches):
        from pyspark import TaskContext

        cut = regex.compile(pattern)
        block, size = TaskContext.get().partitionId() << 24, 0
        names = pa.schema([("block", pa.int64()), ("ids", pa.list_(id_type)), ("counts", pa.list_(pa.int32())), ("positions", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])
        numbers = {}

        def row(**values):
            return pa.RecordBatch.from_pylist([{"block": block, **values}], schema=names)

        def closed():
            words = list(numbers)
            for k in range(0, len(words), ROW_WORDS):
                yield row(first=k, words=words[k : k + ROW_WORDS])

        number = lambda w: numbers.setdefault(w, len(numbers))
        for batch in batches:
            for step in text_steps(batch):
                counts, parts = [], []
                for text in step.column(1).to_pylist():
                    n = 0
                    for words in _words(text or "", cut):
                        parts.append(np.fromiter(map(number, words), np.int32, len(words)))
                        n += len(words)
                    counts.append(n)
                    size += len(text or "")
                positions = _packed(np.concatenate([np.zeros(0, np.int32), *parts]))
                yield row(ids=step.column(0).to_pylist(), counts=counts, positions=positions)
                if size >= BLOCK_BYTES or len(numbers) >= BLOCK_WORDS:
                    yield from closed()
                    numbers.clear()
                    block, size = block + 1, 0
        yield from closed()

    id_type = pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """`df` written to the shared folder in buckets by block, and read back."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/table"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    out = spark.table(name)
    out.schema  # noqa: B018  the plan knows its files before the name goes
    spark.sql(f"drop table {name}")
    out.written_to = path
    return out


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(block, coded binary) of `words(word, block, number)`: the ids of each word, rows of one block put together.

    coded: how many words, their numbers, how many ids each has, and the ids, packed (see `coded_words`).

    One shuffle brings equal words to one task, where they stand one after the other and are
    encoded once. A word has one row a block at most, whatever it stands for in the texts.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    kind = pa.list_(pa.int32())

    def run(batches):
        import tiktoken

        encode = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=shared.value, special_tokens={}).encode_ordinary
        last, known = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            tokens = [known if w == last else encode(w) for w in distinct]
            last, known = distinct[-1], tokens[-1]
            order = np.argsort(batch.column(1).to_numpy(), kind="stable")
            blocks, numbers = batch.column(1).to_numpy()[order], batch.column(2).to_numpy()[order]
            tokens = pa.array(tokens, kind).take(coded.indices.take(pa.array(order)))
            lengths, flat = pc.list_value_length(tokens).to_numpy(), tokens.flatten().to_numpy()
            head = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
            ends, at = np.concatenate([head, [len(blocks)]]), np.concatenate([[0], np.cumsum(lengths)])
            rows = [_packed(np.concatenate([[j - i], numbers[i:j], lengths[i:j], flat[at[i] : at[j]]])) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks[head]), pa.array(rows, pa.binary())], names=["block", "coded"])

    met = words.select("word", "block", "number").repartition("word").sortWithinPartitions("word")
    return met.mapInArrow(run, "block long, coded binary")


def coded_words(rows: list[bytes]) -> tuple[np.ndarray, pa.ListArray]:
    """(numbers, ids of each) of the coded words of a block."""
    parts = [(x[1 : 1 + x[0]], x[1 + x[0] : 1 + 2 * x[0]], x[1 + 2 * x[0] :]) for x in map(_unpacked, rows)]
    numbers, lengths, tokens = (np.concatenate([np.zeros(0, np.int32), *x]) for x in (zip(*parts, strict=True) if parts else ([], [], [])))
    return numbers, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(tokens))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, tokens (array<int>) of each row of `docs(doc_id, text)`: byte-level BPE of each match of `pattern`.

    With `decoded`, also decoded (binary), what `decode` makes of the tokens, in the same task.

    Null and empty texts have no tokens. Repeated rows and null doc_ids are rows like all others;
    other columns are ignored; an empty table gives an empty result. There are no special tokens:
    their spellings are text. Whole texts are encoded; a task holds the distinct words of one
    block, and a word, however long, is one row.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table = _bucketed(_numbered(docs, pattern, kind), buckets)
    words = table.where("words is not null").select("block", "first", F.posexplode("words").alias("k", "word")).select("word", "block", (F.col("first") + F.col("k")).alias("number"))
    coded = encode_words(words, ranks)
    texts = table.where("positions is not null").select("block", "ids", "counts", "positions")
    shared = spark.sparkContext.broadcast(ranks)

    def put_together(texts: pa.Table, coded: pa.Table) -> pa.Table:
        numbers, tokens = coded_words(coded.column("coded").to_pylist())
        by_number = tokens.take(pa.array(np.argsort(numbers)))
        out, ids, back = [], [], []
        pieces = _token_array(shared.value) if decoded else None
        for own, counts, positions in zip(*(texts.column(c).to_pylist() for c in ("ids", "counts", "positions")), strict=True):
            ids += own
            tokens = by_number.take(pa.array(_unpacked(positions)))
            sums = np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())])
            at = sums[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
            out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), tokens.flatten()))
            if decoded:
                back.append(_decoded(out[-1], pieces))
        columns = {"doc_id": pa.array(ids, id_type), "tokens": pa.chunked_array(out, pa.list_(pa.int32()))}
        return pa.table(columns | ({"decoded": pa.chunked_array(back, pa.binary())} if decoded else {}))

    id_type = pa.int32() if kind == "int" else pa.int64() if kind == "bigint" else pa.string()
    schema = f"doc_id {kind}, tokens array<int>" + (", decoded binary" if decoded else "")
    return texts.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(put_together, schema)


def _token_array(ranks: dict[bytes, int]) -> pa.Array:
    """The token-byte table as an array: the bytes of token k are element k."""
    table = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.binary())


def _decoded(tokens: pa.Array, pieces: pa.Array) -> pa.Array:
    """The bytes of the tokens of each list, one after the other."""
    found = pieces.take(tokens.flatten())
    if found.null_count:
        raise ValueError("a token that is not in the table")
    return pc.binary_join(pa.ListArray.from_arrays(_offsets(tokens), found), b"")


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`rows(doc_id, tokens)` with `decoded` (binary): the bytes of the tokens, one after the other.

    Tokens join the token-byte table, which is as long as the vocabulary, by their number: each
    task holds it as an array. An unknown token raises. Null tokens decode to null.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        pieces = _token_array(shared.value)
        for batch in batches:
            tokens = batch.column(1)
            decoded = _decoded(tokens, pieces)
            if tokens.null_count:
                decoded = pc.if_else(pc.is_valid(tokens), decoded, pa.scalar(None, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), tokens, decoded], names=["doc_id", "tokens", "decoded"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.select("doc_id", "tokens").mapInArrow(run, f"doc_id {kind}, tokens array<int>, decoded binary")


def _offsets(lists: pa.Array) -> pa.Array:
    """Offsets of the lists in their flattened values; a null list holds none."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
