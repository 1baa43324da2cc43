"""Benchmark decontamination: normalised test n-grams, broadcast and looked up in all documents.

Ten-word windows of a document are not all hashed. Any such window holds one of the document's
five-word grams that start at a multiple of six, so only those are looked up among the
benchmark's grams; around a gram that is found, the whole windows are compared as text. Items of
fewer than ten words are looked up at every word. All lengths are looked up in one pass over the
texts. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, lower_ascii, written

WINDOW, GRAM = 10, 5
#: The benchmark side is broadcast up to so many bytes of keys, windows and item ids; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20
NOT_WORD, WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def row_keys() -> list[Column]:
    """(id, row_key): rows that share a doc_id are told apart by their text, and rows without one are told apart as well."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("row_key")]


def _gram(w: Column | str, start: Column, length) -> Column:
    return F.array_join(F.slice(w, start, length), " ")


def item_windows(items: DataFrame) -> DataFrame:
    """(window, length, item_ids): each distinct window of `items(item_id, text)` with the items that have it."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    listed = listed.select("item_id", "w", F.least(F.lit(WINDOW), F.size("w")).alias("length"))
    listed = listed.select("item_id", "length", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1), lambda i: _gram("w", i, F.col("length")))).alias("window"))
    return listed.groupBy("window").agg(F.first("length").alias("length"), F.collect_set("item_id").alias("item_ids"))


def _small(df: DataFrame) -> bool:
    """Whether a table of the benchmark may be broadcast, by its measured bytes."""
    size = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        size = size + (F.octet_length(F.array_join(name, ",")) if kind.startswith("array") else F.octet_length(name) if kind == "string" else F.lit(8)) + 8
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, row_key, at, length, item_ids): each occurrence of an item's window in a document, `at` counted from 0."""
    windows = written(item_windows(items), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    side = docs.select(*row_keys(), words(F.col("text")).alias("w"))
    if not lengths:
        return side.where(F.lit(False)).select("id", "row_key", F.lit(0).alias("at"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("item_ids"))
    whole, back = F.col("length") == WINDOW, F.when(F.col("length") == WINDOW, WINDOW - GRAM).otherwise(0)
    key = lambda gram: F.xxhash64("length", gram)
    parts = F.transform(F.sequence(F.lit(1), F.when(whole, WINDOW - GRAM + 1).otherwise(1)), lambda i: _gram(F.split("window", " "), i, F.when(whole, GRAM).otherwise(F.col("length"))))
    grams = written(windows.select("length", F.explode(parts).alias("gram")).select(key("gram").alias("gram")).distinct(), "grams")
    small = _small(grams) and _small(windows)
    sized = F.broadcast if small else lambda df: df
    # the array of words is only passed on by reference up to the broadcast join, and cut there
    spots = side.select("*", F.explode(F.array(*[F.lit(x) for x in lengths])).alias("length")).where(F.size("w") >= F.col("length"))
    gram = F.when(whole, GRAM).otherwise(F.col("length"))
    spots = spots.select("*", F.explode(F.sequence(F.lit(0), F.size("w") - gram, F.when(whole, WINDOW - GRAM + 1).otherwise(1))).alias("q"))
    near = F.slice("w", F.greatest(F.col("q") - back, F.lit(0)) + 1, F.least(F.col("q"), back) + F.col("length"))
    spots = spots.withColumn("gram", key(_gram("w", F.col("q") + 1, gram)))
    if small:
        spots = spots.join(sized(grams), "gram", "left_semi").select("id", "row_key", "length", "q", near.alias("near"))
    else:
        spots = spots.select("id", "row_key", "length", "q", "gram", near.alias("near")).join(grams, "gram", "left_semi")
    starts = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("length")), lambda i: F.struct((F.greatest(F.col("q") - back, F.lit(0)) + i).alias("at"), _gram("near", i + 1, F.col("length")).alias("window")))
    spots = spots.where(F.size("near") >= F.col("length")).select("id", "row_key", "length", F.explode(starts).alias("s")).select("id", "row_key", "length", "s.*")
    return spots.join(sized(windows), ["length", "window"]).select("id", "row_key", "at", "length", "item_ids")


def _hit_words(spans: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """n_words, hit_words (positions from 0), item_ids and contaminated of every row of `docs(doc_id, text)`.

    Null or wordless texts have no hit; null, wordless or no items hit nothing. An item of
    fewer than ten words is one window. Rows that repeat a doc_id, or have none, are told apart
    by their text; equal rows get equal results. Other columns of either table are ignored.
    """
    by_doc = (
        hits(docs, items)
        .groupBy("id", "row_key")
        .agg(F.collect_set(F.struct("at", "length")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids"))
        .select("id", "row_key", _hit_words("spans").alias("hit_words"), F.sort_array("item_ids").alias("item_ids"))
    )
    none = F.array()
    return (
        docs.select("doc_id", *row_keys(), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_words"))
        .join(by_doc, ["id", "row_key"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("hit_words", none.cast("array<int>")).alias("hit_words"),
            F.coalesce("item_ids", none.cast("array<string>")).alias("item_ids"),
            F.col("hit_words").isNotNull().alias("contaminated"),
        )
    )


def without_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id and clean_text: the normalised words that no window hits, joined by one space."""
    found = hits(docs, items).groupBy("id", "row_key").agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    keyed = docs.select("doc_id", *row_keys(), words(F.col("text")).alias("w")).join(found, ["id", "row_key"], "left")
    keyed = keyed.withColumn("hit", F.coalesce(_hit_words("spans"), F.array().cast("array<int>")))
    return keyed.select("doc_id", F.array_join(F.filter("w", lambda x, i: ~F.array_contains(F.col("hit"), i)), " ").alias("clean_text"))


def oracle() -> str:
    """The digest query over `documents` and `benchmark` views, in DuckDB SQL."""
    body = "trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'))"
    split = f"case when {body} = '' then cast([] as varchar[]) else string_split({body}, ' ') end"
    return f"""
with d as (select doc_id, {split} as w from documents),
b as (select cast(item_id as varchar) as item_id, {split} as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as win
       from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
       from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
h as (select doc_id, item_id, i, dw.n as n from dw join bw on dw.win = bw.win and dw.n = bw.n),
p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from h) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on p.doc_id = d.doc_id left join t on t.doc_id = d.doc_id"""
