"""Corpus pipeline: language, near duplicates, decontamination, mix, shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on all that
its predecessor kept, and its result is written as Parquet and read again as the next docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specspark.llm import contamination, language, mixing, near_duplicates, sharding
from specspark.llm.common import DOCUMENT_COLUMNS, read_table, row_key, written


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents and (id, tk), which tell apart rows that share a doc_id but not a text."""
    return docs.select(*DOCUMENT_COLUMNS, *row_key())


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found with a clear margin.

    Null texts, texts without a letter and ties go. A null or repeated doc_id makes no
    difference, repeated rows stay or go together, other columns are dropped. Without a learned
    language, as for an empty table, nothing is kept.
    """
    dictionaries = language.learn(docs, F.lit(True))
    return language.classify(docs.select(*DOCUMENT_COLUMNS), dictionaries).where("accepted").select(*DOCUMENT_COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the smallest doc_id.

    A null doc_id comes after all others; among rows of one doc_id the smallest hash of the text
    decides, so the result does not depend on how rows lie. Of repeated rows (one doc_id, one
    text) one stays, with the smallest of the other columns. Texts without words are near
    nothing: all stay, but for repeated rows. Other columns are dropped; an empty table stays
    empty.
    """
    rows = near_duplicates.grouped(docs).select("group", F.struct(F.col("doc_id").isNull().alias("none"), "id", "tk").alias("r"))
    first = rows.where("group is not null").groupBy("group").agg(F.min("r").alias("r")).select("r.id", "r.tk")
    wordless = rows.where("group is null").select("r.id", "r.tk").distinct()
    # a merge join at every size: the ids grow with the documents
    kept = _keyed(docs).join(first.unionByName(wordless).hint("merge"), ["id", "tk"], "left_semi")
    others = [c for c in DOCUMENT_COLUMNS if c not in ("doc_id", "text")]
    one = kept.groupBy("id", "tk").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*others)).alias("o"))
    return one.select("doc_id", "text", *[F.col(f"o.{c}").alias(c) for c in others]).select(*DOCUMENT_COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item.

    Null texts and an empty benchmark hold none. Rows are told apart by doc_id and text, also
    where the doc_id is null; repeated rows stay or go together. Other columns are dropped; an
    empty table stays empty.
    """
    hit = contamination.hits(docs, read_table(spark, sf_dir, "benchmark")).select("id", "row_key").distinct()
    keyed = docs.select(*DOCUMENT_COLUMNS, *contamination.row_keys())
    return keyed.join(written(hit, "hit"), ["id", "row_key"], "left_anti").select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, three times at most.

    Null texts have no words and are never taken; a null source is a source of its own; null and
    repeated doc_ids are rows like all others, and each of several equal rows has its own number
    of copies. Other columns are dropped; an empty table stays empty.
    """
    place = ["id", "tk", "sourced", "named"]
    keyed = _keyed(docs).withColumns({"sourced": F.col("source").isNotNull(), "named": F.coalesce("source", F.lit(""))})
    nth = lambda *order: F.row_number().over(Window.partitionBy(*place).orderBy(*order)).alias("nth")
    taken = mixing.mix(keyed, columns=tuple(place)).select(*place, "copies", nth(F.desc("copies"))).where("copies > 0")
    rows = keyed.select(*DOCUMENT_COLUMNS, *place, nth("lang", "n_chars"))
    return rows.join(taken.hint("merge"), [*place, "nth"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*DOCUMENT_COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place in it.

    Null texts count as empty, a null doc_id orders first, repeated rows have places of their
    own. Other columns are dropped; an empty table stays empty.
    """
    return sharding.shard(docs, columns=DOCUMENT_COLUMNS[1:])


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mix", mixed),
    ("shards", sharded),
]
#: SQL can express neither the encodings nor the signatures; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
