"""Rows that share a doc_id, or have none, and whose texts share a 32-bit hash."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from specspark.llm import mixing, near_duplicates, substring_dedup, suffix_dedup
from specspark.llm.common import row_key, with_row_keys

from .test_operators import table


def text_of(seed, n=140):
    return " ".join(hashlib.md5(f"{seed} {k}".encode()).hexdigest()[:5] for k in range(n))


@pytest.fixture(scope="module")
def pair(spark):
    """Two texts of 140 words that share no word and have one 32-bit hash, found among 250,000 such texts."""
    a, b = (" ".join(hashlib.md5(f"{seed} {k}".encode()).hexdigest()[:6] for k in range(140)) for seed in (84503, 149990))
    hashes = spark.createDataFrame([(a,), (b,)], "t string").select(F.hash("t")).collect()
    assert hashes[0] == hashes[1] and not set(a.split()) & set(b.split())
    return a, b


@pytest.mark.parametrize("doc_id", [7, None])
def test_nothing_is_cut_from_a_text_that_shares_a_hash(spark, pair, doc_id):
    a, b = pair  # a repeats in another document, b nowhere
    docs = table(spark, [(doc_id, a, "en", "s"), (doc_id, b, "en", "s"), (9, a, "en", "s")])
    words = {r["kept_text"]: r["n_removed"] for r in substring_dedup.deduplicate(docs).where(F.col("doc_id").eqNullSafe(F.lit(doc_id).cast("long"))).collect()}
    assert words == {a: 0, b: 0}
    gone = {r["kept"].decode(): r["n_removed"] for r in suffix_dedup.deduplicate(docs).select("kept", "n_removed").collect()}
    assert gone[b] == 0 and len(gone) == 2
    lower = table(spark, [(3, a, "en", "s"), (doc_id, a, "en", "s"), (doc_id, b, "en", "s")])
    kept = sorted(r["n_removed"] for r in substring_dedup.deduplicate(lower).collect())
    assert kept == [0, 0, 140]


@pytest.mark.parametrize("doc_id", [7, None])
def test_no_document_is_lost_that_shares_a_hash(spark, pair, doc_id):
    a, b = pair
    docs = spark.createDataFrame([(doc_id, a, "en", "s", 1), (doc_id, b, "en", "s", 1), (8, text_of("c"), "en", "s", 1), (9, text_of("d"), "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(r["text"] for r in kept.collect()) == sorted([a, b, text_of("c"), text_of("d")])
    mixed = corpus_pipeline.mixed(spark, docs, "").groupBy("text").count().collect()
    assert {r["text"] for r in mixed} == {a, b, text_of("c"), text_of("d")}
    assert corpus_pipeline.without_benchmark(spark, docs, "/root/testdata/sf0.001").count() == 4
    assert corpus_pipeline.sharded(spark, docs, "").select("text").distinct().count() == 4
    groups = near_duplicates.near_duplicates(docs, 4).collect()
    assert len(groups) == 4 and (all(r["kept"] for r in groups))


def test_keys_tell_null_from_empty_and_from_the_smallest_id(spark):
    rows = [(None, "x"), (-(1 << 63), "x"), (1, None), (1, ""), (1, "x"), (1, "-")]
    keys = spark.createDataFrame(rows, "doc_id long, text string").select(*row_key()).collect()
    assert len({(r["id"], bytes(r["tk"])) for r in keys}) == len(rows)


def test_sets_of_one_key_are_told_apart(spark, monkeypatch):
    """Sets whose first hash agrees are classes of their own."""
    docs = spark.createDataFrame([(k, text_of(k % 3)) for k in range(6)], "doc_id long, text string")
    real = near_duplicates.signatures
    monkeypatch.setattr(near_duplicates, "signatures", lambda d, size: real(d, size).withColumn("set_key", F.lit(5).cast("long")))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(docs, 4).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2}


def test_mix_without_ids_does_not_depend_on_the_layout(spark):
    docs = spark.createDataFrame([(None, text_of(k, 20), "en", f"s{k % 3}", 1) for k in range(400)], "doc_id long, text string, lang string, source string, n_chars long")
    copies = lambda d: {r["tk"].hex(): r["copies"] for r in mixing.mix(with_row_keys(d).join(d.select("text", "source"), "text").drop("id"), columns=("tk",)).collect()}
    assert copies(docs.repartition(5)) == copies(docs.orderBy(F.desc("text")).coalesce(1))
