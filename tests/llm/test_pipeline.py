"""The corpus pipeline, stage by stage, against what each stage should keep."""

import collections
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from specspark.llm.common import DOCUMENT_COLUMNS, read_table

from .test_operators import SPACE, brute_components

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_one_by_one(spark):
    docs, seen = read_table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        rows = out.collect()
        if name != "shards":
            assert tuple(out.columns) == DOCUMENT_COLUMNS
        seen.append((name, {r["doc_id"]: r["text"] for r in rows}, rows))
        docs = out
    stage = dict((n, (t, r)) for n, t, r in seen)
    assert len(stage["language"][0]) >= 0.95 * read_table(spark, SF, "documents").count()
    want = brute_components(stage["language"][0], 5, 80)
    assert set(stage["near_duplicates"][0]) == {d for d, (_, c) in want.items() if c == d}
    items = {tuple(w[i : i + 10]) for r in read_table(spark, SF, "benchmark").collect() for w in [re.findall("[a-z0-9\x80-\U0010ffff]+", r["text"].lower())] for i in range(len(w) - 9)}
    dirty = {d for d, t in stage["near_duplicates"][0].items() for w in [re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))] if any(tuple(w[i : i + 10]) in items for i in range(len(w) - 9))}
    assert set(stage["decontamination"][0]) == set(stage["near_duplicates"][0]) - dirty and dirty
    copies = collections.Counter(r["doc_id"] for r in stage["mix"][1])
    assert set(copies) <= set(stage["decontamination"][0]) and max(copies.values()) <= 3
    words = lambda rows: sum(len(re.findall(SPACE, r["text"])) for r in rows)
    assert abs(words(stage["mix"][1]) - words(stage["decontamination"][1])) < 0.05 * words(stage["decontamination"][1])
    assert collections.Counter(r["doc_id"] for r in stage["shards"][1]) == copies


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(out.columns) and out.select(F.max("shard")).first()[0] <= 15


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with nulls in every column, repeated rows, ties, long and empty texts, and columns of clashing names."""
    real = read_table(spark, SF, "documents").select(*DOCUMENT_COLUMNS)
    english = real.where("lang = 'en' and length(text) > 400").orderBy("doc_id").limit(6).collect()
    a, b, c = (r["text"] for r in english[:3])
    rows = [
        (1, a, "en", "s", 1),
        (1, a, "en", "s", 1),
        (1, b, "en", "s", None),
        (2, a, None, None, 1),
        (None, c, "en", "s", 1),
        (None, c, "en", None, 1),
        (None, a, "en", "s", 1),
        (3, None, "en", "s", None),
        (3, None, "en", "s", None),
        (4, "", None, "s", 0),
        (None, None, None, None, None),
        (5, " ".join(r["text"] for r in english[3:] for _ in range(60)), "en", "t", 9),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = [F.lit(7).alias(x) for x in ("id", "tk", "row_key", "copy", "copies", "size", "shard", "slot", "kept", "nth", "group", "accepted")]
    return made.select("*", *more), rows, real.select("*", *more)


def keys(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


def test_language_stage_on_odd_rows(spark, odd):
    docs, rows, real = odd
    out = STAGE["language"](spark, real.unionByName(docs), SF)
    assert tuple(out.columns) == DOCUMENT_COLUMNS
    got, own = keys(out), keys(docs)
    assert all(got[k] >= n for k, n in own.items() if k[1] and k[0] != 5) and not any(got[k] for k in own if not k[1])


def test_near_duplicate_stage_on_odd_rows(spark, odd):
    docs, rows, _ = odd
    a, b, c = rows[0][1], rows[2][1], rows[4][1]
    for parts in (1, 6):
        out = STAGE["near_duplicates"](spark, docs.repartition(parts), SF)
        assert tuple(out.columns) == DOCUMENT_COLUMNS
        assert keys(out) == collections.Counter([(1, a), (1, b), (None, c), (3, None), (4, ""), (None, None), (5, rows[-1][1])])


def test_decontamination_stage_on_odd_rows(spark, odd):
    docs, rows, _ = odd
    item = read_table(spark, SF, "benchmark").orderBy("item_id").first()["text"]
    dirty = spark.createDataFrame([(None, f"x {item} y", "en", "s", 1), (1, item, "en", "s", 1), (1, item, "en", "s", 1)], docs.select(*DOCUMENT_COLUMNS).schema)
    out = STAGE["decontamination"](spark, docs.select(*DOCUMENT_COLUMNS).unionByName(dirty), SF)
    assert tuple(out.columns) == DOCUMENT_COLUMNS and keys(out) == keys(docs)


def test_mix_stage_on_odd_rows(spark, odd):
    docs, rows, _ = odd
    out = STAGE["mix"](spark, docs, SF)
    assert tuple(out.columns) == DOCUMENT_COLUMNS
    got, own = keys(out), keys(docs)
    assert all(n <= 3 * own[k] for k, n in got.items()) and all(k[1] for k in got) and any(k[0] is None for k in got)
    kinds = collections.Counter(tuple(r) for r in out.collect())
    assert all(n <= 3 * rows.count(k) for k, n in kinds.items())


def test_shard_stage_on_odd_rows(spark, odd):
    docs, rows, _ = odd
    out = STAGE["shards"](spark, docs, SF)
    assert keys(out) == keys(docs) and {"shard", "slot"} <= set(out.columns)
    places = collections.Counter((r["shard"], r["slot"]) for r in out.collect())
    assert len(places) == len(rows)


@pytest.mark.parametrize("name", sorted(STAGE))
def test_stages_of_an_empty_table(spark, odd, name):
    assert STAGE[name](spark, odd[0].limit(0), SF).count() == 0
