"""The text operators against brute force, and their edge cases."""

import collections
import math
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specspark.llm import contamination, language, language_model, licenses, mixing, near_duplicates, quality, queries, sharding, substring_dedup, suffix_dedup
from specspark.llm.common import Words, doc_remainder, with_row_keys
from specspark.llm.components import components, extended

SF = "/root/testdata/sf0.001"
SPACE = r"[^\x20\x09-\x0D]+"


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long, size long, key string, kept string"):
    """Documents with extra columns whose names clash with what the operators make."""
    full = [(i, t, lang, source, None if t is None else len(t), -1, "k", "x") for i, t, lang, source in rows]
    return spark.createDataFrame(full, schema)


def odd_rows():
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "b"), (4, "?! 12 --", "de", "a"), (5, long_text, "en", None), (6, "the same words here", "en", "a"), (7, "the same words here", None, "a"), (7, "the same words here", None, "a"), (8, "é ü ñ\x0b日本語", "fr", "b")]


def docs_of(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(spark):
    return {r["doc_id"]: r["text"] for r in docs_of(spark).select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    canonical = lambda d: d[columns].astype(object).where(d[columns].notna(), None).astype(str).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(canonical(got), canonical(want))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_per_document(spark, name):
    if name not in queries.ORACLE_SQL:
        assert queries.QUERIES[name](spark, SF).count() == docs_of(spark).count()


# ---- 1 language -----------------------------------------------------------------------


def test_language_held_out_accuracy_and_inputs(spark):
    docs = docs_of(spark)
    learned = language.learn(docs, doc_remainder(5) != 0)
    found = language.classify(docs.where(doc_remainder(5) == 0), learned)
    right = found.where("length(text) > 40").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95
    blind = language.classify(docs.withColumn("lang", F.lit("xx")).where(doc_remainder(5) == 0), learned)
    assert sorted(map(tuple, blind.select("doc_id", "lang_pred", "score").collect())) == sorted(map(tuple, found.select("doc_id", "lang_pred", "score").collect()))


def test_language_odd_rows(spark):
    learned = language.learn(docs_of(spark), F.lit(True))
    got = language.classify(table(spark, odd_rows()).withColumn("score", F.lit("old")), learned).collect()
    assert len(got) == 9 and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert all(0 <= r["score"] <= 1 for r in got) and not any(r["accepted"] for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in language.classify(table(spark, odd_rows()), {}).collect()} == {"und"}
    assert language.classify(table(spark, []), learned).count() == 0 and language.learn(table(spark, []), F.lit(True)) == {}


def test_language_against_a_plain_loop(spark):
    import zstandard

    docs = docs_of(spark).where(doc_remainder(5) == 0)
    learned = language.learn(docs_of(spark), doc_remainder(5) != 0)
    names = sorted(learned)
    for r in language.classify(docs, learned).collect():
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        body, sizes = language.plain(r["text"]), []
        for name in names:
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(body[k : k + language.CHUNK])) for k in range(0, len(body), language.CHUNK)))
        best = sizes.index(min(sizes))
        margin = min(x for k, x in enumerate(sizes) if k != best) - sizes[best]
        assert r["lang_pred"] == names[best] and r["margin_bytes"] == margin
        assert r["accepted"] == (margin >= max(2, 0.001 * len(body)))


def test_long_texts_of_two_languages_are_rejected(spark):
    rng = np.random.default_rng(9)
    words = {x: ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(300)] for x, letters in (("aa", "abcdefgh"), ("bb", "mnopqrst"))}
    text = lambda x, n: " ".join(rng.choice(words[x], n))
    rows = [(i, text("ab"[i % 2] * 2, 80), "ab"[i % 2] * 2, "s") for i in range(60)]
    learned = language.learn(table(spark, rows), F.lit(True))
    one, two = text("aa", 20_000), " ".join(text("aa", 100) + " " + text("bb", 100) for _ in range(100))
    got = {r["doc_id"]: r for r in language.classify(table(spark, [(1, one, None, "s"), (2, two, None, "s")]), learned).collect()}
    assert got[1]["accepted"] and got[1]["lang_pred"] == "aa" and got[2]["margin_bytes"] * 20 < got[1]["margin_bytes"]


def test_rare_labels_and_rows_without_a_doc_id_are_not_learned(spark):
    rows = [(i, f"one text of many number {i}", "en", "s") for i in range(20)] + [(30, "a single text", "x1", "s"), *[(None, f"text without an id {i}", "zz", "s") for i in range(9)]]
    assert set(language.learn(table(spark, rows), doc_remainder(5) != 0)) == {"en"}


# ---- 2 language model -------------------------------------------------------------------


def brute_model(texts_, trained):
    tok = {d: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(SPACE, t or "")] + ["</s>"] for d, t in texts_.items()}
    tok = {d: [w.encode() for w in x[:-1]] + [0] for d, x in tok.items()}
    c = collections.Counter(w for d in trained for w in tok[d])
    pairs = collections.Counter(p for d in trained for p in zip([1, *tok[d][:-1]], tok[d], strict=True))
    return tok, c, pairs


def test_language_model_against_brute_force(spark):
    docs = docs_of(spark)
    got = {r["doc_id"]: r for r in language_model.train_and_score(docs, doc_remainder(10) != 0).collect()}
    trained = [d for d, r in got.items() if not r["held_out"]]
    tok, c, pairs = brute_model(texts(spark), trained)
    n, v = sum(c.values()), len(c)
    follow, kinds, left = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (h, w), k in pairs.items():
        follow[h] += k
        kinds[h][min(k, 3) - 1] += 1
        left[w] += 1
    of = lambda counts: language_model._discounts([collections.Counter(counts)[k] for k in (1, 2, 3, 4)])
    high, low = of(pairs.values()), of(left.values())
    unseen = sum(low[min(k, 3) - 1] for k in left.values()) / len(pairs) / (v + 1)
    lower = lambda w: max(left[w] - [0, *low][min(left[w], 3)], 0) / len(pairs) + unseen

    def p(h, w):
        if h not in follow:
            return lower(w)
        k = pairs.get((h, w), 0)
        return max(k - [0, *high][min(k, 3)], 0) / follow[h] + sum(a * b for a, b in zip(high, kinds[h], strict=True)) / follow[h] * lower(w)

    for d, r in got.items():
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tok[d]), sum(c[w] > 0 for w in tok[d]), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok[d]), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(h, w)) for h, w in zip([1, *tok[d][:-1]], tok[d], strict=True)), rel_tol=1e-9)
    for h in (b"the", b"of", 1, b"nowhere"):
        assert math.isclose(sum(p(h, w) for w in c) + unseen * (sum(a * b for a, b in zip(high, kinds[h], strict=True)) / follow[h] if h in follow else 1), 1, rel_tol=1e-9)


def test_language_model_odd_rows(spark):
    got = language_model.train_and_score(table(spark, odd_rows()), F.col("doc_id") > 4).collect()
    assert len(got) == 9 and {r["n_tokens"] for r in got if r["doc_id"] < 4} == {1}
    none = language_model.train_and_score(table(spark, odd_rows()), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(r["score"] == 0 for r in none)
    assert language_model.train_and_score(table(spark, []), F.lit(True)).count() == 0


def test_language_model_rows_without_a_doc_id(spark):
    rows = [(i, f"some words {i}", "en", "s") for i in range(30)] + [(None, "words never learned", "en", "s")]
    got = language_model.train_and_score(table(spark, rows), doc_remainder(10) != 0).collect()
    odd = [r for r in got if r["doc_id"] is None]
    assert len(got) == 31 and odd[0]["held_out"] is None and odd[0]["n_known"] == 2


def test_frequent_first_words_and_counts_beyond_a_byte(spark):
    rows = [(i, "a a a b " * 100 + f"a u{i}", "en", "s") for i in range(20)]
    model = language_model.train(table(spark, rows))
    scorer = language_model.Scorer(model)
    import pyarrow as pa

    w = Words(pa.array(["a b"]), lower=True).hashes()
    assert scorer.pairs(np.array([w[0], w[0]]), np.array([w[0], w[1]])).tolist() == [4000, 2000]


# ---- 3 mix ------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), limit=3):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    w = {k: float(weights[i % 3]) for i, k in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {k: rest * w[k] / sum(w[j] for j in free) for k in free}
        over = {k for k in free if share[k] > limit * sizes[k]}
        if not over:
            return target | share
        for k in over:
            target[k] = limit * sizes[k]
            rest -= target[k]
        free -= over
        if not free:
            return target


def test_mix_targets_and_takes(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", [None, "a", "b", "Z", "é", "c"][i % 6] if i % 50 else "tiny") for i in range(900)]
    got = mixing.mix(table(spark, rows)).collect()
    sizes = collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += len(t.split())
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        assert math.isclose(r["target"], want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    over = 1 + 3.5 * len(sizes) / sum(sizes.values())
    assert all(abs(taken[s] - want[s]) <= 3.5 + (over - 1) * want[s] for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(table(spark, rows).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_long_documents_at_the_edge_go_to_the_nearer_side(spark):
    rng = np.random.default_rng(12)
    rows = [(i, " ".join(["w"] * int(rng.choice([5, 20, 400]))), "en", f"s{i % 6}") for i in range(360)]
    got = mixing.mix(table(spark, rows)).collect()
    taken, want = collections.Counter(), {r["source"]: r["target"] for r in got}
    for r in got:
        taken[r["source"]] += r["taken"]
    total = sum(want.values())
    assert sum(taken.values()) <= total
    assert all(abs(taken[s] - want[s]) <= 200 + want[s] * 200 * 6 / total for s in want)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)


def brute_mix(rows, weights=(1, 2, 3)):
    """Which documents are taken: every source in the order of its hashes, cut at time 1 and the budget."""
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    target, total, line = brute_targets(sizes, weights), sum(sizes.values()), []
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + ([None] if None in sizes else [])
    for rank, name in enumerate(names):
        sent = 0
        for copy in range(3):
            for r in sorted((r for r in rows if r["source"] == name), key=lambda r: (r["h"], r["doc_id"])):
                sent += r["size"]
                if r["size"]:
                    line.append(((sent - r["size"] / 2) / target[name], rank, copy, r["h"], r))
    copies, spent = collections.Counter(), 0
    for time, *_, r in sorted(line, key=lambda x: x[:4]):
        if time > 1 or spent + r["size"] > total:
            break
        spent += r["size"]
        copies[r["doc_id"]] += 1
    return copies


def test_mix_takes_the_documents_of_the_plain_queue(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10_000)
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), "en", "ab"[i % 2] + ("" if i % 5 else "c")) for i in range(300)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    plain = docs.select("doc_id", "source", F.size(F.split("text", " ")).cast("long").alias("size"), mixing._shuffled(17).alias("h")).collect()
    assert got == dict(brute_mix(plain))
    monkeypatch.setattr(mixing, "RANGES", 3)
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert total - 23 * 4 <= sum(r["taken"] for r in mixing.mix(docs).collect()) <= total


def test_mix_in_many_blocks_is_the_global_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 5)
    rows = [(i, " ".join(["w"] * (1 + i % 5)), "en", "ab"[i % 2]) for i in range(120)]
    got = mixing.mix(table(spark, rows)).collect()
    total = sum(len(t.split()) for _, t, _, _ in rows)
    assert total - 5 <= sum(r["taken"] for r in got) <= total


def test_mix_odd_rows(spark):
    got = mixing.mix(table(spark, odd_rows())).collect()
    assert len(got) == 9 and {r["taken"] for r in got if r["doc_id"] < 4} == {0}
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, None, None)])).collect()] == [0]


# ---- 4 quality ----------------------------------------------------------------------------


def base_counts(t):
    w = re.findall(SPACE, t or "")
    lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_verdicts(spark):
    docs = table(spark, odd_rows() + [(20, "a b c d e " * 9, "en", "s"), (21, "x\nx\n\n \nx", "en", "s")])
    all_docs = docs_of(spark).select("doc_id", "text", "lang").unionByName(docs.select(F.col("doc_id") + 10**6, "text", "lang").toDF("doc_id", "text", "lang"))
    rows = {(r["doc_id"], r["text"]): None for r in all_docs.collect()}
    got = {r["doc_id"]: r for r in quality.judge(all_docs).collect()}
    for d, t in rows:
        n, chars, symbols, dup, again = base_counts(t)
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, again)
        assert r["base_failed"] == (n < 10 or 100 * again > 20 * n) and not (r["base_failed"] and r["kept"])
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()
    good = [got[r["doc_id"]] for r in labels]
    assert sum(r["kept"] or r["base_failed"] for r in good) >= 0.97 * len(good)


def test_quality_distances_by_brute_force(spark):
    docs = docs_of(spark).select("doc_id", "text", "lang")
    refs = {r["ref_lang"]: r for r in quality.references(docs).collect()}
    assert set(refs) > {"*"} and all(len(r["common"]) == 24 and math.isclose(sum(r["ref_words"]), 1) and math.isclose(sum(r["ref_classes"]), 1) for r in refs.values())

    def distance(p, q):
        p, q = np.array(p) / sum(p), np.array(q)
        m = (p + q) / 2
        part = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a > 0)
        return math.sqrt(max(0, (part(p) + part(q)) / 2))

    by_id = {r["doc_id"]: r for r in docs.collect()}
    for r in quality.judge(docs).collect():
        d = by_id[r["doc_id"]]
        w, t = re.findall(SPACE, d["text"] or ""), d["text"] or ""
        if len(w) < quality.MIN_JUDGED_WORDS:
            assert r["class_distance"] is None and r["word_distance"] is None and r["kept"] == (not r["base_failed"])
            continue
        ref = refs.get(d["lang"], refs["*"])
        sizes = [len(re.findall(x, t)) for x in ("[a-z]", "[A-Z]", r"[\x20\x09-\x0D]", "[0-9]", r"[^\x00-\x7F]")]
        near = distance([*sizes, len(t) - sum(sizes)], ref["ref_classes"]), distance([*[w.count(x) for x in ref["common"]], sum(x not in ref["common"] for x in w)], ref["ref_words"])
        assert math.isclose(r["class_distance"], near[0], abs_tol=1e-7) and math.isclose(r["word_distance"], near[1], abs_tol=1e-7)
        assert r["kept"] == (not r["base_failed"] and r["class_distance"] <= quality.MAX_CLASS_DISTANCE and r["word_distance"] <= quality.MAX_WORD_DISTANCE)


def test_quality_references_count_every_labelled_text(spark, monkeypatch):
    docs = [(i, " ".join(f"{'Wört' if (i * k) % 7 else 'it-3'}{(i * 31 + k * k) % 40}" for k in range(500)) + "\t \n", "en", "a") for i in range(300)]
    docs += [(1000 + i, f"zz {i} " * 30 + "#x" * (i % 3), "de" if i < 25 else "fr", "a") for i in range(30)] + [(2000 + i, f"star {i} " * 40, "*", "a") for i in range(30)]
    docs += [(3000, "unlabelled " * 60, None, "a"), (3001, " ", "en", "a"), (3002, None, "en", "a")]
    docs = table(spark, docs)
    got = {r["ref_lang"]: r for r in quality.references(docs).collect()}
    assert set(got) == {"en", "de", "*"}
    rows = docs.collect()
    for lang, ref in got.items():
        own = [r["text"] for r in rows if r["text"] and r["text"].strip() and r["lang"] and lang in ("*", r["lang"])]
        words, classes = collections.Counter(), np.zeros(6)
        for t in own:
            w = re.findall(SPACE, t)
            for x in w:
                words[x] += min(1, 300 / len(w))
            sizes = [len(re.findall(x, t)) for x in ("[a-z]", "[A-Z]", r"[\x20\x09-\x0D]", "[0-9]", r"[^\x00-\x7F]")]
            classes += np.array([*sizes, len(t) - sum(sizes)]) * min(1, 2000 / len(t))
        best = sorted(words.items(), key=lambda x: (-round(x[1], 3), x[0]))[: quality.COMMON]
        assert list(ref["common"]) == [w for w, _ in best]
        shares = [n / sum(words.values()) for _, n in best]
        assert np.allclose(ref["ref_words"], [*shares, 1 - sum(shares)], rtol=1e-4)
        assert np.allclose(ref["ref_classes"], classes / classes.sum(), rtol=1e-4)
    columns = ["doc_id", "class_distance", "word_distance", "base_failed", "kept"]
    listed = sorted(map(tuple, quality.judge(docs).select(columns).collect()))
    monkeypatch.setattr(quality, "MAX_LISTED", 1)
    assert sorted(map(tuple, quality.judge(docs).select(columns).collect())) == listed and len(listed) == len(rows)


def test_quality_without_labels_or_rows(spark):
    got = quality.judge(table(spark, [(1, "one two three four five six seven eight nine ten eleven", None, "a")])).collect()
    assert got[0]["kept"] and got[0]["class_distance"] is None
    assert quality.judge(table(spark, [])).count() == 0


def test_js_distance(spark):
    d = spark.range(1).select(quality.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0))).alias("far"), quality.js_distance(F.array(F.lit(0.3), F.lit(0.7)), F.array(F.lit(0.3), F.lit(0.7))).alias("same")).first()
    assert math.isclose(d["far"], 1) and d["same"] == 0


# ---- 5 and 8 repeats ------------------------------------------------------------------------


def test_substring_dedup_random_and_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60))), "en", "s") for i in range(60)] + [(100 + i, t, lang, s) for i, t, lang, s in odd_rows()]
    length = 6
    win = {}
    for i, t, _, _ in rows:
        w = re.findall(SPACE, t or "")
        for k in range(len(w) - length + 1):
            win[tuple(w[k : k + length])] = min(win.get(tuple(w[k : k + length]), i), i)
    for r in substring_dedup.deduplicate(table(spark, rows), length).collect():
        w = re.findall(SPACE, next(t for i, t, _, _ in rows if i == r["doc_id"]) or "")
        gone = {j for k in range(len(w) - length + 1) if win[tuple(w[k : k + length])] < r["doc_id"] for j in range(k, k + length)}
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substring_dedup.deduplicate(table(spark, [])).count() == 0


def test_levels_double_up_to_the_wanted_length(spark):
    assert substring_dedup.levels(50) == [13, 25, 50] and substring_dedup.levels(6) == [3, 6]
    assert all(b <= 2 * a for n in (7, 12, 50, 101, 400) for a, b in zip(substring_dedup.levels(n), substring_dedup.levels(n)[1:], strict=False))
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "s"), (2, "x " + text, "en", "s"), (3, " ".join(f"v{i}" for i in range(90)), "en", "s"), (4, "z " * 30 + " ".join(f"v{i}" for i in range(20, 40)), "en", "s")]
    keyed = with_row_keys(table(spark, rows))
    found = {r["id"] for r in substring_dedup.surviving_cells(keyed).collect()}
    assert {1, 2} <= found and 4 not in found
    none = with_row_keys(table(spark, rows[2:3]))
    assert substring_dedup.surviving_cells(none).count() == 0


def test_substring_dedup_of_repeated_and_missing_doc_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s"), (1, "short", "en", "s"), (1, text + " more", "en", "s"), (2, text, "en", "s"), (2, text, "en", "s"), (None, text, "en", "s"), (None, "other words", "en", "s")]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicate(table(spark, rows)).collect()))
    assert got == [(0, 2, 0), (0, 60, 0), (1, 1, 0), (1, 60, 60), (1, 61, 60), (2, 60, 60), (2, 60, 60)]


def brute_bytes(rows, length):
    count = collections.Counter()
    raws = [(i, (t or "").encode()) for i, t, _, _ in rows]
    for _, b in raws:
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, b in raws:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                hit[k : k + length] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out[i] = (len(b), int(hit.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~hit]))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_suffix_dedup_random(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR", 4)
    rng = np.random.default_rng(3)
    words = ["ab", "é", "cab", "b", "日"]
    rows = [(i, "".join(rng.choice(words, rng.integers(0, 40))), "en", "s") for i in range(50)] + [(99, None, None, None), (98, "", "en", "s")]
    docs = with_row_keys(table(spark, rows))
    for length in (12, 8):
        spans, want = suffix_dedup.repeated_spans(docs, length, anchor=4, group=group).collect(), brute_bytes(rows, length)
        hit = {i: np.zeros(want[i][0], bool) for i in want}
        for r in spans:
            assert r["stop"] - r["start"] >= length and (group == 1 or r["repeat"] >= 0)
            hit[r["id"]][r["start"] : r["stop"]] = True
        assert {i: int(h.sum()) for i, h in hit.items()} == {i: w[1] for i, w in want.items()}


def test_suffix_dedup_rows_and_odd(spark):
    rows = [r for r in odd_rows() if r[0] != 7] + [(30, "part " + "".join(f"k{i * i % 91}" for i in range(95)), "en", "s"), (31, "".join(f"k{i * i % 91}" for i in range(95)) + " of", "en", "s"), (20, "x" * 900, "en", "s"), (21, "q" + "y z" * 300, "en", "s"), (22, "y z" * 300 + "!", "en", "s")]
    want = brute_bytes(rows, 400)
    for r in suffix_dedup.deduplicate(table(spark, rows)).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]]
    assert suffix_dedup.deduplicate(table(spark, [])).count() == 0


def test_suffix_dedup_of_repeated_and_missing_doc_ids(spark):
    text = "".join(f"{i * i % 997}," for i in range(180))
    rows = [(1, text, "en", "s"), (1, text, "en", "s"), (1, "short", "en", "s"), (2, "only here", "en", "s"), (None, text[3:], "en", "s"), (None, "short", "en", "s"), (3, text[:399], "en", "s")]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.deduplicate(table(spark, rows)).collect())
    n = len(text)
    assert got == [(0, 5, 0), (0, n - 3, n - 3), (1, 5, 0), (1, n, n), (1, n, n), (2, 9, 0), (3, 399, 0)]
    alone = suffix_dedup.deduplicate(table(spark, rows[:1] + rows[2:4])).collect()
    assert all(r["n_removed"] == 0 for r in alone)


def test_every_removed_byte_lies_in_an_interval_of_the_tree(spark, monkeypatch):
    docs = docs_of(spark).select("doc_id", "text")
    scanned, real = spark.sparkContext.accumulator(0), suffix_dedup.maximal_repeats

    def counted(before, after, length):
        for members, starts, stop in real(before, after, length):
            scanned.add(1)
            yield members, starts, stop

    monkeypatch.setattr(suffix_dedup, "maximal_repeats", counted)  # nothing by-passes the scan
    spans = suffix_dedup.repeated_spans(with_row_keys(docs)).where("stop - start >= 400 and repeat >= 0").collect()
    assert len({(r["anchor"], r["repeat"]) for r in spans}) <= scanned.value
    covered = collections.defaultdict(set)
    for r in spans:
        covered[r["id"]].update(range(r["start"], r["stop"]))
    for r in suffix_dedup.deduplicate(docs).collect():
        assert r["n_removed"] == len(covered[r["doc_id"]])


def test_maximal_repeats_have_all_occurrences():
    before, after = [b"xxab", b"yyab", b"zzzb", b"q"], [b"cdefgh1", b"cdefgh2", b"cdefg3", b"zz"]
    got = {(tuple(sorted(m.tolist())), stop) for m, _, stop in suffix_dedup.maximal_repeats(before, after, 6)}
    assert got == {((0, 1), 6), ((0, 1, 2), 5)} or got == {((0, 1), 6), ((0, 1, 2), 5), ((0, 1), 5)}


# ---- 6 decontamination ------------------------------------------------------------------------


def test_decontamination_short_items_nulls_and_repeats(spark):
    items = spark.createDataFrame([(1, "Red  fox"), (2, None), (3, "!!"), (4, "a b c d e f g h i j k l"), (10, "red fox"), (None, "lonely")], "item_id long, text string")
    rows = [(1, "the RED-fox; red fox", "en", "s"), (2, "x a b c d e f g h i j k l y", "en", "s"), (3, "b c d e f g h i j k", "en", "s"), (3, "b c d e f g h i j k", "en", "s"), (4, "a b c d e f g h i", "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"), (7, "lonely", "en", "s")]
    got = [(r["doc_id"], r["hit_words"], r["item_ids"], r["contaminated"]) for r in contamination.decontaminate(table(spark, rows), items).orderBy("doc_id").collect()]
    assert got[0] == (1, [1, 2, 3, 4], ["1", "10"], True) and got[1] == (2, list(range(1, 13)), ["4"], True)
    assert got[2] == got[3] == (3, list(range(10)), ["4"], True) and [g[3] for g in got[4:]] == [False, False, False, True]
    clean = {r["doc_id"]: r["clean_text"] for r in contamination.without_spans(table(spark, rows), items).collect()}
    assert clean[1] == "the" and clean[2] == "x y" and clean[4] == "a b c d e f g h i"
    none = contamination.decontaminate(table(spark, rows), items.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == 8
    assert contamination.decontaminate(table(spark, []), items).count() == 0


def test_decontamination_long_texts_clashing_columns_and_ids(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l", "x", 5, 3), (2, "lone words", "y", 6, 4)], "item_id long, text string, window string, length int, q int")
    long_text = "no " * 70_000 + "a b c d e f g h i j " + "yes " * 50_000 + "lone words"
    rows = [(1, long_text, "en", "s"), (None, "Lone; words", "en", "s"), (None, "other", "en", "s"), (2, "other", "en", "s"), (2, "lone words", "en", "s")]
    got = sorted((r["doc_id"] or 0, r["n_words"], len(r["hit_words"]), ",".join(r["item_ids"])) for r in contamination.decontaminate(table(spark, rows), items).collect())
    assert got == [(0, 1, 0, ""), (0, 2, 2, "2"), (1, 120_012, 12, "1,2"), (2, 1, 0, ""), (2, 2, 2, "2")]


def test_decontamination_without_broadcast(spark, monkeypatch):
    a = sorted(map(tuple, queries.op6_decontaminate(spark, SF).collect()))
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", -1)
    assert a == sorted(map(tuple, queries.op6_decontaminate(spark, SF).collect()))


# ---- 7 licences ---------------------------------------------------------------------------------


def test_license_variants_match(spark):
    mit = next(t for n, t in licenses.TEXTS if n == "MIT")
    rows = [(1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.replace(". ", ".\n   ").upper(), "en", "s"), (2, mit + " and more", "en", "s"), (3, "released under the mit licence", "en", "s"), *[(10 + r[0], *r[1:]) for r in odd_rows()]]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(table(spark, rows), licenses.known_digests(spark)).collect()}
    assert got[1] == "MIT" and got[2] is None and got[3] == "MIT" and {got[k] for k in range(11, 19)} == {None}
    assert licenses.scan(table(spark, []), licenses.known_digests(spark)).count() == 0


def test_both_spellings_have_one_digest(spark):
    pairs = licenses.SPELLINGS
    rows = [(k, f"This {w}, as is: {w.upper()} {w}.") for k, p in enumerate(pairs) for w in p]
    got = collections.defaultdict(set)
    for r in spark.createDataFrame(rows, "k int, t string").select("k", licenses.digest(F.col("t")).alias("d")).collect():
        got[r["k"]].add(r["d"])
    assert {len(v) for v in got.values()} == {1}
    known = {left for left, _ in pairs}
    assert not known & {right for _, right in pairs}  # no rule undoes another
    words = spark.createDataFrame([("analogue",), ("analog",), ("centered",), ("centred",), ("analogy",)], "t string").select("t", licenses.canonical(F.col("t")).alias("c")).collect()
    c = dict(map(tuple, words))
    assert c["analogue"] == c["analog"] == "analogue" and c["centered"] == c["centred"] and c["analogy"] == "analogy"


def test_named_holders_headings_and_notices_match(spark):
    text = dict(licenses.TEXTS[::-1])
    named = text["BSD-3-Clause"].replace("name of the copyright holder nor", "name of Example Systems, Inc. nor").replace("PROVIDED BY THE COPYRIGHT HOLDERS", "PROVIDED BY EXAMPLE SYSTEMS").replace("SHALL THE COPYRIGHT HOLDER", "SHALL EXAMPLE SYSTEMS")
    four = text["BSD-4-Clause"].replace("developed by the copyright holder.", "developed by the Example Group and others.")
    lesser = 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.\n\nYou should have received a copy of the GNU Lesser General Public License along with this library.  If not, see <http://www.gnu.org/licenses/>.'
    rows = [
        (1, named, "BSD-3-Clause"), (2, "BSD 3-Clause License\n\nCopyright (c) 2001, Example Systems\nAll rights reserved.\n\n" + named, "BSD-3-Clause"), (3, "BSD 4-Clause License\n" + four, "BSD-4-Clause"), (4, lesser, "LGPL-2.1-or-later"),
        (5, "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.\nTo view a copy of this license, visit https://creativecommons.org/licenses/by-sa/4.0/.", "CC-BY-SA-4.0"), (6, "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        (7, named + " And one thing more.", None), (8, "This product includes software developed by contributors.", None), (9, text["BSL-1.0"], "BSL-1.0"), (10, "The MIT License (MIT)\n\n" + text["MIT"], "MIT"),
        (11, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "AGPL-3.0-or-later"),
    ]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(table(spark, [(i, t, "en", "s") for i, t, _ in rows]), licenses.known_digests(spark)).collect()}
    assert got == {i: name for i, _, name in rows}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"]))
    assert dict(con.sql(licenses.oracle()).df()[["doc_id", "license_id"]].replace({np.nan: None}).itertuples(index=False)) == got


def test_complete_licenses_match(spark):
    if not os.path.isdir("/usr/share/common-licenses"):
        pytest.skip("this machine has no folder of complete licences")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Artistic": "Artistic-1.0-Perl"}
    whole = {}
    for name in files:
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            whole[name] = f.read()
    rows = [(i, whole[name], "en", "s") for i, name in enumerate(files)] + [(100, whole["GPL-3"].replace("\n", "\n  ").upper(), "en", "s"), (101, whole["GPL-3"][:-400], "en", "s")]
    got = {r["doc_id"]: r["license_id"] for r in licenses.scan(table(spark, rows), licenses.known_digests(spark)).collect()}
    assert got == dict(enumerate(files.values())) | {100: "GPL-3.0", 101: None}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    assert dict(con.sql(licenses.oracle()).df()[["doc_id", "license_id"]].replace({np.nan: None}).itertuples(index=False)) == got


# ---- 9 shards -------------------------------------------------------------------------------------


def check_shards(got, n):
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(n))


def test_shards_are_even_and_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 7)
    rows = [(i, "t" * (i * 37 % 90) if i % 3 else "same text", "en", "s") for i in range(600)]
    got = sharding.shard(table(spark, rows), 8).collect()
    check_shards(got, 8)
    sums = collections.Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 2 * 91
    assert all(r["size"] == len(dict((i, t) for i, t, *_ in rows)[r["doc_id"]].encode()) + 1 for r in got)


def brute_shards(rows, shards):
    """Cuts between whole groups of equal texts, in the order of their hashes, nearest to each share."""
    total, sizes, out = sum(r["size"] for r in rows), collections.Counter(), {}
    for r in rows:
        sizes[r["key"]] += r["size"]
    below, ends = 0, []
    for key in sorted(sizes):
        ends.append((below, key))
        below += sizes[key]
    cuts = [min(ends, key=lambda e: abs(e[0] - total * j // shards))[1] for j in range(1, shards)]
    for r in rows:
        out[r["doc_id"]] = sum(r["key"] >= c for c in cuts)
    return out


def test_shards_by_plain_splitters_keep_small_groups_whole(spark):
    rows = [(i, f"text number {i // 2} " + "x" * (i // 2 * 37 % 90), "en", "s") for i in range(1200)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, 8, tolerance=0.0).collect()}
    plain = docs.select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("key"), (F.octet_length("text") + 1).alias("size")).collect()
    assert got == brute_shards(plain, 8)
    assert all(got[2 * k] == got[2 * k + 1] for k in range(600))


def test_large_groups_are_split_by_id(spark):
    rows = [(i, "one text" if i < 500 else f"text {i}", "en", "s") for i in range(1000)]
    got = {r["doc_id"]: r for r in sharding.shard(table(spark, rows), 8).collect()}
    sums = collections.Counter()
    for r in got.values():
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) - min(sums.values()) <= 2 * 10
    assert sorted(got[i]["shard"] for i in range(500)) in ([got[i]["shard"] for i in range(500)], sorted(got[i]["shard"] for i in range(500)))


def test_shards_odd_rows(spark):
    got = sharding.shard(table(spark, [*odd_rows(), (None, "no id", "en", "s")]), 4).collect()
    check_shards(got, 4)
    assert len(got) == 10 and next(r["size"] for r in got if r["doc_id"] == 1) == 1
    assert sharding.shard(table(spark, []), 4).count() == 0
    kept = sharding.shard(table(spark, odd_rows()), 2, columns=("text", "lang"))
    assert kept.columns == ["doc_id", "text", "lang", "size", "text_crc32", "shard", "slot"] and kept.count() == 9


# ---- 10 near duplicates ------------------------------------------------------------------------------


def brute_components(texts_, size, percent):
    sets = {}
    for d, t in texts_.items():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(SPACE, t or "")]
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_with_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(150)]
    rows = {}
    for i in range(150):
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            w[k] = f"x{i}_{k}"
        rows[i] = " ".join(w)
    rows |= {200 + i: " ".join(rng.choice(base, 50)) for i in range(40)}
    rows |= {300: None, 301: "", 302: "One two", 303: "one TWO", 304: "one", 305: rows[3].upper()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(table(spark, [(d, t, "en", "s") for d, t in rows.items()]), 4).collect()}
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_that_resemble_only_the_original(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(300)]
    rows = {500: " ".join(base)}
    for i in range(400):
        w = list(base)
        for k in rng.choice(37, 7, replace=False):
            w[8 * k + 4] = f"x{i}_{k}"
        rows[i] = " ".join(w)
    old = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    try:
        for k, n in zip(old, (20, 7), strict=True):
            spark.conf.set(k, n)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.near_duplicates(table(spark, [(d, t, "en", "s") for d, t in rows.items()]), 4).collect()}
    finally:
        for k, n in old.items():
            spark.conf.set(k, n)
    assert got == brute_components(rows, 4, 80)


def test_near_duplicates_odd_rows(spark):
    got = near_duplicates.near_duplicates(table(spark, odd_rows())).collect()
    assert len(got) == 9 and {r["component_id"] for r in got if r["doc_id"] in (6, 7)} == {6}
    assert all(r["kept"] for r in got if r["doc_id"] < 6)
    assert near_duplicates.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_repeated_and_missing_doc_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, a.upper(), "en", "s"), (3, b, "en", "s"), (None, a, "en", "s"), (None, "c d e f g h", "en", "s"), (None, "c d e f g h", "en", "s"), (None, None, "en", "s")]
    for parts in (1, 5):
        got = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in near_duplicates.near_duplicates(table(spark, rows).repartition(parts)).collect()))
        assert got == [(0, 0, 0, True), (0, 2, 0, True), (0, 2, 0, True), (0, 36, 1, False), (1, 36, 1, True), (1, 36, 1, True), (2, 36, 1, False), (3, 36, 1, False)]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["v"]: r["c"] for r in components(edges).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_components_extended_by_new_edges_equal_those_of_all_edges(spark):
    rng = np.random.default_rng(7)
    rows = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (90, 2)) if a != b]
    table_of = lambda part: spark.createDataFrame(part, "a long, b long")
    found = None
    for part in (rows[:30], rows[:5], rows[30:33], rows[33:]):
        found = extended(found, table_of(part))
    want = {(r["v"], r["c"]) for r in components(table_of(rows)).collect()}
    got = [(r["v"], r["c"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("shared", [0, 400, 700, 800, 950, 1000])
def test_sketches_estimate_the_similarity(spark, shared):
    rng = np.random.default_rng(shared)
    draw = rng.integers(0, 1 << 63, 3000 - shared, dtype=np.int64).astype(np.uint64)
    x, y = np.sort(draw[:1500]), np.sort(draw[1500 - shared : 3000 - shared])
    got = near_duplicates.sketches(spark.createDataFrame([(1, bytearray(x.tobytes())), (2, bytearray(y.tobytes()))], "v long, shingles binary")).collect()
    s = np.stack([np.frombuffer(bytes(r["sketch"]), np.uint8) for r in sorted(got)])
    same = near_duplicates._same_pairs_of_bits(s, np.array([0]), np.array([1]))[0] / near_duplicates.SKETCH
    agree = (1 + 3 * shared / (3000 - shared)) / 4
    assert abs(same - agree) < 4 * np.sqrt(agree * (1 - agree) / near_duplicates.SKETCH) + 1e-9
