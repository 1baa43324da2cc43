"""Periodic runs, byte pairs and the manifest against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specspark.llm import byte_pairs, merkle, queries, runs
from specspark.llm.common import mix64

from .test_operators import SF, odd_rows, table

P = pytest.importorskip("public_tokenizers")
SHA = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- 11 periodic runs -----------------------------------------------------------------


def plain_runs(w, shortest=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - a >= q and i - a + q >= shortest and not any(all(w[j] == w[j + p] for j in range(a, i + q - p)) for p in range(1, q)):
                out.append((a, i - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(catchers):
    return list(zip(*[x.tolist() for x in catchers.runs()], strict=True))


@pytest.mark.parametrize("step", [1, 3, 17, 1000])
def test_runs_of_every_prefix(step):
    rng = random.Random(step)
    for trial in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(90))]
        if w and trial % 2:
            a, p = rng.randrange(len(w)), rng.randrange(1, 9)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
        shortest = rng.choice([2, 5, 12])
        catchers, units = runs.Catchers(shortest), mix64(np.array(w, np.uint64) + np.uint64(9))
        for at in range(0, len(w), step):
            catchers.append(units[at : at + step])
            if trial % 6 == 0:
                assert found(catchers) == plain_runs(w[: at + step], shortest)
        assert found(catchers) == plain_runs(w, shortest)


def test_runs_of_fibonacci_and_doubling_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    t = [0]
    while len(t) < 512:
        t += [1 - x for x in t]
    for w in (b, t, [0] * 700, [0, 1, 2] * 200 + [2, 1, 0] * 100):
        catchers = runs.Catchers(2)
        catchers.append(mix64(np.array(w, np.uint64) + np.uint64(9)))
        assert found(catchers) == plain_runs(w, 2)


def test_run_query_against_a_plain_loop(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    with_runs = 0
    for doc_id, text in documents(spark).select("doc_id", "text").collect():
        w, h = words_of(text), zlib.crc32(str(doc_id).encode())
        n, g = len(w), h // 10
        if n > 1200:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        rs = plain_runs(w)
        with_runs += bool(rs)
        best = max(rs, key=lambda r: (r[1], -r[0], -r[2])) if rs else (None, None, None)
        gone = {i for s, length, q in rs for i in range(s + q, s + length)}
        want = (doc_id, len(rs), *best, 1000 * best[1] // best[2] if rs else None, SHA("".join(f"{s},{length},{q}\n" for s, length, q in rs)), SHA(" ".join(x for i, x in enumerate(w) if i not in gone)))
        assert tuple(got[doc_id]) == want
    assert with_runs > 10


def test_runs_odd_rows(spark):
    long_run = " ".join(["la", "li"] * 40_000)
    rows = [*odd_rows(), (9, "a b " * 6, "en", "a"), (10, "b " + "a b " * 6, None, None), (11, long_run, "en", "a"), (None, "x " * 12, "en", "a")]
    got = runs.find_runs(table(spark, rows).withColumn("runs", F.lit("old")).withColumn("w", F.lit(1)).coalesce(1)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["runs"] == [] for i in (1, 2, 3, 4, 6, 7, 8)) and by[1]["collapsed"] == by[2]["collapsed"] == by[3]["collapsed"] == ""
    assert [tuple(x) for x in by[9]["runs"]] == [(0, 12, 2)] and by[9]["collapsed"] == "a b"
    assert [tuple(x) for x in by[10]["runs"]] == [(0, 13, 2)] and by[10]["collapsed"] == "b a"
    assert [tuple(x) for x in by[11]["runs"]] == [(0, 80_000, 2)] and by[11]["collapsed"] == "la li"
    assert [tuple(x) for x in by[None]["runs"]] == [(0, 12, 1)] and by[8]["collapsed"] == "é ü ñ 日本語"
    assert runs.find_runs(table(spark, [])).count() == 0
    planted = queries._with_planted_runs(table(spark, rows).withColumn("h", F.lit("old"))).collect()
    assert len(planted) == len(rows) and [r["text"] for r in planted if r["doc_id"] is None] == ["x " * 12]


# ---- 12 byte pairs ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    return byte_pairs.ranks_of(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tiktoken_(ranks):
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pair_query_as_tiktoken(spark, tiktoken_):
    want = []
    for doc_id, text in documents(spark).select("doc_id", "text").collect():
        ids = tiktoken_.encode_ordinary(text or "")
        want.append((doc_id, len(ids), SHA(",".join(map(str, ids))), SHA(text or "")))
    assert sorted(map(tuple, queries.QUERIES["op12_byte_bpe"](spark, SF).collect())) == sorted(want)


def test_byte_pairs_odd_rows_and_blocks(spark, ranks, tiktoken_, monkeypatch):
    monkeypatch.setattr(byte_pairs, "BLOCK_BYTES", 40)  # a block after every few texts, read by the closure
    monkeypatch.setattr(byte_pairs, "PIECE", 50)
    rows = [*odd_rows(), (None, "<|endoftext|> it's  \n\n 12345 we'll\x1c\x85　x", None, None), (12, "\U0001f600́ ʼn �" * 30, "en", "a"), (13, "a" * 3000, "en", "a"), (14, " " * 500 + "\t\n" * 20, "en", "a")]
    docs = table(spark, rows).withColumn("block", F.lit("old")).withColumn("tokens", F.lit(1))
    got = byte_pairs.decode(byte_pairs.encode(docs, ranks, P.PATTERN), ranks).collect()
    both = byte_pairs.encode(docs, ranks, P.PATTERN, decoded=True).collect()
    key = lambda x: (x[0] is not None, x)
    assert sorted(map(tuple, both), key=key) == sorted(map(tuple, got), key=key)
    want = [(i, tiktoken_.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows]
    assert sorted(((r["doc_id"], r["tokens"], bytes(r["decoded"])) for r in got), key=key) == sorted(want, key=key)
    assert byte_pairs.decode(byte_pairs.encode(table(spark, []), ranks, P.PATTERN), ranks).count() == 0


def test_decoding_alone(spark, ranks):
    rows = spark.createDataFrame([(1, [0, 1, 2]), (2, []), (3, None)], "doc_id long, tokens array<int>")
    by_rank = {r: t for t, r in ranks.items()}
    got = {r["doc_id"]: r["decoded"] for r in byte_pairs.decode(rows, ranks).collect()}
    assert bytes(got[1]) == by_rank[0] + by_rank[1] + by_rank[2] and bytes(got[2]) == b"" and got[3] is None
    with pytest.raises(Exception, match="not in the table"):
        byte_pairs.decode(spark.createDataFrame([(1, [5]), (2, [6])], "doc_id long, tokens array<int>"), {b"a": 5, b"b": 7}).collect()


def test_each_distinct_word_is_encoded_once(spark, ranks):
    import tiktoken

    words = spark.createDataFrame([(w, b, k) for b in range(5) for k, w in enumerate(["the", " the", "zz zz"])], "word string, block long, number int")
    got = byte_pairs.encode_words(words, ranks).collect()
    one = tiktoken.Encoding("w", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = {0: one("the"), 1: one(" the"), 2: one("zz zz")}
    seen = []
    for r in got:
        for number, ids in zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in byte_pairs.coded_words([bytes(r["coded"])])), strict=True):
            assert ids == want[number]
            seen.append((r["block"], number))
    assert sorted(seen) == [(b, k) for b in range(5) for k in range(3)]


# ---- 13 manifest ------------------------------------------------------------------------


def plain_tree(leaves):
    """Root of a list of digests, and for each the siblings to the left and right, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 3 * 3
            paths[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + 3])))
            at[i] = k // 3
        nodes = [SHA("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_leaf(values):
    return SHA("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    """rows of (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded root, verified."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0], plain_leaf(r), r))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        built[s] = plain_tree([x[2] for x in trees[s]])
    root, over = plain_tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, over, strict=True):
        for (_, doc_id, leaf, r), path in zip(trees[s], built[s][1], strict=True):
            h = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r[4] is not None:
                h = plain_leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in [*path, *top]:
                h = SHA(left + h + right)
            out.append((doc_id, leaf, built[s][0], root, SHA("".join(a + b for a, b in [*path, *top])), h, h == root))
    return out


def manifest_query(spark, monkeypatch, docs):
    monkeypatch.setattr(queries, "read_table", lambda *_: docs)
    return list(map(tuple, queries.QUERIES["op13_merkle_manifest"](spark, SF).collect()))


def test_manifest_against_plain_trees(spark, monkeypatch):
    docs = documents(spark)
    want = plain_manifest([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
    assert sorted(manifest_query(spark, monkeypatch, docs)) == sorted(want)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_manifest_odd_rows(spark, monkeypatch):
    rows = [*odd_rows(), (None, "no id", "en", "a"), (None, None, None, None), (15, "line\nline", "en", "\U0001f600"), (16, "line\n", "en", "￿"), (18, "a\nb", "en", "é"), (1 << 40, "x", "en", "z")]
    docs = table(spark, rows).withColumn("tree", F.lit("old")).withColumn("item", F.lit(1)).withColumn("path", F.lit(2))
    full = [(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows]
    key = lambda r: (r[0] is not None, r)
    assert sorted(manifest_query(spark, monkeypatch, docs), key=key) == sorted(plain_manifest(full), key=key)
    assert manifest_query(spark, monkeypatch, table(spark, [])) == []
    assert manifest_query(spark, monkeypatch, table(spark, rows[:1]))[0][:2] == plain_manifest(full[:1])[0][:2]


def test_manifest_does_not_depend_on_partitions(spark):
    docs = documents(spark)
    proof = lambda d: sorted(map(tuple, merkle.manifest(d).select("doc_id", "leaf", "root", merkle.proof(F.col("path"))).collect()))
    assert proof(docs.repartition(7)) == proof(docs.coalesce(1))
