"""Thin queries opN_* over the driver's tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_pairs, contamination, language, language_model, licenses, merkle, mixing, near_duplicates, quality, runs, sharding, substring_dedup, suffix_dedup
from .common import doc_remainder, read_table, word_array


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    dictionaries = language.learn(docs, doc_remainder(5) != 0)
    return language.classify(docs.select("doc_id", "text", (doc_remainder(5) == 0).alias("held_out")), dictionaries).drop("text")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(read_table(spark, sf_dir, "documents").select("doc_id", "text"), doc_remainder(10) != 0)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document, by crc32 of its doc_id, the words from the a-th on repeat with period p."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("long")
    planted = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, word_array(F.col("text"))))
    planted = planted.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    tail = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("a") - 1), lambda i: F.get("w", (F.col("a") + i % F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail)
    return planted.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(_with_planted_runs(read_table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        F.col("best.length"),
        (-F.col("best.col3")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.col3")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = byte_pairs.ranks_of(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = byte_pairs.encode(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(F.array_join("tokens", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.when(doc_remainder(2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    rows = merkle.manifest(docs.withColumn("changed", merkle.leaf(text=tampered)), columns=("changed",))
    folded = rows.withColumn("folded_root", merkle.fold(F.col("changed"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_lm_score, op3_mix_sources, op4_quality_rules, op5_substring_dedup, op6_decontaminate, op7_license_scan, op8_suffix_array_dedup, op9_shard, op10_minhash_dedup, op11_periodic_runs, op12_byte_bpe, op13_merkle_manifest)}
ORACLE_SQL = {"op3_mix_sources": mixing.oracle(), "op5_substring_dedup": substring_dedup.oracle(), "op6_decontaminate": contamination.oracle(), "op7_license_scan": licenses.oracle(), "op8_suffix_array_dedup": suffix_dedup.oracle(), "op10_minhash_dedup": near_duplicates.oracle(), "op13_merkle_manifest": merkle.oracle()}
