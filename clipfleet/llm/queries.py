"""Queries of the operators of this subpackage over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipfleet.llm import bpe, chat_trees, conversation_repair, embedding_dedup, importance_resampling, license_scan, mixing, ngram_join, pii, quality_qda, quality_rules, secret_scan, token_files
from clipfleet.llm.common import scratch_path, stored
from clipfleet.llm.oracle import ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_documents(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), percent=90, width=3)


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = turns.dtypes
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = turns.union(own.select(*[F.col(c).cast(t) for c, t in kinds]))
    back = chat_trees.read_back(chat_trees.format_paths(chat_trees.best_paths(chat_trees.linear_nodes(turns))))
    learned = F.array_join("learned", "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93).drop("visited")


def op6_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(quality_qda.features(table(spark, sf_dir, "documents")), "features")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label"))
    scored = quality_qda.score(rows, quality_qda.fit(rows.join(labels, "doc_id")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_blocks")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *files), *files)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(pii.KINDS[:4])], F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), "n_examples", "n_owners", "n_repos")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fixed, report, edits = conversation_repair.repair(conversation_repair.damage(turns))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "letters"))), lambda x: x["letters"]), "")
    told = report.join(edits.groupBy("key").agg(letters.alias("audit")), "key").join(conversation_repair.digests(fixed), "key", "left")
    ids = turns.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(told, "key", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"], s["last"], s["edits"])), ",")
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"), "base_labels", "labels", "score", spans.alias("spans"))


__all__ = ["ORACLE_SQL", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_files, op2_quality_rules, op3_ngram_join, op4_reply_trees, op5_embedding_dedup, op6_quality_qda, op7_mixing, op8_byte_bpe, op9_personal_data, op10_secret_scan, op11_conversation_repair, op12_importance_resampling, op13_license_scan)}
