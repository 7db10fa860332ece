"""Queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recentlake.llm import (bpe_merges, fingerprints, hadamard_clusters, html_text, mixing, periodic_runs, quality_net, quality_rules,
                            repeated_spans, sampled_pieces, shingle_join, token_files, warc)
from recentlake.llm.common import read_table


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(read_table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken",
        F.element_at("positions", F.when(F.size("positions") > 0, 1)).alias("first_position"),
    ).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op6_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(read_table(spark, sf_dir, "documents"))
    return token_files.read_documents(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written, then read back by looking up the URLs of ``pages``."""
    pages = read_table(spark, sf_dir, "pages")
    return warc.lookup(warc.write_archive(pages), pages.select("url"), with_body=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op8_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_net.scored(docs, quality_net.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by a sampled segmentation and decoded again."""
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("before"))
    back = sampled_pieces.decoded(sampled_pieces.encoded(docs))
    same = F.col("text").isNull() | (F.xxhash64("text") == F.col("before")) & (F.length("text") == F.col("n_chars"))
    return back.select("doc_id", "n_chars", "n_pieces", "ids_crc32", same.alias("lossless"))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read_table(spark, sf_dir, "pages"))


def op5_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeated_spans.without_repeats(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.joined(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_hadamard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hadamard_clusters.clustered(read_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                        hadamard_clusters.centroid_digest().alias("centroid_sha256"))


def op12_bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded again."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe_merges.decoded(bpe_merges.encoded(docs).drop("text"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded_text", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text, of which one in ten gets a periodic tail first."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(periodic_runs.looped_tails(docs).select("doc_id", "text"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", periodic_runs.highest_run()).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"))


def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that operator 9 starts from, and its base rule."""
    stats = quality_rules.text_statistics(read_table(spark, sf_dir, "documents"), ("doc_id",))
    return stats.select("*", quality_rules.base_failed_column().alias("base_failed"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_main_text, op2_fingerprints, op3_shingle_join, op4_warc_archive, op5_repeated_spans, op6_wavelet_tokens,
        op7_sampled_pieces, op8_quality_net, op9_quality_rules, op10_mix_sources,
        op11_hadamard_clusters, op12_bpe_merges, op13_periodic_runs, text_statistics)}


def oracle_sql() -> dict[str, str]:
    from recentlake.llm.oracle import SQL

    return dict(SQL)
