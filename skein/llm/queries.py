"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, html, media, mixing, quality, repetition, sharding, simhash, toxicity, warc
from skein.llm.common import table


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_simhash_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(table(spark, sf_dir, "documents"))


def op4_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.chunked(table(spark, sf_dir, "documents"))


def op8_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_time", "index_pos"]
    return warc.archive(table(spark, sf_dir, "pages")).select(columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ordinal_toxicity, op2_simhash_positions, op3_suffix_repetition, op4_tree_scoring, op5_sainte_lague_mix,
        op6_quadratic_quality, op7_gear_chunks, op8_bpe_tree, op9_bounded_ring, op10_warc_index,
    )
}

SQL: dict[str, str] = {"op5_sainte_lague_mix": mixing.MIX_SQL.replace("{docs}", "documents"), "op10_warc_index": warc.ARCHIVE_SQL}
