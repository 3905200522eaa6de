"""The registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import arc, bagminhash, factorization, media, mixing, packing, quality, quotes, repair, secrets, sharding, spelling, turns
from .shared import documents
from .tokens import word_bpe_path

SHARDS = (1.0,) * 8
MAX_REPEATS = 2.0


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = repair.write_token_blocks(documents(spark, sf_dir), word_bpe_path(), end_id=2)
    return repair.read_token_blocks(spark, path)


def op2_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), word_bpe_path(), capacity=2048, end_id=0)


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), SHARDS, (*SHARDS, 1.0))


def op4_archive_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_measure(documents(spark, sf_dir))


def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factorization.classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3, metadata=["n_chars"])


def op6_layered_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op7_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(documents(spark, sf_dir), threshold=0.8)


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(documents(spark, sf_dir))


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir), max_repeats=MAX_REPEATS)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.audit_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_tokens, op2_residual_packing, op3_rendezvous_shards, op4_archive_media, op5_factorization_machine,
        op6_layered_secrets, op7_bag_minhash, op8_quotation_links, op9_line_frequency, op10_temperature_mix,
        op11_spelling_variants, op12_turn_repair, op13_arc_to_warc,
    )
}
ORACLES = {"op8_quotation_links": quotes.oracle(), "op9_line_frequency": quality.oracle(), "op10_temperature_mix": mixing.oracle(MAX_REPEATS), "op11_spelling_variants": spelling.oracle(), "op13_arc_to_warc": arc.oracle()}
