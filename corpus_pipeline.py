"""The corpus pipeline: five stages over documents, each written and read again as the next one's input.

Further columns, whatever their names, pass through all stages but the last,
which returns pieces. Null text: as empty, so the first stage drops it. Null
doc_id and null source: kept, as an id and a source of their own. Repeated
rows: one of them stays. Empty table: no rows from any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import bagminhash, mixing, packing, quality, secrets
from tidewave.llm.shared import documents, shared_dir
from tidewave.llm.tokens import word_bpe_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the line rule rejects go; of the others, lines above the limits go."""
    return quality.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least doc_id stays."""
    return bagminhash.drop_near_duplicates(docs, threshold=0.8)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A mark takes the place of each secret."""
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Smaller sources repeat, at most twice in all; no document goes. A repeat is a row of its own."""
    return mixing.repeat_documents(docs, max_repeats=2.0)


def residual_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, word_bpe_path(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", residual_packing),
]

#: Token ids and decoded layers can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_dir(spark, f"stage-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
