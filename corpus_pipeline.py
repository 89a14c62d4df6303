"""A corpus pipeline: quality rules, SimHash near-dedup, personal data, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all the documents that its predecessor kept and returns a DataFrame,
which ``run`` writes as Parquet and reads again for the next stage. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import mixing, packing, pii, quality, shingle_join
from larkspur.llm.common import delete, new_path, scratch, stored, table

#: Identifiers of dropped documents up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the smallest identifier; of rows that repeat an identifier,
    one stays. Rows without an identifier stay, as no component can name them."""
    found = stored(shingle_join.near_duplicates(docs), "components")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not repeated:
        return kept
    named = kept.where("doc_id is not null").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id is null"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Fingerprints, components and token identifiers have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has stored on its way goes when its result is written, and a stage's
    result when the next is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
