"""From raw documents to a mixed corpus: five operators, one after the other.

Each stage takes all that its predecessor kept. Rejected documents go, near copies are reduced to the one
of the least id, documents that hold a benchmark window go, secrets are blanked out in the rest,
and the last stage says how often each document is taken so that the sources meet their targets.

Near copies are those of five-word shingles at a similarity of 0.8 or more. A document is told apart by its id
and text, in a 128-bit key; rows alike in both are reduced by the second stage to the one whose other columns come
first. An empty table passes through. All columns but the text (and its length) are carried along unread,
whatever their names; only the last stage adds one, ``copies``, and replaces an earlier column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import decontaminate, mixing, near_dedup, quality, secret_scan
from nodeloom.llm.columns import free_name, row_key
from nodeloom.runtime import store_table

# Regular expressions in Java's dialect, minwise hashing and Newton steps have no DuckDB form; see tests/llm.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_passing(docs, quality.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, near_dedup.NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_overlaps(docs.select(row_key().alias("doc_id"), "text"), benchmark)
    key = free_name(docs, "key")
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(key))
    return docs.withColumn(key, row_key()).join(hit, key, "left_anti").drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``copies``."""
    mixed = mixing.mix(docs.select(row_key().alias("doc_id"), "text", "source"))
    docs = docs.drop("copies")
    key = free_name(docs, "key")
    taken = mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias("copies")).where("copies > 0")
    return docs.withColumn(key, row_key()).join(taken, key).drop(key)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secrets),
    ("source_mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
