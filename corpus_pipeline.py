"""A corpus pipeline over documents: quality, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before returned, and works on all of it. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontamination, packing, pii, quality_mil, simhash
from lexmill.llm.common import materialize, parted, read, remainder
from lexmill.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of 0.3 or more); it learns from the same labels as its query."""
    model = quality_mil.train(docs, read(spark, sf_dir, "labels"), remainder(5) != 0)
    return quality_mil.accepted(docs, model, 0.3)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key that tells rows with one doc_id and different texts apart."""
    return docs.withColumn("__key", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))


def exactly(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of docs (left_semi) in keys or (left_anti) not in keys, a table with a column `key`."""
    k = keys.select(F.col("key.doc_id").alias("__i"), F.col("key.h").alias("__h"))
    return docs.join(k, F.col("__key.doc_id").eqNullSafe(F.col("__i")) & (F.col("__key.h") == F.col("__h")), how)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Of equal rows one stays.

    Texts whose key surely goes to no group pass by; only the others are joined with the decisions on them.
    """
    named = keyed(docs)
    marked = simhash.near_duplicates(named, id_col="__key").select(F.col("doc_id").alias("key"), "component_id")
    marked = marked.groupBy("key").agg(F.min("component_id").alias("component"), F.count("*").alias("n"))
    affected = materialize(marked.withColumn("stays", F.col("key") == F.col("component")).where(~F.col("stays") | (F.col("n") > 1)), "groups")
    some, rest = parted(named, F.col("__key"), affected, F.col("key"))
    alone = exactly(some, affected, "left_anti")
    once = exactly(some, affected.where("stays"), "left_semi").dropDuplicates(["__key"])
    return rest.unionByName(alone).unionByName(once).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark's passages than the contamination rule allows."""
    named = keyed(docs)
    judged = decontamination.contamination(named, read(spark, sf_dir, "benchmark"), id_col="__key")
    bad = materialize(judged.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "contaminated")
    some, rest = parted(named, F.col("__key"), bad, F.col("key"))
    return rest.unionByName(exactly(some, bad, "left_anti")).select(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and n_chars counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), capacity=2048)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: The trained classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
