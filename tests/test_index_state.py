"""A rewritten table is indexed anew."""

import os
import tempfile

import pandas as pd

from lexmill.operators import search
from lexmill.plans import retrieval


def test_a_rewritten_file_gives_new_hits(spark):
    folder = tempfile.mkdtemp(prefix="spark-")

    def write(texts, when):
        pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(f"{folder}/documents.parquet")
        os.utime(f"{folder}/documents.parquet", (when, when))
        return spark.read.parquet(f"{folder}/documents.parquet")

    hits = lambda: {r["id"] for r in retrieval.fulltext_search(lambda table: spark.read.parquet(f"{folder}/{table}.parquet")).collect()}
    before = search.file_state(write(["the one", "other", "the end"], 1_000_000_000))
    assert hits() == {0, 2}
    after = search.file_state(write(["other", "the one", "the end"], 1_000_000_500))
    assert before != after and hits() == {1, 2}
