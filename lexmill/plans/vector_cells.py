"""Searches over embeddings by cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.operators import cells
from lexmill.operators.graph import shared_folder
from lexmill.plans.registry import Registry

query = Registry()


@query(
    """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 0), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
    SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 10"""
)
def nearest_vectors(t):
    """The ten vectors most similar to each fiftieth one, exactly."""
    vectors = t("embeddings")
    path = f"{shared_folder(vectors.sparkSession)}/cells-{uuid.uuid4().hex}"
    cells.build(vectors, path, "vec_id", "embedding")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return cells.search_many(vectors.sparkSession, path, asked, 10, exact=True).withColumn("similarity", F.round("similarity", 6))
