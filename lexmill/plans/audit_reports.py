"""An audit of chunks and effects made of documents, with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import audits
from lexmill.plans.registry import Registry

query = Registry()


@query(
    """WITH c AS (SELECT 'k' || (doc_id - CASE WHEN lang = 'fr' AND doc_id > 0 THEN 1 ELSE 0 END) AS chunk_id, CASE WHEN lang = 'de' THEN 'full_statute' ELSE 'contextual_provision' END AS kind, 'src' || (n_chars % 25) AS ref, text, n_chars // 5 AS tokens, lang <> 'es' AS eligible, source FROM documents),
    s AS (SELECT DISTINCT source AS v FROM documents),
    e AS (SELECT * FROM (VALUES ('retrieval_chunks', 'repeated id', (SELECT count(*) - count(DISTINCT chunk_id) FROM c)),
      ('retrieval_chunks', 'orphan statute chunk', (SELECT count(*) FROM c WHERE kind = 'full_statute' AND ref NOT IN (SELECT v FROM s))), ('retrieval_chunks', 'orphan chunk', (SELECT count(*) FROM c WHERE kind <> 'full_statute' AND ref NOT IN (SELECT v FROM s))),
      ('retrieval_chunks', 'empty text', (SELECT count(*) FROM c WHERE trim(coalesce(text, '')) = '')), ('retrieval_chunks', 'no input hash', (SELECT count(*) FROM c WHERE eligible AND source = 'src3')), ('retrieval_chunks', 'over the context', (SELECT count(*) FROM c WHERE eligible AND tokens > 500)),
      ('retrieval_chunks', 'no token_count', 0), ('retrieval_chunks', 'no max_tokens', (SELECT count(*) FROM c WHERE eligible AND tokens > 400)), ('retrieval_chunks', 'no context_window', 0), ('retrieval_chunks', 'no chunking_strategy', (SELECT count(*) FROM c WHERE eligible)), ('retrieval_chunks', 'no chunk_version', 0),
      ('temporal_effects', 'invalid confidence', (SELECT count(*) FROM c WHERE tokens / 500 > 1)), ('temporal_effects', 'effect without support', (SELECT count(*) FROM c WHERE kind <> 'full_statute' AND ref NOT IN (SELECT v FROM s)))) v("table", "check", failures))
    SELECT "table", "check", failures::BIGINT AS failures FROM e"""
)
def audit_report(t):
    """How many rows fail each check of chunks and of effects in time."""
    docs = t("documents")
    tokens = F.expr("n_chars div 5")
    ref = F.concat(F.lit("src"), (F.col("n_chars") % 25).cast("string"))
    german = F.col("lang") == "de"
    chunks = docs.select(
        F.concat(F.lit("k"), (F.col("doc_id") - F.when((F.col("lang") == "fr") & (F.col("doc_id") > 0), 1).otherwise(0)).cast("string")).alias("chunk_id"), F.when(german, "full_statute").otherwise("contextual_provision").alias("chunk_type"), ref.alias("parent_version_id"), ref.alias("source_provision_id"), "text",
        F.when(F.col("lang") != "es", "embed_primary").otherwise("none").alias("embedding_policy"), F.when(F.col("source") == "src3", "").otherwise("h").alias("embedding_input_hash"), tokens.alias("token_count"), F.when(tokens <= 400, 512).alias("max_tokens"), F.lit(8192).alias("context_window"),
        F.lit(None).cast("string").alias("chunking_strategy"), F.lit("v1").alias("chunk_version"),
    )
    effects = docs.select((tokens / 500).alias("confidence"), F.when(german, "note").alias("source_note_id"), ref.alias("source_provision_id"), F.lit(None).cast("string").alias("version_id"))
    sources = docs.select("source").distinct()
    tables = {"retrieval_chunks": chunks, "temporal_effects": effects, "legal_text_versions": sources.withColumnRenamed("source", "version_id"), "provisions": sources.withColumnRenamed("source", "provision_id")}
    return audits.run_checks(tables, audits.chunk_checks(500) + audits.SEMANTIC)
