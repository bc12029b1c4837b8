"""Resolution, vector and legislative queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import vectors
from lexmill.operators import resolve
from lexmill.plans.registry import Registry
from lexmill.sources import legislature

query = Registry()


@query(
    """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'or:ors:chapter:' || (o_custkey % 90 + 1) WHEN 1 THEN 'or:ors:' || (o_custkey % 90 + 1) || '.010' WHEN 2 THEN 'or:utcr:' || (o_custkey % 9 + 1) || '.020' END AS canonical_id FROM orders"""
)
def canonical_ids(t):
    """Canonical ids of free citation strings."""
    n, k = (F.col("o_custkey") % 90 + 1).cast("string"), F.col("o_orderkey")
    citation = F.when(k % 4 == 0, F.concat(F.lit("ORS  chapter "), n)).when(k % 4 == 1, F.concat(F.lit("ors "), n, F.lit(".010 (2)"))).when(k % 4 == 2, F.concat(F.lit("UTCR "), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit(".020(1)"))).otherwise("See above")
    return t("orders").select(k.alias("id"), resolve.canonical_id(citation).alias("canonical_id"))


@query(
    """WITH m AS (SELECT o_orderkey AS id, o_custkey * 2 AS c, o_orderkey % 3 AS pin FROM orders), j AS (SELECT m.*, c_custkey IS NOT NULL AS there FROM m LEFT JOIN customer ON c_custkey = c)
    SELECT id, CASE WHEN there THEN 'id:' || c END AS canonical_id, CASE WHEN there AND c % 5 > 0 THEN 'id:' || c || '@2025' END AS version_id,
      CASE WHEN there AND pin = 1 AND c % 7 > 0 THEN 'p:' || c END AS provision_id,
      CASE WHEN NOT there THEN 'unresolved_target_not_in_corpus' WHEN pin = 0 THEN 'resolved_section' WHEN pin = 1 AND c % 7 > 0 THEN 'resolved_section_and_subpath' ELSE 'resolved_section_unresolved_subpath' END AS status FROM j"""
)
def resolved_citations(t):
    """Targets of citations among identities, versions and provisions."""
    c = (F.col("o_custkey") * 2).cast("string")
    pins = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("1"), F.lit("a"))).otherwise(F.array(F.lit("9")))
    mentions = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("ORS "), c).alias("citation"), pins.alias("pins"))
    k = F.col("c_custkey")
    people = t("customer")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    old = people.select(name("ors ").alias("citation"), name("old:").alias("canonical_id"), F.lit(0).alias("seq"))
    identities = old.union(people.select(name("ORS "), name("id:"), F.lit(1)))
    versions = people.where("c_custkey % 5 > 0").select(F.concat(name("id:"), F.lit("@2025")).alias("version_id"))
    parts = people.where("c_custkey % 7 > 0").select(name("id:").alias("canonical_id"), F.lit("1.a").alias("path"), name("p:").alias("provision_id"), F.lit(1).alias("seq"))
    return resolve.resolve(mentions, identities, versions, parts, 2025).select("id", "canonical_id", "version_id", "provision_id", "status")


@query("SELECT o_orderkey AS id, 'n' || (o_orderkey % 40) AS target FROM orders WHERE o_orderkey % 40 < 25 AND o_custkey % 40 < 25")
def range_edges(t):
    """Ranges of which both ends exist."""
    n = lambda c: F.concat(F.lit("n"), (F.col(c) % 40).cast("string"))
    mentions = t("orders").select(F.col("o_orderkey").alias("id"), n("o_orderkey").alias("start_id"), n("o_custkey").alias("end_id"))
    return resolve.range_edges(mentions, t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("canonical_id")))


@query(
    """SELECT c_custkey AS id, array_to_string(list_sort(list(DISTINCT o_orderkey::VARCHAR))[1:5], ',') AS cited, count(o_orderkey) > 0 AS any_cited FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 0
    UNION ALL SELECT c_custkey, '', false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
)
def retrieval_context(t):
    """Hits with the first things that they cite."""
    hits = t("customer").select(F.col("c_custkey").alias("id"), F.lit(1.0).alias("score"))
    cites = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").cast("string").alias("target"))
    terms = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("term"))
    return resolve.enriched(hits, cites, terms).select("id", F.array_join("cited", ",").alias("cited"), (F.size("cited") > 0).alias("any_cited"))


@query(
    """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents), v AS (SELECT doc_id, [('0x' || substring(h, i * 2 % 64 + 1, 2))::INT / 127.5::DOUBLE - 1 FOR i IN range(8)] AS raw FROM d)
    SELECT doc_id, round(raw[1] / sqrt(list_sum([x * x FOR x IN raw])), 6) AS x0, round(raw[8] / sqrt(list_sum([x * x FOR x IN raw])), 6) AS x7 FROM v"""
)
def stand_in_embeddings(t):
    v = vectors.stand_in_embedding(F.col("text"), 8)
    return t("documents").select("doc_id", v.alias("v")).select("doc_id", F.round(F.get("v", F.lit(0)), 6).alias("x0"), F.round(F.get("v", F.lit(7)), 6).alias("x7"))


@query("SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum([x::DOUBLE * x::DOUBLE FOR x IN embedding[1:16]])), 6) AS x0 FROM embeddings")
def shortened_vectors(t):
    return t("embeddings").select("vec_id", F.round(F.get(vectors.shortened(F.col("embedding"), 16), F.lit(0)), 6).alias("x0"))


def bills(t):
    k = F.col("p_partkey")
    return t("part").select(F.when(k % 10 > 0, F.lit("2023R1")).alias("SessionKey"), F.lit(" HB ").alias("MeasurePrefix"), (k % 500).cast("string").alias("MeasureNumber"), F.lit("").alias("CatchLine"), F.col("p_name").alias("RelatingTo"), F.when(k % 2 == 0, "Yes").otherwise("n").alias("EmergencyClause"))


@query("SELECT DISTINCT 'measure:2023r1:hb:' || (p_partkey % 500) AS id, (p_partkey % 500)::VARCHAR AS number, p_partkey % 500 % 2 = 0 AS emergency FROM part WHERE p_partkey % 10 > 0")
def legislative_measures(t):
    return legislature.entities(bills(t), "measures").select("id", "number", "emergency")


@query("SELECT DISTINCT 'measure:2023r1:hb:' || (p_partkey % 500) AS src, 'session:2023r1' AS dst, 'IN_SESSION' AS type FROM part WHERE p_partkey % 10 > 0")
def legislative_edges(t):
    return legislature.entity_edges(bills(t), "measures")


@query("SELECT count_if(p_partkey % 10 = 0) AS without_key, count(*) AS rows FROM part")
def legislative_diagnostics(t):
    return legislature.diagnostics(bills(t), "measures")
