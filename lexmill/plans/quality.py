"""Quality-control and load queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text
from lexmill.operators import checks, loading
from lexmill.plans.registry import Registry

query = Registry()
#: The tables of a release.
RELEASED = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()
LINE = ["l_orderkey", "l_linenumber"]


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return checks.duplicate_keys(t("lineitem"), LINE)


@query("SELECT sum(n - 1)::BIGINT AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def duplicate_count(t):
    return checks.count_duplicates(t("lineitem"), LINE)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def orphan_documents(t):
    return checks.orphans(t("documents").select("doc_id"), t("embeddings"), "doc_id", "vec_id")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'labels' WHEN e.vec_id IS NOT NULL THEN 'embeddings' ELSE 'unresolved' END AS status FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def citation_resolution(t):
    """Which table resolves each key, the first one winning."""
    return checks.resolution(t("documents").select("doc_id"), "doc_id", [("labels", t("labels"), "doc_id"), ("embeddings", t("embeddings"), "vec_id")])


@query("SELECT source, count(*) AS total, count(l.doc_id) AS covered, round(count(l.doc_id) * 100.0 / count(*), 6) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def label_coverage(t):
    known = t("labels").select(F.col("doc_id").alias("k"))
    joined = t("documents").select("doc_id", "source").join(known, F.col("doc_id") == F.col("k"), "left")
    return checks.coverage(joined, "source", F.col("k").isNotNull()).withColumn("percent", F.round("percent", 6))


@query("SELECT l_returnflag, (list(l_extendedprice ORDER BY l_extendedprice))[1 + ceil(0.95 * (count(*) - 1))::BIGINT] AS percentile, count(*) AS total FROM lineitem GROUP BY l_returnflag")
def exact_percentiles(t):
    return checks.exact_percentile(t("lineitem"), "l_extendedprice", 95, "l_returnflag")


@query("WITH e AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1), a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT k, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual FROM e FULL JOIN a USING (k) WHERE coalesce(e.n, 0) <> coalesce(a.n, 0)")
def count_mismatches(t):
    by = lambda table, c: t(table).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return checks.compare_counts(by("supplier", "s_nationkey"), by("customer", "c_nationkey"), "k")


@query("SELECT 'orders' AS label, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")
def corpus_counts(t):
    return checks.counts_by_label({k: t(k) for k in ("orders", "customer", "part")})


@query("SELECT count(*) AS rows, count_if(c_acctbal IS NULL) AS failures, count_if(c_acctbal < 0) AS warnings, CASE WHEN count_if(c_acctbal IS NULL) > 0 THEN 'fail' WHEN count_if(c_acctbal < 0) > 0 THEN 'warning' ELSE 'pass' END AS status FROM customer")
def source_verdict(t):
    return checks.verdict(t("customer"), F.col("c_acctbal").isNull(), F.col("c_acctbal") < 0)


@query("SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) WHERE rn = 1")
def first_per_key(t):
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    return loading.first_per_key(t("lineitem"), LINE, order)


@query("SELECT arg_max(event_id, (ts, event_id)) AS event_id, user_id, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(t):
    rows = t("events").select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("event_id", "ts"), F.struct("ts", "event_id")).alias("r")).select("r.event_id", "user_id", "r.ts")


@query(
    """SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'removed' WHEN p_partkey % 7 = 1 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 7 IN (0, 1) OR p_size > 40"""
)
def snapshot_diff(t):
    """Rows that two snapshots of a table differ in."""
    part = t("part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    before = part.where("k % 7 <> 1")
    after = part.where("k % 7 <> 0").withColumn("p_size", F.when(F.col("p_size") > 40, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return loading.snapshot_diff(before, after, "k", ["p_name", "p_size"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer")
def keyed_upsert(t):
    old = t("customer").select("c_custkey", "c_acctbal")
    return loading.upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 4 = 1 THEN 'stale' ELSE 'current' END AS state FROM documents")
def embedding_state(t):
    """Which embeddings are missing or made from another text."""
    docs = t("documents")
    stored = F.when(F.col("doc_id") % 4 == 1, F.lit("sha256:old")).otherwise(text.sha256_hex(F.col("text")))
    return loading.embedding_state(docs, docs.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), stored.alias("hash")), "doc_id", "text")


@query("SELECT DISTINCT k, name, kind FROM (SELECT s_nationkey AS k, NULL AS name, 'supplier' AS kind FROM supplier UNION ALL SELECT n_nationkey, n_name, NULL FROM nation)")
def combined_sources(t):
    """Distinct rows of sources with different columns."""
    return loading.combine([t("supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("kind")), t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))]).select("k", "name", "kind")


@query()
def release_manifest(t):
    """Rows and digest of every table."""
    return loading.manifest({k: t(k) for k in RELEASED})


@query("SELECT md5(lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))) AS h, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_texts(t):
    """Texts that are equal once normalised."""
    return t("documents").groupBy(F.md5(text.normalize_for_hash(F.col("text"))).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT m.label, c.n, round(sqrt(sum(m * m)), 5) AS norm FROM m JOIN c USING (label) GROUP BY m.label, c.n")
def centroids(t):
    """Each label's vectors, and the length of their mean."""
    parts = t("embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "x"))
    mean = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy("label").agg(F.max("n").alias("n"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("norm"))
