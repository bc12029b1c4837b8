"""Graph and rule queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import graph, rules
from lexmill.plans.registry import Registry

query = Registry()
EDGES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS type FROM nation
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'AT' FROM supplier),
    u AS (SELECT src, dst, type FROM e UNION SELECT dst, src, type FROM e)"""


def edges(t):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    places = t("nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"), F.lit("IN").alias("type"))
    return graph.merge_edges([places, t("supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"), F.lit("AT").alias("type"))])


@query(
    f"""WITH {EDGES}, h0 AS (SELECT 'n3' AS node, 0 AS hops), h1 AS (SELECT u.dst AS node, 1 AS hops FROM h0 JOIN u ON u.src = h0.node), h2 AS (SELECT u.dst AS node, 2 AS hops FROM h1 JOIN u ON u.src = h1.node)
    SELECT node, min(hops) AS hops FROM (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY node"""
)
def neighbourhood(t):
    """Everything within two steps of a node."""
    e = edges(t)
    return graph.neighbourhood(e, t("nation").where("n_nationkey = 3").select(F.lit("n3").alias("node")), 2)


@query(f"WITH {EDGES} SELECT src, dst, type FROM e WHERE src IN ('n1', 'n2', 'r1') AND dst IN ('n1', 'n2', 'r1')")
def induced_edges(t):
    e = edges(t)
    return graph.induced(e, e.select(F.col("src").alias("node")).union(e.select("dst")).where(F.col("node").isin("n1", "n2", "r1")))


@query(
    f"""WITH {EDGES}, n AS (SELECT src AS node, dst AS o, NULL AS i, type FROM e UNION ALL SELECT dst, NULL, src, type FROM e)
    SELECT node, count(DISTINCT o) AS outgoing, count(DISTINCT i) AS incoming, count(DISTINCT type) AS types, round(least(0.1::DOUBLE * count(DISTINCT o) + 0.05::DOUBLE * count(DISTINCT i), 1.5::DOUBLE), 6) AS score FROM n GROUP BY node"""
)
def graph_features(t):
    """Distinct neighbours and the score that they give."""
    d = graph.degree_counts(edges(t))
    return d.withColumn("score", F.round(graph.graph_score(F.col("outgoing"), F.col("incoming")), 6))


@query(
    f"""WITH RECURSIVE {EDGES}, c AS (SELECT DISTINCT node, node AS ancestor, 0 AS depth FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)
      UNION SELECT c.node, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.ancestor)
    SELECT node, ancestor, min(depth) AS depth FROM c GROUP BY ALL"""
)
def jurisdiction_closure(t):
    """Every place that a place is part of, by its depth."""
    return graph.closure(edges(t))


@query(
    """WITH n AS (SELECT conv_id || ':' || turn AS node, lead(conv_id || ':' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations)
    SELECT node AS src, nxt AS dst, 'NEXT' AS type FROM n WHERE nxt IS NOT NULL UNION ALL SELECT nxt, node, 'PREVIOUS' FROM n WHERE nxt IS NOT NULL"""
)
def sequence_edges(t):
    return graph.sequence_edges(t("conversations"), ["conv_id"], "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")))


@query(
    """WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
    SELECT src, dst, round(s, 6) AS similarity FROM p WHERE s >= 0.1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) <= 3"""
)
def similar_edges(t):
    """The nearest vectors of a vector's own group."""
    return graph.similar_edges(t("embeddings"), "vec_id", "embedding", "label", 3, 0.1).select("src", "dst", F.round("similarity", 6).alias("similarity"))


@query(
    """WITH i AS (SELECT o_custkey, o_orderkey, o_orderdate AS start_date, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS end_date FROM orders)
    SELECT o_custkey, o_orderkey FROM i WHERE start_date <= TIMESTAMP '1996-06-01' AND (end_date IS NULL OR end_date >= TIMESTAMP '1996-06-01')"""
)
def rules_in_force(t):
    """Which of each key's intervals hold on a day."""
    spans = rules.intervals_from_events(t("orders").withColumnRenamed("o_orderdate", "start_date"), "o_custkey", "start_date", "o_orderkey")
    return rules.applicable(spans, "1996-06-01").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' GROUP BY o_custkey")
def latest_as_of(t):
    return rules.latest_as_of(t("orders"), "o_custkey", "o_orderdate", "o_orderkey", "1996-06-01", ["o_orderkey", "o_orderstatus"])


@query(
    """SELECT event_id, user_id, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts) AS last_ts FROM events e WHERE event_type = 'click'"""
)
def as_of_join(t):
    """Each click with its user's last purchase before it."""
    clicks = t("events").where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = t("events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("last_ts"))
    return rules.as_of_join(clicks, bought, "user_id", "ts", "last_ts", ["last_ts"]).select("event_id", "user_id", "last_ts")


@query("SELECT o_custkey, o_orderdate AS from_start, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS to_start FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders) QUALIFY to_start IS NOT NULL")
def supersession_edges(t):
    return rules.superseded(t("orders").select("o_custkey", "o_orderdate").distinct(), "o_custkey", "o_orderdate")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def recent_items(t):
    return rules.keep_newest(t("events"), "user_id", "ts", "event_id", 3).select("user_id", "event_id")


@query("SELECT o_orderkey, o_custkey, year(o_orderdate) = max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS current FROM orders")
def current_flags(t):
    return rules.current_flags(t("orders").withColumn("edition", F.year("o_orderdate")), "o_custkey", "edition").select("o_orderkey", "o_custkey", "current")


@query("SELECT n_regionkey AS chapter, list_aggregate(list(n_name ORDER BY n_name)[1:3], 'string_agg', ',') AS first_items, count(*) AS total FROM nation GROUP BY n_regionkey")
def sidebar(t):
    """Groups with their first items."""
    names = F.array_sort(F.collect_list("n_name"))
    return t("nation").groupBy(F.col("n_regionkey").alias("chapter")).agg(F.array_join(F.slice(names, 1, 3), ",").alias("first_items"), F.count("*").alias("total"))
