"""Bounded neighbourhoods of every nation and region, among customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import neighborhoods
from lexmill.plans.registry import Registry

query = Registry()

LIMIT, THRESHOLD = 40, 0.5
GRAPH = """n AS (SELECT 'n' || n_nationkey AS node, ['Nation'] AS labels, NULL::DOUBLE AS confidence FROM nation UNION ALL SELECT 'r' || r_regionkey, ['Region'], 0.5 FROM region
      UNION ALL SELECT 'c' || c_custkey, CASE WHEN c_acctbal < 0 THEN ['Customer', 'RetrievalChunk'] ELSE ['Customer'] END, 0.9 FROM customer UNION ALL SELECT 's' || s_suppkey, ['Supplier'], CASE WHEN s_acctbal < 0 THEN 0.1 END FROM supplier),
    e AS (SELECT 'e-c' || c_custkey AS edge_id, 'c' || c_custkey AS src, 'n' || c_nationkey AS dst, 'CITES' AS type, c_acctbal::DOUBLE AS score FROM customer
      UNION ALL SELECT 'e-s' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey, 'SIMILAR_TO', s_acctbal::DOUBLE / 10000 FROM supplier
      UNION ALL SELECT 'e-n' || n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey, 'CONTAINS', NULL FROM nation
      UNION ALL SELECT 'e-x' || n_nationkey, 'r' || n_regionkey, 'n' || n_nationkey, 'UNKNOWN', 1 FROM nation),
    a AS (SELECT *, src AS node, dst AS other FROM e UNION ALL SELECT *, dst, src FROM e),
    f AS (SELECT * FROM a WHERE type IN ('CITES', 'SIMILAR_TO', 'CONTAINS') AND (type <> 'SIMILAR_TO' OR score >= 0.5)),
    c AS (SELECT node AS center FROM n WHERE node[1] IN ('n', 'r')),
    one AS (SELECT * FROM (SELECT c.center, row_number() OVER (PARTITION BY center ORDER BY score DESC NULLS LAST, edge_id) AS path, 1 AS hops, edge_id, type, src, dst, score, other AS stop FROM c JOIN f ON f.node = c.center) WHERE path <= 120),
    m AS (SELECT center, max(path) AS found FROM one GROUP BY center),
    two AS (SELECT * FROM (SELECT one.center, found + row_number() OVER (PARTITION BY one.center ORDER BY one.path, f.score DESC NULLS LAST, f.edge_id) AS path, 2 AS hops, f.edge_id, f.type, f.src, f.dst, f.score, f.other AS stop
            FROM one JOIN m ON one.center = m.center JOIN f ON f.node = one.stop AND f.edge_id <> one.edge_id) WHERE path <= 120),
    p AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


def around(t):
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    no_number = F.lit(None).cast("double")
    labels = lambda *x: F.array(*map(F.lit, x))
    chunk = F.when(F.col("c_acctbal") < 0, labels("Customer", "RetrievalChunk")).otherwise(labels("Customer"))
    nodes = t("nation").select(name("n", "n_nationkey").alias("node"), labels("Nation").alias("labels"), no_number.alias("confidence"))
    nodes = nodes.union(t("region").select(name("r", "r_regionkey"), labels("Region"), F.lit(0.5)))
    nodes = nodes.union(t("customer").select(name("c", "c_custkey"), chunk, F.lit(0.9))).union(t("supplier").select(name("s", "s_suppkey"), labels("Supplier"), F.when(F.col("s_acctbal") < 0, 0.1)))
    edge = lambda df, i, src, dst, kind, score: df.select(i.alias("edge_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), no_number.alias("confidence"), score.cast("double").alias("score"))
    edges = edge(t("customer"), name("e-c", "c_custkey"), name("c", "c_custkey"), name("n", "c_nationkey"), "CITES", F.col("c_acctbal"))
    edges = edges.union(edge(t("supplier"), name("e-s", "s_suppkey"), name("n", "s_nationkey"), name("s", "s_suppkey"), "SIMILAR_TO", F.col("s_acctbal").cast("double") / 10000))
    edges = edges.union(edge(t("nation"), name("e-n", "n_nationkey"), name("r", "n_regionkey"), name("n", "n_nationkey"), "CONTAINS", no_number))
    edges = edges.union(edge(t("nation"), name("e-x", "n_nationkey"), name("r", "n_regionkey"), name("n", "n_nationkey"), "UNKNOWN", F.lit(1)))
    centers = nodes.where(F.substring("node", 1, 1).isin("n", "r"))
    return neighborhoods.bounded_neighbourhood(neighborhoods.adjacency(edges), nodes, centers, depth=2, limit=LIMIT, mode="legal", similar=True, threshold=THRESHOLD)


@query(
    f"""WITH {GRAPH}, reached AS (SELECT center, center AS node, 0 AS hops, 0 AS place FROM c UNION ALL SELECT center, stop, hops, path FROM p),
    r AS (SELECT center, node, min(hops) AS hops, min(place) AS place FROM reached GROUP BY ALL)
    SELECT * FROM (SELECT r.center, r.node, hops, row_number() OVER (PARTITION BY r.center ORDER BY place, r.node) AS rank FROM r JOIN n ON n.node = r.node WHERE NOT list_contains(labels, 'RetrievalChunk')) WHERE rank <= 40"""
)
def vicinity_nodes(t):
    """The first 40 nodes around each nation and region."""
    return around(t)[0]


@query(
    f"""WITH {GRAPH}, chunk AS (SELECT node FROM n WHERE list_contains(labels, 'RetrievalChunk')),
    d AS (SELECT center, edge_id, src, dst, type, score, min(path) AS place FROM p GROUP BY ALL)
    SELECT center, edge_id, src, dst, type, CASE type WHEN 'SIMILAR_TO' THEN 'semantic_similarity' ELSE 'legal' END AS kind, score, row_number() OVER (PARTITION BY center ORDER BY place) AS rank
    FROM d WHERE src NOT IN (SELECT node FROM chunk) AND dst NOT IN (SELECT node FROM chunk)"""
)
def vicinity_edges(t):
    """The edges on the first 120 paths from each nation and region."""
    return around(t)[1].drop("confidence")
