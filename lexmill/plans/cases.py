"""Node-load and case-work queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import casework, nodes
from lexmill.plans.registry import Registry

query = Registry()
ORDER_LOAD = nodes.NodeLoad("Order", "o_orderkey", ("o_orderdate", "o_totalprice"), (nodes.Link("PLACED_BY", "o_custkey", "customer", "c_custkey", required=True), nodes.Link("RANKED_AS", "o_orderpriority", "priority", "p")), (("OpenOrder", "o_orderstatus = 'O'"), ("LargeOrder", "o_totalprice > 200000")))


def load_tables(t):
    return {"customer": t("customer").where("c_custkey % 5 <> 0"), "priority": t("orders").select(F.col("o_orderpriority").alias("p")).where("p LIKE '1%' OR p LIKE '2%'").distinct()}


@query("SELECT o_orderkey, array_to_string(list_filter_out, ',') AS labels FROM (SELECT o_orderkey, [x FOR x IN ['Order', CASE WHEN o_orderstatus = 'O' THEN 'OpenOrder' END, CASE WHEN o_totalprice > 200000 THEN 'LargeOrder' END] IF x IS NOT NULL] AS list_filter_out FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0))")
def node_load(t):
    """Rows as nodes: required keys, first row wins, labels by condition."""
    return nodes.load_nodes(t("orders"), ORDER_LOAD, load_tables(t)).select("o_orderkey", F.array_join("labels", ",").alias("labels"))


@query(
    """SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst, 'PLACED_BY' AS type FROM orders WHERE o_custkey % 5 <> 0
    UNION ALL SELECT o_orderkey::VARCHAR, o_orderpriority, 'RANKED_AS' FROM orders WHERE o_custkey % 5 <> 0 AND (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')"""
)
def node_edges(t):
    tables = load_tables(t)
    return nodes.node_edges(nodes.load_nodes(t("orders"), ORDER_LOAD, tables), ORDER_LOAD, tables)


@query("SELECT d.doc_id, coalesce(l.doc_id, e.vec_id)::VARCHAR AS dst, CASE WHEN l.doc_id IS NOT NULL THEN 'CITES' ELSE 'CITES_VERSION' END AS type FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE l.doc_id IS NOT NULL OR e.vec_id IS NOT NULL")
def citation_edges(t):
    """Each mention's edge to the first of its targets that is there."""
    mentions = t("documents").select("doc_id").join(t("labels").select("doc_id", F.col("doc_id").alias("l")), "doc_id", "left").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("v")), "doc_id", "left")
    return nodes.target_edge(mentions, [("l", "CITES"), ("v", "CITES_VERSION")]).select("doc_id", "dst", "type")


@query(
    """WITH p AS (SELECT 'n' || n_nationkey AS id, ['r' || n_regionkey, 'n' || n_nationkey] AS path, n_nationkey + 10 AS o FROM nation UNION ALL SELECT 'r' || r_regionkey, ['r' || r_regionkey], r_regionkey FROM region)
    SELECT a.id AS src, b.id AS dst, 'PARENT' AS type FROM p a JOIN p b ON len(a.path) > 1 AND a.path[1:len(a.path) - 1] = b.path UNION ALL SELECT a.id, b.id, 'NEXT' FROM p a JOIN p b ON b.o = a.o + 1"""
)
def hierarchy_edges(t):
    """Parents by path and successors by order."""
    name = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    n = t("nation").select(name("n", "n_nationkey").alias("id"), F.array(name("r", "n_regionkey"), name("n", "n_nationkey")).alias("path"), (F.col("n_nationkey") + 10).alias("o"))
    r = t("region").select(name("r", "r_regionkey").alias("id"), F.array(name("r", "r_regionkey")).alias("path"), F.col("r_regionkey").alias("o"))
    return nodes.hierarchy_edges(n.union(r).withColumn("v", F.lit(1)), "id", "v", "path", "o")


@query("SELECT e.event_id, max(h.ts)::VARCHAR AS heading FROM events e LEFT JOIN events h ON h.user_id = e.user_id AND h.event_type = 'view' AND h.ts <= e.ts WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def heading_sections(t):
    """Each section with the last heading at or before it."""
    e = t("events")
    sections = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    heads = e.where("event_type = 'view'").select("user_id", "ts", F.col("ts").cast("string").alias("heading"))
    return nodes.heading_of(sections, heads, "user_id", "ts").select("event_id", "heading")


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'removed' WHEN p_partkey % 11 = 1 THEN 'added' ELSE 'modified' END AS change FROM part WHERE p_partkey % 11 IN (0, 1, 2)")
def layer_diff(t):
    part = t("part").select("p_partkey", "p_name", "p_retailprice")
    after = part.where("p_partkey % 11 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 11 == 2, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    return casework.layer_diff(part.where("p_partkey % 11 <> 1"), after, ["p_partkey"])


@query(
    """WITH b AS (SELECT conv_id, turn, CASE WHEN turn > 0 THEN turn - 1 END AS parent, role FROM conversations), d AS (SELECT conv_id, turn FROM b GROUP BY ALL HAVING count(*) > 1)
    SELECT conv_id, turn AS id, 'repeated id' AS problem FROM d UNION ALL SELECT conv_id, turn, 'unknown type' FROM b WHERE role IS NULL OR role NOT IN ('user', 'assistant')
    UNION ALL SELECT conv_id, turn, 'lost parent' FROM b WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b p WHERE p.conv_id = b.conv_id AND p.turn = b.parent)"""
)
def block_problems(t):
    blocks = t("conversations").withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1))
    return casework.block_problems(blocks, "conv_id", "turn", "parent", "role", ["user", "assistant"])


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN count_if(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) END AS number FROM conversations")
def renumbered_blocks(t):
    return casework.renumbered(t("conversations"), "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn", "number")


@query("SELECT c_custkey, count(o_orderkey) AS n_facts, count(o_orderkey) > 0 AS satisfied FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 150000 GROUP BY c_custkey")
def claim_elements(t):
    facts = t("orders").where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey")
    return casework.claim_elements(t("customer").select("c_custkey"), facts, "c_custkey")


@query(
    """WITH f AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS label, count(*) - 1 AS dropped FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'kept' ELSE label END AS label, dropped, CASE user_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'open' ELSE 'suggested' END AS status FROM f"""
)
def timeline(t):
    """First candidates, with the state of earlier reviews."""
    found = t("events").select("user_id", "ts", "event_id", F.col("event_type").alias("label"))
    old = t("events").select("user_id").distinct().where("user_id % 3 < 2").select("user_id", F.when(F.col("user_id") % 3 == 0, "approved").otherwise("open").alias("status"), F.lit("kept").alias("label"))
    return casework.timeline(found, old, "user_id", ["ts", "event_id"], ["label"]).select("user_id", "label", "dropped", "status")


@query("SELECT lang, count(*) AS total, count_if(doc_id % 4 > 1) AS current, count_if(doc_id % 4 = 1) AS stale, count_if(doc_id % 4 = 0) AS pending FROM documents GROUP BY lang")
def embedding_coverage(t):
    state = F.when(F.col("doc_id") % 4 == 0, "pending").when(F.col("doc_id") % 4 == 1, "stale").otherwise("current")
    return casework.embedding_coverage(t("documents").withColumn("state", state), "lang", "state")


@query("SELECT lang, count(*) AS n, count_if(rn > 1) AS repeated FROM (SELECT lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents) GROUP BY lang")
def index_summary(t):
    return casework.index_summary(t("documents").select(F.col("doc_id").alias("id"), "lang", F.md5("text").alias("digest")), "lang", "digest")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b, a.o_custkey AS k FROM (SELECT *, o_orderkey % 997 AS s FROM orders WHERE o_orderkey % 2 = 0) a JOIN (SELECT *, o_orderkey % 997 AS s FROM orders WHERE o_orderkey % 2 = 1) b ON a.o_custkey = b.o_custkey AND a.s < b.s + 40 AND b.s < a.s + 30")
def overlapping_ranges(t):
    """Ranges of one key that overlap, without pairing distant ones."""
    o = t("orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderkey") % 997).alias("s"))
    a = o.where("o_orderkey % 2 = 0").select("k", F.col("o_orderkey").alias("a"), F.col("s").alias("a_start"), (F.col("s") + 30).alias("a_end"))
    b = o.where("o_orderkey % 2 = 1").select("k", F.col("o_orderkey").alias("b"), F.col("s").alias("b_start"), (F.col("s") + 40).alias("b_end"))
    return casework.overlapping(a, b, "k", 50).select("a", "b", "k")


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"a":1,"n":{"x":1}}' WHEN 1 THEN '{"a":2,"b":' || c_custkey || ',"n":{"x":1,"y":[2,null]}}' ELSE '{"a":1,"b":' || c_custkey || ',"n":"plain"}' END AS merged FROM customer""")
def merged_payloads(t):
    """Nested merges, removals and replacements; numbers stay numbers."""
    base = F.concat(F.lit('{"a":1,"b":'), F.col("c_custkey").cast("string"), F.lit(',"n":{"x":1,"y":2}}'))
    patch = F.when(F.col("c_custkey") % 3 == 0, '{"b":null,"n":{"y":null}}').when(F.col("c_custkey") % 3 == 1, '{"a":2,"n":{"y":[2,null]}}').otherwise('{"n":"plain"}')
    return t("customer").select("c_custkey", casework.merge_patch(base, patch).alias("merged"))
