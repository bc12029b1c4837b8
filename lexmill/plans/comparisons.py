"""Snapshots of conversations, packs of requirements over orders, concepts of queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import packs, snapshots
from lexmill.plans.registry import Registry

query = Registry()


@query(
    """WITH t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS x FROM conversations),
    m AS (SELECT doc, 'b' || k AS block_id, k AS was, CASE WHEN k = 0 AND n > 1 THEN n - 1 - (n >= 4)::INT ELSE k - 1 + (n = 1)::INT END AS now, CASE WHEN k = 0 AND n > 1 THEN 'moved' WHEN k = 1 THEN 'edited' ELSE 'unchanged' END AS change FROM t WHERE NOT (n >= 4 AND k = n - 1))
    SELECT * FROM m UNION ALL SELECT doc, 'b' || k, k, NULL, 'removed' FROM t WHERE n >= 4 AND k = n - 1 UNION ALL SELECT doc, 'new', NULL, n - (n >= 4)::INT, 'added' FROM t WHERE k = 0"""
)
def snapshot_changes(t):
    """Each conversation against a later form of it: the first turn went to the end, the second was edited, the last of four or more left, one came, and the third has another id."""
    lists = t("conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("x")))).alias("t"), F.count("*").alias("n"))
    rows = lists.select("doc", "n", F.posexplode("t").alias("k", "t"))
    name = F.concat(F.lit("b"), F.col("k").cast("string"))
    before = rows.select("doc", name.alias("block_id"), F.col("k").alias("place"), F.concat("t.x", F.lit(" / "), F.col("k").cast("string")).alias("text"))
    last = F.when(F.col("n") >= 4, F.col("n") - 2).otherwise(F.col("n") - 1)
    place = F.when((F.col("k") == 0) & (F.col("n") > 1), last).otherwise(F.col("k") - 1 + (F.col("n") == 1).cast("int"))
    changed = F.concat("t.x", F.lit(" / "), F.col("k").cast("string"), F.when(F.col("k") == 1, " changed").otherwise(""))
    after = rows.where("NOT (n >= 4 AND k = n - 1)").select("doc", F.when(F.col("k") == 2, F.concat(F.lit("x"), F.col("doc").cast("string"))).otherwise(name).alias("block_id"), place.cast("int").alias("place"), changed.alias("text"))
    after = after.union(lists.select("doc", F.lit("new"), (last + 1).cast("int"), F.lit("came later")))
    changes = snapshots.compare_snapshots(before, after)
    return changes.withColumn("block_id", F.when(F.startswith("block_id", F.lit("x")), "b2").otherwise(F.col("block_id")))


REQUIREMENTS = """r AS (SELECT 'q' || o_orderkey AS requirement_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'FormattingRequirement' WHEN '2-HIGH' THEN 'DeadlineRule' WHEN '3-MEDIUM' THEN 'ServiceRequirement' ELSE 'SanctionRule' END AS semantic_type,
      CASE o_orderstatus WHEN 'F' THEN ['complaint', 'answer'] WHEN 'O' THEN ['motion'] ELSE ['court_document', 'motion'] END AS applies_to FROM orders),
    p AS (SELECT * FROM (VALUES ('x:general_document', ['court_document']), ('x:civil_complaint', ['complaint']), ('x:civil_motion', ['motion']), ('x:answer', ['answer']), ('x:declaration', ['declaration']), ('x:filing_packet', ['filing_packet'])) v(rule_pack_id, types))"""


@query(
    f"""WITH {REQUIREMENTS} SELECT 'rule_pack_membership:' || substring(sha256(rule_pack_id || '::' || requirement_id), 1, 16) AS membership_id, rule_pack_id, requirement_id FROM p JOIN r ON
      CASE WHEN rule_pack_id = 'x:general_document' THEN semantic_type = 'FormattingRequirement' WHEN rule_pack_id = 'x:filing_packet' THEN semantic_type IN ('DeadlineRule', 'ServiceRequirement') ELSE list_has_any(applies_to, types) OR list_contains(applies_to, 'court_document') END"""
)
def rule_pack_memberships(t):
    """Which of the requirements made of orders each of six packs holds."""
    return packs.rule_pack_memberships(*pack_tables(t))


@query(f"WITH {REQUIREMENTS} SELECT rule_pack_id AS src, requirement_id AS dst, 'INCLUDES_RULE' AS type FROM p JOIN r ON CASE WHEN rule_pack_id = 'x:general_document' THEN semantic_type = 'FormattingRequirement' WHEN rule_pack_id = 'x:filing_packet' THEN semantic_type IN ('DeadlineRule', 'ServiceRequirement') ELSE list_has_any(applies_to, types) OR list_contains(applies_to, 'court_document') END")
def includes_rule_edges(t):
    held, requirements = pack_tables(t)
    return packs.includes_rule_edges(packs.rule_pack_memberships(held, requirements), requirements)


def pack_tables(t):
    orders = t("orders")
    texts = lambda *x: F.array(*map(F.lit, x))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "FormattingRequirement").when(F.col("o_orderpriority") == "2-HIGH", "DeadlineRule").when(F.col("o_orderpriority") == "3-MEDIUM", "ServiceRequirement").otherwise("SanctionRule")
    applies = F.when(F.col("o_orderstatus") == "F", texts("complaint", "answer")).when(F.col("o_orderstatus") == "O", texts("motion")).otherwise(texts("court_document", "motion"))
    requirements = orders.select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("requirement_id"), kind.alias("semantic_type"), applies.alias("applies_to"))
    types = {"x:general_document": "court_document", "x:civil_complaint": "complaint", "x:civil_motion": "motion", "x:answer": "answer", "x:declaration": "declaration", "x:filing_packet": "filing_packet"}
    return orders.sparkSession.createDataFrame([(k, [v]) for k, v in types.items()], "rule_pack_id string, work_product_types array<string>"), requirements


@query(
    """WITH q AS (SELECT c_custkey AS id, c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' overdue: Written NOTICE within days' WHEN c_acctbal < 3000 THEN ' court filing' WHEN c_acctbal < 6000 THEN ' nothing' ELSE ' tenant damages' END AS text FROM customer),
    p AS (SELECT * FROM (VALUES (1, 'deadlines', 'deadline|due date|time to|within|days after', ['deadline', 'time limit', 'service date', 'filing date', 'computation of time']), (2, 'notices', 'notice|notify', ['written notice', 'service', 'mailing', 'delivery', 'recipient']),
      (3, 'remedies', 'remedy|damages|relief|injunction|penalty', ['damages', 'equitable relief', 'civil penalty', 'injunction', 'attorney fees']), (5, 'landlord_tenant', 'landlord|tenant|rental|dwelling|habitability', ['residential tenancy', 'dwelling unit', 'habitability', 'possession', 'rent']),
      (6, 'filing_service', 'file|filing|serve|service|certificate', ['filing requirement', 'service requirement', 'certificate of service', 'efiling', 'proof of service']), (7, 'jurisdiction', 'court|venue|jurisdiction|county|circuit', ['subject matter jurisdiction', 'venue', 'circuit court', 'local rule', 'statewide rule'])) v(n, concept, words, terms)),
    h AS (SELECT id, n, concept, unnest(terms) AS term, unnest(range(1, 6)) AS i FROM q JOIN p ON regexp_matches(lower(text), words)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n, i) - 1 AS place FROM h)
    SELECT id, place, term, 'legal_concept_pack:' || concept AS source_id FROM r WHERE place < 8"""
)
def concept_expansion(t):
    """The first eight terms that the concepts in a phrase about each customer bring."""
    balance = F.col("c_acctbal")
    phrase = F.when(balance < 0, " overdue: Written NOTICE within days").when(balance < 3000, " court filing").when(balance < 6000, " nothing").otherwise(" tenant damages")
    return packs.expand_concepts(t("customer").select("c_custkey", F.concat("c_mktsegment", phrase).alias("text")), "c_custkey", "text", 8).drop("kind", "score")
