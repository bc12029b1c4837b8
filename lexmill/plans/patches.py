"""Patches of documents made of conversations: a block a turn, links into their texts, and one patch a conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators import work_products
from lexmill.plans.registry import Registry

query = Registry()

#: The turns and, for each conversation, whether its patch applies; the patch is the same for all: split the first block at 4, merge the second into the new one, move the third to the end, drop the last one from five on.
EXPECTED = """t AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(text, '') AS x FROM conversations),
    d AS (SELECT doc, any_value(n) AS n, any_value(n) >= 3 AND any_value(n) % 2 = 0 AND max(CASE WHEN k = 0 THEN length(x) END) >= 4 AS ok, max(CASE WHEN k = 0 THEN x END) AS a, max(CASE WHEN k = 1 THEN x END) AS b FROM t GROUP BY doc)"""


def flat(rows: DataFrame, ddl: str, **values) -> DataFrame:
    """Rows (doc and others) with the columns of ddl: those given, else null."""
    kinds = [c.split(" ", 1) for c in ddl.split(", ")]
    return rows.select("doc", *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


def tables(t):
    turns = t("conversations").select(F.col("conv_id").alias("doc"), "turn", F.coalesce("text", F.lit("")).alias("x"))
    lists = turns.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("turn", "x"))).alias("turns"), F.count("*").alias("n"))
    rows = lists.select("doc", "n", F.posexplode("turns").alias("k", "turn"))
    name = F.concat(F.lit("b"), F.col("k").cast("string"))
    blocks = flat(rows, work_products.BLOCK, block_id=name, ordinal=F.col("k") + 1, type=F.lit("paragraph"), role=F.lit("fact"), text=F.col("turn.x"))
    length = F.length("turn.x")
    first = flat(rows, work_products.RECORD, record_id=F.concat(F.lit("r"), F.col("k").cast("string")), kind=F.lit("link"), block_id=name, start=F.lit(0), stop=F.least(F.lit(3), length))
    later = flat(rows.where((F.col("k") == 0) & (length >= 5)), work_products.RECORD, record_id=F.lit("s0"), kind=F.lit("citation"), block_id=name, start=F.lit(4), stop=F.lit(5))
    operation = lambda n, op, where="true", **values: flat(lists.where(where), work_products.OPERATION, n=F.lit(n), op=F.lit(op), **values)
    operations = [
        operation(1, "split_block", block_id=F.lit("b0"), position=F.lit(4), other_id=F.lit("b0x")),
        operation(2, "merge_blocks", block_id=F.lit("b0x"), other_id=F.lit("b1")),
        operation(3, "move_block", block_id=F.lit("b2")),
        operation(4, "delete_block", "n >= 5", block_id=F.concat(F.lit("b"), (F.col("n") - 1).cast("string"))),
        operation(5, "delete_block", "n % 2 = 1", block_id=F.lit("missing")),
    ]
    return blocks, first.union(later), reduce(DataFrame.union, operations)


@query(
    f"""WITH {EXPECTED}
    SELECT doc, 'b' || k AS block_id, CASE WHEN k = 2 AND ok THEN t.n WHEN k = 0 OR NOT ok THEN k + 1 ELSE k END AS ordinal, CASE WHEN ok AND k = 0 THEN x[1:4] ELSE x END AS text FROM t JOIN d USING (doc)
    WHERE NOT ok OR k <> 1 AND NOT (t.n >= 5 AND k = t.n - 1)
    UNION ALL SELECT doc, 'b0x', 2, a[5:] || CASE WHEN length(a) > 4 AND b <> '' THEN chr(10) || chr(10) ELSE '' END || b FROM d WHERE ok"""
)
def patched_blocks(t):
    """All blocks after each conversation's patch; where it fails, as before."""
    blocks, records, operations = tables(t)
    return work_products.patched(blocks, work_products.apply_patches(blocks, records, operations), "blocks").select("doc", "block_id", "ordinal", "text")


@query(
    f"""WITH {EXPECTED}, r AS (SELECT doc, k, t.n, ok, a, b, 'r' || k AS record_id, 0 AS start, least(3, length(x)) AS stop FROM t JOIN d USING (doc)
      UNION ALL SELECT doc, 0, d.n, ok, a, b, 's0', 4, 5 FROM d WHERE length(a) >= 5),
    m AS (SELECT *, length(a) - 4 + CASE WHEN length(a) > 4 AND b <> '' THEN 2 ELSE 0 END AS shift FROM r)
    SELECT doc, record_id, CASE WHEN ok AND (k = 1 OR record_id = 's0') THEN 'b0x' ELSE 'b' || k END AS block_id,
      CASE WHEN ok AND k = 1 THEN start + shift WHEN ok AND record_id = 's0' THEN 0 ELSE start END AS start, CASE WHEN ok AND k = 1 THEN stop + shift WHEN ok AND record_id = 's0' THEN 1 ELSE stop END AS stop
    FROM m WHERE NOT (ok AND n >= 5 AND k = n - 1)"""
)
def patched_records(t):
    """All records after each conversation's patch, with their places in the changed texts."""
    blocks, records, operations = tables(t)
    return work_products.patched(records, work_products.apply_patches(blocks, records, operations), "records").select("doc", "record_id", "block_id", "start", "stop")


@query(
    """WITH RECURSIVE t AS (SELECT conv_id AS doc, turn, role, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked FROM conversations),
    b AS (SELECT doc, turn, CASE WHEN role = 'user' OR asked IS NULL THEN NULL ELSE asked END AS parent FROM t)
    SELECT doc, 'b' || turn AS block_id, CASE WHEN parent IS NOT NULL THEN 'b' || parent END AS parent_id, CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS depth, row_number() OVER (PARTITION BY doc ORDER BY turn) - 1 AS place FROM b"""
)
def block_trees(t):
    """Answers below their questions, in the order of reading."""
    rows = t("conversations").select(F.col("conv_id").alias("doc"), "turn", "role", "text")
    turns = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("doc", F.explode("t").alias("x"), "t")
    asked = F.array_max(F.transform(F.filter("t", lambda y: (y["role"] == "user") & (y["turn"] < F.col("x.turn"))), lambda y: y["turn"]))
    name = lambda turn: F.concat(F.lit("b"), turn.cast("string"))
    blocks = flat(turns, work_products.BLOCK, block_id=name(F.col("x.turn")), parent_id=F.when(F.col("x.role") != "user", name(asked)), ordinal=F.col("x.turn") + 1, text=F.col("x.text"))
    return work_products.block_tree(blocks)
