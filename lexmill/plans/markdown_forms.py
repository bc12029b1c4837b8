"""Conversations as Markdown pages: read as blocks, and blocks written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import markdown
from lexmill.plans.registry import Registry

query = Registry()

LINES = r"""c AS (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn, role, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM conversations)"""


def turns(t):
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    grouped = t("conversations").select(F.col("conv_id").alias("doc"), F.struct("turn", "role", lines.alias("lines")).alias("t")).groupBy("doc").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return grouped.select("doc", F.posexplode("turns").alias("k", "t")).select("doc", "k", "t.*")


@query(
    f"""WITH {LINES}, b AS (SELECT doc, 3 * k AS place, 'heading' AS type, 'heading' AS role, role || ' ' || turn AS title, '' AS text, NULL::INT AS number, 'level_2' AS section FROM c
      UNION ALL SELECT doc, 3 * k + 1, 'numbered_paragraph', 'factual_allegation', 'Paragraph ' || (k + 1), lines[1], k + 1, NULL FROM c
      UNION ALL SELECT doc, 3 * k + 2, CASE WHEN role = 'user' THEN 'quote' ELSE 'paragraph' END, CASE WHEN role = 'user' THEN 'quote' ELSE 'custom' END, NULL, CASE WHEN role = 'user' THEN array_to_string(lines, chr(10)) ELSE array_to_string(lines, chr(10) || chr(10)) END, NULL, NULL FROM c)
    SELECT * FROM b"""
)
def markdown_blocks(t):
    """The blocks of a page for each conversation: a heading a turn, its first line numbered, then its lines, quoted for users. The page has front matter and repeats its title."""
    rows = turns(t)
    quoted = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("> "), x)), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string")), F.lit(""), F.concat((F.col("k") + 1).cast("string"), F.lit(". "), F.get("lines", F.lit(0))), F.when(F.col("role") == "user", quoted).otherwise(F.array_join("lines", "\n\n")), F.lit(""))
    pages = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", body.alias("body")))), lambda x: x["body"]), "\n").alias("body"))
    title = F.concat(F.lit("Conversation "), F.col("doc").cast("string"))
    page = F.concat(F.lit("---\ntitle: x\n---\n# "), title, F.lit("\n\n<!-- a note -->\n"), F.col("body"))
    return markdown.parse(pages.select("doc", page.alias("markdown"), title.alias("title")), title_col="title").select("doc", "place", "type", "role", "title", "text", "number", "section")


@query(
    f"""WITH {LINES} SELECT doc, k AS place, 'b' || turn AS block_id, CASE WHEN k > 0 THEN 'b0' END AS parent_id, k + 1 AS ordinal, CASE k % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'numbered_paragraph' WHEN 2 THEN 'quote' ELSE 'paragraph' END AS type, role, role || ' --> ' || turn AS title,
      CASE k % 4 WHEN 1 THEN array_to_string(lines, ' ') ELSE array_to_string(lines, chr(10)) END AS text, CASE WHEN k % 4 = 1 THEN k + 1 END AS number, CASE WHEN k % 4 = 0 THEN 'level_3' END AS section FROM c"""
)
def markdown_round_trip(t):
    """Blocks of four types, written as Markdown and read again: they are as before."""
    rows, k = turns(t), F.col("k") % 4
    name = F.concat(F.lit("b"), F.col("turn").cast("string"))
    blocks = rows.select(
        "doc", F.col("k").alias("place"), name.alias("block_id"), F.when(F.col("k") > 0, "b0").alias("parent_id"), (F.col("k") + 1).alias("ordinal"), F.when(k == 0, "section").when(k == 1, "numbered_paragraph").when(k == 2, "quote").otherwise("paragraph").alias("type"), "role",
        F.concat("role", F.lit(" --> "), F.col("turn").cast("string")).alias("title"), F.when(k == 1, F.array_join("lines", " ")).otherwise(F.array_join("lines", "\n")).alias("text"), F.when(k == 1, F.col("k") + 1).alias("number"), F.when(k == 0, "level_3").alias("section"),
    )
    return markdown.parse(markdown.render(blocks))
