"""Chapter pages made of conversations: each turn is a section, each line of it a labelled part, and the SQL says what a reader must find in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.plans.registry import Registry
from lexmill.sources import chapters

query = Registry()

#: Turns as sections: chapter number, citation, caption, lines, and the heading above (that of the last user's turn).
TURNS = r"""c AS (SELECT conv_id AS doc, (conv_id % 899 + 1)::VARCHAR AS chapter, turn, role, coalesce(text, '') AS t FROM conversations),
    s AS (SELECT doc, chapter, turn, chapter || '.' || lpad((10 * turn + 10)::VARCHAR, 3, '0') AS citation, role,
          list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS lines FROM c),
    h AS (SELECT *, array_to_string(list_transform(lines, lambda x, i: '(' || i || ') ' || x), chr(10) || chr(10)) AS body,
          '[' || (1950 + turn) || ' c.' || (doc + 1) || ' §' || (turn + 1) || ']' AS law,
          last_value(CASE WHEN role = 'user' THEN 'QUESTIONS ' || chr((65 + turn % 26)::INT) || chr((65 + turn // 26)::INT) || 'XYZ' END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY turn) AS heading FROM s)"""


def pages(t):
    """A page for each conversation: contents, then a section a turn; a user's turn has a heading above, a line is a part, the last one ends with a history note; the first section comes again, shortened, after the last."""
    chapter = (F.col("conv_id") % 899 + 1).cast("string")
    section = F.format_string("%03d", 10 * F.col("turn") + 10)
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    lines = F.filter(F.transform(F.split(escaped, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    p = lambda *inner: F.concat(F.lit('<p class="MsoNormal">'), *inner, F.lit("</p>"))
    law = F.concat(F.lit("[").cast("string"), (F.col("turn") + 1950).cast("string"), F.lit(" c."), (F.col("conv_id") + 1).cast("string"), F.lit(" &sect;"), (F.col("turn") + 1).cast("string"), F.lit("]"))
    heading = F.concat(F.lit("QUESTIONS "), F.expr("chr(65 + turn % 26)"), F.expr("chr(65 + turn div 26)"), F.lit("XYZ"))
    start = p(F.lit("<b>"), chapter, F.lit("."), section, F.lit(" The "), F.col("role"), F.lit(" speaks.</b>"))
    body = F.concat_ws("", F.when(F.col("role") == "user", p(heading)), start, F.array_join(F.transform(lines, lambda x, i: p(F.lit("("), (i + 1).cast("string"), F.lit(") "), x)), ""), p(law))
    listed = p(chapter, F.lit("."), section, F.lit("  What the "), F.col("role"), F.lit(" says"))
    turns = t("conversations").select("conv_id", "turn", chapter.alias("chapter"), body.alias("body"), listed.alias("listed"))
    one = F.array_sort(F.collect_list(F.struct("turn", "listed", "body")))
    made = turns.groupBy("conv_id", "chapter").agg(one.alias("t"))
    again = F.concat(F.lit('<p class="MsoNormal"><b>'), F.col("chapter"), F.lit(".010 Again.</b> Short.</p>"))
    html = F.concat(F.lit("<html><body>"), p(F.lit("CONTENTS OF ALL")), F.array_join(F.transform("t", lambda x: x["listed"]), ""), F.array_join(F.transform("t", lambda x: x["body"]), ""), again, F.lit("</body></html>"))
    return chapters.chapter_paragraphs(made.select(F.col("conv_id").alias("source_document_id"), "chapter", html.alias("html")))


@query(
    rf"""WITH {TURNS}, f AS (SELECT doc, chapter, min(turn) AS low, max(turn) AS top, count(*) AS n FROM h GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn) AS section FROM h),
    o AS (SELECT doc, section, citation, 'The ' || role || ' speaks' AS title, coalesce(heading, 'CONTENTS OF ALL') AS heading, regexp_replace(body, '\s+', ' ', 'g') AS text, law AS history,
          CASE WHEN strlen(regexp_replace(body, '\s+', ' ', 'g')) < 80 THEN 'status_only' ELSE 'active' END AS status FROM n),
    d AS (SELECT f.doc, f.n + 1 AS section, f.chapter || '.010' AS citation, 'Again' AS title, (SELECT max_by(heading, section) FROM o WHERE o.doc = f.doc) AS heading, 'Short.' AS text, NULL AS history, 'status_only' AS status FROM f)
    SELECT *, row_number() OVER (PARTITION BY doc, citation ORDER BY (status = 'active') DESC, strlen(text || CASE WHEN history IS NULL THEN '' ELSE ' ' || history END) DESC, section) = 1 AS is_primary
    FROM (SELECT * FROM o UNION ALL SELECT * FROM d)"""
)
def chapter_sections(t):
    """Every section of every page with its caption, heading, text, history, status, and whether it stands for its citation."""
    rows = pages(t)
    found = chapters.sections(chapters.marked_paragraphs(rows), chapters.contents_entries(rows))
    return found.select("doc", "section", "citation", "title", "heading", "text", "history", "status", F.col("primary").alias("is_primary"))


@query(f"WITH {TURNS} SELECT doc, citation, 'What the ' || role || ' says' AS caption, 'CONTENTS OF ALL' AS heading, row_number() OVER (PARTITION BY doc ORDER BY turn) - 1 AS toc_order FROM h")
def chapter_contents(t):
    """The lines of every page's contents."""
    return chapters.contents_entries(pages(t)).select("doc", "citation", "caption", F.array_join("heading_path", " > ").alias("heading"), "toc_order")


@query(
    rf"""WITH {TURNS}, p AS (SELECT doc, citation, unnest(lines) AS text, unnest(range(1, len(lines) + 1)) AS k FROM h)
    SELECT doc, 'ORS ' || citation || '(' || k || ')' AS display_citation, 'subsection' AS provision_type, text, k - 1 AS order_index, 1 AS depth FROM p
    """
)
def chapter_provisions(t):
    """The labelled parts of every section that stands for its citation; history notes leave the last one's text."""
    rows = pages(t)
    marked = chapters.marked_paragraphs(rows)
    drafts = chapters.sections(marked, chapters.contents_entries(rows))
    return chapters.section_provisions(marked, drafts, 2024).where("provision_type <> 'section_text'").select("doc", "display_citation", "provision_type", "text", "order_index", "depth")


@query(f"WITH {TURNS} SELECT doc, citation, (1950 + turn) || ' c.' || (doc + 1) || ' sec. ' || (turn + 1) AS session_law_citation, 'or:laws:' || (1950 + turn) || ':c:' || (doc + 1) || ':s:' || (turn + 1) AS session_law_id FROM h")
def chapter_amendments(t):
    """The session laws in every section's history."""
    rows = pages(t)
    drafts = chapters.sections(chapters.marked_paragraphs(rows), chapters.contents_entries(rows))
    return chapters.amendments(drafts)
