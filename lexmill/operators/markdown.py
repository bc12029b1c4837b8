"""Markdown forms of work products: blocks written as Markdown with their facts in comments, and Markdown read as blocks.

A page is read by its lines. What a line does to the block before it - go on with it, end it, begin another - depends on the last
lines that decide, so blocks are running counts over a page's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import stable_id

#: The comment that holds a block's facts, types written as headings, and the forms of lines.
COMMENT, HEADINGS = "wp-ast-block", ["heading", "section", "count", "caption"]
HEADING_LINE, NUMBER_LINE, QUOTE_LINE = r"^(#{1,6})\s+(.*)$", r"^\s*([0-9]+)\.\s+(.*)$", r"^\s*>\s?(.*)$"
META = "block_id string, block_type string, role string, title string, order_index int, parent_id string, paragraph_number int, section_kind string"


def render(blocks: DataFrame) -> DataFrame:
    """doc and markdown of blocks (doc, place, block_id, parent_id, ordinal, type, role, title, text, number, section): a comment with its facts before each block, in the order of place."""
    facts = F.to_json(F.struct("block_id", F.col("type").alias("block_type"), "role", "title", F.col("ordinal").alias("order_index"), "parent_id", F.col("number").alias("paragraph_number"), F.col("section").alias("section_kind")))
    comment = F.concat(F.lit(f"<!-- {COMMENT} "), F.replace(facts, F.lit(">"), F.lit("\\u003e")), F.lit(" -->"))
    level = F.greatest(F.least(F.coalesce(F.regexp_extract("section", r"^level_([0-9]+)$", 1).try_cast("int"), F.lit(2)), F.lit(4)), F.lit(1))
    text = F.coalesce("text", F.lit(""))
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce("title", F.lit("")), F.when((F.trim(text) != "") & (F.trim(text) != F.trim(F.coalesce("title", F.lit("")))), F.concat(F.lit("\n"), text)).otherwise(""))
    quote = F.array_join(F.transform(F.split(text, "\n"), lambda line: F.concat(F.lit("> "), line)), "\n")
    body = F.when(F.col("type").isin(HEADINGS), heading).when(F.col("type") == "numbered_paragraph", F.concat(F.coalesce("number", "ordinal").cast("string"), F.lit(". "), text)).when(F.col("type") == "quote", quote).when(F.col("type") == "page_break", "<!-- page-break -->").otherwise(text)
    one = F.struct("place", F.concat(F.lit("\n"), comment, F.lit("\n"), body).alias("lines"))
    return blocks.select("doc", one.alias("one")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("one")), lambda x: x["lines"]), "\n").alias("markdown"))


def in_page() -> tuple:
    whole = Window.partitionBy("doc").orderBy("line")
    return whole, whole.rowsBetween(Window.unboundedPreceding, Window.currentRow), whole.rowsBetween(Window.unboundedPreceding, -1)


def kind_of_line(text: Column) -> Column:
    return (
        F.when(F.regexp_like(text, F.lit(rf"^\s*<!--\s*{COMMENT}\s")), "meta")
        .when(F.regexp_like(text, F.lit(r"^\s*<!--")), "comment")
        .when(F.trim(text) == "", "blank")
        .when(F.regexp_like(text, F.lit(HEADING_LINE)), "heading")
        .when(F.regexp_like(text, F.lit(NUMBER_LINE)), "number")
        .when(F.regexp_like(text, F.lit(QUOTE_LINE)), "quote")
        .otherwise("text")
    )


def page_lines(pages: DataFrame, doc_col: str, text_col: str, title_col: str | None) -> DataFrame:
    """doc, line, text and kind of the lines that matter: front matter between the first two --- lines, other comments and a first heading that repeats the title are left out."""
    _, upto, before = in_page()
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    rows = pages.select(F.col(doc_col).alias("doc"), title.alias("title"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\r?\n")).alias("line", "raw")).select("doc", "title", "line", F.rtrim("raw").alias("text"))
    rule = F.trim("text") == "---"
    rules = F.coalesce(F.sum(rule.cast("int")).over(before), F.lit(0))
    rows = rows.withColumn("rules", rules).where(~((F.col("rules") == 1) | rule & (F.col("rules") < 2))).withColumn("kind", kind_of_line(F.col("text"))).where("kind <> 'comment'")
    some = F.coalesce(F.sum((F.col("kind") != "blank").cast("int")).over(before), F.lit(0))
    repeats = (F.col("kind") == "heading") & (F.regexp_extract("text", HEADING_LINE, 1) == "#") & (F.regexp_extract("text", HEADING_LINE, 2) == F.col("title"))
    return rows.withColumn("some", some).where(~F.coalesce(repeats & (F.col("some") == 0), F.lit(False))).select("doc", "line", "text", "kind")


def parse(pages: DataFrame, doc_col: str = "doc", text_col: str = "markdown", title_col: str | None = None) -> DataFrame:
    """doc, place, block_id, parent_id, ordinal, type, role, title, text, number and section of each block of each page.

    A facts comment begins a block, to which the next heading or number belongs; other headings and numbers begin blocks of their own; quote lines
    go together until a blank or another line; text goes on with the block before it, over blank lines too, but not with a quote or a
    numbered paragraph. Blocks without comment get an id from page and place. Damaged facts leave the block what its lines show. A page without
    lines has no blocks. title_col: the product's title, which a first-level heading may repeat at the top.
    """
    whole, upto, before = in_page()
    lines = page_lines(pages, doc_col, text_col, title_col)
    facts = F.from_json(F.regexp_extract("text", rf"<!--\s*{COMMENT}\s+(.*?)\s*-->", 1), META)
    lines = lines.withColumn("facts", F.when(F.col("kind") == "meta", facts))
    solid = F.when(F.col("kind") != "blank", F.struct("kind", "line"))
    lines = lines.withColumn("last", F.last(solid, ignorenulls=True).over(before)).withColumn("blank", F.coalesce(F.last(F.when(F.col("kind") == "blank", F.col("line")), ignorenulls=True).over(before) > F.col("last.line"), F.lit(False)))
    quoting = F.coalesce(F.last(F.when(F.col("kind") == "meta", F.coalesce(F.col("facts.block_type"), F.lit(""))), ignorenulls=True).over(before) == "quote", F.lit(False))
    attached = F.coalesce(F.col("last.kind") == "meta", F.lit(False))
    lines = lines.withColumns({"attached": attached, "quoting": quoting})
    # whether the block that is open at a line began with facts
    event = F.when(F.col("kind") == "meta", True).when((F.col("kind") == "number") | (F.col("kind") == "heading") & ~F.col("attached"), False).when((F.col("kind") == "blank") & (F.col("last.kind") == "quote") & F.col("quoting"), False)
    lines = lines.withColumn("event", event).withColumn("factual", F.coalesce(F.last("event", ignorenulls=True).over(before), F.lit(False)))
    after_quote = F.coalesce(F.col("last.kind") == "quote", F.lit(False))
    begins = (
        F.when(F.col("kind") == "meta", True)
        .when(F.col("kind").isin("heading", "number"), ~F.col("attached"))
        .when(F.col("kind") == "quote", ~F.col("factual") & ~(after_quote & ~F.col("blank")))
        .when(F.col("kind") == "text", F.col("last").isNull() | (F.col("last.kind") == "number") | after_quote & ~F.col("factual"))
        .otherwise(False)
    )
    lines = lines.withColumn("begins", begins).withColumn("place", F.sum(F.col("begins").cast("int")).over(upto) - 1).where("place >= 0")
    said = F.when(F.col("kind") == "number", F.regexp_extract("text", NUMBER_LINE, 2)).when(F.col("kind") == "quote", F.regexp_extract("text", QUOTE_LINE, 1)).when(F.col("kind") == "text", F.trim("text")).when(F.col("kind") == "blank", "")
    first = lambda kind, value: F.min_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, F.col("line")))
    blocks = lines.groupBy("doc", "place").agg(
        F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("line", said.alias("said"))))).alias("said"), first("meta", F.col("facts")).alias("facts"), F.max((F.col("kind") == "meta").cast("int")).alias("has_facts"),
        first("heading", F.regexp_extract("text", HEADING_LINE, 2)).alias("heading"), first("heading", F.length(F.regexp_extract("text", HEADING_LINE, 1))).alias("level"),
        first("number", F.regexp_extract("text", NUMBER_LINE, 1).cast("int")).alias("n"), F.max((F.col("kind") == "quote").cast("int")).alias("quoted"),
    )
    text = F.regexp_replace(F.array_join(F.transform("said", lambda x: x["said"]), "\n"), r"^\n+|\n+$", "")
    shown = F.when(F.col("n").isNotNull(), "numbered_paragraph").when(F.startswith(F.upper("heading"), F.lit("COUNT ")), "count").when(F.col("heading").isNotNull(), "heading").when(F.col("quoted") == 1, "quote").otherwise("paragraph")
    role = F.when(F.col("shown") == "numbered_paragraph", "factual_allegation").when(F.col("shown") == "paragraph", "custom").otherwise(F.col("shown"))
    fact = lambda name: F.col(f"facts.{name}")
    made = blocks.withColumn("shown", shown)
    return made.select(
        "doc", "place", F.coalesce(fact("block_id"), F.concat(F.lit("block:"), stable_id(F.concat_ws("::", F.col("doc").cast("string"), F.col("place").cast("string"))))).alias("block_id"), fact("parent_id").alias("parent_id"),
        F.coalesce(fact("order_index"), F.col("place") + 1).cast("int").alias("ordinal"), F.coalesce(fact("block_type"), "shown").alias("type"), F.coalesce(fact("role"), role).alias("role"),
        F.coalesce("heading", fact("title"), F.when(F.col("shown") == "numbered_paragraph", F.concat(F.lit("Paragraph "), F.col("n").cast("string")))).alias("title"), text.alias("text"),
        F.coalesce(F.col("n"), fact("paragraph_number")).alias("number"), F.coalesce(fact("section_kind"), F.when(F.col("level").isNotNull(), F.concat(F.lit("level_"), F.col("level").cast("string")))).alias("section"),
    )
