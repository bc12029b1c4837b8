"""Statute chapters: published pages of one chapter each, as paragraphs, contents, sections, notes, amendments and provisions.

The pages are word-processor exports: every paragraph is a <p class="MsoNormal">, and what it is shows only in its form and its
place. All states that a reader keeps - whether the body has begun, the headings that are open, whether a note goes on - are
running window values over a chapter's paragraphs, so the parse is one sort by chapter and place; only the labels of a section's
parts are walked through one by one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import clean_parser_text, is_all_caps_heading, is_reserved_expansion, is_reserved_tail, is_rule_line, normalize_ws, stable_id, strip_trailing_period

#: The forms of sections, headings, history notes and effective dates in the published pages.
SECTION = r"^([0-9]{1,3})\.([0-9]{3,4})(?:\s+(.*)|\.?)$"
CONTENTS_LINE = r"^([0-9]{1,3})\.([0-9]{3,4})\s+(.*)$"
ARTICLE = r"(?i)^ARTICLE\s+[IVXLC0-9]+(?:\s*[.\-]\s*.+)?$"
EDITION = r"(?i)\b20[0-9]{2}\s+EDITION\b"
TITLE_NUMBER = r"(?i)^TITLE\s+([0-9]+)\b"
CHAPTER_ENTRY = r"(?i)^Chapter\s+([0-9]{1,3})\s+(.+)$"
HISTORY = r"\s*(\[[12][0-9]{3}\s+c\.[^\]]+\])\s*$"
SESSION_LAW = r"([12][0-9]{3})\s+c\.([0-9A-Za-z]+)(?:\s+§+\s*([0-9A-Za-z.\-]+))?"
ENACTED = r"(?i)\bwas enacted into law\b.*\b(not added to|preface to oregon revised statutes)\b"
DATED = r"(?i)\b(becomes operative|is operative|becomes effective|takes effect|applies to|is repealed|expires|sunsets|notwithstanding the effective date)\b"
#: Fixed value: a heading that has the form of content.
PLAIN_HEADING = "mandatory boating safety education"
#: What a section is worth, by status, when several have its citation.
STATUS_SCORES = {"active": 1_000_000, "formerly": 500_000, "renumbered": 100_000, "repealed": 100_000}
#: Kinds of parts by their depth.
PART_KINDS = ["subsection", "paragraph", "subparagraph", "clause"]


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def style_value(style: Column, name: str) -> Column:
    value = normalize_ws(F.regexp_extract(style, rf"(?i)(?:^|;)\s*{name}\s*:([^;]*)", 1))
    return F.nullif(value, F.lit(""))


def attribute(attributes: Column, name: str) -> Column:
    form = rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.nullif(F.concat(*[F.regexp_extract(attributes, form, k) for k in (1, 2, 3)]), F.lit(""))


def chapter_paragraphs(chapters: DataFrame, id_col: str = "source_document_id", chapter_col: str = "chapter", html_col: str = "html") -> DataFrame:
    """doc, chapter, order, text, bold, underline, italic, align, margin_left, text_indent and the marks that the parse needs, a row for each paragraph, blank ones too.

    A null page has no paragraphs. `order` counts from 0 within the page.
    """
    one = F.lit(r"""(?is)<p\b(?=[^>]*\bclass\s*=\s*["']?[^"'>]*\bMsoNormal\b)([^>]*)>(.*?)(?=<p\b|</p>|</body>|\z)""")
    found = F.arrays_zip(F.regexp_extract_all(html_col, one, F.lit(1)).alias("attributes"), F.regexp_extract_all(html_col, one, F.lit(2)).alias("inner"))
    rows = chapters.select(F.col(id_col).alias("doc"), F.col(chapter_col).cast("string").alias("chapter"), F.posexplode(found).alias("order", "p")).select("doc", "chapter", "order", "p.*")
    bolds = F.transform(F.regexp_extract_all("inner", F.lit(r"(?is)<b\b[^>]*>(.*?)</b>"), F.lit(1)), lambda b: clean_parser_text(F.regexp_replace(b, "<[^>]*>", " ")))
    style = attribute(F.col("attributes"), "style")
    rows = rows.select(
        "doc", "chapter", "order", clean_parser_text(F.regexp_replace("inner", "<[^>]*>", " ")).alias("text"), F.array_join(F.filter(bolds, lambda b: b != ""), " ").alias("bold"),
        matches(F.col("inner"), r"(?i)<u\b").alias("underline"), matches(F.col("inner"), r"(?i)<i\b").alias("italic"),
        F.coalesce(attribute(F.col("attributes"), "align"), style_value(style, "text-align")).alias("align"), style_value(style, "margin-left").alias("margin_left"), style_value(style, "text-indent").alias("text_indent"),
    )
    text, bold = F.col("text"), F.col("bold")
    number = F.nullif(F.regexp_extract("bold", SECTION, 1), F.lit(""))
    level = F.when(matches(text, ARTICLE), 2).when(is_all_caps_heading(text), 1).otherwise(3)
    heading = matches(text, ARTICLE) | is_all_caps_heading(text) | (F.col("underline") & ~matches(text, "[.:]$"))
    return rows.withColumns({"heading": (text != "") & heading, "level": level, "edition": matches(text, EDITION), "starts": F.coalesce(number == F.col("chapter"), F.lit(False)), "starts_other": F.coalesce(number != F.col("chapter"), F.lit(False)), "has_bold": bold != ""})


def in_order() -> tuple:
    """All paragraphs of a chapter, and those up to the present one."""
    whole = Window.partitionBy("doc")
    return whole, whole.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def open_headings(changes: Column) -> Column:
    """The headings open at each paragraph, outermost first: the last in capitals, the last article after it, the last other one after both. changes: where a heading is one."""
    _, upto = in_order()
    last = [F.last(F.when(changes & (F.col("level") == level), F.struct("order", "text")), ignorenulls=True).over(upto) for level in (1, 2, 3)]
    place = [F.coalesce(h["order"], F.lit(-1)) for h in last]
    return F.array_compact(F.array(last[0]["text"], F.when(place[1] > place[0], last[1]["text"]), F.when(place[2] > F.greatest(place[0], place[1]), last[2]["text"])))


def ends_chapter() -> Column:
    """An enrolled bill, a free range of chapters, or another chapter's number."""
    upper = F.upper("text")
    other = F.startswith(upper, F.lit("CHAPTER ")) & (F.length("text") < 20) & ~F.contains(upper, F.concat(F.lit("CHAPTER "), F.col("chapter")))
    return matches(upper, "^ENROLLED (HOUSE|SENATE) BILL") | is_reserved_tail(F.col("text")) | is_reserved_expansion(F.col("text")) | other


def marked_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs that are not blank with phase (front, body, after), section (its number in the body, from 1), kind (start, heading, note, separator, content; null outside the body) and heading_path.

    The body begins at the first section start; in a page with an edition line only after it and some heading. It ends before the first line that ends
    a chapter or a section of another one. A note goes on until a section, a heading, or a bold line with the section's own citation.
    """
    whole, upto = in_order()
    text = F.col("text")
    rows = paragraphs.where("text <> ''")
    ready = ~F.max("edition").over(whole) | (F.max("edition").over(upto) & F.max("heading").over(upto))
    rows = rows.withColumn("begins", F.col("starts") & ready).withColumn("begin", F.min(F.when(F.col("begins"), F.col("order"))).over(whole))
    rows = rows.withColumn("end", F.min(F.when((F.col("order") > F.col("begin")) & (ends_chapter() | F.col("starts_other")), F.col("order"))).over(whole))
    phase = F.when(F.col("begin").isNull() | (F.col("order") < F.col("begin")), "front").when(F.col("end").isNull() | (F.col("order") < F.col("end")), "body").otherwise("after")
    rows = rows.withColumn("phase", phase).withColumn("start", (F.col("phase") == "body") & F.col("starts"))
    note = matches(F.col("bold"), "(?i)^note:?$") | matches(text, ENACTED)
    heading_like = F.col("underline") | (F.lower("text") == PLAIN_HEADING)
    kind = F.when(F.col("start"), "start").when(F.col("heading"), "heading").when(is_rule_line(text), "separator").when(note, "note").when(heading_like, "heading").otherwise("content")
    rows = rows.withColumn("kind", F.when(F.col("phase") == "body", kind)).withColumn("section", F.sum(F.col("start").cast("int")).over(upto))
    cited = F.when(F.col("start"), F.concat("chapter", F.lit("."), F.regexp_extract("bold", SECTION, 2)))
    rows = rows.withColumn("citation", F.when(F.col("phase") == "body", F.last(cited, ignorenulls=True).over(upto)))
    goes_on = F.col("has_bold") & (F.startswith(text, F.concat("citation", F.lit(". "))) | F.startswith(text, F.concat("citation", F.lit(" "))))
    event = F.when(F.col("kind") == "note", True).when(F.col("kind").isin("start", "heading") | goes_on, False)
    rows = rows.withColumn("noted", F.coalesce(F.last(event, ignorenulls=True).over(upto), F.lit(False)))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "content") & F.col("noted"), "note").otherwise(F.col("kind")))
    changes = F.when(F.col("phase") == "body", (F.col("kind") == "heading") | ((F.col("order") == F.col("begin")) & F.col("heading"))).otherwise((F.col("phase") == "front") & F.col("heading"))
    return rows.withColumn("heading_path", open_headings(changes)).select("doc", "chapter", "order", "text", "bold", "has_bold", "phase", "section", "citation", "kind", "heading_path")


def before_sections(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs before the first bold section, not blank, with the headings open there."""
    whole, _ = in_order()
    rows = paragraphs.where("text <> ''").withColumn("first", F.min(F.when(F.col("starts"), F.col("order"))).over(whole))
    return rows.where("first IS NULL OR order < first").withColumn("heading_path", open_headings(F.col("heading")))


def contents_entries(paragraphs: DataFrame) -> DataFrame:
    """doc, chapter, toc_entry_id, citation, caption, heading_path, toc_order and order of each line of the contents."""
    rows = before_sections(paragraphs).where(~(F.col("heading") & ~F.col("edition")) & (F.regexp_extract("text", CONTENTS_LINE, 1) == F.col("chapter")))
    caption = normalize_ws(F.regexp_extract("text", CONTENTS_LINE, 3))
    rows = rows.select("doc", "chapter", "order", "has_bold", F.concat("chapter", F.lit("."), F.regexp_extract("text", CONTENTS_LINE, 2)).alias("citation"), caption.alias("caption"), "heading_path").where("caption <> '' AND NOT startswith(caption, '[')")
    rows = rows.withColumn("toc_order", (F.row_number().over(Window.partitionBy("doc").orderBy("order")) - 1))
    return rows.withColumn("toc_entry_id", F.concat(F.lit("toc_entry:"), stable_id(F.concat_ws("::", "doc", F.col("toc_order").cast("string"), "citation", "caption"))))


def front_matter(paragraphs: DataFrame) -> DataFrame:
    """doc, chapter, order, kind (title_number, title_name or title_chapter_entry), title_number, title_name, chapter_number, chapter_name and text of what stands before the sections.

    The title's name is the first heading after the first title number that is neither an edition line nor a title number.
    """
    whole, upto = in_order()
    text = F.col("text")
    rows = before_sections(paragraphs).withColumn("number", F.nullif(F.regexp_extract("text", TITLE_NUMBER, 1), F.lit("")))
    rows = rows.withColumn("first_number", F.min(F.when(F.col("number").isNotNull(), F.col("order"))).over(whole))
    name = F.col("heading") & ~F.col("edition") & F.col("number").isNull() & (F.col("order") > F.col("first_number"))
    rows = rows.withColumn("name_at", F.min(F.when(name, F.col("order"))).over(whole))
    entry = matches(text, CHAPTER_ENTRY)
    kind = F.when(F.col("number").isNotNull(), "title_number").when(F.col("order") == F.col("name_at"), "title_name").when(entry, "title_chapter_entry")
    rows = rows.withColumns({"kind": kind, "title_number": F.last("number", ignorenulls=True).over(upto), "title_name": F.last(F.when(F.col("order") == F.col("name_at"), text), ignorenulls=True).over(upto)})
    of_entry = lambda c: F.when(F.col("kind") == "title_chapter_entry", c)
    return rows.where("kind IS NOT NULL").select("doc", "chapter", "order", "kind", "title_number", "title_name", of_entry(F.regexp_extract("text", CHAPTER_ENTRY, 1)).alias("chapter_number"), of_entry(strip_trailing_period(F.regexp_extract("text", CHAPTER_ENTRY, 2))).alias("chapter_name"), "text")


def chapter_titles(paragraphs: DataFrame) -> DataFrame:
    """doc and title: what stands after the chapter's own number, or else on the next line that is no edition line."""
    whole = Window.partitionBy("doc").orderBy("order")
    lines = paragraphs.where("text <> ''")
    number = F.expr(r"regexp_extract(text, concat('(?i)^Chapter\\s+0?', chapter, '\\b\\s*(.*)$'), 1)")
    own = F.expr(r"text RLIKE concat('(?i)^Chapter\\s+0?', chapter, '\\b')")
    rest = F.nullif(F.regexp_replace(normalize_ws(number), r"^[\s—-]+", ""), F.lit(""))
    after = F.first(F.when(~F.col("edition"), F.col("text")), ignorenulls=True).over(whole.rowsBetween(1, Window.unboundedFollowing))
    found = lines.select("doc", "order", own.alias("own"), strip_trailing_period(F.coalesce(rest, after)).alias("title")).where("own")
    return found.groupBy("doc").agg(F.min_by("title", "order").alias("title"))


def reserved_ranges(paragraphs: DataFrame) -> DataFrame:
    """doc, chapter, order, text and reserved_range_id of lines that keep chapters free."""
    rows = paragraphs.where(is_reserved_tail(F.col("text")) | is_reserved_expansion(F.col("text")))
    return rows.select("doc", "chapter", "order", "text", F.concat(F.lit("reserved_range:"), stable_id(F.concat_ws("::", "doc", F.col("order").cast("string"), "text"))).alias("reserved_range_id"))


def said_status(text: Column) -> Column:
    return F.when(matches(text, r"(?i)\brenumbered\b"), "renumbered").when(matches(text, r"(?i)\brepealed\b"), "repealed").when(matches(text, r"(?i)\bformerly\b"), "formerly")


def one_line(text: Column) -> Column:
    """Clean text without its line ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def statute_status(text: Column, status_text: Column) -> Column:
    """active, repealed, renumbered, formerly or status_only, by a section's text and the line that takes the place of its caption (null: none)."""
    said = said_status(status_text)
    note = matches(status_text, r"(?i)\bsee note(?:\s+following|\s+under)?\b")
    line = one_line(status_text)
    mark = F.when(F.instr(line, "[") > 0, F.regexp_extract(line, r"^[^\[]*(\[.*)$", 1)).otherwise(line)
    whole = one_line(text)
    rest = F.trim(F.when(F.startswith(whole, mark), F.substring(whole, F.length(mark) + 1, F.length(whole) + 1)).otherwise(whole))
    bare = F.regexp_replace(rest, r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")
    letters = F.regexp_replace(bare, r"[^\p{L}]", "")
    heading_like = (F.octet_length(rest) <= 120) & ~F.contains(rest, F.lit(". ")) & (F.length(letters) >= 3) & ~matches(letters, r"\p{Ll}")
    only_status = (rest == "") | matches(rest, r"^\([^)\[\]]*[^)\[\]\s][^)\[\]]*\)$") | heading_like | F.startswith(rest, F.lit("(")) | F.startswith(rest, F.lit("Sec. "))
    shown = F.coalesce(status_text, text)
    trimmed = F.trim(text)
    inner = F.trim(F.regexp_replace(F.regexp_replace(trimmed, r"^\[+", ""), r"\]+$", ""))
    bracketed = matches(trimmed, r"(?s)^\[.*\]$")
    renumbered = matches(shown, r"(?i)\brenumbered\b")
    return (
        F.when(note, F.coalesce(said, F.lit("status_only")))
        .when(said.isNotNull() & only_status, said)
        .when(matches(inner, "(?i)^(REPEALED|RENUMBERED)"), F.when(renumbered, "renumbered").otherwise("repealed"))
        .when(matches(inner, "(?i)^FORMERLY"), "formerly")
        .when(bracketed | (F.octet_length(inner) < 80), F.coalesce(said_status(shown), F.lit("status_only")))
        .otherwise("active")
    )


def sections(marked: DataFrame, contents: DataFrame) -> DataFrame:
    """A row for each section start of the body: doc, chapter, section, citation, canonical part, title, heading, text, history, status_text, status, score, primary, first_order and last_order.

    Several sections may have one citation; the primary one has the highest score, by status and length, the earlier of equal ones. A trailing
    bracketed history leaves the text. The title is the bold caption, else that of the contents, else a bracketed heading or the inline caption.
    """
    body = marked.where("phase = 'body'")
    caption = F.nullif(strip_trailing_period(F.regexp_extract("bold", SECTION, 3)), F.lit(""))
    after_bold = F.trim(F.when(F.startswith("text", F.col("bold")), F.expr("substring(text, length(bold) + 1)")).otherwise(""))
    captions = contents.where("NOT has_bold").groupBy("doc", "citation").agg(F.max_by("caption", "order").alias("listed"))
    body = body.withColumn("caption", F.when(F.col("kind") == "start", caption)).join(captions, ["doc", "citation"], "left")
    named = F.coalesce("caption", "listed")
    own = F.when(after_bold != "", after_bold).when(named.isNull(), F.col("text"))
    body = body.withColumn("content", F.when(F.col("kind") == "start", own).when(F.col("kind") == "content", F.col("text")))
    status_text = F.when((F.col("kind") == "start") & F.contains("text", F.lit("[")) & F.contains("text", F.lit("]")) & named.isNull(), F.col("text"))
    head = lambda c: F.max(F.when(F.col("kind") == "start", c))
    drafts = body.groupBy("doc", "chapter", "section", "citation").agg(
        head(named).alias("named"), head(F.try_element_at("heading_path", F.lit(-1))).alias("heading"), F.max(status_text).alias("status_text"),
        F.array_sort(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("order", "content")))).alias("parts"), F.min("order").alias("first_order"), F.max("order").alias("last_order"),
    )
    texts = F.transform("parts", lambda p: p["content"])
    drafts = drafts.withColumn("full", F.array_join(texts, "\n\n"))
    drafts = drafts.withColumn("score_status", statute_status(F.col("full"), F.col("status_text")))
    worth = F.create_map(*[F.lit(x) for pair in STATUS_SCORES.items() for x in pair])
    drafts = drafts.withColumn("score", F.coalesce(worth[F.col("score_status")], F.lit(0)) + F.octet_length(F.lower(one_line(F.col("full")))))
    best = F.row_number().over(Window.partitionBy("doc", "citation").orderBy(F.desc("score"), "section"))
    drafts = drafts.withColumn("primary", best == 1)
    history = F.nullif(F.regexp_extract(one_line(F.col("full")), HISTORY, 1), F.lit(""))
    text = one_line(F.regexp_replace(one_line(F.col("full")), HISTORY, ""))
    in_brackets = F.filter(F.transform(texts, lambda t: one_line(F.regexp_extract(one_line(t), r"^\(([^)]+)\)$", 1))), lambda t: t != "")
    prefix = F.concat("citation", F.lit("."))
    inline = F.filter(F.transform(texts, lambda t: F.when(F.startswith(one_line(t), prefix), strip_trailing_period(F.substring_index(F.trim(F.replace(one_line(t), prefix, F.lit(""))), ". ", 1)))), lambda t: t.isNotNull() & (t != ""))
    title = F.coalesce("named", F.when(F.size(in_brackets) == 1, F.get(in_brackets, F.lit(0))), F.get(inline, F.lit(0)))
    made = drafts.withColumns({"title": title, "text": text, "history": history, "status": statute_status(text, F.col("status_text"))})
    return made.select("doc", "chapter", "section", "citation", "title", "heading", "text", "history", "status_text", "status", "score", "primary", "first_order", "last_order")


def note_kind(text: Column) -> Column:
    low = F.lower(one_line(text))
    apart = F.contains(low, F.lit("not added to or made a part of"))
    return (
        F.when(apart & F.contains(low, F.lit("series")), "not_added_to_series_note")
        .when(apart, "not_added_to_chapter_note")
        .when(F.contains(low, F.lit("added to and made a part of")), "added_to_chapter_note")
        .when(matches(text, DATED), "operative_note")
        .when(said_status(text).isNotNull(), "status_note")
        .when(matches(text, HISTORY) | matches(text, SESSION_LAW) | F.contains(low, F.lit("oregon laws")) | F.startswith(low, F.lit("note: section ")), "session_law_note")
        .otherwise("unknown_note")
    )


def source_notes(marked: DataFrame, drafts: DataFrame) -> DataFrame:
    """doc, citation, note_type, text, first_order and last_order of the notes of primary sections, of their histories, and of the sections that another one of their citation stands for.

    A note begins at a paragraph with `Note:` or is a section's first.
    """
    upto = Window.partitionBy("doc", "section").orderBy("order")
    chosen = drafts.where("primary").select("doc", "section")
    rows = marked.where("kind = 'note'").join(chosen, ["doc", "section"], "left_semi")
    rows = rows.withColumn("note", F.sum(F.startswith(F.lower("text"), F.lit("note:")).cast("int")).over(upto))
    first = F.min("note").over(Window.partitionBy("doc", "section"))
    rows = rows.withColumn("note", F.greatest("note", first))
    notes = rows.groupBy("doc", "citation", "section", "note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda p: p["text"]), "\n\n").alias("text"), F.min("order").alias("first_order"), F.max("order").alias("last_order"))
    notes = notes.select("doc", "citation", note_kind(F.col("text")).alias("note_type"), "text", "first_order", "last_order")
    histories = drafts.where("primary AND history IS NOT NULL").select("doc", "citation", F.lit("session_law_note").alias("note_type"), one_line(F.col("history")).alias("text"), F.col("last_order").alias("first_order"), "last_order")
    full = one_line(F.concat_ws(" ", "text", "history"))
    primary = drafts.where("primary").select("doc", "citation", F.lower(full).alias("kept"))
    others = drafts.where("NOT primary").withColumn("full", full).join(primary, ["doc", "citation"])
    same = F.when(F.lower(F.col("full")) == F.col("kept"), "duplicate_section_text").otherwise("duplicate_section_variant")
    said = F.when(F.col("full") == "", F.concat(F.lit("Duplicate source section header for ORS "), F.col("citation"))).otherwise(F.col("full"))
    return notes.unionByName(histories).unionByName(others.select("doc", "citation", same.alias("note_type"), said.alias("text"), "first_order", "last_order"))


def amendments(drafts: DataFrame) -> DataFrame:
    """doc, citation, session_law_citation and session_law_id of each session law in a primary section's history."""
    laws = F.regexp_extract_all("history", F.lit(SESSION_LAW), F.lit(0))
    rows = drafts.where("primary AND history IS NOT NULL").select("doc", "citation", F.explode(laws).alias("law"))
    year, chapter, part = (F.regexp_extract("law", SESSION_LAW, n) for n in (1, 2, 3))
    return rows.select(
        "doc", "citation",
        F.concat(year, F.lit(" c."), chapter, F.when(part != "", F.concat(F.lit(" sec. "), part)).otherwise("")).alias("session_law_citation"),
        F.concat(F.lit("or:laws:"), year, F.lit(":c:"), chapter, F.when(part != "", F.concat(F.lit(":s:"), part)).otherwise("")).alias("session_law_id"),
    )


WHOLE_PART = ["doc", "citation", "section", "part", "text", "local_path", "heading_path", "first_order", "last_order"]


def label_depth(label: str) -> int:
    if label.isdigit():
        return 1
    if len(label) == 1 and label.isupper():
        return 3
    numerals = {"i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"}
    if label.lstrip("x") in numerals and len(label) - len(label.lstrip("x")) <= 3:
        return 4
    return 2 if len(label) == 1 and label.islower() else 4


def paths(chains: pd.Series) -> pd.Series:
    """Of each section's lists of labels, one list a part, the open labels after each."""

    def walk(section) -> list[list[str]]:
        found, path = [], []
        for chain in section:
            for label in chain:
                del path[label_depth(label) - 1 :]
                path.append(label)
            found.append(list(path))
        return found

    return chains.map(walk)


def section_provisions(marked: DataFrame, drafts: DataFrame, edition_year: int) -> DataFrame:
    """doc, citation, provision_id, display_citation, provision_type, local_path, depth, text, heading_path, order_index, first_order and last_order of the parts of primary sections.

    A paragraph that begins with labels, as in `(1)(a)`, opens a part; others go on with it; what stands before any label is the root.
    A label goes below the open ones of lower depth. A path that comes again gets _v2, _v3 and so on at its end. Parts without text are left out;
    a section of such parts only is one root part with its whole text. A part has the headings open at its first paragraph.
    """
    chain = r"^((?:\([0-9A-Za-z]+\))+)\s*(.*)$"
    rows = marked.where("kind IN ('content', 'start')").join(drafts.where("primary").select("doc", "section", F.col("title").alias("named")), ["doc", "section"])
    after_bold = F.trim(F.when(F.startswith("text", F.col("bold")), F.expr("substring(text, length(bold) + 1)")).otherwise(""))
    own = F.when(F.col("kind") == "content", F.col("text")).when(after_bold != "", after_bold).when(F.col("named").isNull(), F.col("text"))
    rows = rows.withColumn("content", own).where("content <> ''")
    labels = F.regexp_extract_all(F.regexp_extract("content", chain, 1), F.lit(r"\(([0-9A-Za-z]+)\)"), F.lit(1))
    rows = rows.withColumn("labels", labels).withColumn("part", F.sum((F.size("labels") > 0).cast("int")).over(Window.partitionBy("doc", "section").orderBy("order")))
    said = F.when(F.size("labels") > 0, F.regexp_extract("content", chain, 2)).otherwise(F.col("content"))
    parts = rows.groupBy("doc", "citation", "section", "part").agg(
        F.array_sort(F.collect_list(F.struct("order", said.alias("said")))).alias("said"), F.max("labels").alias("labels"), F.min_by("heading_path", "order").alias("heading_path"), F.min("order").alias("first_order"), F.max("order").alias("last_order")
    )
    text = one_line(F.regexp_replace(one_line(F.array_join(F.transform("said", lambda s: s["said"]), " ")), HISTORY, ""))
    parts = parts.withColumn("text", text)
    opened = parts.where("part > 0").groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("part", "labels"))).alias("opened"))
    walked = F.pandas_udf(paths, "array<array<string>>")(F.transform("opened", lambda o: o["labels"]))
    opened = opened.select("doc", "section", F.posexplode(walked).alias("part", "local_path")).withColumn("part", F.col("part") + 1)
    parts = parts.where("text <> ''").join(opened, ["doc", "section", "part"], "left").withColumn("local_path", F.coalesce("local_path", F.array(F.lit("root"))))
    whole = rows.groupBy("doc", "citation", "section").agg(F.array_sort(F.collect_list(F.struct("order", "content"))).alias("said"), F.min_by("heading_path", "order").alias("heading_path"), F.min("order").alias("first_order"), F.max("order").alias("last_order"))
    whole = whole.join(parts.select("doc", "section"), ["doc", "section"], "left_anti")  # sections of labels alone
    parts = parts.select(*WHOLE_PART).unionByName(whole.select(*WHOLE_PART[:3], F.lit(0).cast("long").alias("part"), one_line(F.array_join(F.transform("said", lambda s: s["content"]), " ")).alias("text"), F.array(F.lit("root")).alias("local_path"), "heading_path", "first_order", "last_order"))
    again = F.row_number().over(Window.partitionBy("doc", "section", "local_path").orderBy("part"))
    last = F.concat(F.element_at("local_path", -1), F.when(again > 1, F.concat(F.lit("_v"), again.cast("string"))).otherwise(""))
    parts = parts.withColumn("local_path", F.concat(F.slice("local_path", 1, F.size("local_path") - 1), F.array(last)))
    is_root = F.array_join("local_path", ".") == "root"
    shown = F.when(is_root, "").otherwise(F.concat(F.lit("("), F.array_join("local_path", ")("), F.lit(")")))
    kind = F.when(is_root, "section_text").otherwise(F.element_at(F.array(*map(F.lit, PART_KINDS)), F.least(F.size("local_path"), F.lit(len(PART_KINDS)))))
    order = F.row_number().over(Window.partitionBy("doc", "section").orderBy("part")) - 1
    return parts.select(
        "doc", "citation", F.concat(F.lit("or:ors:"), F.col("citation"), F.lit(f"@{edition_year}::p:"), F.array_join("local_path", ".")).alias("provision_id"), F.concat(F.lit("ORS "), F.col("citation"), shown).alias("display_citation"),
        kind.alias("provision_type"), "local_path", F.size("local_path").alias("depth"), "text", "heading_path", order.alias("order_index"), "first_order", "last_order",
    )


def diagnostics(marked: DataFrame) -> DataFrame:
    """doc and counts: section starts, headings and notes kept out of the text, paragraphs before the body."""
    n = lambda c: F.count(F.when(c, 1))
    return marked.groupBy("doc").agg(n(F.col("kind") == "start").alias("section_starts"), n(F.col("kind") == "heading").alias("headings"), n(F.col("kind") == "note").alias("notes"), n(F.col("phase") == "front").alias("before_body"))
