"""Statute chapters: a made-up page, read by hand, and odd pages."""

import pytest

from lexmill.functions.text import clean_parser_text, is_reserved_tail
from lexmill.sources import chapters

P = '<p class="MsoNormal">{}</p>'
PAGE = "".join(
    P.format(x)
    for x in [
        "TITLE 1", "COURTS OF RECORD", "Chapter 1. Courts Generally", "Chapter 2 Supreme Court", "2023 EDITION", "SUPREME COURT", "2.010 Judges of court", "2.020 Terms and sessions", "2.030 [Repealed]", "JUDGES",
        "<b>2.010 Supreme Court.</b> The court exercises judicial power and cites ORS 2.020 in a sentence that is long enough.", "(1) The court may sit in departments.", "(a) One.", "more of one", "&nbsp;", "(2)(a) Two.", "(2)(a) Two again. [1959 c.44 &sect;1; 2001 c.7]",
        "<b>Note:</b> 2.010 was enacted into law by the Legislative Assembly but was not added to or made a part of ORS chapter 2 or any series therein.", "The note goes on.", "Note: becomes operative later.", "2.010 <b>goes</b> on here",
        "<u>Terms</u>", "<b>2.020</b>", "A term may be held at Salem, and it may be held in other places as the court orders from time to time.",
        "<b>2.030</b> [Repealed by 1981 c.1]", "<b>2.020 Terms of court.</b> Short.", "ARTICLE IV", "<b>2.040</b> (Removal)", "CHAPTER 3", "<b>2.050 Late.</b> not read",
    ]
)


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("d", "2", f"<html><body>{PAGE}</body></html>"), ("none", "9", None), ("empty", "9", ""), ("bare", "7", '<p>7.010 not of the class</p><P CLASS=MsoNormal ALIGN=center style="margin-left: 2in; text-indent:1em">(Title)</P>')]
    rows.append(("golden", "2", "".join(P.format(x) for x in ["<b>2.010 Supreme Court.</b>", "The Supreme Court exercises judicial power and cites ORS 2.020 for this fixture.", "(1) The court may sit in departments for assigned matters.", "<b>2.020 Terms of court.</b>", "A term of the Supreme Court may be held at Salem."])))
    pages = spark.createDataFrame(rows, "source_document_id string, chapter string, html string").withColumnsRenamed({})
    paragraphs = chapters.chapter_paragraphs(pages).cache()
    marked = chapters.marked_paragraphs(paragraphs).cache()
    contents = chapters.contents_entries(paragraphs)
    return paragraphs, marked, contents, chapters.sections(marked, contents).cache()


def test_kinds_and_headings(parsed):
    rows = parsed[1].where("doc = 'd' AND phase = 'body'").orderBy("order").collect()
    assert [r["kind"][0] for r in rows] == list("scccccnnnchscsshs")
    paths = {r["order"]: r["heading_path"] for r in rows}
    assert paths[10] == ["JUDGES"] and paths[24] == ["JUDGES", "Terms"] and paths[27] == ["JUDGES", "ARTICLE IV"]
    assert [r["text"] for r in parsed[1].where("phase = 'after'").orderBy("order").collect()] == ["CHAPTER 3", "2.050 Late. not read"]


def test_contents_and_front(parsed):
    paragraphs, _, contents, _ = parsed
    assert [(r["citation"], r["caption"], r["heading_path"], r["toc_order"]) for r in contents.orderBy("order").collect()] == [("2.010", "Judges of court", ["SUPREME COURT"], 0), ("2.020", "Terms and sessions", ["SUPREME COURT"], 1)]
    front = chapters.front_matter(paragraphs).orderBy("order").collect()
    assert [(r["kind"], r["title_number"], r["title_name"], r["chapter_number"], r["chapter_name"]) for r in front] == [("title_number", "1", None, None, None), ("title_name", "1", "COURTS OF RECORD", None, None), ("title_chapter_entry", "1", "COURTS OF RECORD", "2", "Supreme Court")]
    assert [tuple(r) for r in chapters.chapter_titles(paragraphs).collect()] == [("d", "Supreme Court")]
    assert {r["text"] for r in chapters.reserved_ranges(paragraphs).collect()} == {"TITLE 1", "CHAPTER 3"}


def test_sections(parsed):
    rows = {r["section"]: r for r in parsed[3].where("doc = 'd'").collect()}
    assert [(r["citation"], r["title"], r["heading"], r["status"], r["primary"]) for _, r in sorted(rows.items())] == [
        ("2.010", "Supreme Court", "JUDGES", "active", True),
        ("2.020", "Terms and sessions", "Terms", "active", True),
        ("2.030", None, "Terms", "repealed", True),
        ("2.020", "Terms of court", "Terms", "status_only", False),
        ("2.040", "Removal", "ARTICLE IV", "status_only", True),
    ]
    assert rows[1]["text"].startswith("The court exercises") and rows[1]["text"].endswith("2.010 goes on here") and rows[1]["history"] is None
    assert "[1959" in rows[1]["text"], "only a history at the end of the text is taken off"
    golden = {r["citation"]: r for r in parsed[3].where("doc = 'golden'").collect()}
    assert golden["2.010"]["text"] == "The Supreme Court exercises judicial power and cites ORS 2.020 for this fixture. (1) The court may sit in departments for assigned matters." and golden["2.020"]["status"] == "status_only"
    assert parsed[3].where("doc IN ('none', 'empty', 'bare')").count() == 0


def test_notes_and_provisions(parsed):
    _, marked, _, drafts = parsed
    notes = {(r["citation"], r["note_type"]): (r["text"][:9], r["first_order"], r["last_order"]) for r in chapters.source_notes(marked, drafts).where("doc = 'd'").collect()}
    assert notes == {("2.010", "not_added_to_series_note"): ("Note: 2.0", 17, 18), ("2.010", "operative_note"): ("Note: bec", 19, 19), ("2.020", "duplicate_section_variant"): ("Short.", 25, 26)}
    parts = chapters.section_provisions(marked, drafts, 2023).where("doc = 'd'").orderBy("first_order").collect()
    assert [(r["display_citation"], r["provision_type"], r["local_path"], r["text"][:10]) for r in parts] == [
        ("ORS 2.010", "section_text", ["root"], "The court "),
        ("ORS 2.010(1)", "subsection", ["1"], "The court "),
        ("ORS 2.010(1)(a)", "paragraph", ["1", "a"], "One. more "),
        ("ORS 2.010(2)(a)", "paragraph", ["2", "a"], "Two."),
        ("ORS 2.010(2)(a_v2)", "paragraph", ["2", "a_v2"], "Two again."),
        ("ORS 2.020", "section_text", ["root"], "A term may"),
        ("ORS 2.030", "section_text", ["root"], "[Repealed "),
        ("ORS 2.040", "section_text", ["root"], "(Removal)"),
    ]
    assert parts[4]["provision_id"] == "or:ors:2.010@2023::p:2.a_v2" and parts[5]["heading_path"] == ["JUDGES", "Terms"]


def test_amendments_and_counts(spark, parsed):
    html = "".join(P.format(x) for x in ["<b>5.010 A.</b> Text of a section that says something. [1959 c.44 &sect;1; 2001 c.7]"])
    paragraphs = chapters.chapter_paragraphs(spark.createDataFrame([(1, "5", html)], "source_document_id int, chapter string, html string"))
    drafts = chapters.sections(chapters.marked_paragraphs(paragraphs), chapters.contents_entries(paragraphs))
    assert {(r["session_law_citation"], r["session_law_id"]) for r in chapters.amendments(drafts).collect()} == {("1959 c.44 sec. 1", "or:laws:1959:c:44:s:1"), ("2001 c.7", "or:laws:2001:c:7")}
    counts = {r["doc"]: r for r in chapters.diagnostics(parsed[1]).collect()}
    assert (counts["d"]["section_starts"], counts["d"]["headings"], counts["d"]["notes"], counts["d"]["before_body"]) == (5, 2, 3, 10)


def test_forms(parsed):
    bare = parsed[0].where("doc = 'bare'").collect()
    assert [(r["text"], r["align"], r["margin_left"], r["text_indent"]) for r in bare] == [("(Title)", "center", "2in", "1em")]


@pytest.mark.parametrize(("text", "clean", "tail"), [("CHAPTERS 831 TO 834", "CHAPTERS 831 TO 834", True), ("TITLES 63 et seq.", "TITLES 63 et seq.", True), ("CHAPTER 531 [Reserved for expansion]_", "", True), ("the end CHAPTERS 1 AND 2 [Reserved for expansion]", "the end", False), ("_____ x", "x", False), ("Chapter one", "Chapter one", False)])
def test_reserved(spark, text, clean, tail):
    from pyspark.sql import functions as F

    row = spark.range(1).select(clean_parser_text(F.lit(text)).alias("clean"), is_reserved_tail(F.lit(text)).alias("tail")).first()
    assert (row["clean"], row["tail"]) == (clean, tail)


@pytest.mark.parametrize(("text", "line", "status"), [("Words of a section that is in force and says at some length what has to be done.", None, "active"), ("[Repealed by 1981 c.1]", "2.030 [Repealed by 1981 c.1]", "repealed"), ("[Formerly 3.010]", None, "formerly"), ("Renumbered 4.020 in 1999", None, "renumbered"), ("x", None, "status_only"), ("[Renumbered 1.1] " + "Long text follows. " * 9, "[Renumbered 1.1]", "renumbered"), ("whatever", "See note under 2.010", "status_only")])
def test_status(spark, text, line, status):
    from pyspark.sql import functions as F

    row = spark.range(1).select(chapters.statute_status(F.lit(text), F.lit(line).cast("string")).alias("s")).first()
    assert row["s"] == status
