"""Markdown pages as blocks: what begins, goes on with and ends a block."""

import pytest

from lexmill.operators import markdown

PAGES = {
    1: ("", []),
    2: (None, []),
    3: ("one\n\ntwo\n# H\ntext of H\n\nmore\n> q1\n> q2\nafter\n> q3\n\n> q4", [("paragraph", None, "one\n\ntwo"), ("heading", "H", "text of H\n\nmore"), ("quote", None, "q1\nq2"), ("paragraph", None, "after"), ("quote", None, "q3"), ("quote", None, "q4")]),
    4: ("1. first\nloose\n2. second\n\nCount me\n## count one\n3. third", [("numbered_paragraph", "Paragraph 1", "first"), ("paragraph", None, "loose"), ("numbered_paragraph", "Paragraph 2", "second"), ("paragraph", None, "Count me"), ("count", "count one", ""), ("numbered_paragraph", "Paragraph 3", "third")]),
    5: ('<!-- wp-ast-block {"block_id":"x","block_type":"quote","role":"r","order_index":7} -->\n> a\n> b\n\nnot quoted\n<!-- wp-ast-block {broken -->\n### T\nbody\n> in body\n<!-- page-break -->\n---', [("quote", None, "a\nb"), ("paragraph", None, "not quoted"), ("heading", "T", "body\nin body")]),
    6: ("---\na: b\n---\n# Title\r\n\r\n# Title\r\nx", [("heading", "Title", "x")]),
}


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame([(i, text, "Title") for i, (text, _) in PAGES.items()], "doc int, markdown string, name string")
    return [r for r in markdown.parse(pages, title_col="name").orderBy("doc", "place").collect()]


@pytest.mark.parametrize("page", PAGES)
def test_blocks(parsed, page):
    assert [(r["type"], r["title"], r["text"]) for r in parsed if r["doc"] == page] == PAGES[page][1]


def test_facts(parsed):
    first = next(r for r in parsed if r["doc"] == 5)
    assert (first["block_id"], first["role"], first["ordinal"]) == ("x", "r", 7)
    ids = [r["block_id"] for r in parsed]
    assert len(set(ids)) == len(ids) and [r["section"] for r in parsed if r["doc"] == 5] == [None, None, "level_3"]


def test_no_pages(spark):
    assert markdown.parse(spark.createDataFrame([], "doc int, markdown string")).count() == 0
