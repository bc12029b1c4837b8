"""Pages of a service followed by their links."""

import json

import pytest

from lexmill.sources import paged


def page(url, rows, following=None, form="value"):
    body = {"d": {"results": rows, "__next": following}} if form == "d" else {form: rows, "@odata.nextLink": following}
    return url, json.dumps({k: v for k, v in body.items() if v is not None})


def test_chains(spark):
    pages = [page(f"p{i}", [{"id": 10 * i}, {"id": 10 * i + 1}], f"p{i + 1}") for i in range(9)] + [page("p9", [{"id": 90}], "lost")] + [page("d0", [{"id": 1}], "d1", "d"), page("d1", [], None, "d"), ("null", None), page("d0", [{"id": 1}], "d1", "d")]
    requests = [("long", "p0"), ("inner", "p7"), ("odd", "d0"), ("none", "missing"), ("null", "null")]
    got = paged.paged_rows(spark.createDataFrame(pages, "url string, body string"), spark.createDataFrame(requests, "request string, url string"), "id:int").orderBy("request", "place", "n").collect()
    by = {}
    for r in got:
        by.setdefault(r["request"], []).append((r["place"], r["id"]))
    assert by == {"long": [(i, 10 * i + k) for i in range(9) for k in (0, 1)] + [(9, 90)], "inner": [(0, 70), (0, 71), (1, 80), (1, 81), (2, 90)], "odd": [(0, 1)]}


def test_a_circle_is_an_error(spark):
    pages = spark.createDataFrame([page("a", [], "b"), page("b", [], "a")], "url string, body string")
    with pytest.raises(RuntimeError, match="more than 8 pages"):
        paged.follow_pages(pages, spark.createDataFrame([("r", "a")], "request string, url string"), most=8)
