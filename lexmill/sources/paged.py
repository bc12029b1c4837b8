"""Answers of a JSON service that are stored page by page: next links followed, rows put together in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.graph import stored

#: Where a page names the next one, and where it has its rows.
NEXT = ["$['@odata.nextLink']", "$['odata.nextLink']", "$.d.__next"]
ROWS = ["$.d.results", "$.value", "$.results"]


def follow_pages(pages: DataFrame, requests: DataFrame, url_col: str = "url", body_col: str = "body", most: int = 10_000) -> DataFrame:
    """request, place (from 0), url and body of all pages that a request's first page leads to, in their order.

    requests: request (unique) and url of its first page. Links are followed two, four, eight at a time, so a chain of n pages takes about
    log2(n) joins. A link to a page that isn't there ends a chain; one of more than `most` pages, as a circle is, raises an error. Of
    pages with one url the least body counts. A null body has no rows and no next page.
    """
    body = pages.select(F.col(url_col).alias("url"), F.col(body_col).alias("body")).groupBy("url").agg(F.min("body").alias("body"))
    link = F.nullif(F.coalesce(*[F.get_json_object("body", p) for p in NEXT]), F.lit(""))
    there = body.select("url")
    jump = stored(body.select("url", link.alias("next")).where("next IS NOT NULL").join(there.withColumnRenamed("url", "next"), "next", "left_semi").select("url", "next"))
    chain = stored(requests.select("request", "url").join(there, "url", "left_semi").select("request", F.lit(0).alias("place"), "url"))
    step = 1
    while step < 2 * most:
        further = stored(chain.join(jump, "url").select("request", (F.col("place") + step).alias("place"), F.col("next").alias("url")))
        if further.isEmpty():
            return chain.join(body, "url").select("request", "place", "url", "body")
        chain = chain.union(further)
        if step <= most:
            far = jump.select(F.col("url").alias("next"), F.col("next").alias("far"))
            jump = stored(jump.join(far, "next").select("url", F.col("far").alias("next")))
        step *= 2
    raise RuntimeError(f"more than {most} pages in a chain")


def paged_rows(pages: DataFrame, requests: DataFrame, row_schema: str, url_col: str = "url", body_col: str = "body", most: int = 10_000) -> DataFrame:
    """request, place, n (in the page) and the fields of each row of each request's pages, in order by (place, n)."""
    found = follow_pages(pages, requests, url_col, body_col, most)
    rows = F.from_json(F.coalesce(*[F.get_json_object("body", p) for p in ROWS]), f"array<struct<{row_schema}>>")
    return found.select("request", "place", F.posexplode(rows).alias("n", "row")).select("request", "place", "n", "row.*")
