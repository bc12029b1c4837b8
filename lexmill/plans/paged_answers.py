"""Customers as pages of a JSON service: a chain of pages for each nation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.plans.registry import Registry
from lexmill.sources import paged

query = Registry()


@query("SELECT c_nationkey AS request, (row_number() OVER w - 1) // 7 AS place, (row_number() OVER w - 1) % 7 AS n, c_custkey AS id, c_name AS name FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)")
def followed_pages(t):
    """The customers of every nation, from pages of seven that name the next one."""
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    rows = t("customer").select(F.col("c_nationkey").alias("nation"), F.expr("c_custkey AS id"), F.expr("c_name AS name"), (F.row_number().over(order) - 1).alias("k"))
    rows = rows.withColumn("page", F.expr("k div 7")).withColumn("last", F.max(F.expr("k div 7")).over(Window.partitionBy("nation")))
    url = lambda page: F.concat(F.lit("https://service.example/customers?nation="), F.col("nation").cast("string"), F.lit("&page="), page.cast("string"))
    pages = rows.groupBy("nation", "page", "last").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "id", "name"))), lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name")))).alias("value"))
    link = F.when(F.col("page") < F.col("last"), F.concat(F.lit(', "@odata.nextLink": "'), url(F.col("page") + 1), F.lit('"'))).otherwise("")
    stored = pages.select(url(F.col("page")).alias("url"), F.concat(F.lit('{"value": '), F.col("value"), link, F.lit("}")).alias("body"))
    first = rows.select("nation").distinct().select(F.col("nation").alias("request"), url(F.lit(0)).alias("url"))
    return paged.paged_rows(stored, first, "id:bigint,name:string")
