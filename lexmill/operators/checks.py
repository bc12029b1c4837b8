"""Quality control: duplicates, orphans, coverage, statuses, exact percentiles, expected counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def count_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: the rows that repeat an earlier key."""
    return duplicate_keys(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(F.col(parent_key).alias("__key")), F.col(child_key) == F.col("__key"), "left_anti")


def resolution(mentions: DataFrame, key: str, targets: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """mentions and status: the name of the first table that has the key, else unresolved."""
    joined, hits = mentions, []
    for name, table, column in targets:
        found = table.select(F.col(column).alias(f"__{name}")).distinct()
        joined = joined.join(found, F.col(key) == F.col(f"__{name}"), "left")
        hits.append(F.when(F.col(f"__{name}").isNotNull(), F.lit(name)))
    return joined.select(*mentions.columns, F.coalesce(*hits, F.lit("unresolved")).alias("status"))


def coverage(df: DataFrame, group: str, covered: Column) -> DataFrame:
    """group, total, covered and percent."""
    counted = df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    return counted.withColumn("percent", F.col("covered") * 100.0 / F.col("total"))


def exact_percentile(df: DataFrame, value: str, percent: float, group: str) -> DataFrame:
    """The sorted value at index ceil(percent / 100 * (n - 1)) of each group: not an interpolation.

    Values are counted first and cumulated over distinct values only, so a frequent value is one row.
    """
    counted = df.groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group)
    cumulated = counted.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    index = F.ceil(F.lit(percent) / 100.0 * (F.col("total") - 1))
    return cumulated.where((F.col("upto") > index) & (F.col("upto") - F.col("n") <= index)).select(group, F.col(value).alias("percentile"), "total")


def compare_counts(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose counts (column n) differ, with both."""
    joined = expected.select(key, F.col("n").alias("expected")).join(actual.select(key, F.col("n").alias("actual")), key, "full_outer")
    e, a = (F.coalesce(c, F.lit(0)) for c in ("expected", "actual"))
    return joined.select(key, e.alias("expected"), a.alias("actual")).where(e != a)


def counts_by_label(tables: dict[str, DataFrame]) -> DataFrame:
    """label and n of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("label"), "n") for name, df in tables.items()])


def verdict(df: DataFrame, failed: Column, warned: Column) -> DataFrame:
    """One row: rows, failures, warnings and a status: fail, warning or pass."""
    counted = df.agg(F.count("*").alias("rows"), F.count_if(failed).alias("failures"), F.count_if(warned).alias("warnings"))
    return counted.withColumn("status", F.when((F.col("rows") == 0) | (F.col("failures") > 0), "fail").when(F.col("warnings") > 0, "warning").otherwise("pass"))
