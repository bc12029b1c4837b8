"""Resolution of citations: canonical ids of free citation strings, and their targets among identities, versions and provisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical_id(citation: Column) -> Column:
    """The canonical id of a citation string: chapter, section or rule; null for others."""
    c = F.trim(F.regexp_replace(citation, r"\s+", " "))
    upper = F.upper(c)
    chapter = F.regexp_extract(upper, r"^ORS CHAPTERS? ([0-9]+[A-Z]?)", 1)
    section = F.regexp_extract(c, r"(?i)^ORS ([^ (,]*\.[^ (,]*)", 1)
    rule = F.regexp_extract(F.lower(c), r"^utcr ([^(,]+)", 1)
    civil = F.regexp_extract(F.lower(c), r"^orcp (.+)$", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), "[^a-z0-9.]+", "-")
    return F.when(chapter != "", F.concat(F.lit("or:ors:chapter:"), chapter)).when(section != "", F.concat(F.lit("or:ors:"), section)).when(civil != "", F.concat(F.lit("or:orcp:"), clean(civil))).when(rule != "", F.concat(F.lit("or:utcr:"), clean(rule)))


def last_of(table: DataFrame, key: Column, order: str, columns: list[str]) -> DataFrame:
    """The last row of each key: maps of symbols let later rows win."""
    return table.where(key.isNotNull()).groupBy(key.alias("__key")).agg(F.max_by(F.struct(*columns), order).alias("__row")).select("__key", "__row.*")


def resolve(mentions: DataFrame, identities: DataFrame, versions: DataFrame, provisions: DataFrame, year: int) -> DataFrame:
    """mentions (citation, pins: array of labels) with canonical_id, version_id, provision_id, unresolved_pins and status.

    identities: citation, canonical_id, seq; versions: version_id; provisions: canonical_id, path (labels joined by dots), provision_id,
    seq. Lookups ignore case; a version need not exist; a pin that has no provision leaves the section resolved and is reported.
    """
    by_citation = last_of(identities, F.lower("citation"), "seq", ["canonical_id"]).withColumnRenamed("canonical_id", "found_id")
    named = mentions.join(by_citation, F.lower("citation") == F.col("__key"), "left").drop("__key").withColumnRenamed("found_id", "canonical_id")
    named = named.withColumn("__version", F.concat("canonical_id", F.lit(f"@{year}"))).withColumn("__path", F.concat("canonical_id", F.lit("|"), F.array_join("pins", ".")))
    there = versions.select("version_id").distinct()
    versioned = named.join(there, F.col("__version") == F.col("version_id"), "left")
    by_path = last_of(provisions, F.concat("canonical_id", F.lit("|"), "path"), "seq", ["provision_id"])
    full = versioned.join(by_path, F.col("__path") == F.col("__key"), "left")
    pinned = F.size("pins") > 0
    status = F.when(F.col("canonical_id").isNull(), "unresolved_target_not_in_corpus").when(pinned & F.col("provision_id").isNull(), "resolved_section_unresolved_subpath").when(pinned, "resolved_section_and_subpath").otherwise("resolved_section")
    return full.select(*mentions.columns, "canonical_id", "version_id", F.when(pinned, F.col("provision_id")).alias("provision_id"), F.when(pinned & F.col("provision_id").isNull(), F.col("pins")).alias("unresolved_pins"), status.alias("status"))


def range_edges(mentions: DataFrame, identities: DataFrame) -> DataFrame:
    """id and target of ranges (id, start_id, end_id) whose both ends exist: one edge, to the start."""
    known = identities.select("canonical_id").distinct()
    starts = mentions.join(known, F.col("start_id") == F.col("canonical_id"), "left_semi")
    return starts.join(known, F.col("end_id") == F.col("canonical_id"), "left_semi").select("id", F.col("start_id").alias("target"))


def enriched(hits: DataFrame, cites: DataFrame, definitions: DataFrame, most: int = 5) -> DataFrame:
    """hits (id, score) with the first cited targets and definitions of each, for a retrieval context."""
    def first(df: DataFrame, column: str, name: str) -> DataFrame:
        ranked = df.select("id", column).distinct().withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(column))).where(F.col("n") <= most)
        return ranked.groupBy("id").agg(F.array_sort(F.collect_list(column)).alias(name))

    wanted = hits.select("id").distinct()
    cited = first(cites.join(wanted, "id", "left_semi"), "target", "cited")
    defined = first(definitions.join(wanted, "id", "left_semi"), "term", "defined")
    empty = F.array().cast("array<string>")
    return hits.join(cited, "id", "left").join(defined, "id", "left").withColumns({"cited": F.coalesce(F.col("cited").cast("array<string>"), empty), "defined": F.coalesce(F.col("defined").cast("array<string>"), empty)})
