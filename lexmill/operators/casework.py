"""Case work: layer differences, block trees and checks, claim coverage, timelines, embedding coverage, index summaries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layer_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change of each item of two layers: added, removed, or modified where the hash of its content differs."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        rest = sorted(c for c in df.columns if c not in keys)
        return df.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(name))

    joined = hashed(before, "was").join(hashed(after, "is"), keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "modified")
    return joined.select(*keys, change.alias("change")).where(F.col("change").isNotNull())


def block_problems(blocks: DataFrame, group: str, id_col: str, parent_col: str, type_col: str, known_types: list[str]) -> DataFrame:
    """group, id and problem: missing or repeated ids, unknown types, parents that aren't there or are the block itself."""
    rows = blocks.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(type_col).alias("type"))
    repeated = rows.groupBy("g", "id").agg(F.count("*").alias("n")).where("n > 1 AND id IS NOT NULL").select("g", "id", F.lit("repeated id").alias("problem"))
    own = F.array_compact(F.array(F.when(F.col("id").isNull(), F.lit("missing id")), F.when(F.col("type").isNull() | ~F.col("type").isin(known_types), F.lit("unknown type")), F.when(F.col("parent") == F.col("id"), F.lit("own parent"))))
    alone = rows.select("g", "id", F.explode(own).alias("problem"))
    there = rows.select(F.col("g").alias("pg"), F.col("id").alias("pid")).distinct()
    lost = rows.where("parent IS NOT NULL").join(there, (F.col("g") == F.col("pg")) & (F.col("parent") == F.col("pid")), "left_anti").select("g", "id", F.lit("lost parent").alias("problem"))
    return repeated.union(alone).union(lost).withColumnRenamed("g", group)


def renumbered(blocks: DataFrame, group: str, order: list[str], numbered: Column) -> DataFrame:
    """blocks with `number`: the place among the group's numbered blocks, null for the others."""
    w = Window.partitionBy(group).orderBy(*order)
    return blocks.withColumn("number", F.when(numbered, F.sum(numbered.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def claim_elements(elements: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """elements with n_facts and satisfied: whether any fact supports them."""
    counted = facts.groupBy(key).agg(F.count("*").alias("n_facts"))
    return elements.join(counted, key, "left").withColumn("n_facts", F.coalesce("n_facts", F.lit(0))).withColumn("satisfied", F.col("n_facts") > 0)


def timeline(candidates: DataFrame, reviewed: DataFrame, key: str, order: list[str], text_cols: list[str]) -> DataFrame:
    """One candidate a key (the first), with the reviewed row's status; its texts too, if it was approved or rejected."""
    rest = [c for c in candidates.columns if c != key]
    first = candidates.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count("*") - 1).alias("dropped")).select(key, "r.*", "dropped")
    old = reviewed.select(F.col(key).alias("__k"), F.col("status").alias("__status"), *[F.col(c).alias(f"__{c}") for c in text_cols])
    kept = F.col("__status").isin("approved", "rejected")
    joined = first.join(old, F.col(key) == F.col("__k"), "left")
    return joined.select(key, *[F.when(kept, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in text_cols else F.col(c) for c in rest], "dropped", F.coalesce("__status", F.lit("suggested")).alias("status"))


def embedding_coverage(records: DataFrame, kind: str, state: str) -> DataFrame:
    """kind, total and the number in each state."""
    return records.groupBy(kind).agg(F.count("*").alias("total"), *[F.count_if(F.col(state) == s).alias(s) for s in ("current", "stale", "pending")])


def index_summary(documents: DataFrame, status: str, digest: str) -> DataFrame:
    """status, n and repeated: documents by status, and those that repeat an earlier one's content."""
    w = Window.partitionBy(digest).orderBy("id")
    return documents.withColumn("__n", F.row_number().over(w)).groupBy(status).agg(F.count("*").alias("n"), F.count_if(F.col("__n") > 1).alias("repeated"))


def patched(base, patch):
    """A JSON value after a merge patch: objects merge key by key, null removes a key, anything else replaces."""
    if not isinstance(patch, dict) or not isinstance(base, dict):
        return patch
    out = {k: v for k, v in base.items() if k not in patch}
    for key, value in patch.items():
        if value is not None:
            out[key] = patched(base.get(key), value)
    return out


def merge_patch(base: Column, patch: Column) -> Column:
    """A JSON merge patch, nested objects too; types stay. Keys are sorted. A null or broken patch leaves the base, a null base is empty."""

    def merged(bases: pd.Series, patches: pd.Series) -> pd.Series:
        def one(b, p):
            try:
                return json.dumps(patched(json.loads(b) if b else {}, json.loads(p)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return b

        return pd.Series([one(b, p) for b, p in zip(bases, patches)])

    return F.pandas_udf(merged, "string")(base, patch)


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of ranges [start, end) of one key that overlap. Ranges meet in blocks of `width` places, so distant ones are never paired.

    left: key, a, a_start, a_end; right: key, b, b_start, b_end. Each pair is found in the block where its overlap begins.
    """
    def blocks(df: DataFrame, n: str) -> DataFrame:
        first, last = (F.floor(F.col(f"{n}_start") / width), F.floor((F.col(f"{n}_end") - 1) / width))
        return df.where(F.col(f"{n}_end") > F.col(f"{n}_start")).withColumn("block", F.explode(F.sequence(first, last)))

    joined = blocks(left, "a").join(blocks(right, "b"), [key, "block"])
    begins = F.greatest("a_start", "b_start")
    return joined.where((begins < F.least("a_end", "b_end")) & (F.floor(begins / width) == F.col("block"))).drop("block")
