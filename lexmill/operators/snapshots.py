"""Snapshots compared: which blocks of a document were added, removed, edited or moved.

A block is the same in both snapshots by its id, or else, where ids were made anew, by its text. Of the blocks in both, the longest
sequence that kept its order stayed; the others moved. So one block that jumps over many is one move.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def longest_rise(places: list[int]) -> list[bool]:
    """Which elements are in a longest increasing subsequence; of several, one whose last elements are least."""
    tails, ends, before = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        tails[k : k + 1], ends[k : k + 1] = [p], [i]
        before.append(ends[k - 1] if k else -1)
    stays = [False] * len(places)
    i = ends[-1] if ends else -1
    while i >= 0:
        stays[i] = True
        i = before[i]
    return stays


def stayed(places: pd.Series) -> pd.Series:
    return places.map(lambda p: longest_rise(list(p)))


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """All blocks of both snapshots, each pair in one row: doc, block_id (the later one), was and now (places), and whether the text changed."""
    hashed = lambda df, place: df.select("doc", "block_id", F.col("place").alias(place), F.sha2(F.coalesce("text", F.lit("")), 256).alias(f"{place}_text"))
    a, b = hashed(before, "was"), hashed(after, "now")
    by_id = a.join(b, ["doc", "block_id"], "full_outer")
    same = by_id.where("was IS NOT NULL AND now IS NOT NULL").select("doc", "block_id", "was", "now", (F.col("was_text") != F.col("now_text")).alias("edited"))
    # ids that only one side has: equal texts, the first with the first
    nth = lambda place: F.row_number().over(Window.partitionBy("doc", "text").orderBy(place))
    gone = by_id.where("now IS NULL").select("doc", F.col("block_id").alias("old_id"), "was", F.col("was_text").alias("text")).withColumn("nth", nth("was"))
    come = by_id.where("was IS NULL").select("doc", F.col("block_id").alias("new_id"), "now", F.col("now_text").alias("text")).withColumn("nth", nth("now"))
    others = gone.join(come, ["doc", "text", "nth"], "full_outer").select("doc", F.coalesce("new_id", "old_id").alias("block_id"), "was", "now", F.lit(False).alias("edited"))
    return same.unionByName(others)


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, block_id, was, now, change (added, removed, edited, moved, moved and edited, unchanged) of each block of two snapshots (doc, block_id, place, text).

    ids are unique in a document of a snapshot. Null texts are empty. A document that only one snapshot has is added or removed block by
    block. Of equal ways to keep the order the one that keeps the later blocks is taken.
    """
    pairs = paired(before, after)
    both = pairs.where("was IS NOT NULL AND now IS NOT NULL")
    lists = both.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("was", "now", "block_id"))).alias("b"))
    flags = F.pandas_udf(stayed, "array<boolean>")(F.transform("b", lambda x: x["now"]))
    order = lists.select("doc", F.explode(F.arrays_zip(F.transform("b", lambda x: x["block_id"]).alias("block_id"), flags.alias("stays"))).alias("x")).select("doc", "x.*")
    rows = pairs.join(order, ["doc", "block_id"], "left")
    moved = ~F.col("stays")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(moved & F.col("edited"), "moved and edited").when(moved, "moved").when(F.col("edited"), "edited").otherwise("unchanged")
    return rows.select("doc", "block_id", "was", "now", change.alias("change"))


def change_summary(changes: DataFrame) -> DataFrame:
    """doc and the number of blocks of each change but unchanged."""
    n = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    return changes.groupBy("doc").agg(n("added").alias("added"), n("removed").alias("removed"), n("edited", "moved and edited").alias("edited"), n("moved", "moved and edited").alias("moved"))
