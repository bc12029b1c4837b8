"""Typed node loads: keyed upserts of row batches, and the edges that their keys make."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """An edge of a type from a node to the row of `target` whose `target_key` equals the node's `key`. A required one drops nodes without it."""

    edge_type: str
    key: str
    target: str
    target_key: str
    required: bool = False


@dataclass(frozen=True)
class NodeLoad:
    """How rows become nodes: the id (rows without one are left out; of several the first by `order` wins), labels by condition, links."""

    label: str
    id_col: str
    order: tuple[str, ...]
    links: tuple[Link, ...] = ()
    labels: tuple[tuple[str, str], ...] = field(default=())


def load_nodes(rows: DataFrame, load: NodeLoad, tables: dict[str, DataFrame]) -> DataFrame:
    """One row a node: all its columns and `labels`."""
    rest = [c for c in rows.columns if c != load.id_col]
    first = rows.where(F.col(load.id_col).isNotNull()).groupBy(load.id_col).agg(F.min_by(F.struct(*rest), F.struct(*load.order)).alias("r")).select(load.id_col, "r.*")
    for link in load.links:
        if link.required:
            known = tables[link.target].select(F.col(link.target_key).alias("__k")).distinct()
            first = first.join(known, F.col(link.key) == F.col("__k"), "left_semi")
    extra = [F.when(F.expr(condition), F.lit(label)) for label, condition in load.labels]
    return first.withColumn("labels", F.array_compact(F.array(F.lit(load.label), *extra)))


def node_edges(nodes: DataFrame, load: NodeLoad, tables: dict[str, DataFrame]) -> DataFrame:
    """src, dst and type of each link whose target exists."""
    found = []
    for link in load.links:
        known = tables[link.target].select(F.col(link.target_key).alias("__k")).distinct()
        found.append(nodes.join(known, F.col(link.key) == F.col("__k"), "left_semi").select(F.col(load.id_col).cast("string").alias("src"), F.col(link.key).cast("string").alias("dst"), F.lit(link.edge_type).alias("type")))
    return reduce(DataFrame.union, found).distinct()


def target_edge(mentions: DataFrame, targets: list[tuple[str, str]]) -> DataFrame:
    """Edges of mentions to the first of their targets that is there. targets: (column, edge type) by precedence."""
    chosen = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).cast("string").alias("dst"), F.lit(kind).alias("type"))) for c, kind in targets])
    return mentions.withColumn("__e", chosen).where(F.col("__e").isNotNull()).select(*mentions.columns, "__e.*")


def hierarchy_edges(provisions: DataFrame, id_col: str, version_col: str, path_col: str, order_col: str) -> DataFrame:
    """PARENT edges (a path without its last label, in the same version) and NEXT edges (the following order number)."""
    p = provisions.select(F.col(id_col).alias("id"), F.col(version_col).alias("v"), F.col(path_col).alias("path"), F.col(order_col).alias("o"))
    parent = p.select(F.col("id").alias("dst"), F.col("v").alias("pv"), F.col("path").alias("pp"))
    up = p.where(F.size("path") > 1).join(parent, (F.col("v") == F.col("pv")) & (F.slice("path", 1, F.size("path") - 1) == F.col("pp"))).select(F.col("id").alias("src"), "dst", F.lit("PARENT").alias("type"))
    after = p.select(F.col("id").alias("dst"), F.col("v").alias("nv"), (F.col("o") - 1).alias("no"))
    following = p.join(after, (F.col("v") == F.col("nv")) & (F.col("o") == F.col("no"))).select(F.col("id").alias("src"), "dst", F.lit("NEXT").alias("type"))
    return up.union(following)


def heading_of(sections: DataFrame, headings: DataFrame, group: str, at: str) -> DataFrame:
    """Each section with the last heading at or before it. sections, headings: group, at; headings also `heading`.

    One shuffle by the group: both are ordered together and the last heading is carried on.
    """
    both = sections.select(F.col(group).alias("g"), F.col(at).alias("at"), F.lit(1).alias("side"), F.struct(*sections.columns).alias("row"), F.lit(None).cast("string").alias("heading")).unionByName(
        headings.select(F.col(group).alias("g"), F.col(at).alias("at"), F.lit(0).alias("side"), F.lit(None).cast(row_type(sections)).alias("row"), F.col("heading").cast("string").alias("heading"))
    )
    w = Window.partitionBy("g").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("heading", F.last("heading", ignorenulls=True).over(w)).where("side = 1").select("row.*", "heading")


def row_type(df: DataFrame):
    """The type of a struct of all of a table's columns."""
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType


def case_labels(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    found = F
    for condition, label in rules:
        found = found.when(condition, F.lit(label))
    return found.otherwise(F.lit(otherwise))
