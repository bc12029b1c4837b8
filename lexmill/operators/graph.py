"""Typed edges as a table: neighbourhoods, shortest paths, closures, trees of provisions, counts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, which has one machine, may go without."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    """edges (src, dst, type) and their reverses."""
    return edges.select("src", "dst", "type").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int = 2, types: list[str] | None = None) -> DataFrame:
    """node and hops of every node within depth (1 or 2) undirected steps of the nodes in start (column node)."""
    near = both_ways(edges if types is None else edges.where(F.col("type").isin(types)))
    found = start.select("node", F.lit(0).alias("hops")).distinct()
    frontier = found
    for hop in range(1, depth + 1):
        frontier = frontier.join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(hop).alias("hops")).distinct()
        found = found.union(frontier)
    return found.groupBy("node").agg(F.min("hops").alias("hops"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    inside = nodes.select("node").distinct()
    return edges.join(inside, F.col("src") == F.col("node"), "left_semi").join(inside, F.col("dst") == F.col("node"), "left_semi")


def shortest_path(edges: DataFrame, source, target, longest: int = 6) -> DataFrame:
    """The length and nodes of a shortest undirected path of at most `longest` steps, of several the least; no row without one.

    Breadth first: a frontier keeps the least path to each node it reaches first, and nodes once reached are left out.
    """
    near = both_ways(edges)
    frontier = edges.sparkSession.createDataFrame([(source,)], near.select("src").schema.fields[0].name + " " + near.schema["src"].dataType.simpleString()).select(F.col("src").alias("node"), F.array("src").alias("path"))
    seen = frontier.select("node")
    for hop in range(longest + 1):
        hit = frontier.where(F.col("node") == F.lit(target)).select(F.lit(hop).alias("length"), "path").limit(1)
        if hop == longest or hit.count():
            return hit
        step = frontier.join(near, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = stored(step.join(seen, "node", "left_anti").groupBy("node").agg(F.min("path").alias("path")))
        seen = seen.union(frontier.select("node"))
    return hit


def closure(edges: DataFrame, deepest: int = 1000) -> DataFrame:
    """node, ancestor and depth over child -> parent edges (src, dst), each node its own ancestor at depth 0; stops when nothing is new.

    Chains deeper than `deepest` raise an error; there is no partial closure.
    """
    step = stored(edges.select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct())
    found = step.select(F.col("child").alias("node")).union(step.select("parent")).distinct().select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    frontier = found
    for depth in range(1, deepest + 1):
        up = frontier.join(step, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        frontier = stored(up.join(found, ["node", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.union(frontier)
        if depth % 10 == 0:  # else each step reads all before it
            found = stored(found)
    else:
        raise RuntimeError(f"chains of over {deepest} steps")
    return found.groupBy("node", "ancestor").agg(F.min("depth").alias("depth"))


def degree_counts(edges: DataFrame) -> DataFrame:
    """node, outgoing, incoming and types: distinct neighbours each way, and distinct edge types."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"), F.lit(None).cast(edges.schema["src"].dataType).alias("from"), "type")
    into = edges.select(F.col("dst").alias("node"), F.lit(None).cast(edges.schema["dst"].dataType).alias("to"), F.col("src").alias("from"), "type")
    return out.unionByName(into).groupBy("node").agg(F.countDistinct("to").alias("outgoing"), F.countDistinct("from").alias("incoming"), F.countDistinct("type").alias("types"))


def graph_score(outgoing: Column, incoming: Column) -> Column:
    """A node's bonus for its links, at most 1.5."""
    return F.least(F.lit(0.1) * outgoing + F.lit(0.05) * incoming, F.lit(1.5))


def ancestors(provisions: DataFrame, id_col: str, path_col: str, most: int = 8) -> DataFrame:
    """id, ancestor path and depth of each provision, from its path (an array of labels)."""
    path = F.col(path_col)
    up = F.transform(F.sequence(F.lit(1), F.least(F.size(path) - 1, F.lit(most))), lambda n: F.slice(path, 1, n))
    return provisions.where(F.size(path) > 1).select(id_col, F.posexplode(up).alias("depth", "ancestor"))


def sequence_edges(rows: DataFrame, group: list[str], order: str, node: Column) -> DataFrame:
    """src, dst and type: each row's NEXT and PREVIOUS within its group."""
    named = rows.withColumn("__node", node)
    follows = F.lead("__node").over(Window.partitionBy(*group).orderBy(order))
    pairs = named.select("__node", follows.alias("then")).where(F.col("then").isNotNull())
    forward = pairs.select(F.col("__node").alias("src"), F.col("then").alias("dst"), F.lit("NEXT").alias("type"))
    return forward.union(pairs.select("then", "__node", F.lit("PREVIOUS")))


def similar_edges(vectors: DataFrame, id_col: str, vector_col: str, group_col: str | None, k: int, least: float, queries: Column | None = None, block: int = 512) -> DataFrame:
    """src, dst and similarity: the k nearest at `least` similarity or more of each vector that meets the condition queries (of all without one).

    Exact over all vectors, or within the group where group_col is given. Unit-scaled vectors meet in blocks of about `block` rows
    as matrices; each pair of blocks gives at most k rows a source, so pairs of vectors are never rows.
    """
    size = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))
    unit = vectors.select("*", F.lit(0).alias("g") if group_col is None else F.col(group_col).alias("g")).select(F.col(id_col).alias("id"), "g", F.transform(vector_col, lambda x: x.cast("double") / size).alias("v"), (F.lit(True) if queries is None else queries).alias("asks"))
    unit = unit.where("g IS NOT NULL AND v IS NOT NULL")
    counts = unit.groupBy("g").agg(F.ceil(F.count("*") / block).alias("blocks"))
    unit = unit.join(counts, "g").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))
    left = unit.where("asks").select("id", "g", "v", F.lit(True).alias("asks"), F.col("b").cast("int").alias("b1"), others.alias("b2"))
    right = unit.select("id", "g", "v", F.lit(False).alias("asks"), others.alias("b1"), F.col("b").cast("int").alias("b2"))
    kind = unit.schema["id"].dataType.simpleString()

    def nearest(table):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        asks = table.column("asks")
        mine, theirs = table.filter(asks), table.filter(pa.compute.invert(asks))
        src, dst, near = [], [], []
        if mine.num_rows and theirs.num_rows:
            ids, others = mine.column("id").to_pylist(), theirs.column("id").to_pylist()
            a, b = (np.array(x.column("v").to_pylist(), dtype=np.float64) for x in (mine, theirs))
            for i, row in enumerate(a @ b.T):
                found = [j for j in np.nonzero(row >= least)[0].tolist() if others[j] != ids[i]]
                for j in sorted(found, key=lambda j: (-row[j], others[j]))[:k]:
                    src.append(ids[i])
                    dst.append(others[j])
                    near.append(float(row[j]))
        id_type = table.schema.field("id").type
        return pa.table({"src": pa.array(src, id_type), "dst": pa.array(dst, id_type), "similarity": pa.array(near, pa.float64())})

    pairs = left.union(right).groupBy("g", "b1", "b2").applyInArrow(nearest, f"src {kind}, dst {kind}, similarity double")
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return pairs.withColumn("place", best).where(F.col("place") <= k)


def merge_edges(tables: list[DataFrame]) -> DataFrame:
    """Edge tables of different columns as one, each edge once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).distinct()
