"""Bounded neighbourhoods: what lies within one or two steps of a node, by kinds of edges, with limits on nodes and edges.

Edges are kept from both ends, each with its place among the edges of its node and type, best first. A hub is never expanded
whole: of each type only its first edges are read, since the first k of several types are among the first k of each. Places are
counted within salts of a node, so that no node's edges are ranked in one task; a filter on them keeps at most salts times k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.graph import stored

#: The types of edges that each mode follows, by the family that they belong to.
CITATION_TYPES = "CITES CITES_VERSION CITES_PROVISION CITES_CHAPTER CITES_RANGE MENTIONS_CITATION RESOLVES_TO RESOLVES_TO_VERSION RESOLVES_TO_PROVISION RESOLVES_TO_CHAPTER RESOLVES_TO_EXTERNAL RESOLVES_TO_RANGE_START RESOLVES_TO_RANGE_END CITES_EXTERNAL".split()
SIMILARITY_TYPES = ["SIMILAR_TO"]
SEMANTIC_TYPES = "EXPRESSES SUPPORTED_BY IMPOSED_ON REQUIRES_ACTION HAS_DEADLINE SUBJECT_TO VIOLATION_PENALIZED_BY EXCEPTION_TO REQUIRES_NOTICE DEFINES HAS_SCOPE".split()
HISTORY_TYPES = "HAS_STATUS_EVENT HAS_TEMPORAL_EFFECT HAS_LINEAGE_EVENT FORMERLY RENUMBERED_TO REPEALED_BY MENTIONS_SESSION_LAW ENACTS AFFECTS AFFECTS_VERSION HAS_SOURCE_NOTE".split()
STRUCTURE_TYPES = "HAS_VERSION VERSION_OF CONTAINS HAS_PARENT NEXT PREVIOUS".split()
MEANING_TYPES = "EXPRESSES SUPPORTED_BY DEFINES HAS_SCOPE HAS_DEADLINE EXCEPTION_TO REQUIRES_NOTICE HAS_SOURCE_NOTE HAS_TEMPORAL_EFFECT ENACTS AFFECTS".split()
LEGAL_TYPES = [*"CITES CITES_VERSION CITES_PROVISION CITES_CHAPTER CITES_RANGE CITES_EXTERNAL PART_OF_VERSION".split(), *STRUCTURE_TYPES, *MEANING_TYPES]
MODES = {"citation": CITATION_TYPES, "embedding_similarity": SIMILARITY_TYPES, "similarity": SIMILARITY_TYPES, "semantic": SEMANTIC_TYPES, "history": HISTORY_TYPES, "hybrid": [*CITATION_TYPES, *SIMILARITY_TYPES, *STRUCTURE_TYPES, *MEANING_TYPES]}
#: The kinds that types of edges are shown as; others are legal.
EDGE_KINDS = {
    "semantic_similarity": ["SIMILAR_TO"],
    "provenance": ["DERIVED_FROM", "SUPPORTED_BY", "HAS_SOURCE_NOTE"],
    "history": ["HAS_STATUS_EVENT", "HAS_TEMPORAL_EFFECT", "HAS_LINEAGE_EVENT", "FORMERLY", "RENUMBERED_TO", "REPEALED_BY", "MENTIONS_SESSION_LAW", "ENACTS", "AFFECTS", "AFFECTS_VERSION"],
    "retrieval": ["PART_OF_CHUNK", "HAS_CHUNK", "CHUNK_OF"],
}
#: The largest numbers of nodes and edges of an answer; the label of nodes that only serve retrieval.
MOST_NODES, EDGES_A_NODE, MOST_EDGES, MOST_STEPS, CHUNK = 500, 3, 1500, 2, "RetrievalChunk"
ADJACENT = ["node", "other", "edge_id", "type", "src", "dst", "confidence", "score", "place"]


def edge_types(mode: str = "legal", types: list[str] | None = None, similar: bool = False) -> list[str]:
    """The types that a request follows: those it names, or else its mode's; similarity edges too if asked for."""
    chosen = list(types or MODES.get(mode, LEGAL_TYPES))
    return chosen + ([] if not similar or "SIMILAR_TO" in chosen else ["SIMILAR_TO"])


def edge_kind(edge_type: Column) -> Column:
    kind = F.lit("legal")
    for name, types in EDGE_KINDS.items():
        kind = F.when(edge_type.isin(types), name).otherwise(kind)
    return kind


def adjacency(edges: DataFrame, salts: int = 16) -> DataFrame:
    """Edges (edge_id, src, dst, type, confidence, score) from both ends, with their place: 1 for the best of a node, type and salt. A higher score goes first, then the smaller edge_id; null scores are last. A loop is one row."""
    from_src = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "edge_id", "type", "src", "dst", "confidence", "score")
    both = from_src.union(edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "edge_id", "type", "src", "dst", "confidence", "score"))
    salt = F.pmod(F.xxhash64("edge_id"), F.lit(salts))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("node", "type", salt).orderBy(F.desc_nulls_last("score"), "edge_id")))


def write_adjacency(edges: DataFrame, path: str, buckets: int = 64, salts: int = 16) -> None:
    """Stores the adjacency as Parquet by bucket of the node, best places first in each file, so that a request reads its nodes' buckets and of these the first row groups. A bucket's rows are split by place, so hubs do not make one large file."""
    rows = adjacency(edges, salts).withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod("place", F.lit(8))).sortWithinPartitions("bucket", "place", "node").write.partitionBy("bucket").parquet(path)


def read_adjacency(spark: SparkSession, path: str, nodes: DataFrame, buckets: int = 64) -> DataFrame:
    """The stored edges of the given nodes; other buckets are not read."""
    wanted = nodes.select("node").distinct().withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"))
    numbers = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most `buckets`
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers)).join(wanted, ["bucket", "node"], "left_semi").select(*ADJACENT)


def followed(adjacent: DataFrame, types: list[str], threshold: float | None, first: int) -> DataFrame:
    """The edges that a request may follow: of its types, similar enough, and among the first of their node."""
    rows = adjacent.where(F.col("type").isin(types) & (F.col("place") <= first))
    return rows if threshold is None else rows.where((F.col("type") != "SIMILAR_TO") | (F.coalesce("score", F.lit(0.0)) >= threshold))


def first_of(df: DataFrame, group: list[str], order: list, first: int, name: str) -> DataFrame:
    """The first rows of each group with their rank; parts of a group are cut to as many rows before they meet."""
    salt = F.pmod(F.xxhash64("edge_id"), F.lit(16))
    for window in (Window.partitionBy(*group, salt).orderBy(*order), Window.partitionBy(*group).orderBy(*order)):
        df = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= first)
    return df


def paths(adjacent, centers: DataFrame, depth: int, types: list[str], threshold: float | None, most: int) -> DataFrame:
    """center, path (its rank), hops, and the edge and node that each path ends with: the first `most` paths from each center.

    adjacent: an adjacency, or a function of a frontier (node) that gives its adjacency. Paths of one step come first, by score and edge_id;
    those of two steps follow in the order of their first step, then of their second. No path goes over one edge twice.
    """
    of = adjacent if callable(adjacent) else lambda nodes: adjacent
    start = centers.select(F.col("node").alias("center")).distinct()
    near = followed(of(start.select(F.col("center").alias("node"))), types, threshold, most)
    one = start.join(near, F.col("center") == F.col("node"))
    one = stored(first_of(one, ["center"], [F.desc_nulls_last("score"), "edge_id"], most, "path").select("center", "path", F.lit(1).alias("hops"), "edge_id", "type", "src", "dst", "confidence", "score", F.col("other").alias("end"), F.col("edge_id").alias("first_edge")))
    if depth < 2:
        return one
    counts = one.groupBy("center").agg(F.max("path").alias("found"))
    open_paths = one.join(counts.where(F.col("found") < most), "center").select("center", F.col("path").alias("before"), "found", F.col("end").alias("at"), "first_edge")
    far = followed(of(open_paths.select(F.col("at").alias("node")).distinct()), types, threshold, most)
    two = open_paths.join(far, (F.col("at") == F.col("node")) & (F.col("first_edge") != F.col("edge_id")))
    # a first step's own continuations are cut before those of a center meet
    two = first_of(two, ["center", "before"], [F.desc_nulls_last("score"), "edge_id"], most, "path")
    two = two.withColumn("path", F.row_number().over(Window.partitionBy("center").orderBy("before", F.desc_nulls_last("score"), "edge_id")) + F.col("found")).where(F.col("path") <= most)
    return one.unionByName(two.select("center", "path", F.lit(2).alias("hops"), "edge_id", "type", "src", "dst", "confidence", "score", F.col("other").alias("end"), "first_edge"))


def bounded_neighbourhood(adjacent, nodes: DataFrame, centers: DataFrame, depth: int = 1, limit: int = 40, mode: str = "legal", types: list[str] | None = None, similar: bool = False, threshold: float | None = None, node_types: list[str] | None = None, chunks: bool = False, min_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes (center, node, hops, rank) and edges (center, edge_id, src, dst, type, kind, confidence, score, rank) around each center (column node).

    depth: 1 or 2 steps, in either direction of edges; limit: nodes, 1 to 500; edges and paths are limited to three times as many, 1500 at
    most. Paths are taken best first (see paths), nodes and edges in the order of their first path, the center before all. Nodes
    (node, labels, confidence) are left out if they only serve retrieval (unless chunks), have none of node_types, or a confidence under min_confidence (null counts
    as 1); edges if an end is a node for retrieval, or their own confidence is lower. threshold: the least score of similarity edges that are followed. A center that is no node has no rows.
    """
    limit = max(1, min(limit, MOST_NODES))
    most = min(limit * EDGES_A_NODE, MOST_EDGES)
    depth = max(1, min(depth, MOST_STEPS))
    known = nodes.select("node", "labels", F.coalesce("confidence", F.lit(1.0)).alias("sure"), F.array_contains("labels", CHUNK).alias("chunk"))
    start = centers.select("node").distinct().join(known.select("node"), "node", "left_semi")
    found = stored(paths(adjacent, start, depth, edge_types(mode, types, similar), threshold, most))
    by = Window.partitionBy("center").orderBy("at", "node")
    reached = start.select(F.col("node").alias("center"), "node", F.lit(0).alias("hops"), F.lit(0).alias("at")).unionByName(found.select("center", F.col("end").alias("node"), "hops", F.col("path").alias("at")))
    reached = reached.groupBy("center", "node").agg(F.min("hops").alias("hops"), F.min("at").alias("at")).join(known, "node")
    keep = F.lit(True) if chunks else ~F.col("chunk")
    if node_types:
        keep &= F.arrays_overlap("labels", F.array(*map(F.lit, node_types)))
    if min_confidence is not None:
        keep &= F.col("sure") >= min_confidence
    shown = reached.where(keep).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit).select("center", "node", "hops", "rank")
    edges = found.groupBy("center", "edge_id", "type", "src", "dst", "confidence", "score").agg(F.min("path").alias("at"))
    if not chunks:
        only = known.where("chunk").select("node")
        edges = edges.join(only, F.col("src") == F.col("node"), "left_anti").join(only, F.col("dst") == F.col("node"), "left_anti")
    if min_confidence is not None:
        edges = edges.where(F.coalesce("confidence", F.lit(1.0)) >= min_confidence)
    ranked = edges.withColumn("rank", F.row_number().over(Window.partitionBy("center").orderBy("at"))).where(F.col("rank") <= most)
    return shown, ranked.select("center", "edge_id", "src", "dst", "type", edge_kind(F.col("type")).alias("kind"), "confidence", "score", "rank")
