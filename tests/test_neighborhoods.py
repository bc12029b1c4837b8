"""Bounded neighbourhoods: against a brute-force walk, with hubs, limits, modes, thresholds and stored edges."""

import random
import tempfile

import pytest

from lexmill.operators import neighborhoods as n

EDGE = "edge_id string, src string, dst string, type string, confidence double, score double"


def walk(edges, center, types, threshold, most, depth):
    """The first paths by hand: lists of (hops, edge, end)."""
    near = {}
    for e in edges:
        if e[3] in types and (threshold is None or e[3] != "SIMILAR_TO" or (e[5] or 0.0) >= threshold):
            near.setdefault(e[1], []).append((e, e[2]))
            if e[1] != e[2]:
                near.setdefault(e[2], []).append((e, e[1]))
    best = lambda x: (x[0][5] is None, -(x[0][5] or 0.0), x[0][0])
    one = sorted(near.get(center, []), key=best)[:most]
    found = [(1, e, end) for e, end in one]
    for first, at in one if depth > 1 else ():
        found += [(2, e, end) for e, end in sorted(near.get(at, []), key=best) if e[0] != first[0]]
    return found[:most]


@pytest.fixture(scope="module")
def graph(spark):
    random.seed(8)
    names = [f"v{i}" for i in range(40)]
    edges = [(f"h{i:04d}", "hub", f"v{i % 40}", random.choice(["CITES", "NEXT", "SIMILAR_TO", "ODD"]), random.choice([None, 0.2, 0.9]), random.choice([None, 0.1, 0.5, 0.5, 0.9])) for i in range(900)]
    edges += [(f"x{i:04d}", random.choice(names), random.choice(names), random.choice(["CITES", "SIMILAR_TO", "DEFINES"]), None, random.choice([None, 0.3, 0.7])) for i in range(150)]
    nodes = [("hub", ["Part"], None), *[(v, [random.choice(["Part", "Term"])] + (["RetrievalChunk"] if i % 7 == 0 else []), random.choice([None, 0.3, 0.8])) for i, v in enumerate(names)], ("alone", ["Part"], 1.0)]
    return edges, nodes, spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, "node string, labels array<string>, confidence double")


@pytest.mark.parametrize(("depth", "limit", "options"), [(1, 40, {}), (2, 5, {"mode": "hybrid"}), (2, 500, {"similar": True, "threshold": 0.5}), (2, 30, {"types": ["SIMILAR_TO"], "threshold": 0.5, "chunks": True, "min_confidence": 0.5}), (7, 0, {"node_types": ["Term"]})])
def test_equals_a_walk(spark, graph, depth, limit, options):
    edges, nodes, edge_table, node_table = graph
    centers = ["hub", "v3", "v0", "alone", "nowhere"]
    shown, lines = n.bounded_neighbourhood(n.adjacency(edge_table, salts=4), node_table, spark.createDataFrame([(c,) for c in [*centers, "hub"]], "node string"), depth=depth, limit=limit, **options)
    limit = max(1, limit)
    most, types = 3 * limit if 3 * limit < 1500 else 1500, n.edge_types(options.get("mode", "legal"), options.get("types"), options.get("similar", False))
    labels, sure = {x[0]: x[1] for x in nodes}, {x[0]: 1.0 if x[2] is None else x[2] for x in nodes}

    def visible(v):
        return (options.get("chunks") or "RetrievalChunk" not in labels[v]) and (not options.get("node_types") or set(labels[v]) & set(options["node_types"])) and sure[v] >= options.get("min_confidence", -1)

    want_nodes, want_edges = set(), set()
    for c in centers[:-1]:
        found = walk(edges, c, types, options.get("threshold"), most, min(depth, 2))
        order = list(dict.fromkeys([c, *(end for _, _, end in found)]))
        hops = {c: 0}
        for h, _, end in found:
            hops.setdefault(end, h)
        want_nodes |= {(c, v, hops[v], k + 1) for k, v in enumerate([v for v in order if visible(v)][:limit])}
        ids = list(dict.fromkeys(e[:5] for _, e, _ in found if (options.get("chunks") or not any("RetrievalChunk" in labels[v] for v in e[1:3])) and (1.0 if e[4] is None else e[4]) >= options.get("min_confidence", -1)))
        want_edges |= {(c, e[0], k + 1) for k, e in enumerate(ids[:most])}
    assert {tuple(r) for r in shown.collect()} == want_nodes
    assert {(r["center"], r["edge_id"], r["rank"]) for r in lines.collect()} == want_edges


def test_stored_edges(spark, graph):
    _, _, edges, nodes = graph
    path = tempfile.mkdtemp(prefix="spark-") + "/edges"
    n.write_adjacency(edges, path, buckets=8, salts=4)
    centers = spark.createDataFrame([("hub",), ("v3",)], "node string")
    stored = n.bounded_neighbourhood(lambda some: n.read_adjacency(spark, path, some, buckets=8), nodes, centers, depth=2, limit=20)
    direct = n.bounded_neighbourhood(n.adjacency(edges, salts=4), nodes, centers, depth=2, limit=20)
    for a, b in zip(stored, direct):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = n.followed(n.read_adjacency(spark, path, centers, buckets=8), ["CITES"], None, 5)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull" in plan or "PartitionFilters: [bucket" in plan
    assert "LessThanOrEqual(place,5)" in plan


def test_a_hub_is_not_read_whole(spark):
    hub = spark.range(20_000).selectExpr("concat('e', id) AS edge_id", "'hub' AS src", "concat('v', id) AS dst", "'CITES' AS type", "cast(null AS double) AS confidence", "cast(id AS double) AS score")
    kept = n.followed(n.adjacency(hub, salts=16).where("node = 'hub'"), ["CITES"], None, 15)
    assert kept.count() <= 16 * 15
    assert [r["end"] for r in n.paths(n.adjacency(hub), spark.createDataFrame([("hub",)], "node string"), 1, ["CITES"], None, 15).orderBy("path").collect()] == [f"v{i}" for i in range(19_999, 19_984, -1)]


def test_modes_and_kinds(spark):
    from pyspark.sql import functions as F

    assert n.edge_types("similarity") == ["SIMILAR_TO"] and n.edge_types("unheard of") == n.LEGAL_TYPES and n.edge_types("history", ["A"]) == ["A"]
    assert n.edge_types("legal", similar=True)[-1] == "SIMILAR_TO" and n.edge_types("hybrid", similar=True).count("SIMILAR_TO") == 1
    kinds = spark.createDataFrame([("SIMILAR_TO",), ("HAS_SOURCE_NOTE",), ("AFFECTS",), ("HAS_CHUNK",), ("CITES",)], "t string").select(n.edge_kind(F.col("t"))).collect()
    assert [r[0] for r in kinds] == ["semantic_similarity", "provenance", "history", "retrieval", "legal"]
