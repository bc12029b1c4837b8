"""Snapshots, rule packs and concepts on small tables."""

import itertools
import random

from pyspark.sql import functions as F

from lexmill.operators import packs, snapshots


def test_longest_rise():
    random.seed(3)
    for n in range(9):
        for _ in range(20):
            places = random.sample(range(n), n)
            flags = snapshots.longest_rise(places)
            kept = [p for p, f in zip(places, flags) if f]
            best = max((k for k in range(n + 1) for c in itertools.combinations(places, k) if list(c) == sorted(c)), default=0)
            assert kept == sorted(kept) and len(kept) == best
    assert snapshots.longest_rise([1, 0]) == [False, True]


def compare(spark, before, after):
    table = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "doc int, block_id string, place int, text string")
    changes = snapshots.compare_snapshots(table(before), table(after)).cache()
    return {r["block_id"]: (r["was"], r["now"], r["change"]) for r in changes.collect()}, changes


def test_changes(spark):
    before = [("a", 0, "A"), ("b", 1, "B"), ("c", 2, "C"), ("d", 3, None), ("twin1", 4, "T"), ("twin2", 5, "T"), ("gone", 6, "G")]
    after = [("b", 0, "B!"), ("c", 1, "C"), ("d", 2, ""), ("a", 3, "A!"), ("new1", 4, "T"), ("new2", 5, "T"), ("new3", 6, "T")]
    got, changes = compare(spark, before, after)
    assert got == {"a": (0, 3, "moved and edited"), "b": (1, 0, "edited"), "c": (2, 1, "unchanged"), "d": (3, 2, "unchanged"), "new1": (4, 4, "unchanged"), "new2": (5, 5, "unchanged"), "new3": (None, 6, "added"), "gone": (6, None, "removed")}
    assert tuple(snapshots.change_summary(changes).first()) == (1, 1, 1, 2, 1)
    assert compare(spark, [], [("x", 0, "")])[0] == {"x": (None, 0, "added")} and compare(spark, [], [])[0] == {}
    assert compare(spark, [("x", 0, "1"), ("y", 1, "2")], [("y", 0, "2"), ("x", 1, "1")])[0] == {"x": (0, 1, "moved"), "y": (1, 0, "unchanged")}


def test_rule_packs(spark):
    held = spark.createDataFrame([("p:general_document", ["court_document"]), ("p:complaint", ["complaint"]), ("p:filing_packet", ["filing_packet"]), ("p:none", None), ("p:empty", [])], "rule_pack_id string, work_product_types array<string>")
    rows = [("f", "FormattingRequirement", ["motion"]), ("d", "DeadlineRule", ["complaint", "complaint"]), ("s", "SanctionRule", ["court_document"]), ("n", None, None), ("d", "DeadlineRule", ["complaint"])]
    requirements = spark.createDataFrame(rows, "requirement_id string, semantic_type string, applies_to array<string>")
    members = packs.rule_pack_memberships(held, requirements)
    assert sorted((r["rule_pack_id"], r["requirement_id"]) for r in members.collect()) == [("p:complaint", "d"), ("p:complaint", "s"), ("p:filing_packet", "d"), ("p:general_document", "f")]
    edges = packs.includes_rule_edges(members, requirements.where("requirement_id <> 's'"))
    assert sorted((r["src"], r["dst"]) for r in edges.collect()) == [("p:complaint", "d"), ("p:filing_packet", "d"), ("p:general_document", "f")]


def test_concepts(spark):
    texts = spark.createDataFrame([(1, "Terms within the LEASE"), (2, None), (3, "nothing here"), (4, "serve notice")], "id int, t string")
    got = {}
    for r in packs.expand_concepts(texts, "id", "t", 7).orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["source_id"].split(":")[1], r["term"]))
    assert got == {
        1: [("deadlines", t) for t in packs.CONCEPTS["deadlines"][1]] + [("definitions", t) for t in packs.CONCEPTS["definitions"][1][:2]],
        4: [("notices", t) for t in packs.CONCEPTS["notices"][1]] + [("filing_service", t) for t in packs.CONCEPTS["filing_service"][1][:2]],
    }
    assert texts.select(F.size(packs.concept_terms(F.col("t"), 0)).alias("n")).where("n > 0").count() == 0


def test_packs_meet_requirements_where_these_are(spark):
    """No join that brings a key's requirements into one task: packs are broadcast, and requirements shuffled by their ids alone."""
    held = spark.createDataFrame([("x:a", ["motion"]), ("x:general_document", ["motion"])], "rule_pack_id string, work_product_types array<string>")
    requirements = spark.range(50).selectExpr("'q' || id % 40 AS requirement_id", "'FormattingRequirement' AS semantic_type", "array('motion') AS applies_to")
    members = packs.rule_pack_memberships(held, requirements)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(requirement_id")
    assert members.count() == 80
