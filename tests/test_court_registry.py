"""A registry of court rules, as it is published."""

from pyspark.sql import functions as F

from lexmill.sources import court_registry as registry

TEXT = """Supplementary Local Court Rules (SLRs)
Ignored 1/1/2020
Current and Future Rules
Description\tJurisdiction\tSubcategory\tEffective Start Date\tEffective End Date
CJO 25-018 Order Establishing Interim Procedures Addressing Immigration Enforcement Activities, superseding CJO 24-001 (PDF)\tStatewide\tCJO\t7/1/2025\t
PJO 25-005 Order to Set Aside Judgments and Seal Eligible Residential Landlord Tenant Cases\tLinn\tPJO\t11/10/2025\t
Linn County Supplementary Local Court Rules (SLR) (PDF)\tLinn\tRule\t2/1/2026\t1/31/2027
Courthouse emergency closure Linn PJO 6/2/2026 6/2/2026
Broken row\tLinn\tPJO\t13/40/2025\t
Prior Rules
Description\tJurisdiction\tSubcategory\tEffective Start Date\tEffective End Date
CJO 24-001 Remote hearings and fees\tStatewide\tCJO\t1/1/2024\t6/30/2025
* Out-of-Cycle Amendment of SLR 6.101 and Appendix B (effective April 19, 2025) (PDF)\tLinn\tOut-of-Cycle\t4/19/2025\t12/31/2025
Linn County Supplementary Local Court Rules (SLR) (PDF)\tLinn County\tRule\t2/1/2025\t1/31/2026
"""


def test_registry(spark):
    rows, bad = registry.entries(spark.createDataFrame([("r1", TEXT, "2026-05-01"), ("r2", "", "2026-05-01")], "registry_id string, text string, snapshot_date string"))
    got = {r["authority_document_id"]: r for r in rows.collect()}
    assert len(got) == 7 and [r["line"].split("\t")[0] for r in bad.collect()] == ["Broken row"]
    assert (got["or:linn:slr@2026"]["date_status"], got["or:linn:slr@2026"]["flags"]) == ("current", ["current"])
    order = got["or:state:cjo:25-018"]
    assert (order["identifier"], order["kind"], order["flags"], order["topics"]) == ("CJO 25-018", "ChiefJusticeOrder", ["current", "open_ended"], ["Immigration Enforcement"])
    amendment = got["or:linn:slr:6.101;:appendix:b"]
    assert (amendment["identifier"], amendment["amends"], amendment["flags"]) == ("SLR 6.101; Appendix B", "or:linn:slr@2025", ["expired", "out_of_cycle", "prior"])
    closure = got["or:linn:presidingjudgeorder:courthouse-emergency-closure-2026-06-02"]
    assert (closure["flags"], closure["topics"], closure["start_date"]) == (["future", "one_day_only"], ["Emergency Closure", "Court Closure"], "2026-06-02")
    assert got["or:linn:pjo:25-005"]["topics"] == ["Landlord Tenant Sealing"] and got["or:state:cjo:24-001"]["topics"] == ["Remote Proceedings", "Fees"]
    edges = registry.supersessions(rows)
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in edges.collect()) == [("or:linn:slr@2026", "or:linn:slr@2025", 0.95), ("or:state:cjo:25-018", "or:state:cjo:24-001", 0.9)]
    flagged = registry.with_superseded(rows, edges).where(F.array_contains("flags", "superseded"))
    assert sorted(r["authority_document_id"] for r in flagged.collect()) == ["or:linn:slr@2025", "or:state:cjo:24-001"]
    assert registry.intervals(rows).where("effective_interval_id like 'effective_interval:%'").count() == 7


def test_names(spark):
    value = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]
    assert [value(registry.jurisdiction_id, x) for x in ("Statewide", "Lane County", "or:x", "Multnomah")] == ["or:state", "or:lane", "or:x", "or:multnomah"]
    assert [value(registry.registry_date, x) for x in ("2/1/2026", "2/30/2026", "x")] == ["2026-02-01", None, None]
    assert [value(registry.kind_of, x) for x in ("CJO", "special order")] == ["ChiefJusticeOrder", "SpecialOrder"]
