"""Query plans, candidates' hierarchy and boosts, on the forms that users type."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import planning as p


@pytest.fixture(scope="module")
def planned(spark):
    texts = [
        "90.300", "ors 90.300(1)", "utcr 2.010(4)(a)", "90.320 to 90.330", " chapter 90 ", "“landlord” notice", "ORS 90.320(1)(a)", "ORS 90.320 to 90.330", "UTCR 21.040 to 21.140", "chapter 90 habitability", "U.S. Const. art. I, § 8, cl. 3",
        "Fourteenth Amendment due process", "Amdt14.S1.5.1", "Or. Const. Art. I, § 8", "Article XVII, section 1", "Oregon Constitution Article XI-F(1), section 1", "Art. VII (Amended), § 2", "see ORS 90.100 to UTCR 90.200 now", "90.1 to 91.2", "civil penalty", None,
    ]
    rows = p.plan(spark.createDataFrame([(t,) for t in texts], "q string"), "q").collect()
    return {r["q"]: r for r in rows}


def test_normal_forms(planned, spark):
    want = {"90.300": "ORS 90.300", "ors 90.300(1)": "ORS 90.300(1)", "utcr 2.010(4)(a)": "UTCR 2.010(4)(a)", "90.320 to 90.330": "ORS 90.320 to ORS 90.330", " chapter 90 ": "Chapter 90", "“landlord” notice": '"landlord" notice'}
    assert {q: planned[q]["normalized"] for q in want} == want
    assert spark.range(1).select(p.normalized_query(F.lit("2.010"), F.lit("utcr"))).first()[0] == "UTCR 2.010"


def test_citations_in_queries(planned):
    one = lambda q: planned[q]["citations"][0]
    assert (one("ORS 90.320(1)(a)")["base"], one("ORS 90.320(1)(a)")["subsections"], one("ORS 90.320(1)(a)")["parent"]) == ("ORS 90.320", ["1", "a"], "ORS 90.320")
    assert (one("utcr 2.010(4)(a)")["family"], one("utcr 2.010(4)(a)")["base"]) == ("UTCR", "UTCR 2.010")
    federal = one("U.S. Const. art. I, § 8, cl. 3")
    assert (federal["family"], federal["normalized"], federal["chapter"], federal["parent"]) == ("USCONST", "U.S. Const. art. I, § 8, cl. 3", "article-1", "U.S. Const. art. I, § 8")
    assert (one("Fourteenth Amendment due process")["normalized"], planned["Fourteenth Amendment due process"]["residual"], planned["Fourteenth Amendment due process"]["family"]) == ("U.S. Const. amend. XIV", "due process", "USCONST")
    assert (one("Amdt14.S1.5.1")["family"], one("Amdt14.S1.5.1")["normalized"], one("Amdt14.S1.5.1")["chapter"]) == ("CONAN", "Amdt14.S1.5.1", "amendment-14")
    state = {"Or. Const. Art. I, § 8": ("Or. Const. art. I, § 8", "article-i"), "Article XVII, section 1": ("Or. Const. art. XVII, § 1", "article-xvii"), "Oregon Constitution Article XI-F(1), section 1": ("Or. Const. art. XI-F(1), § 1", "article-xi-f-1"), "Art. VII (Amended), § 2": ("Or. Const. art. VII (Amended), § 2", "article-vii-amended")}
    assert {q: (one(q)["normalized"], one(q)["chapter"]) for q in state} == state
    assert one("Or. Const. Art. I, § 8")["parent"] == "Or. Const. art. I"


def test_ranges_chapters_and_modes(planned):
    for q, start, end, chapter, family in [("ORS 90.320 to 90.330", "ORS 90.320", "ORS 90.330", "90", "ORS"), ("UTCR 21.040 to 21.140", "UTCR 21.040", "UTCR 21.140", "21", "UTCR")]:
        r = planned[q]["ranges"][0]
        assert (r["start"], r["end"], r["chapter"], r["family"], planned[q]["intent"], planned[q]["mode"]) == (start, end, chapter, family, "citation", "citation")
    assert planned["see ORS 90.100 to UTCR 90.200 now"]["ranges"] == [] and planned["90.1 to 91.2"]["ranges"] == []
    topic = planned["chapter 90 habitability"]
    assert (topic["chapter"], topic["residual"], topic["chapter_filter"], topic["retrieval"], topic["mode"]) == ("90", "habitability", "90", "habitability", "hybrid")
    assert (planned[" chapter 90 "]["intent"], planned[" chapter 90 "]["mode"]) == ("chapter", "citation")
    assert planned["civil penalty"]["intent"] == "penalty"


def test_intents(spark):
    want = {"ORS 90.300": "citation", "UTCR 2.010": "citation", "U.S. Const. amend. XIV, § 1": "citation", "Amdt14.S1.5.1": "citation", "Chapter 90": "chapter", "definition of dwelling unit": "definition", "security deposit deadline": "deadline", "civil penalty": "penalty", "xyz": "general"}
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", p.intent(F.col("q")).alias("i")).collect()
    assert {r["q"]: r["i"] for r in rows} == want


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_query_shapes(spark):
    assert value(spark, p.conjunctive_query(F.lit("the penalty for 'late' rent"))) == "penalty AND for AND late AND rent"
    assert value(spark, p.conjunctive_query(F.lit("a OR b"))) is None and value(spark, p.conjunctive_query(F.lit("penalty"))) is None
    assert value(spark, p.fulltext_query(F.lit("tax of director"), F.lit("actor"))) == "tax AND director"
    assert value(spark, p.fulltext_query(F.lit("rent notice"), F.lit("notice"))) == "rent notice"
    terms = F.array(*[F.lit(t) for t in ("Dwelling unit", "dwelling UNIT", "x" * 90, " ", "fit")])
    assert value(spark, p.expanded_query(F.lit("habitability "), terms)) == "habitability habitable Dwelling unit fit"
    assert [value(spark, p.default_result_type(F.lit(i), F.lit(c))) for i, c in (("penalty", None), ("definition", "90"), ("definition", None), ("history", None), ("actor", None), ("notice", None))] == ["penalty", "statute", "definition", "history", "statute", None]


def test_candidates(spark):
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    assert value(spark, p.dedupe_key(none, F.lit("v"), F.lit("c"), none, F.lit("chunk"), F.lit("i"))) == "version:v"
    assert value(spark, p.dedupe_key(none, none, none, F.lit("ORS 1"), F.lit("chunk"), F.lit("i"))) == "id:i"
    assert value(spark, p.dedupe_key(none, none, none, F.lit("ORS 1"), F.lit("statute"), F.lit("i"))) == "citation:ORS 1"
    assert [value(spark, p.kind_priority(F.lit(k))) for k in ("Provision", "statute", "DefinedTerm", "TaxRule", "amendment", "chunk", "x")] == [10, 9, 8, 7, 6, 5, 0]
    assert value(spark, p.matches_result_type("penalty", F.lit("chunk"), F.lit("a civil penalty"), empty, none, none))
    assert not value(spark, p.matches_result_type("semantic", F.lit("chunk"), F.lit("a civil penalty"), empty, none, none))
    assert value(spark, p.matches_result_type("constitution", F.lit("chunk"), F.lit(""), empty, F.lit("orconst"), none))
    assert value(spark, p.matches_result_type("session_law", F.lit("SessionLaw"), F.lit(""), empty, none, none))
    assert value(spark, p.intent_boost(F.lit("notice"), F.lit("chunk"), F.lit("Notice given"), empty)) == 0.75
    assert value(spark, p.intent_boost(F.lit("history"), F.lit("chunk"), F.lit("x"), F.array(F.lit("Amendment")))) == 1.0
    assert value(spark, p.with_actor_type(empty, F.lit("actor"), F.lit("what must a landlord do"), F.lit("A Landlord shall"))) == ["LegalActor"]
    assert value(spark, p.with_actor_type(empty, F.lit("actor"), F.lit("what must a landlord do"), F.lit("a tenant"))) == []


def test_hierarchy(spark):
    rows = [("USCONST", None, None, None, None, None), (None, "ORS 90.300", None, None, None, None), (None, "Amdt14.S1", None, None, None, None), ("SLR", None, None, "commentary", "federal", None), (None, None, 62, None, None, "us:x"), (None, "Or. Const. art. I", None, None, None, None)]
    got = p.with_hierarchy(spark.createDataFrame(rows, "authority_family string, citation string, authority_level int, source_role string, jurisdiction_id string, corpus_id string"))
    told = [(r["level"], r["tier"], r["role"], r["jurisdiction"], round(r["controlling_weight"], 2)) for r in got.collect()]
    assert told == [(100, "constitution", "primary_law", "us", 5.05), (90, "statute", "primary_law", "or:state", 3.0), (65, "official_commentary", "official_commentary", "us", 0.85), (75, "rule", "official_commentary", "us", 1.45), (62, "case_law", "secondary", "us", 0.45), (91, "constitution", "primary_law", "or:state", 3.6)]
    assert p.filtered(got, tier="constitutional").count() == 2 and p.filtered(got, family="ors").count() == 1 and p.filtered(got, primary_law=True, jurisdiction="federal").count() == 1


def test_direct_open_and_rerank(spark):
    queries = spark.createDataFrame([(1, "ORS 90.300(1)"), (2, "90.300"), (3, "ORS 90.999(2)"), (4, "ORS 90.300(9)")], "query_id int, q string")
    provisions = spark.createDataFrame([("ORS 90.300(1)", "p1"), ("ors 90.300(1)", "p2")], "citation string, id string")
    statutes = spark.createDataFrame([("ORS 90.300", "s1")], "citation string, id string")
    got = {r["query_id"]: (r["match_type"], r["id"]) for r in p.direct_open(p.plan(queries, "q"), provisions, statutes).collect()}
    assert got == {1: ("exact_provision", "p1"), 2: ("exact_statute", "s1"), 3: ("none", None), 4: ("parent_statute", "s1")}
    candidates = spark.createDataFrame([(1, 9.0), (2, 3.0), (5, 9.0), (6, 1.0)], "query_id int, score double")
    plans = spark.createDataFrame([(1, "hybrid", "general", None), (2, "hybrid", "general", None), (3, "citation", "citation", None), (5, "hybrid", "general", True), (6, "hybrid", "general", False)], "query_id int, mode string, intent string, asked boolean")
    assert {r["query_id"]: r["rerank"] for r in p.rerank_decisions(candidates, plans).collect()} == {1: False, 2: True, 3: False, 5: True, 6: False}


def test_ranked(spark):
    rows = [(1, "a", 1, "chunk", 2.0, 0.0), (1, "a", 2, "provision", 1.0, 0.5), (1, "b", 1, "chunk", 9.0, 0.0), (2, "a", 1, "chunk", 1.0, 0.0)]
    got = {(r["query_id"], r["key"]): (round(r["score"], 4), r["kind"], r["rank"]) for r in p.ranked(spark.createDataFrame(rows, "query_id int, key string, arm int, kind string, score double, boost double")).collect()}
    assert got == {(1, "a"): (2.575, "provision", 2), (1, "b"): (9.0, "chunk", 1), (2, "a"): (1.0, "chunk", 1)}


def test_rows_of_one_order_give_their_best(spark):
    """Which of several rows of the first order stands for an arm does not depend on the order of reading."""
    from lexmill.plans import planned

    for quantities in ([5.0, 9.0, None], [9.0, 5.0, None], [None, 5.0, 9.0]):
        rows = [(1, 20, 7, 1, q) for q in quantities] + [(2, 20, 7, 1, 40.0)]
        table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1)
        assert [tuple(r) for r in planned.ranked_candidates(lambda name: table).collect()] == [(7, "k0", 0.9, "chunk")]
