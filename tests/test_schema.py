"""Node kinds, their labels and edges on small rows."""

import pytest

from pyspark.sql import functions as F

from lexmill.operators import schema


def table(spark, text, *rows):
    return spark.createDataFrame(list(rows), text)


def triples(df):
    return sorted(tuple(r) for r in df.select("src", "type", "dst").collect())


def test_every_rule_names_known_kinds():
    assert len(schema.KINDS) == 58
    for found in (*schema.BY_KIND.values(), *schema.BY_PASS.values()):
        assert all(r.kind in schema.KINDS and r.target in schema.KINDS for r in found)
    assert schema.key_of("StatusEvent") == "status_event_id" and schema.key_of("LegalTextIdentity") == "canonical_id"


def test_last_row_wins_and_old_values_stay(spark):
    rows = table(spark, "status_event_id string, canonical_id string, version_id string, n int", ("s1", "c1", None, 1), ("s1", "c2", None, 2), (None, "c1", None, 3))
    old = table(spark, "status_event_id string, canonical_id string, version_id string", ("s1", "c0", "v0"), ("s0", "c9", None))
    got = schema.load("StatusEvent", rows, F.col("n"), {}, old)
    assert {r["status_event_id"]: (r["canonical_id"], r["version_id"], r["labels"]) for r in got.collect()} == {"s1": ("c2", "v0", ["StatusEvent"]), "s0": ("c9", None, ["StatusEvent"])}


def test_required_targets(spark):
    rows = table(spark, "edition_id string, corpus_id string, n int", ("e1", "or:ors", 1), ("e2", "gone", 1), ("e3", None, 1))
    corpora = table(spark, "corpus_id string", ("or:ors",))
    assert [r["edition_id"] for r in schema.load("CorpusEdition", rows, F.col("n"), {"LegalCorpus": corpora}).collect()] == ["e1"]


def test_labels_by_type_family_and_title(spark):
    labels = lambda kind, text, *rows: [r["labels"] for r in schema.load(kind, table(spark, text, *rows), F.lit(0), {}).orderBy(schema.key_of(kind)).collect()]
    assert labels("LegalSemanticNode", "semantic_id string, semantic_type string", ("a", "Fee"), ("b", "Other")) == [["LegalSemanticNode", "Fee"], ["LegalSemanticNode"]]
    assert labels("Provision", "provision_id string, authority_family string", ("a", None), ("b", "SLR")) == [["Provision", "LegalAuthorityUnit", "ORSProvision"], ["Provision", "LegalAuthorityUnit", "CourtRuleProvision", "SLRProvision", "SupplementaryLocalRuleProvision"]]
    assert labels("RuleAuthorityDocument", "authority_document_id string, authority_kind string, title string", ("a", "PresidingJudgeOrder", "Remote hearings and Fee schedule")) == [["RuleAuthorityDocument", "PresidingJudgeOrder", "FeeOrder", "RemoteProceedingOrder"]]
    assert labels("Deadline", "deadline_id string, text string", ("a", "t")) == [["Deadline", "LegalSemanticNode"]]


def test_edges_by_expressions_and_conditions(spark):
    tables = {
        "ChapterTocEntry": table(spark, "toc_entry_id string, chapter string, edition_year int, canonical_id string", ("t1", "90", 2025, None)),
        "ChapterVersion": table(spark, "chapter_id string, chapter string", ("or:ors:chapter:90@2025", "90")),
        "RetrievalChunk": table(spark, "chunk_id string, chunk_type string, source_provision_id string, source_version_id string, parent_version_id string, source_id string", ("k1", "full_statute", "p1", None, "v1", None), ("k2", "contextual", None, None, "v1", "p1")),
        "Provision": table(spark, "provision_id string", ("p1",)),
        "LegalTextVersion": table(spark, "version_id string", ("v1",)),
        "CitationMention": table(spark, "citation_mention_id string, citation_type string, normalized_citation string", ("m1", "statute_chapter", "ORS chapter 90"), ("m2", "statute_section", "ORS chapter 90")),
        "TaxRule": table(spark, "tax_rule_id string, source_provision_id string", ("x1", "p1")),
        "MoneyAmount": table(spark, "money_amount_id string, source_provision_id string", ("y1", "p1"), ("y2", "p2")),
    }
    assert triples(schema.edges(schema.BY_KIND["ChapterTocEntry"], tables)) == [("or:ors:chapter:90@2025", "HAS_TOC_ENTRY", "t1")]
    assert triples(schema.edges(schema.BY_PASS["chunk"], tables)) == [("k1", "DERIVED_FROM", "v1"), ("k2", "DERIVED_FROM", "p1"), ("p1", "HAS_CHUNK", "k2"), ("v1", "HAS_STATUTE_CHUNK", "k1")]
    with pytest.raises(ValueError, match="CitationMention lacks source_provision_id for MENTIONS_CITATION"):
        schema.edges(schema.BY_PASS["citation"], tables)
    lacking = {(r.kind, r.edge) for r in schema.BY_PASS["citation"] if r.kind == "CitationMention" and r.edge != "RESOLVES_TO_CHAPTER"}
    assert triples(schema.edges(schema.BY_PASS["citation"], tables, lacking)) == [("m1", "RESOLVES_TO_CHAPTER", "or:ors:chapter:90@2025")]
    amounts = [r for r in schema.BY_PASS["specialized"] if r.edge == "HAS_AMOUNT"]
    assert ("x1", "HAS_AMOUNT", "y1") in triples(schema.edges(amounts, tables))


def test_targets_by_precedence_lists_and_provenance(spark):
    notes = table(spark, "reporter_note_id string, source_provision_id string, version_id string", ("n1", "p1", "v1"), ("n2", "gone", "v1"), ("n3", None, None))
    provisions = table(spark, "provision_id string, version_id string, source_page_start int", ("p1", "v1", 3))
    versions = table(spark, "version_id string, source_document_id string", ("v1", "d1"))
    assert triples(schema.first_target(notes, "ReporterNote", [("source_provision_id", "Provision", provisions), ("version_id", "LegalTextVersion", versions)], ["HAS_REPORTER_NOTE"], [])) == [("p1", "HAS_REPORTER_NOTE", "n1"), ("v1", "HAS_REPORTER_NOTE", "n2")]
    orders = table(spark, "authority_document_id string, topic_ids array<string>", ("o1", ["t1", "t9"]), ("o2", None))
    assert triples(schema.listed_edges(orders, "RuleAuthorityDocument", "topic_ids", "RuleTopic", table(spark, "rule_topic_id string", ("t1",)), "HAS_TOPIC")) == [("o1", "HAS_TOPIC", "t1")]
    tables = {"LegalTextVersion": versions, "Provision": provisions, "CitationMention": table(spark, "citation_mention_id string, source_provision_id string", ("m1", "p1")), "SourceDocument": table(spark, "source_document_id string, authority_family string", ("d1", "UTCR")), "SourcePage": table(spark, "source_page_id string, source_document_id string, page_number int", ("g3", "d1", 3), ("g4", "d1", 4))}
    assert triples(schema.provenance(tables)) == [("d1", "SOURCE_FOR", "m1"), ("d1", "SOURCE_FOR", "p1"), ("g3", "CONTAINS_TEXT", "p1"), ("p1", "APPEARS_ON_PAGE", "g3"), ("p1", "DERIVED_FROM", "d1")]
    assert triples(schema.publishers(tables["SourceDocument"])) == [("or:judicial_department", "PUBLISHED", "d1"), ("or:judicial_department", "PUBLISHES", "d1")]


def test_chapters_of_versions(spark):
    rows = table(spark, "authority_family string, chapter string, edition_year int, title string, corpus_id string, edition_id string, authority_type string, authority_level int", (None, "90", 2025, "B", None, None, None, None), (None, "90", 2025, "A", None, None, None, None), ("SLR", "2", 2026, None, "or:lane:slr", None, None, None))
    got = {r["chapter_id"]: r for r in schema.chapter_versions(rows).collect()}
    assert set(got) == {"or:ors:chapter:90@2025", "or:lane:slr:chapter:2@2026"}
    one, two = got["or:ors:chapter:90@2025"], got["or:lane:slr:chapter:2@2026"]
    assert (one["title"], one["citation"], one["edition_id"], one["authority_level"], one["jurisdiction_id"]) == ("A", "ORS Chapter 90", "or:ors@2025", 90, "or:state")
    assert (two["citation"], two["authority_type"], two["authority_level"], two["jurisdiction_id"], two["official_status"]) == ("SLR Chapter 2", "court_rule", 75, "or:lane", "official_pdf")
