"""Each check fires on a planted defect and on nothing else."""

import pytest

from lexmill.operators import audits

GOOD = {
    "legal_text_versions": ("version_id string", [("v",)]), "provisions": ("provision_id string", [("p",)]), "legal_text_identities": ("canonical_id string", [("i",)]), "source_documents": ("source_document_id string", [("d",)]),
    "status_events": ("version_id string, confidence double", [("v", 0.5), ("v", None)]), "source_notes": ("version_id string, provision_id string, confidence double", [("v", "p", 1.0), (None, None, 0.0)]),
    "html_paragraphs": ("source_document_id string", [("d",)]), "chapter_front_matter": ("source_document_id string, confidence double", [("d", 0.9)]), "title_chapter_entries": ("source_document_id string, confidence double", [("d", 0.9)]),
    "chapter_toc_entries": ("canonical_id string, confidence double", [("i", 0.9), (None, 0.9)]), "reserved_ranges": ("confidence double", [(0.8,)]), "session_laws": ("confidence double", [(0.8,)]), "amendments": ("confidence double", [(0.8,)]),
    "temporal_effects": ("source_note_id string, source_provision_id string, version_id string, confidence double", [("n", None, None, 0.1), (None, "p", "lost", 0.1), (None, None, "v", 0.1)]), "lineage_events": ("current_canonical_id string, confidence double", [("i", 0.2)]),
    "defined_terms": ("defined_term_id string", [("a",), ("b",), (None,), (None,)]), "definition_scopes": ("definition_scope_id string, scope_type string", [("s", "chapter")]),
    "definitions": ("definition_id string, source_provision_id string, defined_term_id string, definition_scope_id string, confidence double", [("x", "p", "a", "s", 0.4)]),
    "retrieval_chunks": ("chunk_id string, chunk_type string, parent_version_id string, source_provision_id string, text string, embedding_policy string, embedding_input_hash string, token_count int, max_tokens int, context_window int, chunking_strategy string, chunk_version string", [("k1", "full_statute", "v", None, "t", "embed_primary", "h", 10, 1, 1, "s", "1"), ("k2", "other", None, "p", "t", "none", None, None, None, None, None, None)]),
}
BAD = [
    ("status_events", ("lost", -0.1), {"status event without version", "invalid confidence"}), ("status_events", (None, 1.5), {"status event without version", "invalid confidence"}), ("source_notes", ("lost", "p", None), {"source note of a lost version"}), ("source_notes", (None, "lost", None), {"source note of a lost provision"}),
    ("html_paragraphs", (None,), {"orphan"}), ("chapter_toc_entries", ("lost", 0.5), {"contents entry of a lost identity"}), ("temporal_effects", (None, "lost", "lost", 0.5), {"effect without support"}), ("temporal_effects", (None, None, None, 0.5), {"effect without support"}), ("lineage_events", (None, 0.5), {"lineage without identity"}),
    ("defined_terms", ("a",), {"repeated id"}), ("definition_scopes", ("t", None), {"unknown scope"}), ("definition_scopes", ("s", "title"), {"unknown scope", "repeated id"}), ("definitions", ("y", "lost", "", None, 0.5), {"orphan", "definition without term", "definition without scope"}),
    ("retrieval_chunks", ("k1", "full_statute", "lost", None, " ", "embed_special", "", 900, None, None, None, None), {"repeated id", "orphan statute chunk", "empty text", "no input hash", "over the context", "no max_tokens", "no context_window", "no chunking_strategy", "no chunk_version"}),
    ("retrieval_chunks", ("k3", None, None, None, "t", "embed_special", "h", None, 1, 1, "s", "1"), {"orphan chunk", "no token_count"}),
]
CHECKS = audits.SEMANTIC + audits.chunk_checks(500)


def failed(spark, extra):
    tables = {name: spark.createDataFrame(rows + [r for t, r, _ in extra if t == name], columns) for name, (columns, rows) in GOOD.items()}
    return {(r["table"], r["check"]): r["failures"] for r in audits.run_checks(tables, CHECKS).coalesce(1).collect()}


def test_every_check_fires_on_its_defects(spark):
    sound = failed(spark, [])
    assert set(sound.values()) == {0} and len(sound) == len(CHECKS)
    counts = {}
    for table, _, names in BAD:
        for name in names:
            counts[table, name] = counts.get((table, name), 0) + 1
    assert {k: n for k, n in failed(spark, BAD).items() if n} == counts


def test_missing_targets_are_an_error(spark):
    with pytest.raises(ValueError, match="needs legal_text_versions"):
        audits.run_checks({"status_events": spark.createDataFrame([], "version_id string, confidence double")}, audits.SEMANTIC)
    empty = {"session_laws": spark.createDataFrame([], "confidence double")}
    assert [tuple(r) for r in audits.run_checks(empty, audits.SEMANTIC).collect()] == [("session_laws", "invalid confidence", 0)]
