"""Every query over the test tables, by name, and the SQL that each must equal."""

from __future__ import annotations

from lexmill.plans import audit_reports, cases, comparisons, details, fielded_search, graphs, markdown_forms, paged_answers, patches, planned, quality, resolution, retrieval, schemas, statutes, texts, vector_cells, vicinity

MODULES = (retrieval, graphs, quality, texts, cases, resolution, schemas, planned, details, statutes, vicinity, fielded_search, patches, markdown_forms, comparisons, vector_cells, paged_answers, audit_reports)
FLAGSHIP = "hybrid_search"
QUERIES = {name: q for module in MODULES for name, q in module.query.queries.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.query.sql.items()}
