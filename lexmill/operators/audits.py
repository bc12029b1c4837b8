"""Audits: tables of checks over a release's tables, each table read once for all conditions on its rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scopes of definitions, chunks that are embedded, and the tables whose rows say how sure they are.
SCOPES = ["section", "chapter", "range", "article", "corpus", "unknown"]
EMBEDDED = ["embed_primary", "embed_special"]
SURE = ["status_events", "source_notes", "chapter_front_matter", "title_chapter_entries", "chapter_toc_entries", "reserved_ranges", "temporal_effects", "lineage_events", "session_laws", "amendments", "definitions"]


@dataclass(frozen=True)
class Check:
    """What rows of a table must not do. failing: a condition of SQL; unique: a column without repeated values; refers: columns with the table and key that each must be found in.

    One of several references is enough. absent: whether a row may have none of them; a row that has a reference must find it. Where
    `where` is given, only its rows are looked at.
    """

    name: str
    table: str
    failing: str = ""
    unique: str = ""
    refers: tuple[tuple[str, str, str], ...] = ()
    absent: bool = False
    where: str = "true"


def quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


VERSION, PROVISION, IDENTITY, DOCUMENT = ("legal_text_versions", "version_id"), ("provisions", "provision_id"), ("legal_text_identities", "canonical_id"), ("source_documents", "source_document_id")
SEMANTIC = [
    *[Check("invalid confidence", t, failing="confidence < 0 OR confidence > 1 OR isnan(confidence)") for t in SURE],
    Check("status event without version", "status_events", refers=(("version_id", *VERSION),)),
    Check("source note of a lost version", "source_notes", refers=(("version_id", *VERSION),), absent=True),
    Check("source note of a lost provision", "source_notes", refers=(("provision_id", *PROVISION),), absent=True),
    *[Check("orphan", t, refers=(("source_document_id", *DOCUMENT),)) for t in ("html_paragraphs", "chapter_front_matter", "title_chapter_entries")],
    Check("contents entry of a lost identity", "chapter_toc_entries", refers=(("canonical_id", *IDENTITY),), absent=True),
    Check("effect without support", "temporal_effects", refers=(("source_provision_id", *PROVISION), ("version_id", *VERSION)), where="source_note_id IS NULL"),
    Check("lineage without identity", "lineage_events", refers=(("current_canonical_id", *IDENTITY),)),
    Check("repeated id", "defined_terms", unique="defined_term_id"),
    Check("repeated id", "definition_scopes", unique="definition_scope_id"),
    Check("repeated id", "definitions", unique="definition_id"),
    Check("unknown scope", "definition_scopes", failing=f"scope_type IS NULL OR scope_type NOT IN ({quoted(SCOPES)})"),
    Check("orphan", "definitions", refers=(("source_provision_id", *PROVISION),)),
    Check("definition without term", "definitions", failing="coalesce(defined_term_id, '') = ''"),
    Check("definition without scope", "definitions", failing="coalesce(definition_scope_id, '') = ''"),
]


def chunk_checks(context_tokens: int) -> list[Check]:
    """The checks of retrieval chunks for an embedding model that takes so many tokens."""
    eligible = f"embedding_policy IN ({quoted(EMBEDDED)})"
    return [
        Check("repeated id", "retrieval_chunks", unique="chunk_id"),
        Check("orphan statute chunk", "retrieval_chunks", refers=(("parent_version_id", *VERSION),), where="chunk_type = 'full_statute'"),
        Check("orphan chunk", "retrieval_chunks", refers=(("source_provision_id", *PROVISION),), where="coalesce(chunk_type, '') <> 'full_statute'"),
        Check("empty text", "retrieval_chunks", failing="trim(coalesce(text, '')) = ''"),
        Check("no input hash", "retrieval_chunks", failing="coalesce(embedding_input_hash, '') = ''", where=eligible),
        Check("over the context", "retrieval_chunks", failing=f"token_count > {context_tokens}", where=eligible),
        *[Check(f"no {c}", "retrieval_chunks", failing=f"{c} IS NULL", where=eligible) for c in ("token_count", "max_tokens", "context_window", "chunking_strategy", "chunk_version")],
    ]


def outcome(check: Check, failures: Column) -> list[Column]:
    return [F.lit(check.table).alias("table"), F.lit(check.name).alias("check"), failures.alias("failures")]


def conditions(table: DataFrame, checks: list[Check]) -> DataFrame:
    """All conditions on a table's rows in one pass."""
    counts = table.agg(*[F.count(F.when(F.expr(f"({c.where}) AND ({c.failing})"), 1)).alias(f"c{k}") for k, c in enumerate(checks)])
    return counts.select(F.explode(F.array(*[F.struct(*outcome(c, F.col(f"c{k}"))) for k, c in enumerate(checks)])).alias("o")).select("o.*")


def repeats(table: DataFrame, check: Check) -> DataFrame:
    """Rows beyond the first of each value; nulls don't count."""
    extra = table.where(f"({check.where}) AND {check.unique} IS NOT NULL").groupBy(check.unique).agg((F.count("*") - 1).alias("extra"))
    return extra.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n")).select(*outcome(check, F.col("n")))


def orphans(tables: dict[str, DataFrame], check: Check) -> DataFrame:
    """Rows none of whose references is found; rows are counted by their references before they meet the keys."""
    columns = [c for c, _, _ in check.refers]
    rows = tables[check.table].where(check.where).groupBy(*columns).agg(F.count("*").alias("n"))
    if check.absent:
        rows = rows.where(" OR ".join(f"{c} IS NOT NULL" for c in columns))
    for column, target, key in check.refers:
        rows = rows.join(tables[target].select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(*outcome(check, F.col("n")))


def run_checks(tables: dict[str, DataFrame], checks: list[Check]) -> DataFrame:
    """table, check and failures (rows) of each check whose table is given; a target that isn't given is an error. An empty table fails nothing."""
    here = [c for c in checks if c.table in tables]
    parts = []
    for name in dict.fromkeys(c.table for c in here):
        if own := [c for c in here if c.table == name and c.failing]:
            parts.append(conditions(tables[name], own))
    parts += [repeats(tables[c.table], c) for c in here if c.unique]
    for c in here:
        if c.refers:
            if missing := [t for _, t, _ in c.refers if t not in tables]:
                raise ValueError(f"{c.name} of {c.table} needs {', '.join(missing)}")
            parts.append(orphans(tables, c))
    return reduce(DataFrame.unionByName, parts)
