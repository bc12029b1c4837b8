"""Queries that load every kind of node and make its edges, from rows that the test tables' keys give."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lexmill.operators import schema
from lexmill.plans.registry import Registry

query = Registry()
#: Kinds whose columns hold only keys of other kinds, by the family that loads them.
FAMILIES = {
    "load_sources": ["SourceDocument", "SourcePage", "SourceTocEntry", "SourceNote", "HtmlParagraph", "ReporterNote", "Commentary", "TitleChapterEntry", "ParserDiagnostic", "ExternalLegalCitation"],
    "load_texts": ["LegalTextIdentity", "LegalTextVersion", "Provision", "CitationMention", "RetrievalChunk", "ChapterVersion", "ChapterHeading", "ChapterTocEntry", "ChapterFrontMatter", "ReservedRange"],
    "load_places": ["Jurisdiction", "Court", "PublicBody", "LegalCorpus", "CorpusEdition", "FormattingProfile"],
    "load_semantics": ["LegalSemanticNode", "Obligation", "Exception", "Deadline", "Penalty", "Remedy", "LegalActor", "LegalAction", "TaxRule", "RateLimit", "MoneyAmount", "FormText", "RequiredNotice"],
    "load_definitions": ["DefinedTerm", "Definition", "DefinitionScope"],
    "load_history": ["SessionLaw", "Amendment", "StatusEvent", "TemporalEffect", "LineageEvent", "TimeInterval", "EffectiveInterval"],
    "load_rules": ["CourtRulesRegistrySource", "CourtRulesRegistrySnapshot", "RulePublicationEntry", "RuleAuthorityDocument", "RuleTopic", "ProceduralRequirement", "WorkProductRulePack", "WorkProductRulePackAuthority", "RulePackMembership"],
}


def plain(rule: schema.Rule) -> bool:
    """Whether a rule is from a column to the target's key."""
    return bool(re.fullmatch("[a-z_]+", rule.column)) and rule.target_column == schema.key_of(rule.target)


def step(column: str) -> int:
    """A number that tells columns apart, so that they don't all name the same target."""
    return sum(map(ord, column)) % 7 + 2


def all_rules() -> list[schema.Rule]:
    return [r for found in (*schema.BY_KIND.values(), *schema.BY_PASS.values()) for r in found if plain(r)]


def rows_of(t, kind: str):
    """Rows of a kind, some of them twice: each column names a target by a number that may not be there."""
    k = F.col("s_suppkey")
    columns = {r.column: r.target for r in all_rules() if r.kind == kind and r.column != schema.key_of(kind)}
    twice = t("supplier").select(k, F.explode(F.array(F.lit(0), F.lit(1))).alias("seq")).where("seq = 0 or s_suppkey % 3 = 0")
    named = [F.concat(F.lit(f"{target}:"), ((k * step(c) + F.col("seq") * 5) % 120).cast("string")).alias(c) for c, target in columns.items()]
    return twice.select(F.concat(F.lit(f"{kind}:"), k.cast("string")).alias(schema.key_of(kind)), *named, "seq")


def nodes_sql(kind: str, column: str) -> str:
    """The last rows of a kind and the target that one of its columns names."""
    target = next(r.target for r in all_rules() if r.kind == kind and r.column == column)
    return f"SELECT '{kind}:' || s_suppkey AS n, '{target}:' || ((s_suppkey * {step(column)} + CASE WHEN s_suppkey % 3 = 0 THEN 5 ELSE 0 END) % 120) AS t FROM supplier"


def edges_sql(found: list[schema.Rule]) -> str:
    """The edges of rules over rows_of, each by its own join."""
    parts = []
    for r in found:
        inner = nodes_sql(r.kind, r.column)
        for other in schema.BY_KIND[r.kind]:
            if other.required:
                inner = f"SELECT q.* FROM ({inner}) q SEMI JOIN (SELECT n FROM ({nodes_sql(other.kind, other.column)}) JOIN supplier ON t = '{other.target}:' || s_suppkey) USING (n)"
        a, b = ("t", "n") if r.inward else ("n", "t")
        parts.append(f"SELECT {a} AS src, '{r.edge}' AS type, {b} AS dst FROM ({inner}) JOIN supplier ON t = '{r.target}:' || s_suppkey")
    return "\nUNION ".join(parts)


def loaded(t, kinds):
    """Nodes of kinds, and rows of all that they refer to. Targets that are required in turn are taken as they come."""
    needed = {*kinds, *(r.target for k in kinds for r in schema.BY_KIND[k])}
    tables = {k: rows_of(t, k) for k in needed}
    return {k: schema.load(k, tables[k], F.col("seq"), tables) for k in kinds}, tables


def register_load(name: str, kinds: list[str]) -> None:
    found = [r for k in kinds for r in schema.BY_KIND[k] if plain(r)]
    if not found:
        raise ValueError(name)

    def build(t):
        nodes, tables = loaded(t, kinds)
        return schema.edges(found, tables | nodes)

    build.__name__, build.__doc__ = name, f"Edges of the nodes loaded as {', '.join(kinds)}."
    query("\nUNION ".join(edges_sql_over(kinds, found)))(build)


def edges_sql_over(kinds, found):
    """edges_sql where nodes of the loaded kinds need their required targets on both ends."""
    for r in found:
        sql = edges_sql([r])
        own = [o for o in schema.BY_KIND[r.target] if o.required] if r.target in kinds else []
        for o in own:
            side = "src" if r.inward else "dst"
            sql = f"SELECT e.* FROM ({sql}) e SEMI JOIN (SELECT n FROM ({nodes_sql(o.kind, o.column)}) JOIN supplier ON t = '{o.target}:' || s_suppkey) ON e.{side} = n"
        yield sql


def register_pass(name: str) -> None:
    found = [r for r in schema.BY_PASS[name] if plain(r) and not r.condition]

    def build(t):
        kinds = {k for r in found for k in (r.kind, r.target)}
        return schema.edges(found, {k: newest(rows_of(t, k), k) for k in kinds})

    build.__name__, build.__doc__ = f"edges_{name}", f"The {name} pass over the whole graph."
    query(edges_sql_unrequired(found))(build)


def newest(rows, kind):
    """The last row of each key, whatever it refers to."""
    key = schema.key_of(kind)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*")


def edges_sql_unrequired(found):
    parts = []
    for r in found:
        a, b = ("t", "n") if r.inward else ("n", "t")
        parts.append(f"SELECT {a} AS src, '{r.edge}' AS type, {b} AS dst FROM ({nodes_sql(r.kind, r.column)}) JOIN supplier ON t = '{r.target}:' || s_suppkey")
    return "\nUNION ".join(parts)


for _name, _kinds in FAMILIES.items():
    register_load(_name, _kinds)
for _name in schema.BY_PASS:
    if any(plain(r) and not r.condition for r in schema.BY_PASS[_name]):
        register_pass(_name)


@query("SELECT kind || ':' || s_suppkey AS node, kind AS label FROM supplier, (SELECT unnest([" + ", ".join(f"'{k}'" for k in schema.KINDS if not any(r.required for r in schema.BY_KIND[k])) + "]) AS kind)")
def loaded_nodes(t):
    """Every kind's nodes, each key once, and their first label."""
    kinds = [k for k in schema.KINDS if not any(r.required for r in schema.BY_KIND[k])]
    nodes, _ = loaded(t, kinds)
    parts = [nodes[k].select(F.col(schema.key_of(k)).alias("node"), F.get("labels", F.lit(0)).alias("label")) for k in kinds]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found
