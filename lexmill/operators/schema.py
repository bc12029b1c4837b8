"""The node kinds of the document graph, how rows become nodes of them, and the edges that their columns make.

An edge rule reads `Kind column > Target EDGE`: nodes of the kind are linked to the targets whose key equals the column; with `<` the
edge runs from the target to the node. The column may be an SQL expression without spaces, `Target.column` names another column
than the target's key, `!` after the edge leaves out nodes without a target, and what follows `?` is a condition on the node.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that don't follow from their kind's name.
KEYS = {
    "CorpusEdition": "edition_id", "LegalCorpus": "corpus_id", "ChapterVersion": "chapter_id", "ChapterHeading": "heading_id", "ChapterFrontMatter": "front_matter_id", "ChapterTocEntry": "toc_entry_id", "HtmlParagraph": "paragraph_id",
    "CourtRulesRegistrySnapshot": "registry_snapshot_id", "CourtRulesRegistrySource": "registry_source_id", "ExternalLegalCitation": "external_citation_id", "LegalTextIdentity": "canonical_id", "LegalTextVersion": "version_id",
    "LegalAction": "action_id", "LegalActor": "actor_id", "LegalSemanticNode": "semantic_id", "ProceduralRequirement": "requirement_id", "RetrievalChunk": "chunk_id", "RuleAuthorityDocument": "authority_document_id",
    "RulePackMembership": "membership_id", "RulePublicationEntry": "publication_entry_id", "WorkProductRulePack": "rule_pack_id", "WorkProductRulePackAuthority": "rule_pack_authority_id",
}
#: Kinds whose key is their name in lower case, words joined by underscores, and _id.
NAMED_KEYS = "Amendment CitationMention Commentary Court Deadline DefinedTerm Definition DefinitionScope EffectiveInterval Exception FormText FormattingProfile Jurisdiction LineageEvent MoneyAmount Obligation ParserDiagnostic Penalty Provision PublicBody RateLimit Remedy ReporterNote RequiredNotice ReservedRange RuleTopic SessionLaw SourceDocument SourceNote SourcePage SourceTocEntry StatusEvent TaxRule TemporalEffect TimeInterval TitleChapterEntry".split()
#: Kinds that a provision expresses and that it supports.
EXPRESSED = "Deadline Exception FormText LegalSemanticNode MoneyAmount Obligation Penalty ProceduralRequirement RateLimit Remedy RequiredNotice TaxRule".split()
#: Semantic types that are labels, too.
SEMANTIC_LABELS = "Obligation Permission Power AuthorityGrant Prohibition Definition Exception Deadline Penalty Remedy MoneyAmount TaxRule BondAuthority DistributionRule RequiredNotice FormText TimePeriod Fee Procedure".split()
REQUIREMENT_LABELS = "ProceduralRule ApplicabilityRule FilingRequirement FormattingRequirement CaptionRequirement SignatureRequirement CertificateOfServiceRequirement ExhibitRequirement ProtectedInformationRequirement EfilingRequirement ServiceRequirement DeadlineRule SanctionRule ExceptionRule MotionRequirement OrderRequirement".split()
AUTHORITY_LABELS = "ChiefJusticeOrder PresidingJudgeOrder SupplementaryLocalRuleEdition OutOfCycleAmendment".split()
#: What an order's title says about its kind.
TITLE_LABELS = {"EmergencyClosureOrder": "emergency.*closure", "FeeOrder": "fees?", "RemoteProceedingOrder": "remote", "CourtOperationsOrder": "court operations", "SecurityScreeningOrder": "security screening", "PretrialReleaseOrder": "pretrial release", "SealingOrder": "seal|landlord tenant"}
#: Labels of provisions and versions by authority family.
PROVISION_LABELS = {"UTCR": ["CourtRuleProvision", "UTCRProvision"], "SLR": ["CourtRuleProvision", "SLRProvision", "SupplementaryLocalRuleProvision"], "ORS": ["ORSProvision"], "USCONST": ["USConstitutionProvision", "ConstitutionProvision", "PrimaryLaw"], "CONAN": ["ConstitutionAnnotatedProvision", "OfficialCommentary"]}
VERSION_LABELS = {"UTCR": ["CourtRule", "UTCRRuleVersion"], "SLR": ["CourtRule", "SLRRuleVersion", "SupplementaryLocalRule"], "ORS": ["ORSSectionVersion"], "USCONST": ["USConstitutionVersion", "Constitution", "PrimaryLaw"], "CONAN": ["ConstitutionAnnotatedVersion", "OfficialCommentary"]}

CHAPTER = "concat('or:ors:chapter:',chapter,'@',edition_year)"
#: The edges that the load of each kind makes.
LOAD_EDGES = f"""
Amendment canonical_id > LegalTextIdentity AFFECTS
Amendment version_id > LegalTextVersion AFFECTS_VERSION
Amendment source_document_id > SourceDocument SUPPORTED_BY
Amendment session_law_id < SessionLaw ENACTS
Amendment source_note_id > SourceNote SUPPORTED_BY
ChapterFrontMatter source_document_id < SourceDocument HAS_FRONT_MATTER
ChapterFrontMatter source_document_id > SourceDocument DERIVED_FROM
ChapterFrontMatter {CHAPTER} < ChapterVersion HAS_FRONT_MATTER
ChapterFrontMatter concat(source_document_id,'#',source_paragraph_order) > HtmlParagraph.concat(source_document_id,'#',order_index) DERIVED_FROM
ChapterTocEntry {CHAPTER} < ChapterVersion HAS_TOC_ENTRY
ChapterTocEntry canonical_id > LegalTextIdentity POINTS_TO
ChapterTocEntry source_document_id > SourceDocument DERIVED_FROM
CorpusEdition corpus_id < LegalCorpus HAS_EDITION !
ChapterVersion edition_id < CorpusEdition HAS_CHAPTER !
CourtRulesRegistrySnapshot registry_source_id < CourtRulesRegistrySource HAS_SNAPSHOT
CourtRulesRegistrySource jurisdiction_id > Jurisdiction APPLIES_TO_JURISDICTION
Court jurisdiction_id > Jurisdiction LOCATED_IN
Court jurisdiction_id < Jurisdiction HAS_COURT
Court judicial_district_id > Jurisdiction PART_OF_JUDICIAL_DISTRICT
Deadline obligation_id > Obligation APPLIES_TO
DefinitionScope target_canonical_id > LegalTextIdentity APPLIES_TO
DefinitionScope target_chapter_id > ChapterVersion APPLIES_TO
Definition source_provision_id < Provision DEFINES
Definition source_provision_id > Provision SUPPORTED_BY
Definition defined_term_id > DefinedTerm DEFINES_TERM
Definition definition_scope_id > DefinitionScope HAS_SCOPE
Exception target_provision_id > Provision EXCEPTION_TO
FormText source_provision_id < Provision HAS_FORM_TEXT
FormattingProfile source_corpus_id > LegalCorpus DERIVED_FROM
HtmlParagraph source_document_id < SourceDocument HAS_PARAGRAPH
HtmlParagraph source_document_id > SourceDocument DERIVED_FROM
Jurisdiction parent_jurisdiction_id > Jurisdiction PART_OF
LegalCorpus jurisdiction_id < Jurisdiction HAS_CORPUS
LineageEvent current_canonical_id < LegalTextIdentity HAS_LINEAGE_EVENT
LineageEvent source_note_id > SourceNote SUPPORTED_BY
Obligation actor_id > LegalActor IMPOSED_ON
Obligation action_id > LegalAction REQUIRES_ACTION
Obligation deadline_id > Deadline HAS_DEADLINE
Obligation exception_id > Exception SUBJECT_TO
Obligation penalty_id > Penalty VIOLATION_PENALIZED_BY
ParserDiagnostic source_document_id > SourceDocument DERIVED_FROM
ParserDiagnostic source_document_id > SourceDocument WARNED_ON
ParserDiagnostic concat(source_document_id,'#',source_paragraph_order) > HtmlParagraph.concat(source_document_id,'#',order_index) WARNED_ON
Penalty obligation_id > Obligation PENALIZES_VIOLATION_OF
RateLimit source_provision_id < TaxRule.source_provision_id HAS_RATE_LIMIT
RequiredNotice source_provision_id < Provision REQUIRES_NOTICE
ReservedRange {CHAPTER} < ChapterVersion HAS_RESERVED_RANGE
ReservedRange source_document_id > SourceDocument DERIVED_FROM
RulePackMembership rule_pack_id > WorkProductRulePack MEMBERSHIP_OF !
RulePackMembership requirement_id > ProceduralRequirement INCLUDES !
RulePackMembership source_provision_id > Provision BASED_ON !
SessionLaw source_document_id > SourceDocument DERIVED_FROM
SessionLaw source_note_id < SourceNote MENTIONS_SESSION_LAW
SourceNote version_id < LegalTextVersion HAS_SOURCE_NOTE
SourceNote version_id > LegalTextVersion ANNOTATES
SourceNote provision_id < Provision HAS_SOURCE_NOTE
SourceNote provision_id > Provision ANNOTATES
SourceNote source_document_id < SourceDocument SOURCE_FOR
SourceNote source_document_id > SourceDocument DERIVED_FROM
SourcePage source_document_id < SourceDocument HAS_PAGE
SourceTocEntry source_document_id < SourceDocument HAS_TOC_ENTRY
StatusEvent canonical_id < LegalTextIdentity HAS_STATUS_EVENT
StatusEvent version_id < LegalTextVersion HAS_STATUS_EVENT
StatusEvent source_document_id > SourceDocument SUPPORTED_BY
StatusEvent source_note_id > SourceNote SUPPORTED_BY
TaxRule source_provision_id > RateLimit.source_provision_id HAS_RATE_LIMIT
TemporalEffect version_id < LegalTextVersion HAS_TEMPORAL_EFFECT
TemporalEffect source_provision_id < Provision HAS_TEMPORAL_EFFECT
TemporalEffect source_provision_id > Provision SUPPORTED_BY
TemporalEffect source_note_id > SourceNote SUPPORTED_BY
TemporalEffect session_law_ref > SessionLaw.citation REFERENCES_SESSION_LAW
TitleChapterEntry source_document_id < SourceDocument HAS_TITLE_CHAPTER_ENTRY
TitleChapterEntry source_document_id > SourceDocument DERIVED_FROM
TitleChapterEntry concat('or:ors:chapter:',chapter_number,'@',edition_year) > ChapterVersion POINTS_TO_CHAPTER
TitleChapterEntry concat(source_document_id,'#',source_paragraph_order) > HtmlParagraph.concat(source_document_id,'#',order_index) DERIVED_FROM
WorkProductRulePackAuthority authority_document_id > RuleAuthorityDocument INCLUDES_AUTHORITY !
WorkProductRulePack source_corpus_id > LegalCorpus DERIVED_FROM
"""
#: The passes over the whole graph.
PASSES = {
    "chunk": """
RetrievalChunk coalesce(source_provision_id,source_id) > Provision DERIVED_FROM ? chunk_type <> 'full_statute'
RetrievalChunk coalesce(source_provision_id,source_id) < Provision HAS_CHUNK ? chunk_type <> 'full_statute'
RetrievalChunk coalesce(source_version_id,parent_version_id,source_id) > LegalTextVersion DERIVED_FROM ? chunk_type = 'full_statute'
RetrievalChunk coalesce(source_version_id,parent_version_id,source_id) < LegalTextVersion HAS_STATUTE_CHUNK ? chunk_type = 'full_statute'
""",
    "citation": """
CitationMention source_provision_id < Provision MENTIONS_CITATION
CitationMention target_canonical_id > LegalTextIdentity RESOLVES_TO
CitationMention target_canonical_id > LegalTextVersion.canonical_id RESOLVES_TO_VERSION
CitationMention target_provision_id > Provision RESOLVES_TO_PROVISION
CitationMention regexp_extract(lower(normalized_citation),'^ors.chapter.([0-9a-z]+)',1) > ChapterVersion.chapter RESOLVES_TO_CHAPTER ? citation_type = 'statute_chapter'
CitationMention external_citation_id > ExternalLegalCitation RESOLVES_TO_EXTERNAL ? resolver_status in ('resolved_external', 'resolved_external_placeholder')
""",
    "court_rules_registry": """
RulePublicationEntry registry_source_id < CourtRulesRegistrySource HAS_ENTRY
RulePublicationEntry registry_snapshot_id < CourtRulesRegistrySnapshot HAS_ENTRY
RulePublicationEntry authority_document_id > RuleAuthorityDocument DESCRIBES
RulePublicationEntry jurisdiction_id > Jurisdiction APPLIES_TO_JURISDICTION
EffectiveInterval authority_document_id < RuleAuthorityDocument EFFECTIVE_DURING
RuleAuthorityDocument supplements_corpus_id > LegalCorpus SUPPLEMENTS ? authority_kind = 'SupplementaryLocalRuleEdition'
RuleAuthorityDocument amends_authority_document_id > RuleAuthorityDocument AMENDS ? authority_kind = 'OutOfCycleAmendment'
""",
    "definition": """
Definition source_provision_id < Provision DEFINES
Definition source_provision_id > Provision SUPPORTED_BY
Definition defined_term_id > DefinedTerm DEFINES_TERM
Definition definition_scope_id > DefinitionScope HAS_SCOPE
DefinitionScope target_canonical_id > LegalTextIdentity APPLIES_TO ? scope_type = 'section'
DefinitionScope target_chapter_id > ChapterVersion APPLIES_TO_CHAPTER ? scope_type = 'chapter'
DefinitionScope target_range_start > LegalTextIdentity APPLIES_TO_RANGE_START ? scope_type in ('range', 'subchapter')
DefinitionScope target_range_end > LegalTextIdentity APPLIES_TO_RANGE_END ? scope_type in ('range', 'subchapter')
""",
    "history": """
SourceNote version_id < LegalTextVersion HAS_SOURCE_NOTE
SourceNote provision_id < Provision HAS_SOURCE_NOTE
SessionLaw source_note_id < SourceNote MENTIONS_SESSION_LAW
Amendment session_law_id < SessionLaw ENACTS
Amendment affected_canonical_id > LegalTextIdentity AFFECTS
Amendment affected_version_id > LegalTextVersion AFFECTS_VERSION
StatusEvent canonical_id < LegalTextIdentity HAS_STATUS_EVENT
StatusEvent version_id < LegalTextVersion HAS_STATUS_EVENT
TemporalEffect version_id < LegalTextVersion HAS_TEMPORAL_EFFECT
TemporalEffect source_note_id > SourceNote SUPPORTED_BY
LineageEvent current_canonical_id < LegalTextIdentity HAS_LINEAGE_EVENT
""",
    "identity_version": """
LegalTextVersion canonical_id < LegalTextIdentity HAS_VERSION
LegalTextVersion canonical_id > LegalTextIdentity VERSION_OF
""",
    "obligation": """
Obligation actor_id > LegalActor IMPOSED_ON
Obligation action_id > LegalAction REQUIRES_ACTION
Obligation deadline_id > Deadline HAS_DEADLINE
Obligation exception_id > Exception SUBJECT_TO
Obligation penalty_id > Penalty VIOLATION_PENALIZED_BY
Exception target_obligation_id > Obligation EXCEPTION_TO
Deadline obligation_id > Obligation APPLIES_TO
Penalty obligation_id > Obligation PENALIZES_VIOLATION_OF
""",
    "source": """
LegalTextVersion source_document_id < SourceDocument SOURCE_FOR
LegalTextVersion source_document_id > SourceDocument DERIVED_FROM
SourcePage source_document_id < SourceDocument HAS_PAGE
SourceNote source_document_id < SourceDocument SOURCE_FOR
SourceNote source_document_id > SourceDocument DERIVED_FROM
SourceNote version_id < LegalTextVersion HAS_SOURCE_NOTE
SourceNote version_id > LegalTextVersion ANNOTATES
""",
    "specialized": """
FormText source_provision_id < Provision HAS_FORM_TEXT
RequiredNotice source_provision_id < Provision REQUIRES_NOTICE
TaxRule source_provision_id > MoneyAmount.source_provision_id HAS_AMOUNT
TaxRule source_provision_id > RateLimit.source_provision_id HAS_RATE_LIMIT
""",
    "structural": """
ChapterVersion edition_id < CorpusEdition HAS_CHAPTER
ChapterVersion concat(chapter,'@',edition_year) > SourceDocument.concat(chapter,'@',edition_year) DERIVED_FROM
ChapterVersion chapter > LegalTextIdentity.chapter HAS_SECTION
ChapterVersion chapter > LegalTextIdentity.chapter HAS_RULE
ChapterVersion chapter > ChapterHeading.chapter HAS_HEADING
""",
    "version_provision": """
Provision version_id < LegalTextVersion CONTAINS
Provision version_id > LegalTextVersion PART_OF_VERSION
""",
}


def key_of(kind: str) -> str:
    """The key column of a kind."""
    if kind in KEYS:
        return KEYS[kind]
    if kind not in NAMED_KEYS:
        raise KeyError(kind)
    return re.sub(r"(?<!^)([A-Z])", r"_\1", kind).lower() + "_id"


KINDS = sorted([*KEYS, *NAMED_KEYS])


@dataclass(frozen=True)
class Rule:
    kind: str
    column: str
    inward: bool
    target: str
    target_column: str
    edge: str
    required: bool
    condition: str | None


def rules(text: str) -> list[Rule]:
    """The edge rules of a text, one a line."""
    found = []
    for line in filter(None, text.splitlines()):
        rule, _, condition = line.partition(" ? ")
        kind, column, way, target, edge, *required = rule.split()
        target, _, target_column = target.partition(".")
        found.append(Rule(kind, column, way == "<", target, target_column or key_of(target), edge, bool(required), condition or None))
    return found


def supports(kinds: list[str]) -> str:
    """The rules by which provisions express nodes and support them."""
    return "\n".join(f"{k} source_provision_id {way}" for k in kinds for way in ("< Provision EXPRESSES", "> Provision SUPPORTED_BY"))


#: Rules by the kind that is loaded, and by pass.
BY_KIND = {kind: [r for r in rules(LOAD_EDGES + supports(EXPRESSED)) if r.kind == kind] for kind in KINDS}
BY_PASS = {name: rules(text) for name, text in PASSES.items()}
BY_PASS["semantic"] = rules(supports([k for k in EXPRESSED if k not in ("FormText", "MoneyAmount", "RateLimit", "RequiredNotice", "TaxRule")]) + "\n" + "\n".join(x for x in LOAD_EDGES.splitlines() if x.startswith(("RulePackMembership", "WorkProductRulePack "))))
BY_PASS["specialized"] += rules(supports(["MoneyAmount", "TaxRule", "RateLimit"]) + "\nFormText source_provision_id > Provision SUPPORTED_BY\nRequiredNotice source_provision_id > Provision SUPPORTED_BY")


def labels_of(kind: str, columns: list[str]) -> Column:
    """The labels of a kind's nodes: its own, and those that their type, authority or title gives."""
    extra = []
    if "semantic_type" in columns and kind in ("LegalSemanticNode", "ProceduralRequirement"):
        extra.append(F.when(F.col("semantic_type").isin(SEMANTIC_LABELS if kind == "LegalSemanticNode" else REQUIREMENT_LABELS), F.array("semantic_type")))
    if kind in EXPRESSED and kind not in ("LegalSemanticNode", "ProceduralRequirement"):
        extra.append(F.array(F.lit("LegalSemanticNode")))
    if kind in ("Provision", "LegalTextVersion"):
        extra.append(F.array(F.lit("LegalAuthorityUnit" if kind == "Provision" else "LegalAuthority")))
        family = F.coalesce("authority_family", F.lit("ORS")) if "authority_family" in columns else F.lit("ORS")
        for name, labels in (PROVISION_LABELS if kind == "Provision" else VERSION_LABELS).items():
            extra.append(F.when(family == name, F.array(*map(F.lit, labels))))
    if kind == "RuleAuthorityDocument":
        if "authority_kind" in columns:
            extra.append(F.when(F.col("authority_kind").isin(AUTHORITY_LABELS), F.array("authority_kind")))
        if "title" in columns:
            extra += [F.when(F.regexp_like("title", F.lit(f"(?i)({pattern})")), F.array(F.lit(label))) for label, pattern in TITLE_LABELS.items()]
    return F.concat(F.array(F.lit(kind)), *[F.coalesce(e, F.array().cast("array<string>")) for e in extra])


def load(kind: str, rows: DataFrame, order: Column, tables: dict[str, DataFrame], old: DataFrame | None = None) -> DataFrame:
    """Nodes of a kind: the last row of each key by `order`, with `labels`. Rows without a key, or without a target that a rule requires, are left out.

    old: nodes loaded before; their values stay where the new row has none, and nodes without a new row stay.
    """
    key = key_of(kind)
    rest = [c for c in rows.columns if c != key]
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    for rule in BY_KIND[kind]:
        if rule.required:
            known = tables[rule.target].select(F.expr(rule.target_column).alias("__k")).distinct()
            last = last.join(known, F.expr(rule.column) == F.col("__k"), "left_semi")
    if old is not None:
        before = old.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in rest if c in old.columns])
        joined = last.join(before, F.col(key) == F.col("__key"), "full_outer")
        last = joined.select(F.coalesce(key, "__key").alias(key), *[F.coalesce(c, f"__{c}").alias(c) if c in old.columns else F.col(c) for c in rest])
    return last.withColumn("labels", labels_of(kind, last.columns))


def edges(found: list[Rule], tables: dict[str, DataFrame], without: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """src, type and dst of the edges that rules make between the given nodes, each once. Rules of tables that aren't given are passed over; one that names a column that its table lacks is an error, unless without lists its (kind, edge)."""
    parts = []
    for r in found:
        if r.kind not in tables or r.target not in tables:
            continue
        nodes, targets = tables[r.kind], tables[r.target]
        if (r.kind, r.edge) in without:
            continue
        if lacking := set(re.findall(r"\b[a-z_]+\b(?!\()", re.sub(r"'[^']*'", "", f"{r.column} {r.condition or ''}"))) - {"in"} - set(nodes.columns):
            raise ValueError(f"{r.kind} lacks {', '.join(sorted(lacking))} for {r.edge}")
        nodes = nodes.where(r.condition) if r.condition else nodes
        left = nodes.select(F.col(key_of(r.kind)).cast("string").alias("a"), F.expr(r.column).cast("string").alias("k"))
        right = targets.select(F.col(key_of(r.target)).cast("string").alias("b"), F.expr(r.target_column).cast("string").alias("t"))
        pair = ("b", "a") if r.inward else ("a", "b")
        parts.append(left.join(right, F.col("k") == F.col("t")).select(F.col(pair[0]).alias("src"), F.lit(r.edge).alias("type"), F.col(pair[1]).alias("dst")))
    return reduce(DataFrame.union, parts).distinct()


def first_target(nodes: DataFrame, kind: str, targets: list[tuple[str, str, DataFrame]], inward: list[str], outward: list[str]) -> DataFrame:
    """Edges between nodes and the first of several targets that exists: (column, target kind, targets) by precedence."""
    joined, present = nodes, []
    for i, (column, target, table) in enumerate(targets):
        known = table.select(F.col(key_of(target)).alias(f"__t{i}")).distinct()
        joined = joined.join(known, F.col(column) == F.col(f"__t{i}"), "left")
        present.append(F.col(f"__t{i}").cast("string"))
    one = joined.select(F.col(key_of(kind)).cast("string").alias("n"), F.coalesce(*present).alias("t")).where(F.col("t").isNotNull())
    ways = F.array(*[F.struct(F.col("t").alias("src"), F.lit(e).alias("type"), F.col("n").alias("dst")) for e in inward], *[F.struct(F.col("n").alias("src"), F.lit(e).alias("type"), F.col("t").alias("dst")) for e in outward])
    return one.select(F.explode(ways).alias("e")).select("e.*").distinct()


def provenance(tables: dict[str, DataFrame]) -> DataFrame:
    """Edges from provisions and mentions to the documents and pages that they come from, through their versions."""
    versions = tables["LegalTextVersion"].select("version_id", "source_document_id")
    provisions = tables["Provision"].select("provision_id", "version_id", "source_page_start").join(versions, "version_id")
    mentions = tables["CitationMention"].select("citation_mention_id", F.col("source_provision_id").alias("provision_id")).join(provisions.select("provision_id", "source_document_id"), "provision_id")
    documents = tables["SourceDocument"].select("source_document_id").distinct()
    pages = tables["SourcePage"].select("source_page_id", "source_document_id", F.col("page_number").alias("source_page_start"))
    edge = lambda a, kind, b: F.struct(F.col(a).cast("string").alias("src"), F.lit(kind).alias("type"), F.col(b).cast("string").alias("dst"))
    told = provisions.join(documents, "source_document_id", "left_semi").select(F.explode(F.array(edge("source_document_id", "SOURCE_FOR", "provision_id"), edge("provision_id", "DERIVED_FROM", "source_document_id"))).alias("e"))
    cited = mentions.join(documents, "source_document_id", "left_semi").select(edge("source_document_id", "SOURCE_FOR", "citation_mention_id").alias("e"))
    paged = provisions.join(pages, ["source_document_id", "source_page_start"]).select(F.explode(F.array(edge("provision_id", "APPEARS_ON_PAGE", "source_page_id"), edge("source_page_id", "CONTAINS_TEXT", "provision_id"))).alias("e"))
    return told.union(cited).union(paged).select("e.*").distinct()


def publishers(documents: DataFrame) -> DataFrame:
    """The public body that publishes each source document, by its authority family."""
    family = F.col("authority_family")
    body = F.when(family.isin("USCONST", "CONAN"), "us:library_of_congress").when(family == "UTCR", "or:judicial_department").otherwise("or:legislature")
    return documents.select(body.alias("src"), F.explode(F.array(F.lit("PUBLISHED"), F.lit("PUBLISHES"))).alias("type"), F.col("source_document_id").alias("dst"))


def listed_edges(nodes: DataFrame, kind: str, column: str, target: str, targets: DataFrame, edge: str) -> DataFrame:
    """Edges from nodes to each of the targets that an array column lists."""
    each = nodes.select(F.col(key_of(kind)).cast("string").alias("src"), F.explode(column).alias("k"))
    known = targets.select(F.col(key_of(target)).alias("t")).distinct()
    return each.join(known, F.col("k") == F.col("t"), "left_semi").select("src", F.lit(edge).alias("type"), F.col("k").cast("string").alias("dst")).distinct()


def chapter_versions(versions: DataFrame) -> DataFrame:
    """The chapters of versions, once each: id, citation, corpus, edition, type, level and jurisdiction by authority family, and one of its titles."""
    family = F.coalesce("authority_family", F.lit("ORS"))
    year = F.col("edition_year").cast("string")
    corpus = F.coalesce("corpus_id", F.when(family == "UTCR", "or:utcr").when(family == "SLR", "or:linn:slr").otherwise("or:ors"))
    named = versions.select(family.alias("authority_family"), "chapter", "edition_year", "title", corpus.alias("corpus_id"), F.coalesce("edition_id", F.concat(corpus, F.lit("@"), year)).alias("edition_id"), F.coalesce("authority_type", F.when(family.isin("UTCR", "SLR"), "court_rule").otherwise("statute")).alias("authority_type"), F.coalesce("authority_level", F.when(family == "UTCR", 80).when(family == "SLR", 75).otherwise(90)).alias("authority_level"))
    one = named.groupBy("authority_family", "corpus_id", "chapter", "edition_year").agg(F.min("title").alias("title"), F.min("edition_id").alias("edition_id"), F.min("authority_type").alias("authority_type"), F.min("authority_level").alias("authority_level"))
    slr, rules_ = F.col("authority_family") == "SLR", F.col("authority_family").isin("UTCR", "SLR")
    prefix = F.when(F.col("authority_family") == "UTCR", "or:utcr").when(slr, F.col("corpus_id")).otherwise("or:ors")
    place = F.concat(F.lit(":chapter:"), F.col("chapter"), F.lit("@"), F.col("edition_year").cast("string"))
    return one.select(F.concat(prefix, place).alias("chapter_id"), F.concat(F.when(rules_, F.col("authority_family")).otherwise("ORS"), F.lit(" Chapter "), F.col("chapter")).alias("citation"), *one.columns, F.when(slr, F.substring_index("corpus_id", ":slr", 1)).otherwise("or:state").alias("jurisdiction_id"), F.when(rules_, "official_pdf").otherwise("official_online_not_official_print").alias("official_status"))
