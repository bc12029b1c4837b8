"""Packs of rules and of concepts: which requirements a pack of work-product rules holds, and which terms a query's words bring with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import stable_id

#: What packs hold requirements by their semantic type, by the end of the pack's id; others hold those that apply to their documents or to all.
TYPED_PACKS = {
    "general_document": ["FormattingRequirement", "CaptionRequirement", "SignatureRequirement", "ProceduralRule"],
    "filing_packet": ["CertificateOfServiceRequirement", "ServiceRequirement", "EfilingRequirement", "ProtectedInformationRequirement", "DeadlineRule"],
}
ANY_DOCUMENT = "court_document"
#: The words that bring a concept's terms into a search, and those terms, in order.
CONCEPTS = {
    "deadlines": (["deadline", "due date", "time to", "within", "days after"], ["deadline", "time limit", "service date", "filing date", "computation of time"]),
    "notices": (["notice", "notify", "serve notice", "written notice"], ["written notice", "service", "mailing", "delivery", "recipient"]),
    "remedies": (["remedy", "damages", "relief", "injunction", "penalty"], ["damages", "equitable relief", "civil penalty", "injunction", "attorney fees"]),
    "definitions": (["define", "definition", "means", "term"], ["means", "includes", "does not include", "defined term", "scope"]),
    "landlord_tenant": (["landlord", "tenant", "rental", "dwelling", "habitability"], ["residential tenancy", "dwelling unit", "habitability", "possession", "rent"]),
    "filing_service": (["file", "filing", "serve", "service", "certificate"], ["filing requirement", "service requirement", "certificate of service", "efiling", "proof of service"]),
    "jurisdiction": (["court", "venue", "jurisdiction", "county", "circuit"], ["subject matter jurisdiction", "venue", "circuit court", "local rule", "statewide rule"]),
}
CONCEPT_SCORE = 0.35


def named(prefix: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.concat(F.lit(f"{prefix}:"), v))


def rule_pack_memberships(packs: DataFrame, requirements: DataFrame) -> DataFrame:
    """membership_id, rule_pack_id and requirement_id of each requirement that a pack holds, once.

    packs: rule_pack_id, work_product_types; requirements: requirement_id, semantic_type, applies_to. A general pack and one for
    filing hold the requirements of their semantic types; any other holds those that apply to one of its types or to every court document.
    Both sides name what they hold or are by keys, so they meet in an equi-join; nulls hold nothing. Few packs have few keys, so
    the packs are broadcast: keyed by them, requirements would meet in one task a key. Requirements are spread by their id instead,
    and pairs are made different where they are.
    """
    keys = named("applies", F.array_append(F.coalesce("work_product_types", F.array().cast("array<string>")), F.lit(ANY_DOCUMENT)))
    keys = F.when(F.size("work_product_types") > 0, keys).otherwise(F.array().cast("array<string>"))
    for end, types in TYPED_PACKS.items():
        keys = F.when(F.endswith("rule_pack_id", F.lit(end)), named("type", F.array(*map(F.lit, types)))).otherwise(keys)
    held = packs.select("rule_pack_id", F.explode(F.array_distinct(keys)).alias("key"))
    own = F.concat(named("applies", F.col("applies_to")), named("type", F.array_compact(F.array("semantic_type"))))
    parts = int(requirements.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that they are not made fewer and larger
    offered = requirements.select("requirement_id", F.array_distinct(F.array_compact(own)).alias("keys")).repartition(parts, "requirement_id").select("requirement_id", F.explode("keys").alias("key"))
    pairs = offered.join(F.broadcast(held), "key").select("rule_pack_id", "requirement_id").distinct()
    return pairs.select(F.concat(F.lit("rule_pack_membership:"), stable_id(F.concat_ws("::", "rule_pack_id", "requirement_id"))).alias("membership_id"), "rule_pack_id", "requirement_id")


def includes_rule_edges(memberships: DataFrame, requirements: DataFrame) -> DataFrame:
    """src (pack), dst (requirement) and type of the memberships whose requirement is there."""
    return memberships.join(requirements.select("requirement_id"), "requirement_id", "left_semi").select(F.col("rule_pack_id").alias("src"), F.col("requirement_id").alias("dst"), F.lit("INCLUDES_RULE").alias("type")).distinct()


def concept_terms(text: Column, limit: int) -> Column:
    """The terms of the concepts whose words a text holds anywhere, as structs (concept, term), in order, at most limit; a null text has none."""
    low = F.lower(text)
    each = []
    for concept, (words, terms) in CONCEPTS.items():
        shown = F.regexp_like(low, F.lit("|".join(words)))
        each.append(F.when(shown, F.array(*[F.struct(F.lit(concept).alias("concept"), F.lit(t).alias("term")) for t in terms])).otherwise(F.array().cast("array<struct<concept:string,term:string>>")))
    return F.slice(F.flatten(F.array(*each)), 1, max(0, limit))


def expand_concepts(queries: DataFrame, id_col: str, text_col: str, limit: int) -> DataFrame:
    """id, place, term, kind, source_id and score of the terms that each query's concepts add, one pass over the queries. A term of two concepts comes twice, as in the limit's count."""
    rows = queries.select(F.col(id_col).alias("id"), F.posexplode(concept_terms(F.col(text_col), limit)).alias("place", "t"))
    return rows.select("id", "place", F.col("t.term").alias("term"), F.lit("legal_concept_pack").alias("kind"), F.concat(F.lit("legal_concept_pack:"), F.col("t.concept")).alias("source_id"), F.lit(CONCEPT_SCORE).alias("score"))
