"""Search planning over tables of queries and candidates: normal forms, citations and ranges in queries, intents, filters, hierarchy, boosts, direct hits.

Everything is a column expression, so a log of queries is planned in one pass and candidates are judged where they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import roman_to_int, to_roman
from lexmill.operators.loading import spread

SECTION = r"\d{1,3}[A-Z]?\.\d{3}(?:\([^)]+\))?"
RANGE = r"(?i)\b(?:(ORS|UTCR)\s+)?(\d{1,3}[A-Z]?)\.(\d{3})(?:\([^)]+\))*\s+(?:to|through|thru|-|–)\s+(?:(ORS|UTCR)\s+)?(\d{1,3}[A-Z]?)\.(\d{3})(?:\([^)]+\))*"
CHAPTER = r"(?i)^\s*(?:(ORS|UTCR)\s+)?chapter\s+(\d{1,3}[A-Z]?)\b\s*(.*)$"
ORDINALS = "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth Eleventh Twelfth Thirteenth Fourteenth Fifteenth Sixteenth Seventeenth Eighteenth Nineteenth Twentieth Twenty-First Twenty-Second Twenty-Third Twenty-Fourth Twenty-Fifth Twenty-Sixth Twenty-Seventh".split()
#: Shapes of citations in queries, in the order in which they are looked for.
SHAPES = {
    "state_constitution": r"(?i)\b(?:Or\.?\s+Const\.?|Oregon\s+Constitution)\s+(?:Art(?:icle)?\.?\s+)?([IVXLCDM]+(?:-[A-Z]+(?:\([0-9]+\))?)?|\d+)(?:\s*\((Amended|Original)\))?(?:\s*,?\s*(?:§+|section)\s*([0-9]+[A-Za-z]?))?((?:\([A-Za-z0-9]+\))*)",
    "article": r"(?i)(?<!Const\. )(?<!Constitution )\bArt(?:icle)?\.?\s+([IVXLCDM]+(?:-[A-Z]+(?:\([0-9]+\))?)?|\d+)(?:\s*\((Amended|Original)\))?\s*,?\s*(?:§+|section)\s*([0-9]+[A-Za-z]?)((?:\([A-Za-z0-9]+\))*)",
    "annotation": r"(?i)\b((?:Amdt|Art)[0-9IVXLCDM]+(?:\.[A-Za-z0-9]+)+)",
    "federal_article": r"(?i)\bU\.?\s*S\.?\s+Const\.?\s+art\.?\s+([IVXLCDM]+|\d+)(?:,\s*§+\s*(\d+))?(?:,\s*cl\.?\s*(\d+))?",
    "federal_amendment": r"(?i)\bU\.?\s*S\.?\s+Const\.?\s+amend\.?\s+([IVXLCDM]+|\d+)(?:,\s*§+\s*(\d+))?",
    "named_amendment": rf"(?i)\b({'|'.join(reversed(ORDINALS))})\s+Amendment\b",
    "due_process": r"(?i)\bDue Process Clause\b",
    "section": r"(?i)\b(?:(ORS|UTCR)\s+)?(\d{1,3}[A-Z]?)\.(\d{3})((?:\([A-Za-z0-9]+\))*)",
}
#: Intents in the order in which they are tried; the first pattern that matches decides.
INTENTS = [
    ("citation", r"^(?:ORS|UTCR)\s+\d{1,3}[A-Z]?\.\d{3}(?:\([^)]+\))?$"),
    ("citation", rf"(?i)^(?:Or\.?\s+Const\.?|Oregon\s+Constitution|Article\s+[IVXLCDM]+,?\s+section\s+\d+|U\.?\s*S\.?\s+Const\.?|(?:{'|'.join(ORDINALS)})\s+Amendment|Due Process Clause|(?:Amdt|Art)[A-Za-z0-9.]+)"),
    ("chapter", r"(?i)^(?:(?:ORS|UTCR)\s+)?chapter\s+\d{1,3}[A-Z]?$"),
    ("definition", r"(?i)^definition\s+of|defines?\b|meaning\s+of"),
    ("deadline", r"(?i)deadline|within\s+\d+\s+days|by\s+the\s+\w+\s+day|how long|when must"),
    ("penalty", r"(?i)penalty|fine|misdemeanor|felony|punished\s+by|civil penalty"),
    ("notice", r"(?i)notice|notify|inform\b|written notice"),
    ("actor", r"(?i)landlord|tenant|director|department|public\s+body|must .* do|shall"),
    ("history", r"(?i)operative|effective|amended|repealed|renumbered|session law|current"),
]
#: Words that a conjunctive query leaves out, actors, and what an intent adds to a candidate that has one of its words.
STOPWORDS = ["a", "an", "and", "of", "or", "the", "to"]
ACTOR_TERMS = ["landlord", "tenant", "department", "director", "public body", "revenue"]
INTENT_BOOSTS = {"definition": (1.0, ["definition"]), "deadline": (1.0, ["deadline", "temporal", "notice"]), "penalty": (1.0, ["penalty", "fine"]), "notice": (0.75, ["notice"]), "actor": (0.75, ["obligation", "shall"]), "history": (1.0, ["operative", "effective", "amend", "repeal"])}
REQUIREMENT_KINDS = ["requirednotice", "proceduralrequirement", "formattingrequirement", "filingrequirement", "servicerequirement", "efilingrequirement", "certificateofservicerequirement", "exhibitrequirement", "protectedinformationrequirement"]
EFFECT_KINDS = ["obligation", "exception", "deadline", "penalty", "remedy"]
#: Priorities of kinds when duplicates are folded.
PRIORITIES = {
    10: ["provision", "court_rule_provision", "utcrprovision"], 9: ["statute", "court_rule", "legaltextidentity", "legaltextversion"], 8: ["definition", "definedterm"],
    7: [*EFFECT_KINDS, *REQUIREMENT_KINDS, "taxrule", "moneyamount", "ratelimit", "legalactor", "legalaction"], 6: ["sourcenote", "sessionlaw", "amendment", "temporaleffect"], 5: ["chunk", "retrievalchunk"],
}
#: Kinds that a result type takes besides its own name.
RESULT_KINDS = {
    "statute": ["legaltextidentity", "legaltextversion"], "provision": ["court_rule_provision", "utcrprovision"], "semantic": ["legalsemanticnode", *EFFECT_KINDS, *REQUIREMENT_KINDS],
    "history": ["sourcenote", "source_note", "statusevent", "status_event", "temporaleffect", "temporal_effect", "sessionlaw", "session_law", "amendment"],
    **dict.fromkeys(["court_rule", "courtrule", "rule"], ["court_rule", "courtrule", "utcrrule", "utcrruleversion", "court_rule_provision", "utcrprovision"]), "constitution": ["constitution", "constitution_provision"],
    **dict.fromkeys(["definition", "definedterm"], ["definedterm"]), **dict.fromkeys(["notice", "requirednotice"], ["requirednotice", "required_notice"]),
    **{name: pair for pair in (["source_note", "sourcenote"], ["temporal_effect", "temporaleffect"], ["session_law", "sessionlaw"], ["taxrule", "tax_rule"], ["moneyamount", "money_amount"], ["ratelimit", "rate_limit"]) for name in pair},
    **dict.fromkeys(["legalactor", "legal_actor", "actor"], ["legalactor", "legal_actor"]), **dict.fromkeys(["legalaction", "legal_action", "action"], ["legalaction", "legal_action"]),
}
#: Words in a candidate that stand for a result type.
RESULT_SIGNALS = {"definition": ["definition"], "definedterm": ["definition"], "notice": ["notice"], "requirednotice": ["notice"], **{k: [k] for k in EFFECT_KINDS}}
#: Authority levels and roles of families.
LEVELS = {100: ["USCONST"], 92: ["FEDERALSTATUTE", "USC"], 91: ["ORCONST", "STATECONSTITUTION"], 90: ["ORS"], 84: ["FEDERALRULE", "FRCP", "FRE", "FRAP", "CFR"], 80: ["UTCR", "ORCP", "ORAP", "OAR"], 75: ["SLR", "LOCALRULE"], 65: ["CONAN", "OFFICIALCOMMENTARY"], 60: ["CASELAW"]}
CONSTITUTIONS = ["USCONST", "ORCONST", "STATECONSTITUTION"]
TIERS = [(100, 100, "constitution", 4.0), (91, 99, "statute", 2.8), (84, 90, "statute", 2.2), (75, 83, "rule", 1.4), (65, 74, "official_commentary", 0.8), (60, 64, "case_law", 0.6)]
ROLE_WEIGHTS = {"primary_law": 0.8, "official_commentary": -0.2, "case_law": 0.1}


def cases(rules, otherwise=None) -> Column:
    """The value of the first condition that holds."""
    found = F
    for condition, value in rules:
        found = found.when(condition, value)
    return found.otherwise(otherwise)


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_query(query: Column, family: Column | None = None) -> Column:
    """A query with plain quotes and its citation, range or chapter in normal form; bare numbers belong to the given family."""
    default = F.upper(F.coalesce(F.lit("ORS") if family is None else family, F.lit("ORS")))
    q = F.translate(F.trim(query), "“”‘’", "\"\"''")
    whole = rf"(?i)^\s*(?:(ORS|UTCR)\s+)?({SECTION})\s+(?:to|through|thru|-|–)\s+(?:(ORS|UTCR)\s+)?({SECTION})\s*$"
    part = lambda p, i: F.nullif(F.upper(F.regexp_extract(q, p, i)), F.lit(""))
    authority = F.coalesce(part(whole, 1), part(whole, 3), default)
    ranged = F.concat(authority, F.lit(" "), part(whole, 2), F.lit(" to "), authority, F.lit(" "), part(whole, 4))
    bare = F.concat(default, F.lit(" "), part(rf"(?i)^\s*({SECTION})\s*$", 1))
    chaptered = cases([(part(rf"(?i)^\s*({name})\s+chapter\s+(\d{{1,3}}[A-Z]?)\s*$", 2).isNotNull(), F.concat(F.lit(f"{name} Chapter "), part(rf"(?i)^\s*({name})\s+chapter\s+(\d{{1,3}}[A-Z]?)\s*$", 2))) for name in ("UTCR", "ORS")])
    plain = part(r"(?i)^\s*chapter\s+(\d{1,3}[A-Z]?)\s*$", 1)
    alone = F.concat(F.when(default == "UTCR", "UTCR Chapter ").otherwise("Chapter "), plain)
    cased = q
    for name in ("UTCR", "ORS"):  # the name in capitals before a section
        cased = F.regexp_replace(cased, rf"(?i)\b{name}\s+(?={SECTION})", f"{name} ")
    return F.coalesce(ranged, bare, chaptered, alone, cased)


def all_parts(text: Column, pattern: str, groups: int) -> Column:
    """Every match of a pattern as an array of strings: the match and its groups."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])


def numeral(token: Column) -> Column:
    """The value of a roman or decimal numeral."""
    return F.coalesce(token.try_cast("int"), roman_to_int(token))


def citation(raw, family, normal, base, chapter, parent, subsections=None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.trim(raw).alias("raw"), lit(family).alias("family"), lit(normal).alias("normalized"), lit(base).alias("base"), lit(chapter).alias("chapter"), lit(parent).cast("string").alias("parent"), (F.array().cast("array<string>") if subsections is None else subsections).alias("subsections"))


def labels(text: Column) -> Column:
    """What stands in each pair of brackets."""
    return F.regexp_extract_all(text, F.lit(r"\(([A-Za-z0-9]+)\)"), F.lit(1))


def section_sign(number: Column) -> Column:
    return F.when(number != "", F.concat(F.lit(", § "), number)).otherwise("")


def query_citations(query: Column) -> Column:
    """The citations of a query as an array of (raw, family, normalized, base, chapter, parent, subsections), each normal form once."""

    def state(m):
        article = F.upper(m["g1"])
        variant = F.when(m["g2"] != "", F.concat(F.lit(" ("), F.initcap(m["g2"]), F.lit(")"))).otherwise("")
        base = F.concat(F.lit("Or. Const. art. "), article, variant)
        normal = F.concat(base, section_sign(m["g3"]), m["g4"])
        chapter = F.concat(F.lit("article-"), F.trim(F.regexp_replace(F.lower(F.concat(m["g1"], variant)), "[^a-z0-9]+", " ")))
        return citation(m["g0"], "ORCONST", normal, base, F.replace(chapter, F.lit(" "), F.lit("-")), F.when(m["g3"] != "", F.when(m["g4"] != "", F.concat(base, section_sign(m["g3"]))).otherwise(base)), labels(m["g4"]))

    def annotation(m):
        head = F.regexp_extract(m["g1"], r"(?i)^(Amdt|Art)([^.]*)", 1)
        rest = F.regexp_extract(m["g1"], r"(?i)^(?:Amdt|Art)([^.]*)", 1)
        normal = F.concat(F.initcap(head), F.substring(m["g1"], F.length(head) + 1, F.length(m["g1"])))
        chapter = F.when(F.lower(head) == "amdt", F.concat(F.lit("amendment-"), F.lower(rest))).otherwise(F.concat(F.lit("article-"), F.coalesce(numeral(rest), F.lit(0)).cast("string")))
        return citation(m["g1"], "CONAN", normal, normal, chapter, None)

    def article(m):
        n = F.coalesce(numeral(m["g1"]), F.lit(1))
        base = F.concat(F.lit("U.S. Const. art. "), to_roman(n))
        upto = F.concat(base, section_sign(m["g2"]))
        clause = m["g3"] != ""
        return citation(m["g0"], "USCONST", F.when(clause, F.concat(upto, F.lit(", cl. "), m["g3"])).otherwise(upto), base, F.concat(F.lit("article-"), n.cast("string")), F.when(clause, upto).when(m["g2"] != "", base), F.when(clause, F.array(F.concat(F.lit("clause-"), m["g3"]))).otherwise(F.array().cast("array<string>")))

    def amendment(m):
        n = F.coalesce(numeral(m["g1"]), F.lit(14))
        base = F.concat(F.lit("U.S. Const. amend. "), to_roman(n))
        return citation(m["g0"], "USCONST", F.concat(base, section_sign(m["g2"])), base, F.concat(F.lit("amendment-"), n.cast("string")), F.when(m["g2"] != "", base))

    def named(m):
        n = F.array_position(F.array(*[F.lit(o.lower()) for o in ORDINALS]), F.lower(m["g1"])).cast("int")
        base = F.concat(F.lit("U.S. Const. amend. "), to_roman(n))
        return citation(m["g0"], "USCONST", base, base, F.concat(F.lit("amendment-"), n.cast("string")), None)

    def due_process(m):
        base = F.lit("U.S. Const. amend. XIV")
        return citation(m["g0"], "USCONST", F.concat(base, F.lit(", § 1")), base, "amendment-14", base, F.array(F.lit("due-process")))

    def section(m):
        family = F.when(m["g1"] == "", "ORS").otherwise(F.upper(m["g1"]))
        base = F.concat(family, F.lit(" "), F.upper(m["g2"]), F.lit("."), m["g3"])
        return citation(m["g0"], family, F.concat(base, m["g4"]), base, F.upper(m["g2"]), F.when(m["g4"] != "", base), labels(m["g4"]))

    how = {"state_constitution": (4, state), "article": (4, state), "annotation": (1, annotation), "federal_article": (3, article), "federal_amendment": (2, amendment), "named_amendment": (1, named), "due_process": (0, due_process), "section": (4, section)}
    found = F.concat(*[F.transform(all_parts(query, SHAPES[name], groups), make) for name, (groups, make) in how.items()])
    return F.filter(found, lambda c, i: F.array_position(F.transform(found, lambda x: x["normalized"]), c["normalized"]) == i + 1)


def query_ranges(query: Column) -> Column:
    """The ranges of a query as an array of (raw, family, start, end, chapter); both ends belong to one family and one chapter."""

    def make(m):
        family = F.upper(F.coalesce(F.nullif(m["g1"], F.lit("")), F.nullif(m["g4"], F.lit("")), F.lit("ORS")))
        chapter = F.upper(m["g2"])
        end = lambda number: F.concat(family, F.lit(" "), chapter, F.lit("."), number)
        return F.struct(F.trim(m["g0"]).alias("raw"), family.alias("family"), end(m["g3"]).alias("start"), end(m["g6"]).alias("end"), chapter.alias("chapter"))

    one = F.filter(all_parts(query, RANGE, 6), lambda m: (F.upper(m["g2"]) == F.upper(m["g5"])) & ((m["g1"] == "") | (m["g4"] == "") | (F.upper(m["g1"]) == F.upper(m["g4"]))))
    return F.transform(one, make)


def intent(query: Column) -> Column:
    return cases([(F.regexp_like(query, F.lit(pattern)), name) for name, pattern in INTENTS], "general")


def without(text: Column, raws: Column) -> Column:
    return spaced(F.aggregate(raws, text, lambda t, r: F.replace(t, r, F.lit(" "))))


def plan(queries: DataFrame, query_col: str, family_col: str | None = None) -> DataFrame:
    """queries with normalized, citations, ranges, chapter, family, residual, intent, retrieval (the text to search for), chapter_filter and mode (citation for a bare citation or chapter, else hybrid)."""
    family = F.nullif(F.upper(F.trim(F.col(family_col))), F.lit("")) if family_col else F.lit(None).cast("string")
    named = spread(queries).withColumn("normalized", normalized_query(F.col(query_col), family))
    n = F.col("normalized")
    read = named.withColumns({"ranges": query_ranges(n), "citations": query_citations(n)})
    part = lambda i: F.nullif(F.regexp_extract(n, CHAPTER, i), F.lit(""))
    raws = lambda c: F.transform(c, lambda x: x["raw"])
    first = lambda c, field: F.get(c, F.lit(0))[field]
    prefix, has_ranges, has_citations = F.upper(part(2)), F.size("ranges") > 0, F.size("citations") > 0
    residual = F.nullif(F.coalesce(spaced(part(3)), F.when(has_ranges, without(n, raws("ranges"))).when(has_citations, without(n, raws("citations")))), F.lit(""))
    told = read.withColumns({"residual": residual, "chapter": F.coalesce(prefix, first("ranges", "chapter"), first("citations", "chapter")), "family": F.coalesce(F.upper(part(1)), first("ranges", "family"), first("citations", "family"), family)})
    bare = F.col("residual").isNull()
    found = F.when((has_ranges | has_citations) & bare, "citation").when(prefix.isNotNull() & bare, "chapter").otherwise(intent(F.coalesce("residual", n)))
    full = told.withColumns({"intent": found, "retrieval": F.coalesce("residual", n), "chapter_filter": F.coalesce(prefix, F.when(~bare, F.col("chapter")))})
    return full.withColumn("mode", F.when(F.col("intent").isin("citation", "chapter") & bare, "citation").otherwise("hybrid"))


def mentions_any(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in terms])


def default_result_type(intent_col: Column, chapter_filter: Column) -> Column:
    return F.when(intent_col == "penalty", "penalty").when(intent_col == "definition", F.when(chapter_filter.isNotNull(), "statute").otherwise("definition")).when(intent_col == "history", "history").when(intent_col == "actor", "statute")


def conjunctive_query(query: Column) -> Column:
    """The words of a query joined by AND; null if fewer than two are left or it has operators of its own."""
    words = F.split(F.trim(query), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9.()-]+|[^A-Za-z0-9.()-]+$", ""))
    kept = F.filter(bare, lambda w: (w != "") & ~F.lower(w).isin(STOPWORDS))
    operators = F.exists(words, lambda w: F.upper(w).isin("AND", "OR", "NOT"))
    return F.when(~operators & (F.size(kept) >= 2), F.array_join(kept, " AND "))


def fulltext_query(query: Column, intent_col: Column) -> Column:
    """The conjunctive form for penalties and for actors in tax matters, else the query."""
    tight = (intent_col == "penalty") | ((intent_col == "actor") & mentions_any(query, ["tax", "revenue"]))
    return F.when(tight, F.coalesce(conjunctive_query(query), F.trim(query))).otherwise(query)


def expanded_query(query: Column, terms: Column) -> Column:
    """The query with its lexical expansion and up to five of the given terms of at most 80 characters and 8 words, none twice."""
    sized = F.slice(F.filter(terms, lambda t: (F.trim(t) != "") & (F.length(F.trim(t)) <= 80) & (F.size(F.split(F.trim(t), r"\s+")) <= 8)), 1, 5)
    lexical = F.when(F.contains(F.lower(query), F.lit("habitability")), F.array(F.lit("habitable"))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array(F.trim(query)), lexical, sized)
    low = F.transform(parts, lambda p: F.lower(p))
    return F.trim(F.array_join(F.filter(parts, lambda p, i: (F.trim(p) != "") & (F.array_position(low, F.lower(p)) == i + 1)), " "))


def kind_priority(kind: Column) -> Column:
    return cases([(F.lower(kind).isin(names), p) for p, names in PRIORITIES.items()], 0)


def dedupe_key(provision_id: Column, version_id: Column, canonical_id: Column, citation_: Column, kind: Column, id_: Column) -> Column:
    """What makes two candidates the same: the provision, version or identity that they stand for, a statute's or provision's citation, else the id."""
    named = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    return F.coalesce(named("provision", provision_id), named("version", version_id), named("identity", canonical_id), F.when(kind.isin("statute", "provision"), named("citation", citation_)), named("id", id_.cast("string")))


def semantic_signal(kind: Column, snippet: Column, types: Column, needles: list[str]) -> Column:
    """Whether the kind, the snippet or one of the types holds a needle."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(kind), F.lit(n)) | F.contains(F.lower(snippet), F.lit(n)) | F.exists(types, lambda t: F.contains(F.lower(t), F.lit(n))) for n in needles])


def matches_result_type(result_type: str, kind: Column, snippet: Column, types: Column, family: Column, tier: Column) -> Column:
    """Whether a candidate is of a result type: by its kind, for some types by a word of it, for constitutions by family or tier."""
    wanted = result_type.lower()
    found = F.lower(kind).isin([wanted, *RESULT_KINDS.get(wanted, [])])
    if wanted in RESULT_SIGNALS:
        found = found | semantic_signal(kind, snippet, types, RESULT_SIGNALS[wanted])
    if wanted == "constitution":
        found = found | F.coalesce(F.lower(tier) == "constitution", F.lit(False)) | F.upper(F.coalesce(family, F.lit(""))).isin(CONSTITUTIONS)
    return found


def intent_boost(intent_col: Column, kind: Column, snippet: Column, types: Column) -> Column:
    text = F.lower(F.concat_ws(" ", kind, F.array_join(types, " "), snippet))
    return cases([((intent_col == name) & mentions_any(text, needles), F.lit(value)) for name, (value, needles) in INTENT_BOOSTS.items()], F.lit(0.0))


def with_actor_type(types: Column, intent_col: Column, query: Column, text: Column) -> Column:
    """types with LegalActor, if the intent is an actor that the query names and the candidate names it, too, or states an obligation."""
    named = reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(t)) & F.contains(F.lower(text), F.lit(t)) for t in ACTOR_TERMS])
    fits = (intent_col == "actor") & mentions_any(query, ACTOR_TERMS) & (named | F.exists(types, lambda t: F.lower(t) == "obligation"))
    return F.when(fits, F.array_union(types, F.array(F.lit("LegalActor")))).otherwise(types)


def family_of_citation(citation_: Column) -> Column:
    """The authority family that a citation's form shows."""
    c = F.upper(F.trim(citation_))
    starts = lambda *names: reduce(lambda a, b: a | b, [c.startswith(n) for n in names])
    return cases([(starts("OR. CONST", "OR CONST", "OREGON CONST"), "ORCONST"), (starts("U.S. CONST", "US CONST", "UNITED STATES CONST") | c.contains(" AMENDMENT") | c.contains("DUE PROCESS CLAUSE"), "USCONST"), (starts("CONAN ", "AMDT", "ART"), "CONAN"), (starts("UTCR "), "UTCR"), (starts("ORS "), "ORS")])


def jurisdiction_name(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("us", "federal", "united_states", "united states"), "us").when(v == "local", "local").otherwise("or:state")


def role_name(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("primary", "primary_law", "controlling"), "primary_law").when(v.isin("official_commentary", "commentary", "analysis"), "official_commentary").when(v.isin("case", "case_law", "caselaw"), "case_law").otherwise("secondary")


def tier_name(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return cases([(v.isin("constitution", "constitutional"), "constitution"), (v.isin("statute", "statutes"), "statute"), (v.isin("rule", "rules", "court_rule", "court_rules"), "rule"), (v.isin("official_commentary", "commentary", "analysis"), "official_commentary"), (v.isin("case", "case_law", "caselaw"), "case_law")], "secondary")


def with_hierarchy(candidates: DataFrame) -> DataFrame:
    """candidates (authority_family, citation, authority_level, source_role, jurisdiction_id, corpus_id) with family, level, tier, role, jurisdiction, primary_law, official_commentary and controlling_weight."""
    named = F.coalesce("authority_family", family_of_citation(F.col("citation")), F.lit("secondary"))
    family = F.upper(F.regexp_replace(named, "[^A-Za-z0-9]", ""))
    level = F.coalesce("authority_level", cases([(F.col("family").isin(names), value) for value, names in LEVELS.items()], 30))
    tier = F.when(F.col("family").isin(CONSTITUTIONS), "constitution").otherwise(cases([(F.col("level").between(a, b), name) for a, b, name, _ in TIERS], "secondary"))
    known = [n for value, names in LEVELS.items() if value >= 75 for n in names]
    role = F.when(F.col("source_role").isNotNull(), role_name(F.col("source_role"))).otherwise(cases([(F.col("family").isin(known), "primary_law"), (F.col("family").isin(LEVELS[65]), "official_commentary"), (F.col("family") == "CASELAW", "case_law")], "secondary"))
    federal = F.col("family").isin("USCONST", "CONAN") | F.coalesce(F.col("corpus_id").startswith("us:"), F.lit(False))
    jurisdiction = F.when(F.col("jurisdiction_id").isNotNull(), jurisdiction_name(F.col("jurisdiction_id"))).otherwise(F.when(federal, "us").when(F.col("family").isin(LEVELS[75]), "local").otherwise("or:state"))
    told = candidates.withColumn("family", family).withColumn("level", level).withColumns({"tier": tier, "role": role, "jurisdiction": jurisdiction})
    base = cases([(F.col("level").between(a, b), F.lit(w)) for a, b, _, w in TIERS], F.lit(0.0))
    weight = base + cases([(F.col("role") == r, F.lit(w)) for r, w in ROLE_WEIGHTS.items()], F.lit(-0.4)) + F.when(F.col("jurisdiction") == "us", 0.25).otherwise(0.0)
    return told.withColumns({"primary_law": F.col("role") == "primary_law", "official_commentary": F.col("role") == "official_commentary", "controlling_weight": weight})


def filtered(candidates: DataFrame, family: str | None = None, tier: str | None = None, role: str | None = None, jurisdiction: str | None = None, primary_law: bool = False, official_commentary: bool = False) -> DataFrame:
    """The candidates of with_hierarchy that pass the given filters."""
    kept = [F.lit(True)]
    if family:
        kept.append(F.upper(F.coalesce("authority_family", family_of_citation(F.col("citation")))) == family.upper())
    for column, value, name in (("tier", tier, tier_name), ("role", role, role_name), ("jurisdiction", jurisdiction, jurisdiction_name)):
        if value:
            kept.append(F.col(column) == name(F.lit(value)))
    if primary_law:
        kept.append(F.col("primary_law"))
    if official_commentary:
        kept.append(F.col("official_commentary"))
    return candidates.where(reduce(lambda a, b: a & b, kept))


def rerank_decisions(candidates: DataFrame, plans: DataFrame, policy: str = "low_confidence") -> DataFrame:
    """query_id and rerank: whether a query's candidates (query_id, score) need reranking. plans: query_id, mode, intent, asked (true, false or null)."""
    per = candidates.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    joined = plans.join(per, "query_id", "left")
    sure = (F.col("mode") == "citation") | F.col("intent").isin("citation", "chapter")
    unsure = ~sure & ((F.coalesce("n", F.lit(0)) >= 24) | (F.coalesce("top", F.lit(0.0)) < 4.0))
    return joined.select("query_id", F.coalesce("asked", F.lit(True) if policy == "always" else F.lit(False) if policy == "explicit" else unsure).alias("rerank"))


def direct_open(plans: DataFrame, provisions: DataFrame, statutes: DataFrame) -> DataFrame:
    """query_id, match_type and id of what each planned query opens: the provision of its first citation, else the statute, else the parent's statute.

    plans: query_id and the columns of plan; provisions, statutes: citation, id (of several with a citation the smallest).
    """
    first = F.get("citations", F.lit(0))
    asked = plans.select("query_id", F.lower(F.coalesce(first["normalized"], F.col("normalized"))).alias("wanted"), F.lower(first["parent"]).alias("above"))
    one = lambda df: df.groupBy(F.lower("citation").alias("c")).agg(F.min("id").alias("id"))
    joined = asked
    for name, table, column in (("exact_provision", provisions, "wanted"), ("exact_statute", statutes, "wanted"), ("parent_statute", statutes, "above")):
        joined = joined.join(one(table).withColumnsRenamed({"c": f"c_{name}", "id": name}), F.col(column) == F.col(f"c_{name}"), "left").drop(f"c_{name}")
    names = ("exact_provision", "exact_statute", "parent_statute")
    return joined.select("query_id", cases([(F.col(n).isNotNull(), n) for n in names], "none").alias("match_type"), F.coalesce(*names).alias("id"))


def ranked(candidates: DataFrame) -> DataFrame:
    """One row a query_id and key, by rank: candidates (query_id, key, arm, kind, score, boost) folded as max + 0.35 * max(min, 0) + 0.05 in the order of arms, kind of the highest priority."""
    hits = candidates.groupBy("query_id", "key").agg(F.array_sort(F.collect_list(F.struct("arm", (F.col("score") + F.col("boost")).alias("score"), "kind", kind_priority(F.col("kind")).alias("priority")))).alias("hits"))
    merged = F.aggregate(F.slice("hits", 2, F.size("hits")), F.get("hits", F.lit(0))["score"], lambda acc, h: F.greatest(acc, h["score"]) + 0.35 * F.greatest(F.least(acc, h["score"]), F.lit(0.0)) + 0.05)
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["priority"].alias("priority"), (-h["arm"]).alias("arm"), h["kind"].alias("kind"))))["kind"]
    folded = hits.select("query_id", "key", merged.alias("score"), best.alias("kind"))
    return folded.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key")))
