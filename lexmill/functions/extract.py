"""Extraction on columns: mentions of citations, amounts, dates, deadlines, definitions, duties, penalties, taxes, notices, forms, remedies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import first_clause, first_sentence, money_value, normalize_ws, percent_value, stable_id, tidied
from lexmill.operators.loading import spread

SECTION = r"[0-9]{1,3}[A-Z]?\.[0-9]{3,4}"
PINS = r"(?:\s*\([^)]+\))*"
#: Shapes of citations in order of precedence.
RANGE = rf"\bORS\s+({SECTION}){PINS}\s+(?:to|through)\s+({SECTION}){PINS}"
CHAPTER_RANGE = r"\bORS\s+chapters?\s+([0-9]{1,3}[A-Z]?)\s+(?:to|through)\s+([0-9]{1,3}[A-Z]?)\b"
CHAPTER = r"\bORS\s+chapters?\s+([0-9]{1,3}[A-Z]?)\b"
GROUP = rf"\bORS\s+({SECTION}{PINS}(?:\s*(?:,|or|and)\s*{SECTION}{PINS})*)"
#: All shapes in one pattern, which goes over a text once.
MENTION = "(?i)" + "|".join(f"(?:{p})" for p in (RANGE, CHAPTER_RANGE, CHAPTER, GROUP))
#: Texts that a task reads at most on average.
TASK_ROWS = 100_000
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
LONG_DATE = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},\s+[12]\d{{3}}\b"
MONEY = r"\$[0-9][0-9,]*(?:\.\d{2})?"
PERCENT = r"(?i)\b\d+(?:\.\d+)?\s*percent\b"
DURATION = r"(?i)\b(?:within|before|after|on or before|not later than|no later than)\s+[^.;]{1,80}"
OBLIGATION = r"(?i)\b(shall|must|is required to|required to)\b"
ACTION = r"(?i)\b(shall|must|may|is required to|required to|may not)\s+([A-Za-z][^.;]{0,120})"
SCOPE_RANGE = r"(?i)\bAs used in ORS\s+(\d{1,3}\.\d{3,4})\s+to\s+(\d{1,3}\.\d{3,4})\b"
PENALTY_CLASS = r"(?i)\bClass\s+([A-Z])\s+(misdemeanor|felony|violation)\b"
JAIL = r"(?i)\b(?:imprisonment|jail|county jail)[^.]{0,80}\b(?:\d+\s+(?:days?|months?|years?))"
#: What makes a provision a candidate for a definition, an exception, a deadline or a penalty.
CANDIDATES = {
    "Definition": r"(?i)^As used in |(^|[.;]\s+)(as used in (this (section|subsection|paragraph)|ORS [0-9A-Za-z.\s]+)|[^.]{0,80}\bmeans\b|[^.]{0,80}\bincludes\b)",
    "Exception": r"(?i)\b(except as provided|except that|unless|notwithstanding|does not apply|is exempt from)\b|(^|[.;]\s+)subject to\s+(ORS|this |subsection|paragraph|section)",
    "Deadline": r"(?i)\b(no later than|within \d+|not later than|before [A-Z][a-z]+ \d+|after \d+ days|for \d+ days|on or before)\b",
    "Penalty": r"(?i)\b(penalty|punishable|fine|civil penalty|criminal penalty|misdemeanor|felony|contempt|class [a-z] violation)\b",
}
#: Actors in the order in which they are looked for, and the words that begin a condition.
ACTORS = ["landlord", "tenant", "applicant", "department", "Department of Revenue", "Housing and Community Services Department", "Oregon State Lottery", "district board", "district", "county governing body", "city", "electors", "local government", "school district"]
PUBLIC_BODIES = ["department", "lottery", "district", "county", "city", "government"]
CONDITIONS = ["if ", "when ", "unless ", "except as provided", "provided that"]
#: Words in a provision that give it a semantic type.
TYPE_WORDS = {
    "Power": ["shall have the power", "has the power", "power to", "authority to"], "AuthorityGrant": ["shall have the power", "has the power", "power to", "authority to"], "Prohibition": ["may not", "shall not", "must not", "prohibited"],
    "Remedy": ["remedy", "recover damages", "injunctive relief", "may recover"], "TaxRule": ["tax", "assessment", "levy", "rate limit"], "BondAuthority": ["bond", "indebtedness", "debt"], "DistributionRule": ["distribute", "distribution", "fund", "account", "pay over"],
    "RequiredNotice": ["notice", "notify"], "FormText": ["form", "oath", "disclosure", "____"],
}
#: Kinds of taxes by their words, in order.
TAX_TYPES = {"ad valorem": "ad_valorem", "construction tax": "construction", "amusement device": "amusement_device", "income tax": "income", "special tax": "special"}
LIMIT_WORDS = ["may not exceed", "not to exceed", "limit"]


def has_any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words, in any case."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match of a pattern, or a group of it; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def citation_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, mention_id, kind, raw, normalized, canonical_id, start_id, end_id, pins, status and confidence of each citation, each (kind, normalized) once a row.

    A range is one mention; each section of a group is one, with its pins.
    """
    text = F.col(text_col)
    part = lambda m, p, i: F.regexp_extract(m, f"(?i){p}", i)
    none = F.lit(None).cast("string")
    target = lambda p, x: F.concat(F.lit(p), x)
    no_pins = F.array().cast("array<string>")

    def row(kind, raw, key, normal, canonical, start, end, pins, confidence):
        return F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), raw.alias("raw"), key.alias("key"), normal.alias("normalized"), canonical.alias("canonical_id"), start.alias("start_id"), end.alias("end_id"), pins.alias("pins"), F.lit(confidence).alias("confidence"))

    def section(group, m):
        number, pin = F.regexp_extract(m, SECTION, 0), F.trim(F.regexp_replace(m, SECTION, ""))
        pinned = pin != ""
        raw = F.concat(F.lit("ORS "), number, F.when(pinned, F.concat(F.lit(" "), pin)).otherwise(""))
        return row(F.when(pinned, "statute_subsection").otherwise("statute_section"), raw, F.concat(group, F.lit("::"), raw), F.concat(F.lit("ORS "), number, F.replace(pin, F.lit(" "), F.lit(""))), target("or:ors:", number), none, none, F.regexp_extract_all(pin, F.lit(r"\(([^)]+)\)"), F.lit(1)), 0.92)

    def mention(m):
        is_ = lambda p: F.regexp_like(m, F.lit(f"(?i)^{p}"))
        a, b = part(m, RANGE, 1), part(m, RANGE, 2)
        c, d = part(m, CHAPTER_RANGE, 1), part(m, CHAPTER_RANGE, 2)
        e = part(m, CHAPTER, 1)
        chapter = "or:ors:chapter:"
        sections = F.transform(F.regexp_extract_all(m, F.lit(f"(?i){SECTION}{PINS}"), F.lit(0)), lambda s: section(m, s))
        return (
            F.when(is_(RANGE), F.array(row("statute_range", m, m, F.concat(F.lit("ORS "), a, F.lit(" to "), b), none, target("or:ors:", a), target("or:ors:", b), no_pins, 0.94)))
            .when(is_(CHAPTER_RANGE), F.array(row("statute_chapter_range", m, m, F.concat(F.lit("ORS chapters "), c, F.lit(" to "), d), none, target(chapter, c), target(chapter, d), no_pins, 0.9)))
            .when(is_(CHAPTER), F.array(row("statute_chapter", m, m, F.concat(F.lit("ORS chapter "), e), target(chapter, e), none, none, no_pins, 0.9)))
            .otherwise(sections)
        )

    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), mention))
    rows = spread(df).where(F.regexp_like(text, F.lit(r"(?i)\bORS\s"))).select(F.col(id_col), F.posexplode(found).alias("at", "m"))
    first = rows.groupBy(id_col, F.col("m.kind").alias("kind"), F.col("m.normalized").alias("normalized")).agg(F.min_by("m", "at").alias("m"))
    mention_id = F.concat(F.lit("cite:"), stable_id(F.concat_ws("::", F.col(id_col).cast("string"), F.col("m.key"))))
    return first.select(id_col, mention_id.alias("mention_id"), "kind", F.col("m.raw").alias("raw"), "normalized", *[F.col(f"m.{c}").alias(c) for c in ("canonical_id", "start_id", "end_id", "pins", "confidence")], F.lit("parsed_unverified").alias("status"))


def money_amounts(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MONEY), F.lit(0))


def amounts(text: Column) -> Column:
    """Sums and percentages as an array of (text, type, amount, percent, confidence)."""
    none = F.lit(None).cast("double")
    sums = F.transform(money_amounts(text), lambda m: F.struct(m.alias("text"), F.lit("currency").alias("type"), money_value(m).alias("amount"), none.alias("percent"), F.lit(0.82).alias("confidence")))
    shares = F.transform(F.regexp_extract_all(text, F.lit(PERCENT), F.lit(0)), lambda m: F.struct(m.alias("text"), F.lit("percent").alias("type"), none.alias("amount"), percent_value(m).alias("percent"), F.lit(0.78).alias("confidence")))
    return F.concat(sums, shares)


def long_dates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LONG_DATE), F.lit(0))


def iso_date(long_date: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.initcap(F.regexp_replace(long_date, r"\s+", " ")), F.lit("MMMM d, yyyy")), "yyyy-MM-dd")


def actor(text: Column) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(a.lower())), F.lit(a)) for a in ACTORS])


def actor_kind(name: Column) -> Column:
    return F.when(has_any(name, PUBLIC_BODIES), "public_body").when(F.lower(name).isin("landlord", "tenant", "applicant", "electors"), "role")


def modality(text: Column) -> Column:
    """The verb of the first duty, permission or ban."""
    return F.lower(matched(text, ACTION, 1))


def action(text: Column) -> Column:
    """What that verb asks for, up to the end of its clause."""
    return first_clause(matched(text, ACTION, 2))


def is_obligation(text: Column) -> Column:
    return F.regexp_like(text, F.lit(OBLIGATION))


def condition(text: Column) -> Column:
    """The first condition, in the order of the words that begin one."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), first_clause(F.substring(text, F.locate(w, low), F.length(text)))) for w in CONDITIONS])


def duration(text: Column) -> Column:
    return first_clause(matched(text, DURATION))


def deadline_trigger(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(" after ")), first_clause(F.substring(text, F.locate(" after ", low) + 1, F.length(text))))


def deadline_days(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)within\s+([0-9]+)\s+(?:business\s+)?days?", 1).try_cast("int")


def defined_term(text: Column) -> Column:
    """A quoted term, else what stands before `means`."""
    return F.coalesce(matched(text, r'"([^"]{2,120})"', 1), normalize_ws(matched(text, r"(?i)^\s*([A-Za-z][A-Za-z0-9 ,'-]{1,120})\s+means\s+", 1)))


def scope_type(text: Column, headings: Column | None = None) -> Column:
    """Where a definition holds: a range, the chapter, the section or an article."""
    scoped = F.when(F.regexp_like(text, F.lit(SCOPE_RANGE)), "range").when(has_any(text, ["as used in this chapter"]), "chapter").when(has_any(text, ["as used in this section"]), "section")
    return scoped.when(F.exists(headings, lambda h: F.contains(F.lower(h), F.lit("article"))), "article").otherwise("section") if headings is not None else scoped.otherwise("section")


def scope_range(text: Column) -> Column:
    """The canonical ids of the ends of a definition's range; null without one."""
    return F.when(F.regexp_like(text, F.lit(SCOPE_RANGE)), F.struct(*[F.concat(F.lit("or:ors:"), F.regexp_extract(text, SCOPE_RANGE, i)).alias(n) for i, n in ((1, "start"), (2, "end"))]))


def penalty_class(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(PENALTY_CLASS)), F.concat(F.lit("Class "), F.regexp_extract(text, PENALTY_CLASS, 1), F.lit(" "), F.lower(F.regexp_extract(text, PENALTY_CLASS, 2))))


def penalty(text: Column) -> Column:
    """type, amount, maximum, class, civil, jail, suspension, revocation, conduct, citation and detailed of what a text says of a penalty."""
    money, civil = matched(text, MONEY), has_any(text, ["civil penalty"])
    kind = F.when(civil, "civil").when(penalty_class(text).isNotNull() | has_any(text, ["misdemeanor", "felony"]), "criminal").when(has_any(text, ["suspend", "revoke"]), "administrative")
    jail = normalize_ws(matched(text, JAIL))
    suspension, revocation = has_any(text, ["license"]) & has_any(text, ["suspend"]), has_any(text, ["revocation", "revoke"])
    detailed = penalty_class(text).isNotNull() | money.isNotNull() | jail.isNotNull() | suspension | revocation | kind.isNotNull()
    fields = {"type": kind, "amount": money, "maximum": F.when(has_any(text, ["not to exceed", "may not exceed"]), money), "class": penalty_class(text), "civil": F.when(civil, money), "jail": jail, "suspension": F.when(suspension, True), "revocation": F.when(revocation, True), "conduct": first_sentence(text), "citation": matched(text, r"ORS\s+\d{1,3}\.\d{3,4}"), "detailed": detailed}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def after_phrase(text: Column, phrase: str, most: int) -> Column:
    """The clause after a phrase, at most so many characters of it."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit(phrase)), F.left(first_clause(F.substring(text, F.locate(phrase, low) + len(phrase), F.length(text))), F.lit(most)))


def tax_rule(text: Column) -> Column:
    """type, rate, base, cap, recipient and fund of a text about a tax; null for others."""
    kind = F
    for words, name in TAX_TYPES.items():
        kind = kind.when(has_any(text, [words]), name)
    recipient = after_phrase(text, "to the ", 80)
    fields = {"type": kind.otherwise("tax"), "rate": matched(text, PERCENT), "base": after_phrase(text, "of ", 100), "cap": F.when(has_any(text, LIMIT_WORDS), first_sentence(text)), "recipient": F.concat(F.lit("the "), recipient), "fund": normalize_ws(matched(text, r"(?i)\b([A-Z][A-Za-z ]{2,80}\s+Fund)\b", 1))}
    return F.when(has_any(text, ["tax", "assessment", "rate limit", "levy"]), F.struct(*[v.alias(k) for k, v in fields.items()]))


def rate_limit(text: Column) -> Column:
    """type, amount, percent, cap and confidence of a limit: a percentage, else words of one; null for others."""
    share = matched(text, PERCENT)
    kind = F.when(has_any(text, ["bond"]), "bond_cap").when(has_any(text, ["tax"]), "tax_rate_limit").otherwise("percentage_limit")
    shape = lambda t, amount, percent, confidence: F.struct(t.alias("type"), amount.alias("amount"), percent.cast("double").alias("percent"), first_sentence(text).alias("cap"), F.lit(confidence).alias("confidence"))
    return F.when(share.isNotNull(), shape(kind, share, percent_value(share), 0.7)).when(has_any(text, LIMIT_WORDS), shape(F.lit("textual_limit"), matched(text, MONEY), F.lit(None), 0.58))


def required_notice(text: Column) -> Column:
    """type, recipient, sender and trigger of a notice that is asked for or allowed; null for others."""
    asked = has_any(text, ["notice", "notify", "service or delivery"]) & has_any(text, ["shall", "must", "required", "may"])
    return F.when(asked, F.struct(F.when(has_any(text, ["actual notice"]), "actual_notice").otherwise("notice").alias("type"), after_phrase(text, "to ", 80).alias("recipient"), actor(text).alias("sender"), condition(text).alias("trigger")))


def form_type(text: Column) -> Column:
    """What kind of form a text gives; null for others."""
    return F.when(has_any(text, ["form", "substantially the following", "notice must contain", "____"]), F.when(has_any(text, ["notice"]), "notice_template").otherwise("form_text"))


def remedy_type(text: Column) -> Column:
    """What kind of remedy a text gives; null for others."""
    given = has_any(text, ["remedy", "recover damages", "injunctive relief", "may recover", "terminate the rental agreement", "bring an action"])
    return F.when(given, F.when(has_any(text, ["damages", "recover"]), "damages").when(has_any(text, ["injunctive"]), "injunctive_relief").when(has_any(text, ["terminate"]), "termination").otherwise("remedy"))


def is_candidate(kind: str, text: Column, normal: Column | None = None) -> Column:
    """Whether a provision may hold a definition, an exception, a deadline or a penalty. normal: its normalize_ws, if that is at hand."""
    found = F.regexp_like(normalize_ws(text) if normal is None else normal, F.lit(CANDIDATES[kind]))
    return found & ~(F.contains(text, F.lit("civil liability")) & ~F.contains(text, F.lit("civil penalty"))) if kind == "Penalty" else found


def semantic_types(text: Column, candidate: dict[str, Column] | None = None) -> Column:
    """Sorted labels of what a provision holds. candidate: is_candidate of each kind, if that is at hand."""
    low = F.lower(text)
    rules = {"Obligation": is_obligation(text), "Permission": F.contains(low, F.lit(" may ")) | low.startswith("may "), "MoneyAmount": F.regexp_like(text, F.lit(MONEY)), "TimePeriod": F.regexp_like(text, F.lit(DURATION)) | F.regexp_like(text, F.lit(LONG_DATE))}
    rules |= (candidate or {kind: is_candidate(kind, text) for kind in CANDIDATES}) | {kind: has_any(text, words) for kind, words in TYPE_WORDS.items()}
    return F.array_remove(F.array(*[F.when(rules[k], F.lit(k)).otherwise("") for k in sorted(rules)]), "")  # unlike array_compact it runs as compiled code


def semantic_rows(provisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and, in one pass, what each provision says: actor, actor_kind, verb, object, condition, term, scope, scope_range, duration, trigger, penalty, amounts, dates, tax, limit, notice, form, remedy and types. Empty texts are left out."""
    # explode keeps the filter above it; pushed down, it would compute each text several times over
    rows = spread(provisions, TASK_ROWS).select(F.col(id_col).alias("id"), F.explode(F.array(tidied(F.col(text_col)))).alias("t")).where("t <> ''")
    t, candidate = F.col("t"), {kind: F.col(kind) for kind in CANDIDATES}
    # each in a step of its own, so that what several fields ask for is computed once
    rows = rows.select("id", "t", tidied(t).alias("normal"))
    rows = rows.select("id", "t", *[is_candidate(kind, t, F.col("normal")).alias(kind) for kind in CANDIDATES])
    fields = {"actor": actor(t), "actor_kind": actor_kind(actor(t)), "verb": modality(t), "object": action(t), "condition": condition(t), "term": F.when(candidate["Definition"], defined_term(t)), "scope": F.when(candidate["Definition"], scope_type(t)), "scope_range": scope_range(t), "duration": F.when(candidate["Deadline"], duration(t)), "trigger": F.when(candidate["Deadline"], deadline_trigger(t)), "penalty": F.when(candidate["Penalty"], penalty(t))}
    fields |= {"amounts": amounts(t), "dates": long_dates(t), "tax": tax_rule(t), "limit": rate_limit(t), "notice": required_notice(t), "form": form_type(t), "remedy": remedy_type(t), "types": semantic_types(t, candidate)}
    return rows.select("id", *[v.alias(k) for k, v in fields.items()])
