"""Text, extraction and chunking queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import extract, history, text
from lexmill.operators import chunking, provisions as provision_trees
from lexmill.plans.registry import Registry
from lexmill.sources import pages

query = Registry()
#: Provisions with a chapter, a section, an amount and a number of days.
PROVISIONS = [
    "Under ORS {c}.{s} through {c}.{s}, the landlord shall pay ${p} within {d} days after notice, unless waived.",
    "ors {c}.{s} (1)(a), {c}.{s} or {d}.010 applies; the tenant may not refuse the department entry.",
    "The tax under ORS chapter {c} may not exceed {d} percent of the assessed value.",
    'As used in ORS {c}.001 to {c}.{s}, "dwelling" means a unit.',
    "A person who violates ORS chapters {c} to {d} commits a Class A misdemeanor and owes a civil penalty not to exceed ${p}.",
    "The applicant must use the form on or before January {d}, 2021, if the landlord may recover damages.",
]
QUOTED = ", ".join("'" + p.replace("'", "''") + "'" for p in PROVISIONS)
PROVISION = f"(SELECT o_orderkey AS id, replace(replace(replace(replace([{QUOTED}][o_orderkey % {len(PROVISIONS)} + 1], '{{c}}', (o_custkey % 90 + 10)::VARCHAR), '{{s}}', lpad((o_custkey % 1000)::VARCHAR, 3, '0')), '{{p}}', (o_totalprice::BIGINT)::VARCHAR), '{{d}}', (o_custkey % 28 + 1)::VARCHAR) AS t FROM orders)"
SECTION = r"[0-9]{1,3}\.[0-9]{3,4}(?:\s*\([^)]+\))*"


def provisions(t):
    n = lambda c: c.cast("string")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = F.get(F.array(*[F.lit(p) for p in PROVISIONS]), (key % len(PROVISIONS)).cast("int"))
    for name, value in (("{c}", n(cust % 90 + 10)), ("{s}", F.lpad(n(cust % 1000), 3, "0")), ("{p}", n(F.rint("o_totalprice").cast("long"))), ("{d}", n(cust % 28 + 1))):
        body = F.replace(body, F.lit(name), value)
    return t("orders").select(key.alias("id"), body.alias("t"))


@query(
    rf"""WITH p AS (SELECT id, t FROM {PROVISION}), r AS (SELECT id, unnest(regexp_extract_all(t, '(?i)\bORS\s+{SECTION}\s+(?:to|through)\s+{SECTION}')) AS m FROM p),
    g AS (SELECT id, unnest(regexp_extract_all(regexp_replace(t, '(?i)\bORS\s+{SECTION}\s+(?:to|through)\s+{SECTION}', ' ', 'g'), '(?i)\bORS\s+{SECTION}(?:\s*(?:,|or|and)\s*{SECTION})*')) AS m FROM p),
    s AS (SELECT id, unnest(regexp_extract_all(m, '{SECTION}')) AS m FROM g)
    SELECT id, 'statute_range' AS kind, 'ORS ' || regexp_extract_all(m, '[0-9]+\.[0-9]+')[1] || ' to ' || regexp_extract_all(m, '[0-9]+\.[0-9]+')[2] AS normalized FROM r
    UNION SELECT id, CASE WHEN contains(m, '(') THEN 'statute_subsection' ELSE 'statute_section' END, 'ORS ' || replace(m, ' ', '') FROM s
    UNION SELECT id, 'statute_chapter_range', 'ORS chapters ' || regexp_extract(t, 'ORS chapters ([0-9]+) to ([0-9]+)', 1) || ' to ' || regexp_extract(t, 'ORS chapters ([0-9]+) to ([0-9]+)', 2) FROM p WHERE regexp_matches(t, 'ORS chapters')
    UNION SELECT id, 'statute_chapter', regexp_extract(t, 'ORS chapter [0-9]+') FROM p WHERE regexp_matches(t, 'ORS chapter ')"""
)
def citation_mentions(t):
    """Ranges, groups of sections, subsections and chapters."""
    return extract.citation_mentions(provisions(t), "id", "t").select("id", "kind", "normalized")


@query(
    rf"""WITH p AS (SELECT id, t, lower(t) AS l FROM {PROVISION})
    SELECT id, CASE WHEN contains(l, 'landlord') THEN 'landlord' WHEN contains(l, 'tenant') THEN 'tenant' WHEN contains(l, 'applicant') THEN 'applicant' WHEN contains(l, 'department') THEN 'department' END AS actor,
      nullif(lower(regexp_extract(t, '(?i)\b(shall|must|may|is required to|required to|may not)\s+[A-Za-z]', 1)), '') AS verb, CASE WHEN contains(l, 'unless ') THEN 'unless waived' WHEN contains(l, 'if ') THEN 'if the landlord may recover damages' END AS condition,
      try_cast(replace(regexp_extract(t, '\$[0-9]+'), '$', '') AS DOUBLE) AS amount, CASE WHEN regexp_matches(l, 'january') THEN '2021-01-' || lpad(regexp_extract(t, 'January ([0-9]+)', 1), 2, '0') END AS date,
      CASE WHEN regexp_matches(l, '\bmeans\b|^as used in') THEN regexp_extract(t, '"([^"]+)"', 1) END AS term, CASE WHEN contains(l, 'civil penalty') THEN 'civil' WHEN contains(l, 'misdemeanor') THEN 'criminal' END AS penalty,
      CASE WHEN contains(l, 'tax') OR contains(l, 'assess') AND contains(l, 'assessment') THEN 'tax' END AS tax, CASE WHEN contains(l, 'form') THEN 'form_text' END AS form, CASE WHEN contains(l, 'may recover') THEN 'damages' END AS remedy,
      array_to_string(list_sort([x FOR x IN [CASE WHEN regexp_matches(l, '\b(shall|must)\b') THEN 'Obligation' END, CASE WHEN contains(l, ' may ') THEN 'Permission' END, CASE WHEN contains(l, 'may not') THEN 'Prohibition' END, CASE WHEN regexp_matches(l, '\bmeans\b') OR l LIKE 'as used in%' THEN 'Definition' END,
        CASE WHEN contains(l, 'unless') THEN 'Exception' END, CASE WHEN regexp_matches(l, 'within [0-9]|on or before') THEN 'Deadline' END, CASE WHEN regexp_matches(l, '\b(penalty|misdemeanor)\b') THEN 'Penalty' END, CASE WHEN contains(l, 'may recover') THEN 'Remedy' END,
        CASE WHEN regexp_matches(t, '\$[0-9]') THEN 'MoneyAmount' END, CASE WHEN contains(l, 'tax') THEN 'TaxRule' END, CASE WHEN contains(l, 'notice') THEN 'RequiredNotice' END, CASE WHEN contains(l, 'form') THEN 'FormText' END, CASE WHEN regexp_matches(l, '\b(within|before|after)\s|on or before') THEN 'TimePeriod' END] IF x IS NOT NULL]), ',') AS types FROM p"""
)
def semantic_rows(t):
    """What each provision says: actor, verb, condition, amount, date, term, penalty, tax, form, remedy and types."""
    rows = extract.semantic_rows(provisions(t), "id", "t")
    date = extract.iso_date(F.get("dates", F.lit(0)))
    return rows.select("id", "actor", "verb", "condition", F.get("amounts", F.lit(0))["amount"].alias("amount"), "term", F.col("penalty.type").alias("penalty"), F.col("tax.type").alias("tax"), "form", "remedy", F.array_join("types", ",").alias("types"), date.alias("date"))


@query(
    r"""SELECT doc_id, 'sha256:' || sha256(text) AS hash, left(sha256(text), 16) AS id, ceil(length(text) / 5.2)::BIGINT AS n_tokens,
    regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN length(text) > 30 THEN left(text, 30) || '…' ELSE text END AS preview FROM documents"""
)
def text_identifiers(t):
    x = F.col("text")
    return t("documents").select("doc_id", text.sha256_hex(x).alias("hash"), text.stable_id(x).alias("id"), text.estimate_tokens(x).alias("n_tokens"), text.slug(x).alias("slug"), text.preview(x, 30).alias("preview"))


@query(
    """WITH d(i, r) AS (VALUES (0,''),(1,'I'),(2,'II'),(3,'III'),(4,'IV'),(5,'V'),(6,'VI'),(7,'VII'),(8,'VIII'),(9,'IX')),
    tens(i, r) AS (VALUES (0,''),(1,'X'),(2,'XX'),(3,'XXX'),(4,'XL'),(5,'L'),(6,'LX'),(7,'LXX'),(8,'LXXX'),(9,'XC'))
    SELECT p_partkey, tens.r || d.r AS roman, (p_partkey % 99 + 1)::INT AS number FROM part JOIN d ON d.i = (p_partkey % 99 + 1) % 10 JOIN tens ON tens.i = (p_partkey % 99 + 1) // 10 % 10 WHERE p_partkey % 99 + 1 < 100"""
)
def roman_numerals(t):
    """Numbers to numerals and back."""
    n = (F.col("p_partkey") % 99 + 1).cast("int")
    return t("part").select("p_partkey", text.to_roman(n).alias("roman")).withColumn("number", text.roman_to_int(F.col("roman")))


@query(
    """SELECT doc_id AS id, unnest(range(0, ((length(text) - 1) // 500 + 1)::BIGINT))::INT AS part, unnest([substring(text, i * 500 + 1, 500) FOR i IN range(0, ((length(text) - 1) // 500 + 1)::BIGINT)]) AS chunk FROM documents WHERE length(text) > 0"""
)
def char_windows(t):
    return t("documents").select(F.col("doc_id").alias("id"), F.posexplode(chunking.char_windows(F.col("text"), 500)).alias("part", "chunk"))


@query()
def text_chunks(t):
    """Parts cut at the best boundaries, with overlap."""
    return chunking.chunks(t("documents"), "doc_id", "text", tokens=200, overlap_words=10)


@query(
    """SELECT page_id AS id, (i - 1)::INT AS n, replace(replace(a[i], '&amp;', '&'), '&sect;', '§') AS href FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>|<style\\b[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>', 1) AS a FROM pages))"""
)
def page_links(t):
    return pages.links(t("pages"), "page_id", "html").select("id", "n", "href")


@query()
def page_paragraphs(t):
    return pages.paragraphs(t("pages"), "page_id", "html")


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def page_hosts(t):
    host, path = pages.url_parts(F.col("url"))
    return t("pages").select("page_id", host.alias("host"), path.alias("path"))


@query("SELECT kind, year::INT AS year, CASE kind WHEN 'full_statute' THEN 28000 WHEN 'penalty_block' THEN 14000 END - CASE WHEN year < 2020 THEN 1000 ELSE 0 END AS tokens FROM (SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN 'full_statute' ELSE 'penalty_block' END AS kind, 2018 + o_orderkey % 5 AS year FROM orders)")
def chunk_budgets(t):
    rows = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, "full_statute").otherwise("penalty_block").alias("kind"), (2018 + F.col("o_orderkey") % 5).cast("int").alias("year")).distinct()
    return rows.withColumn("tokens", chunking.budget(F.col("kind"), F.col("year")))


NOTE = """(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Section becomes operative on January ' || (p_partkey % 28 + 1) || ', 2020. ' WHEN 1 THEN 'Formerly ' || (p_partkey % 90 + 10) || '.010; ' WHEN 2 THEN 'Repealed by 2015 c.' || (p_partkey % 700 + 1) || ' §2. ' ELSE 'The sunset applies to fees. ' END || '1999 c.' || (p_partkey % 9 + 1) AS t FROM part)"""


def notes(t):
    k = F.col("p_partkey")
    n = lambda c: c.cast("string")
    first = F.when(k % 4 == 0, F.concat(F.lit("Section becomes operative on January "), n(k % 28 + 1), F.lit(", 2020. "))).when(k % 4 == 1, F.concat(F.lit("Formerly "), n(k % 90 + 10), F.lit(".010; "))).when(k % 4 == 2, F.concat(F.lit("Repealed by 2015 c."), n(k % 700 + 1), F.lit(" §2. "))).otherwise(F.lit("The sunset applies to fees. "))
    return t("part").select(k.alias("id"), F.concat(first, F.lit("1999 c."), n(k % 9 + 1)).alias("t"))


@query(
    f"""SELECT id, 'operative' AS effect_type, '2020-01-' || lpad((id % 28 + 1)::VARCHAR, 2, '0') AS operative_date FROM {NOTE} WHERE id % 4 = 0 UNION ALL SELECT id, 'repeal', NULL FROM {NOTE} WHERE id % 4 = 2
    UNION ALL SELECT id, unnest(['sunset', 'applies_to']), NULL FROM {NOTE} WHERE id % 4 = 3"""
)
def temporal_effects(t):
    return history.temporal_effects(notes(t), "id", "t").select("id", "effect_type", "operative_date")


@query(f"SELECT id, 'formerly' AS lineage_type, (id % 90 + 10) || '.010' AS other FROM {NOTE} WHERE id % 4 = 1 UNION ALL SELECT id, 'repealed_by', '2015 c.' || (id % 700 + 1) FROM {NOTE} WHERE id % 4 = 2")
def lineage_events(t):
    return history.lineage_events(notes(t), "id", "t")


@query(f"SELECT id, '1999 c.' || (id % 9 + 1) AS citation, 1999 AS year, (id % 9 + 1)::INT AS chapter FROM {NOTE} UNION ALL SELECT id, '2015 c.' || (id % 700 + 1) || ' §2', 2015, (id % 700 + 1)::INT FROM {NOTE} WHERE id % 4 = 2")
def session_laws(t):
    return history.session_laws(notes(t), "id", "t")


@query(
    """SELECT o_orderkey AS id, unnest(range(0, 4))::INT AS "order", unnest(['1', '1.a', '1.b', '2']) AS path, unnest([1, 2, 2, 1])::INT AS depth,
    unnest(['A person shall file.', 'Within ' || (o_custkey % 30 + 1) || ' days; and', 'In writing.', 'Fee: $' || (o_orderkey % 100)]) AS text FROM orders"""
)
def provision_tree(t):
    """Sections as trees of labelled parts."""
    n = lambda c: c.cast("string")
    body = F.concat(F.lit("(1) A person shall file.\n(a) Within "), n(F.col("o_custkey") % 30 + 1), F.lit(" days; and\n(b) In\nwriting.\n(2) Fee: $"), n(F.col("o_orderkey") % 100))
    rows = provision_trees.provision_tree(t("orders").select(F.col("o_orderkey").alias("id"), body.alias("t")), "id", "t")
    return rows.select("id", "order", F.array_join("path", ".").alias("path"), "depth", "text")
