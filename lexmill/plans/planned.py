"""Search-planning queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import planning
from lexmill.plans.registry import Registry

query = Registry()
#: What users type, with two numbers: a chapter of 1 to 90 and a section of 0 to 999.
PHRASES = ["{c}.{s}", "ors {c}.{s}(1)(a)", "utcr {c}.{s} to {c}.{s}", " chapter {c} ", "chapter {c} security deposit", "definition of rent in ORS {c}.{s}", "within 30 days of notice", "civil penalty {c}", "written notice", "landlord must repair", "law amended in {c}", "plain words"]
INTENT_SQL = """CASE WHEN regexp_full_match(x, '(ORS|UTCR)\\s+[0-9]{1,3}[A-Z]?\\.[0-9]{3}(\\([^)]+\\))?') OR regexp_matches(lower(x), '^(or\\.? const|oregon constitution|u\\.? ?s\\.? const|(first|fourteenth) amendment|due process clause|(amdt|art)[a-z0-9.]+)') THEN 'citation'
      WHEN regexp_full_match(lower(x), '((ors|utcr)\\s+)?chapter\\s+[0-9]{1,3}[a-z]?') THEN 'chapter' WHEN regexp_matches(lower(x), '^definition\\s+of|defines?\\b|meaning\\s+of') THEN 'definition'
      WHEN regexp_matches(lower(x), 'deadline|within\\s+[0-9]+\\s+days|by\\s+the\\s+\\w+\\s+day|how long|when must') THEN 'deadline' WHEN regexp_matches(lower(x), 'penalty|fine|misdemeanor|felony|punished\\s+by') THEN 'penalty'
      WHEN regexp_matches(lower(x), 'notice|notify|inform\\b') THEN 'notice' WHEN regexp_matches(lower(x), 'landlord|tenant|director|department|public\\s+body|must .* do|shall') THEN 'actor'
      WHEN regexp_matches(lower(x), 'operative|effective|amended|repealed|renumbered|session law|current') THEN 'history' ELSE 'general' END"""
TYPED_SQL = "(SELECT o_orderkey AS id, replace(replace(['" + "', '".join(PHRASES) + f"'][o_orderkey % {len(PHRASES)} + 1], '{{c}}', (o_custkey % 90 + 1)::VARCHAR), '{{s}}', lpad((o_custkey % 1000)::VARCHAR, 3, '0')) AS q FROM orders)"


def typed(t):
    n = lambda c: c.cast("string")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("o_orderkey") % len(PHRASES)).cast("int"))
    return t("orders").select(F.col("o_orderkey").alias("id"), F.replace(F.replace(phrase, F.lit("{c}"), n(F.col("o_custkey") % 90 + 1)), F.lit("{s}"), F.lpad(n(F.col("o_custkey") % 1000), 3, "0")).alias("q"))


@query(
    rf"""WITH a AS (SELECT id, q, trim(q) AS t, upper(regexp_extract(q, '(?i)^\s*(ors|utcr)?', 1)) AS f, [upper(m) FOR m IN regexp_extract_all(q, '[0-9]{{1,3}}[A-Za-z]?\.[0-9]{{3}}(?:\([^)]+\))*')] AS cites, regexp_extract(q, '(?i)^\s*chapter\s+([0-9]{{1,3}})', 1) AS ch FROM {TYPED_SQL}),
    b AS (SELECT *, CASE WHEN len(cites) = 2 THEN coalesce(nullif(f, ''), 'ORS') || ' ' || cites[1] || ' to ' || coalesce(nullif(f, ''), 'ORS') || ' ' || cites[2] WHEN regexp_full_match(t, '[0-9]+\.[0-9]+') THEN 'ORS ' || t WHEN regexp_full_match(t, 'chapter [0-9]+') THEN 'Chapter ' || ch
      ELSE regexp_replace(q, '(?i)\b(ors)\s+([0-9])', 'ORS \2') END AS n FROM a),
    c AS (SELECT *, CASE WHEN ch <> '' THEN nullif(trim(regexp_replace(t, '^chapter [0-9]+', '')), '') WHEN len(cites) > 0 THEN nullif(trim(regexp_replace(regexp_replace(t, '(?i)(ors |utcr )?[0-9]+\.[0-9]{{3}}(\([^)]+\))*( to )?', '', 'g'), '\s+', ' ', 'g')), '') END AS r FROM b),
    e AS (SELECT *, coalesce(r, n) AS x FROM c)
    SELECT id, n AS normalized, coalesce(nullif(ch, ''), split_part(cites[1], '.', 1)) AS chapter, r AS residual, CASE WHEN len(cites) > 0 AND r IS NULL THEN 'citation' WHEN ch <> '' AND r IS NULL THEN 'chapter' ELSE {INTENT_SQL} END AS intent,
      CASE WHEN (len(cites) > 0 OR ch <> '') AND r IS NULL THEN 'citation' ELSE 'hybrid' END AS mode FROM e"""
)
def query_plans(t):
    """Normal form, chapter, residual, intent and mode of each query."""
    return planning.plan(typed(t), "q").select("id", "normalized", "chapter", "residual", "intent", "mode")


@query(f"SELECT id, {INTENT_SQL} AS intent FROM (SELECT id, q AS x FROM {TYPED_SQL})")
def typed_intents(t):
    """The first rule that matches decides, over all nine intents."""
    return typed(t).select("id", planning.intent(F.col("q")).alias("intent"))


FAMILIES = ["USCONST", "ORS", "UTCR", "SLR", "CONAN", "CASELAW", "OAR", "blog"]


@query(
    f"""WITH a AS (SELECT c_custkey AS id, [{", ".join(f"'{f}'" for f in FAMILIES)}][c_custkey % 8 + 1] AS family, CASE WHEN c_custkey % 5 = 0 THEN 'federal' WHEN c_custkey % 5 = 1 THEN 'local' END AS j FROM customer),
    b AS (SELECT *, CASE family WHEN 'USCONST' THEN 100 WHEN 'ORS' THEN 90 WHEN 'UTCR' THEN 80 WHEN 'OAR' THEN 80 WHEN 'SLR' THEN 75 WHEN 'CONAN' THEN 65 WHEN 'CASELAW' THEN 60 ELSE 30 END AS level,
      CASE WHEN family IN ('USCONST', 'ORS', 'UTCR', 'SLR', 'OAR') THEN 'primary_law' WHEN family = 'CONAN' THEN 'official_commentary' WHEN family = 'CASELAW' THEN 'case_law' ELSE 'secondary' END AS role,
      CASE WHEN j = 'federal' THEN 'us' WHEN j = 'local' THEN 'local' WHEN family IN ('USCONST', 'CONAN') THEN 'us' WHEN family = 'SLR' THEN 'local' ELSE 'or:state' END AS jurisdiction FROM a)
    SELECT id, level, role, jurisdiction, CASE WHEN level = 100 THEN 'constitution' WHEN level >= 84 THEN 'statute' WHEN level >= 75 THEN 'rule' WHEN level >= 65 THEN 'official_commentary' WHEN level >= 60 THEN 'case_law' ELSE 'secondary' END AS tier,
      round(CASE WHEN level = 100 THEN 4.0::DOUBLE WHEN level >= 91 THEN 2.8 WHEN level >= 84 THEN 2.2 WHEN level >= 75 THEN 1.4 WHEN level >= 65 THEN 0.8 WHEN level >= 60 THEN 0.6 ELSE 0 END
        + CASE role WHEN 'primary_law' THEN 0.8::DOUBLE WHEN 'official_commentary' THEN -0.2 WHEN 'case_law' THEN 0.1 ELSE -0.4 END + CASE WHEN jurisdiction = 'us' THEN 0.25::DOUBLE ELSE 0 END, 6) AS weight FROM b"""
)
def candidate_hierarchy(t):
    """Level, tier, role, jurisdiction and weight of candidates by their authority family."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    rows = t("customer").select(k.alias("id"), F.get(F.array(*[F.lit(f) for f in FAMILIES]), (k % 8).cast("int")).alias("authority_family"), none.alias("citation"), F.lit(None).cast("int").alias("authority_level"), none.alias("source_role"), F.when(k % 5 == 0, "federal").when(k % 5 == 1, "local").alias("jurisdiction_id"), none.alias("corpus_id"))
    return planning.with_hierarchy(rows).select("id", "level", "role", "jurisdiction", "tier", F.round("controlling_weight", 6).alias("weight"))


@query(
    """WITH q AS (SELECT o_orderkey AS query_id, 'ors ' || (o_custkey % 90 + 1) || '.010' AS base, o_orderkey % 3 AS k FROM orders), s AS (SELECT 'ors ' || p_partkey || '.010' AS c, 's' || p_partkey AS id FROM part WHERE p_partkey % 2 = 0), p AS (SELECT 'ors ' || p_partkey || '.010(1)' AS c, 'p' || p_partkey AS id FROM part WHERE p_partkey % 3 = 0)
    SELECT query_id, CASE WHEN p.id IS NOT NULL THEN 'exact_provision' WHEN k = 0 AND s.id IS NOT NULL THEN 'exact_statute' WHEN k > 0 AND s.id IS NOT NULL THEN 'parent_statute' ELSE 'none' END AS match_type, coalesce(p.id, s.id) AS id
    FROM q LEFT JOIN p ON k = 1 AND p.c = base || '(1)' LEFT JOIN s ON s.c = base"""
)
def direct_opens(t):
    """What each query opens directly: a provision, a statute, or the statute above a provision that isn't there."""
    n = lambda c: c.cast("string")
    end = F.get(F.array(F.lit(""), F.lit("(1)"), F.lit("(2)")), (F.col("o_orderkey") % 3).cast("int"))
    queries = t("orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("ors "), n(F.col("o_custkey") % 90 + 1), F.lit(".010"), end).alias("q"))
    k = F.col("p_partkey")
    statutes = t("part").where(k % 2 == 0).select(F.concat(F.lit("ORS "), n(k), F.lit(".010")).alias("citation"), F.concat(F.lit("s"), n(k)).alias("id"))
    provisions = t("part").where(k % 3 == 0).select(F.concat(F.lit("ORS "), n(k), F.lit(".010(1)")).alias("citation"), F.concat(F.lit("p"), n(k)).alias("id"))
    return planning.direct_open(planning.plan(queries, "q"), provisions, statutes)


@query(
    """WITH h AS (SELECT l_suppkey AS query_id, 'k' || (l_partkey % 20) AS key, l_linenumber AS arm, l_orderkey AS o, l_quantity::DOUBLE / 10 AS score, CASE WHEN l_linenumber % 2 = 0 THEN 'provision' ELSE 'chunk' END AS kind FROM lineitem),
    f AS (SELECT query_id, key, arm, min(o) AS o FROM h GROUP BY ALL), one AS (SELECT h.* FROM h SEMI JOIN f USING (query_id, key, arm, o)),
    two AS (SELECT query_id, key, max(score) FILTER (arm = 1) AS a, max(score) FILTER (arm = 2) AS b FROM one WHERE arm <= 2 GROUP BY ALL)
    SELECT query_id, key, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE greatest(a, b) + 0.35::DOUBLE * least(a, b) + 0.05::DOUBLE END, 6) AS score, CASE WHEN b IS NOT NULL THEN 'provision' ELSE 'chunk' END AS kind FROM two"""
)
def ranked_candidates(t):
    """Candidates of two arms folded to one row a query and key."""
    h = t("lineitem").where("l_linenumber <= 2 AND l_orderkey IS NOT NULL").select(F.col("l_suppkey").alias("query_id"), F.concat(F.lit("k"), (F.col("l_partkey") % 20).cast("string")).alias("key"), F.col("l_linenumber").alias("arm"), "l_orderkey", (F.col("l_quantity").cast("double") / 10).alias("score"))
    one = h.groupBy("query_id", "key", "arm").agg(F.min_by("score", F.struct("l_orderkey", F.isnull("score"), -F.col("score"))).alias("score"))  # of rows of one order the best
    rows = one.select("*", F.when(F.col("arm") % 2 == 0, "provision").otherwise("chunk").alias("kind"), F.lit(0.0).alias("boost"))
    return planning.ranked(rows).select("query_id", "key", F.round("score", 6).alias("score"), "kind")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'penalty AND late AND rent' END AS conjunctive, CASE WHEN o_orderkey % 2 = 0 THEN 'penalty' ELSE NULL END AS result_type FROM orders")
def query_shapes(t):
    """Conjunctive forms and default result types of queries."""
    even = F.col("o_orderkey") % 2 == 0
    q = F.when(even, "the penalty of 'late' rent").otherwise("rent OR deposit")
    i = planning.intent(q)
    return t("orders").select(F.col("o_orderkey").alias("id"), planning.conjunctive_query(q).alias("conjunctive"), planning.default_result_type(i, F.lit(None).cast("string")).alias("result_type"))
