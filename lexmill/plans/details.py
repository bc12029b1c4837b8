"""Queries of paths, ancestors, intervals and loosely typed values over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import history, text
from lexmill.operators import graph, rules
from lexmill.plans.graphs import EDGES, edges
from lexmill.plans.registry import Registry
from lexmill.plans.texts import NOTE, notes

query = Registry()


@query(
    f"""WITH RECURSIVE {EDGES}, p AS (SELECT ['n3'] AS path UNION ALL SELECT list_append(path, u.dst) FROM p JOIN u ON u.src = path[-1] WHERE len(path) < 5 AND NOT list_contains(path, u.dst))
    SELECT (len(path) - 1)::INT AS length, array_to_string(path, '>') AS path FROM p WHERE path[-1] = 'n23' ORDER BY len(path), p.path LIMIT 1"""
)
def shortest_path(t):
    """A shortest path between two nodes, of several the least."""
    return graph.shortest_path(edges(t), "n3", "n23", 4).select("length", F.array_join("path", ">").alias("path"))


@query(
    """WITH p AS (SELECT o_orderkey AS id, ['1', 'a', 'A', 'i'][1 : o_orderkey % 4 + 1] AS path FROM orders)
    SELECT id, (n - 1)::INT AS depth, array_to_string(path[1 : n], '.') AS ancestor FROM (SELECT id, path, unnest(range(1, len(path))) AS n FROM p)"""
)
def provision_ancestors(t):
    """What each provision lies in, from its path."""
    path = F.slice(F.array(*[F.lit(x) for x in ("1", "a", "A", "i")]), F.lit(1), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = graph.ancestors(t("orders").select(F.col("o_orderkey").alias("id"), path.alias("path")), "id", "path")
    return rows.select("id", "depth", F.array_join("ancestor", ".").alias("ancestor"))


@query(f"SELECT id, '2020-01-' || lpad(regexp_extract(t, 'January ([0-9]+), 2020', 1), 2, '0') AS start_date FROM {NOTE} WHERE regexp_matches(t, 'January [0-9]+, 2020')")
def note_intervals(t):
    """Every long date in a note begins an interval."""
    return history.time_intervals(notes(t), "id", "t")


@query(f"SELECT id, CASE WHEN regexp_matches(lower(t), 'repealed') THEN 'repealed' ELSE 'active' END AS status FROM {NOTE}")
def note_status(t):
    return notes(t).select("id", history.status_of(F.col("t")).alias("status"))


@query(
    r"""WITH v AS (SELECT c_custkey AS id, [' Yes', 'n', '0', '17', 'maybe', 'TRUE '][c_custkey % 6 + 1] AS b, '/Date(' || (c_custkey * 86400000)::BIGINT || '-0700)/' AS d, CASE WHEN c_custkey % 3 = 0 THEN '  ' WHEN c_custkey % 3 = 1 THEN NULL ELSE ' first ' END AS f FROM customer)
    SELECT id, CASE WHEN lower(trim(b)) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(trim(b)) IN ('false', 'f', 'no', 'n', '0') THEN false WHEN regexp_full_match(trim(b), '-?[0-9]+') THEN trim(b)::INT <> 0 END AS flag,
      strftime(make_timestamp(regexp_extract(d, '\((-?[0-9]+)', 1)::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS at, coalesce(nullif(trim(f), ''), 'second') AS named, left(sha256(id || '|' || b), 16) AS stable, CASE WHEN id % 7 = 0 THEN 0.0::DOUBLE ELSE round(id % 7 * 100.0::DOUBLE / (id % 7 + 3), 6) END AS share,
      regexp_replace(b || '+(x)', '([+()])', '\\\1', 'g') AS escaped FROM v"""
)
def loose_values(t):
    """Flags, service dates, first filled fields, stable ids, shares and escaped queries."""
    k = F.col("c_custkey")
    b = F.get(F.array(*[F.lit(x) for x in (" Yes", "n", "0", "17", "maybe", "TRUE ")]), (k % 6).cast("int"))
    rows = t("customer").select(k.alias("id"), b.alias("b"), F.concat(F.lit("/Date("), (k * 86_400_000).cast("string"), F.lit("-0700)/")).alias("d"), F.when(k % 3 == 0, "  ").when(k % 3 == 2, " first ").alias("f"))
    i = F.col("id") % 7
    return rows.select("id", text.value_bool(F.col("b")).alias("flag"), text.service_date(F.col("d")).alias("at"), text.first_value(F.col("f"), F.lit("second")).alias("named"), F.substring(text.generate_id("x", F.col("id").cast("string"), F.col("b")), 3, 16).alias("stable"), F.round(text.percentage(i, F.when(i == 0, 0).otherwise(i + 3)), 6).alias("share"), text.sanitize_fulltext(F.concat("b", F.lit("+(x)"))).alias("escaped"))


@query(
    """WITH v AS (SELECT p_partkey AS id, ['_______', '_____ a heading ______', '  ', 'GENERAL RULES', 'One thing; two. Three'][p_partkey % 5 + 1] AS x, ['2024-02-30', '2024-02-29', '24-1-1'][p_partkey % 3 + 1] AS d FROM part)
    SELECT id, regexp_full_match(x, '_{5,}') AS rule, trim(regexp_replace(regexp_replace(trim(x), '^_{5,} *', ''), ' *_{5,}$', '')) AS bare, trim(x) = '' AS blank, trim(regexp_split_to_array(x, '[;.]')[1]) AS clause, trim(split_part(x, '. ', 1)) AS sentence, x = 'GENERAL RULES' AS heading, d = '2024-02-29' AS iso FROM v"""
)
def line_kinds(t):
    """Rules, blanks, headings, clauses and dates of lines."""
    k = F.col("p_partkey")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    rows = t("part").select(k.alias("id"), pick(["_______", "_____ a heading ______", "  ", "GENERAL RULES", "One thing; two. Three"]).alias("x"), pick(["2024-02-30", "2024-02-29", "24-1-1"]).alias("d"))
    x = F.col("x")
    return rows.select("id", text.is_rule_line(x).alias("rule"), text.without_rule_marks(x).alias("bare"), text.is_blank(x).alias("blank"), text.first_clause(x).alias("clause"), text.first_sentence(x).alias("sentence"), text.is_all_caps_heading(x).alias("heading"), rules.is_iso_date(F.col("d")).alias("iso"))
