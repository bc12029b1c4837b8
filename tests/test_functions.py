import hashlib
import math
import os
import random

from pyspark.sql import functions as F

from lexmill.functions import extract, text
from lexmill.operators import checks, chunking, graph, loading, provisions, rules, search
from lexmill.plans import catalog
from lexmill.sources import pages


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalising(spark):
    assert one(spark, "�§ 12.  a&nbsp;b &amp; c", text.normalize_ws) == "12. a b & c"
    assert one(spark, "see � 3", text.normalize_ws) == "see §3"
    assert one(spark, "______", text.is_rule_line) and not one(spark, "____", text.is_rule_line)
    assert one(spark, "a\n______\nb", text.count_rule_lines) == 1
    assert one(spark, "GENERAL RULES", text.is_all_caps_heading) and not one(spark, "GENERAL Rules", text.is_all_caps_heading)
    assert not one(spark, "RULE 12", text.is_all_caps_heading)
    assert one(spark, "end.. ", text.strip_trailing_period) == "end"
    assert one(spark, None, text.normalize_ws) is None


def test_values(spark):
    assert one(spark, "MCMXCIV", text.roman_to_int) == 1994 and one(spark, "ABC", text.roman_to_int) is None
    assert [one(spark, x, text.value_bool) for x in ("Yes", "0", "7", "maybe")] == [True, False, True, None]
    assert one(spark, "/Date(0+0000)/", text.service_date) == "1970-01-01T00:00:00+00:00"
    assert one(spark, " soon ", text.service_date) == "soon"
    assert one(spark, "a/../b", text.relative_path) is None and one(spark, "a\\.\\b c", text.relative_path) == "a/b c"
    assert one(spark, "a+b", text.sanitize_fulltext) == "a\\+b"
    assert one(spark, "$1,234.50", text.money_value) == 1234.5 and one(spark, "5 percent", text.percent_value) == 5
    assert one(spark, "A b! C", text.slug) == "a-b-c"


def mentions(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [sorted((r["kind"], r["normalized"]) for r in extract.citation_mentions(df, "id", "t").where(F.col("id") == i).collect()) for i in range(len(texts))]


def test_citations_take_places_once(spark):
    got = mentions(
        spark, "See ORS 1.001 to 1.003.", "See ORS 1.001 through 1.003, ORS 2.010(1)(a) and 2.020, and ORS chapters 3 to 5.", "ORS 316.1234. ors 2.020 and ORS 2.020", "ORS 90.100, 90.105 or 90.110 (2) (b)", "ORS 1.010 (1) to 1.020 (2); ORS chapter 5A", None, "nothing"
    )
    assert got == [
        [("statute_range", "ORS 1.001 to 1.003")],
        [("statute_chapter_range", "ORS chapters 3 to 5"), ("statute_range", "ORS 1.001 to 1.003"), ("statute_section", "ORS 2.020"), ("statute_subsection", "ORS 2.010(1)(a)")],
        [("statute_section", "ORS 2.020"), ("statute_section", "ORS 316.1234")],
        [("statute_section", "ORS 90.100"), ("statute_section", "ORS 90.105"), ("statute_subsection", "ORS 90.110(2)(b)")],
        [("statute_chapter", "ORS chapter 5A"), ("statute_range", "ORS 1.010 to 1.020")], [], [],
    ]
    row = extract.citation_mentions(spark.createDataFrame([(7, "ORS 2.010 (1)(a)")], "id int, t string"), "id", "t").first()
    key = hashlib.sha256(b"7::ORS 2.010 (1)(a)::ORS 2.010 (1)(a)").hexdigest()[:16]
    assert (row["mention_id"], row["canonical_id"], row["pins"], row["confidence"], row["status"]) == (f"cite:{key}", "or:ors:2.010", ["1", "a"], 0.92, "parsed_unverified")


def test_semantics(spark):
    texts = {
        "duty": "The landlord shall return the deposit within 31 days after termination, unless the tenant owes rent; other text.",
        "tax": "The construction tax may not exceed 5 percent of the permit value, paid to the county treasurer into the Oregon School Fund. More.",
        "crime": "A person who violates ORS 90.300 commits a Class a misdemeanor, punishable by county jail for not more than 30 days, and the license may be suspended.",
        "civil": "The director may impose a civil penalty not to exceed $1,250.50.",
        "means": 'As used in ORS 90.100 to 90.465, "dwelling unit" means a structure.',
        "plain": "Premises includes a yard.",
        "notice": "The tenant must give actual notice to the landlord in substantially the following form: ______",
        "remedy": "The tenant may recover damages or bring an action.",
        "blank": "  ",
    }
    rows = {r["id"]: r for r in extract.semantic_rows(spark.createDataFrame(list(texts.items()), "id string, t string"), "id", "t").collect()}
    assert "blank" not in rows
    duty = rows["duty"]
    assert (duty["actor"], duty["actor_kind"], duty["verb"], duty["object"], duty["condition"]) == ("landlord", "role", "shall", "return the deposit within 31 days after termination, unless the tenant owes rent", "unless the tenant owes rent")
    assert (duty["duration"], duty["trigger"]) == ("within 31 days after termination, unless the tenant owes rent", "after termination, unless the tenant owes rent")
    assert duty["types"] == ["Deadline", "Exception", "Obligation", "TimePeriod"]
    tax = rows["tax"]
    assert (tax["tax"]["type"], tax["tax"]["rate"], tax["tax"]["base"], tax["tax"]["recipient"], tax["limit"]["type"], tax["limit"]["percent"]) == ("construction", "5 percent", "the permit value, paid to the county treasurer into the Oregon School Fund", "the county treasurer into the Oregon School Fund", "tax_rate_limit", 5.0)
    assert tax["tax"]["cap"].startswith("The construction tax") and tax["tax"]["cap"].endswith("Fund")
    crime = rows["crime"]["penalty"]
    assert (crime["type"], crime["class"], crime["jail"], crime["citation"], crime["suspension"], crime["revocation"]) == ("criminal", "Class a misdemeanor", "county jail for not more than 30 days", "ORS 90.300", True, None)
    civil = rows["civil"]["penalty"]
    assert (civil["type"], civil["amount"], civil["maximum"], civil["civil"]) == ("civil", "$1,250.50", "$1,250.50", "$1,250.50")
    assert [(a["type"], a["amount"]) for a in rows["civil"]["amounts"]] == [("currency", 1250.5)]
    assert (rows["means"]["term"], rows["means"]["scope"], tuple(rows["means"]["scope_range"])) == ("dwelling unit", "range", ("or:ors:90.100", "or:ors:90.465"))
    assert rows["plain"]["scope"] == "section" and rows["plain"]["term"] is None
    assert (rows["notice"]["notice"]["type"], rows["notice"]["notice"]["sender"], rows["notice"]["form"]) == ("actual_notice", "landlord", "notice_template")
    assert rows["remedy"]["remedy"] == "damages"


def test_chunks_keep_every_word_and_stay_small(spark):
    words = " ".join(f"w{i}" for i in range(400)) + "\n" + "x" * 500
    rows = chunking.chunks(spark.createDataFrame([(1, words), (2, ""), (3, None)], "id int, t string"), "id", "t", tokens=20).collect()
    assert {r["id"] for r in rows} == {1} and all(len(r["text"]) <= 104 for r in rows)
    assert "".join("".join(r["text"].split()) for r in sorted(rows, key=lambda r: r["part"])) == "".join(words.split())


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("a", "d", "t"), ("d", "e", "t"), ("e", "c", "t"), ("x", "y", "t")], "src string, dst string, type string")
    got = graph.shortest_path(edges, "a", "c").first()
    assert (got["length"], got["path"]) == (2, ["a", "b", "c"])
    assert graph.shortest_path(edges, "a", "x").first() is None


def test_fold_follows_the_arms(spark):
    rows = spark.createDataFrame([("k", 1, "a", 2, 1.0), ("k", 2, "b", 1, 2.0), ("k", 3, "c", 1, -1.0)], "key string, arm int, kind string, priority int, score double")
    got = search.fold_duplicates(rows).first()
    assert abs(got["score"] - (2 + 0.35 + 0.05 + 0.05)) < 1e-9 and got["kind"] == "a"


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v string")
    assert loading.first_per_key(empty, ["k"], ["v"]).count() == 0
    assert checks.count_duplicates(empty, ["k"]).first()["duplicates"] == 0
    assert rules.keep_newest(empty, "k", "v", "v", 2).count() == 0
    assert pages.links(spark.createDataFrame([(1, None)], "i int, h string"), "i", "h").count() == 0


def test_registry(spark, tmp_path):
    (tmp_path / "r.md").write_text("# x\n| id | name |\n|---|:-:|\n| a | A |\n| a |  |\n")
    rows = pages.markdown_registry(spark, str(tmp_path / "r.md"))
    assert [r["cells"] for r in rows.collect()] == [["id", "name"], ["a", "A"], ["a", ""]]
    table = rows.where(F.col("cells")[0] != "id").select(F.col("cells")[0].alias("id"), F.col("cells")[1].alias("name"))
    assert {r["problem"] for r in pages.registry_problems(table, "id", ["name"]).collect()} == {"missing name", "repeated id"}


def test_provision_paths():
    text = "(1)(a) First\nmore\n(A) sub\n(i) numeral\n(ii) next\n(b) Second\n(2) Third\n(2) again\nend"
    got = [(".".join(p["path"]), p["text"], p["implied"]) for p in provisions.parse_section(text)]
    assert got == [("1", "", True), ("1.a", "First more", False), ("1.a.A", "sub", False), ("1.a.A.i", "numeral", False), ("1.a.A.ii", "next", False), ("1.b", "Second", False), ("2", "Third", False), ("2_v2", "again end", False)]
    assert [".".join(p["path"]) for p in provisions.parse_section("(h) x\n(i) y\n(j) z")] == ["h", "i", "j"]
    assert provisions.parse_section("") == [] and provisions.parse_section(None) == []


def test_similar_edges_across_groups(spark):
    """All vectors meet, whatever their label, in blocks; each has the same nearest ones as by comparing all pairs."""
    r = random.Random(1)
    rows = [(i, i % 3, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, label int, v array<float>")
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, _, v in rows}

    def want(sources, same):
        for i in sources:
            near = [(-sum(a * b for a, b in zip(unit[i], unit[j])), j) for j in unit if j != i and (not same or i % 3 == j % 3)]
            yield from ((i, j) for s, j in sorted(near)[:3] if s <= -0.1)

    def got(*more, **named):
        return sorted((x["src"], x["dst"]) for x in graph.similar_edges(vectors, "id", "v", *more, **named).collect())

    assert got(None, 3, 0.1, block=7) == sorted(want(unit, False))
    assert got("label", 3, 0.1, block=7) == sorted(want(unit, True))
    assert got(None, 3, 0.1, queries=F.col("id") % 20 == 0, block=7) == sorted(want([0, 20, 40], False))


def test_closure_of_a_deep_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(13)], "src long, dst long")
    assert sorted(map(tuple, graph.closure(edges).collect())) == [(i, j, j - i) for i in range(14) for j in range(i, 14)]


def test_release_manifest_of_every_table(spark):
    """Rows and digests equal a brute-force hash of the rows, for all tables."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    want = []
    for name in sorted(f.removesuffix(".parquet") for f in os.listdir(folder) if f.endswith(".parquet")):
        rows = spark.read.parquet(f"{folder}/{name}.parquet")
        lines = [r[0] for r in rows.select(F.to_json(F.struct(*sorted(rows.columns)))).collect()]
        want.append((name, len(lines), str(sum(int(hashlib.sha256(x.encode()).hexdigest()[:15], 16) for x in lines))))
    assert sorted(map(tuple, catalog.QUERIES["release_manifest"](spark, folder).collect())) == want and len(want) == 14


def test_chunks_come_in_slices(spark):
    """Ids of any kind, null texts without parts, and batches cut by their bytes."""
    import pyarrow as pa

    from lexmill.operators import chunking, loading

    assert list(loading.slices([pa.array(["abcd", None, "ab", "abcdefgh", ""])], 6)) == [(0, 3), (3, 4), (4, 5)]
    table = spark.createDataFrame([("a", "one two three four five six"), ("b", None), ("c", "one")], "id string, t string")
    got = [tuple(r)[:4] for r in chunking.chunks(table, "id", "t", tokens=2, overlap_words=1).orderBy("id", "part").collect()]
    assert [g[:3] for g in got] == [("a", 0, 3), ("a", 1, 3), ("a", 2, 3), ("c", 0, 1)] and got[1][3].startswith(got[0][3].split()[-1])


def test_tidied_equals_normalize_ws(spark):
    odd = ["", " ", "a", "a b", " a", "a ", "a  b", "a\tb", "a\r\nb", "a&nbsp;b", "&amp;amp;lt; x", "§ 5", "a § 5", "§a", "� 7", "a �7", "a�", "a b", "a b c", " a", "a ", "a\n", "5", "(1)", "§§(1) x", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.tidied(F.col("t")).alias("got"), text.normalize_ws(F.col("t")).alias("want")).collect()
    assert len(rows) == len(odd) and [r for r in rows if r["got"] != r["want"]] == []


def test_semantic_rows_are_dealt_by_number_and_keep_repeated_ids(spark, monkeypatch, tmp_path):
    """The parts grow with the rows, and two rows of one id give two rows, as in the SQL."""
    import duckdb

    monkeypatch.setattr(extract, "TASK_ROWS", 3)
    rows = spark.range(40).selectExpr("id", "'The tenant shall pay $5.' AS t").coalesce(1)
    dealt = extract.semantic_rows(rows, "id", "t").select("id", F.spark_partition_id().alias("part")).collect()
    assert len(dealt) == 40 and len({r["part"] for r in dealt}) > 8
    orders = [(k // 2, 7 * k, 1000.5 + k) for k in range(24)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.QUERIES["semantic_rows"](spark, str(tmp_path))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = base.execute(catalog.ORACLE_SQL["semantic_rows"]).fetchall()
    got = got.select(*[d[0] for d in base.description])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and len(want) == 24
