"""The fielded index: equal to scoring every row, also when most postings are never opened."""

import math
import random
import re
import tempfile
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.operators import fielded

FIELDS = {"title": 3.0, "text": 1.0}


def scores(rows, query, only=None):
    """index -> id -> score, by scoring every row."""
    words = lambda x: [w for w in re.split(r"[^a-z0-9.]+", (x or "").lower()) if w]
    by_index = defaultdict(list)
    for r in rows:
        by_index[r[1] or ""].append(r)
    found = {}
    for index, members in by_index.items():
        means = [sum(len(words(r[k])) for r in members) / len(members) or 1.0 for k in (2, 3)]
        for term in set(words(query)):
            impact = {}
            for r in members:
                for k, weight in ((2, 3.0), (3, 1.0)):
                    w = words(r[k])
                    if tf := Counter(w)[term]:
                        impact[r[0]] = impact.get(r[0], 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / means[k - 2]))
            idf = math.log(1 + (len(members) - len(impact) + 0.5) / (len(impact) + 0.5))
            for i, x in impact.items():
                if only is None or i in only:
                    found.setdefault(index, Counter())[i] += idf * x
    return found


@pytest.fixture(scope="module")
def index(spark):
    random.seed(12)
    rare = [f"w{i}" for i in range(40)]
    rows = [(i, random.choice(["a", "a", "b", None]), " ".join(random.choices(rare, k=random.randint(0, 3))) or None, " ".join(random.choices(["the", "of", *rare], weights=[60, 30] + [1] * 40, k=random.randint(0, 60)))) for i in range(600)]
    rows += [(1000 + i, "a", "twin", "the same text twice") for i in range(5)] + [(2000, "b", None, None)]
    table = spark.createDataFrame(rows, "id int, kind string, title string, text string")
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    fielded.build(table, path, FIELDS, index_col="kind", head=16, salts=4, file_rows=500)
    return rows, path


QUERIES = {1: "the w3 of W7, w9!", 2: "the", 3: "w1 w1 w1 the of w2 w4 w5 w6", 4: "unheard", 5: None, 6: "twin same", 7: "the of"}


@pytest.mark.parametrize("k", [1, 3, 50, 1000])
def test_equals_scoring_every_row(spark, index, k):
    rows, path = index
    asked = spark.createDataFrame(list(QUERIES.items()), "query int, text string")
    got = defaultdict(list)
    for r in fielded.search_many(spark, path, asked, k).orderBy("query", "index", "rank").collect():
        got[r["query"], r["index"]].append((r["id"], r["score"]))
    want = {(q, i): [(d, pytest.approx(s, abs=1e-8)) for d, s in sorted(((d, round(s, 9)) for d, s in c.items()), key=lambda x: (-x[1], x[0]))[:k]] for q, text in QUERIES.items() for i, c in scores(rows, text).items()}
    assert dict(got) == want


def test_light_terms_stay_shut(spark, index):
    _, path = index
    terms = fielded.wanted_terms(spark, path, spark.createDataFrame([(1, "the w3 w7 w9")], "query int, text string"), "text", ["a"])
    heads = spark.read.parquet(f"{path}/postings").where("head").join(terms, ["bucket", "index", "term"]).selectExpr("query", "index", "id", "idf * impact AS part")
    opens = {r["term"]: r["opens"] for r in fielded.bounds(terms, heads, 3).collect()}
    assert opens["the"] is False
    tail = spark.read.parquet(f"{path}/postings").where("term = 'the' AND NOT head AND index = 'a'").count()
    assert tail > 100


def test_filters_and_fan_out(spark, index):
    rows, path = index
    asked = spark.createDataFrame([(1, QUERIES[1])], "query int, text string")
    only = spark.createDataFrame([(i,) for i in range(0, 600, 3)], "id int")
    got = [r["id"] for r in fielded.search_many(spark, path, asked, 4, indexes=["b"], rows=only).orderBy("rank").collect()]
    want = scores(rows, QUERIES[1], set(range(0, 600, 3)))["b"]
    assert got == [d for d, _ in sorted(((d, round(s, 9)) for d, s in want.items()), key=lambda x: (-x[1], x[0]))[:4]]


def test_fan_out(spark):
    rows = [(f"{kind}{i}", kind, f"tax {'court ' * i}") for kind in ("statute", "provision", "chunk", "actor") for i in range(12)]
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    fielded.build(spark.createDataFrame(rows, "id string, kind string, text string"), path, {"text": 1.0}, index_col="kind")
    asked = spark.createDataFrame([(7, "court")], "query int, text string")
    merged = fielded.fan_out(spark, path, asked, 5).orderBy("rank").collect()
    assert [(r["index"], round(r["score"], 4)) for r in merged] == [("provision", 1.15), ("statute", 1.05), ("chunk", 0.85), ("provision", 0.8132), ("statute", 0.7425)]
    assert {r["index"] for r in fielded.fan_out(spark, path, asked, 3, "actor").collect()} == {"actor"}
    assert fielded.fan_out(spark, path, asked, 0, "sourcenote").count() == 0


def test_empty_index(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    fielded.build(spark.createDataFrame([], "id int, text string"), path, {"text": 1.0})
    assert fielded.search_many(spark, path, spark.createDataFrame([(1, "a")], "query int, text string"), 3).count() == 0


def test_frequent_terms_lie_in_several_files(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small files would be made one
    fielded.build(spark.range(400).selectExpr("id", "'the' AS text"), path, {"text": 1.0}, file_rows=50)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{path}/postings").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 2 and sum(r["count"] for r in files) == 400


def test_words_are_counted_where_rows_are_read(spark, monkeypatch):
    """Slices of few rows give the impacts of all fields; before, each word of each row was shuffled to be counted."""
    monkeypatch.setattr(fielded, "SLICE_ROWS", 2)
    rows = [(i, "a b" if i % 2 else None, "b " * i + "c") for i in range(5)]
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    fielded.build(spark.createDataFrame(rows, "id int, title string, text string").coalesce(1), path, FIELDS)
    impact = lambda weight, tf, length, mean: weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))
    want = {(i, "c"): impact(1, 1, i + 1, 3) for i in range(5)} | {(i, "a"): impact(3, 1, 2, 0.8) for i in (1, 3)} | {(i, "b"): (impact(3, 1, 2, 0.8) if i % 2 else 0) + impact(1, i, i + 1, 3) for i in range(1, 5)}
    assert {(r["id"], r["term"]): pytest.approx(r["impact"]) for r in spark.read.parquet(f"{path}/postings").collect()} == want


def test_no_row_for_each_query_and_row_found(spark, index):
    """Many queries for frequent terms shuffle postings and first rows only; before, each query's share in each row that it finds was a shuffled row."""
    rows, path = index
    asked = spark.range(300).selectExpr("id AS query", "'the of w1' AS text")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    written = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))}
    before = written()
    got = [(r["index"], r["id"]) for r in fielded.search_many(spark, path, asked, 2).where("query = 299").orderBy("index", "rank").collect()]
    assert got == [(i, d) for i, c in sorted(scores(rows, "the of w1").items()) for d, _ in sorted(((d, round(s, 9)) for d, s in c.items()), key=lambda x: (-x[1], x[0]))[:2]]
    pairs = 300 * sum(len(c) for c in scores(rows, "the of w1").values())
    assert 0 < sum(n for stage, n in written().items() if stage not in before) < pairs / 5


def test_small_parts_and_groups(spark, index, monkeypatch):
    """Rows and queries that meet in many parts and groups give what they give together."""
    rows, path = index
    for name, value in (("LEAST_PART", 50), ("MOST_PART", 50), ("PART_PAIRS", 5)):
        monkeypatch.setattr(fielded, name, value)
    asked = spark.createDataFrame([(str(q), t) for q, t in QUERIES.items()], "query string, text string")
    got = defaultdict(list)
    for r in fielded.search_many(spark, path, asked, 3).orderBy("query", "index", "rank").collect():
        got[int(r["query"]), r["index"]].append((r["id"], r["score"]))
    want = {(q, i): [(d, pytest.approx(s, abs=1e-8)) for d, s in sorted(((d, round(s, 9)) for d, s in c.items()), key=lambda x: (-x[1], x[0]))[:3]] for q, text in QUERIES.items() for i, c in scores(rows, text).items()}
    assert dict(got) == want


def test_index_of_asked_terms(spark):
    """Only their postings are stored; frequencies, lengths and so the scores are those of the whole index."""
    docs = spark.createDataFrame([(i, "x " * (i % 3) + "y z " * (i % 5)) for i in range(40)] + [(50, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "y X"), (2, "unheard")], "query int, text string")
    terms = spark.createDataFrame([("x",), ("y",), ("y",), ("unheard",)], "term string")
    found = []
    for known in (None, terms):
        path = tempfile.mkdtemp(prefix="spark-") + "/index"
        fielded.build(docs, path, {"text": 1.0}, terms=known)
        found.append([tuple(r) for r in fielded.search_many(spark, path, asked, 5).orderBy("query", "rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 5
    assert {r["term"] for r in spark.read.parquet(f"{path}/postings").collect()} == {"x", "y"}
