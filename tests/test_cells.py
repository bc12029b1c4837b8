"""Vector cells: exact search equals comparing all, and the near one finds most."""

import random
import tempfile

import numpy as np
import pytest

from lexmill.operators import cells

SF = "/root/testdata/sf0.01"


def store(spark, rows, **options):
    path = tempfile.mkdtemp(prefix="spark-") + "/cells"
    cells.build(spark.createDataFrame(rows, "id int, vector array<float>"), path, **options)
    return path


def nearest(rows, query, k):
    def cosine(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(np.dot(a, b) / size), 9) if size else 0.0

    scored = sorted(((-cosine(np.array(v, np.float32).astype(float), np.array(query, np.float32).astype(float)), i) for i, v in rows if v is not None))
    return [i for _, i in scored[:k]]


@pytest.mark.parametrize(("n", "groups"), [(400, 6), (60, 1), (1, 1)])
def test_exact(spark, n, groups):
    random.seed(n)
    middles = [[random.gauss(0, 1) for _ in range(8)] for _ in range(groups)]
    rows = [(i, [x + random.gauss(0, 0.3) for x in random.choice(middles)]) for i in range(n)]
    rows += [(1000, [0.0] * 8), (1001, None), (1002, list(rows[0][1]))]
    path = store(spark, rows, sample=50)
    queries = {1: rows[0][1], 2: [-x for x in middles[0]], 3: [0.0] * 8, 4: None}
    asked = spark.createDataFrame(list(queries.items()), "query int, vector array<float>")
    got = {}
    for r in cells.search_many(spark, path, asked, 7, probes=1, exact=True).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == {q: nearest(rows, v, 7) for q, v in queries.items() if v is not None}


def test_every_row_is_in_the_index_and_few_cells_are_read(spark):
    random.seed(5)
    middles = [[10.0 * (i == j) for j in range(12)] for i in range(12)]
    rows = [(i, [x + random.gauss(0, 0.2) for x in middles[i % 12]]) for i in range(600)]
    path = store(spark, rows, cells=12, sample=200)
    sizes = spark.read.parquet(f"{path}/cells").collect()
    assert sum(r["n"] for r in sizes) == 600 and len(sizes) <= 12
    assert spark.read.parquet(f"{path}/settings").first()["probes"] <= 2
    found = cells.search_many(spark, path, spark.createDataFrame([(1, middles[3])], "query int, vector array<double>"), 5, probes=1)
    assert [r["id"] for r in found.orderBy("rank").collect()] == nearest(rows, middles[3], 5)


def test_recall_on_the_test_table(spark):
    """The cells that the sample was measured to need find nine tenths of the ten nearest of all rows."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    path = tempfile.mkdtemp(prefix="spark-") + "/cells"
    cells.build(table, path)
    asked = table.where("id % 50 = 0").selectExpr("id AS query", "vector")
    near = {(r["query"], r["id"]) for r in cells.search_many(spark, path, asked, 10).collect()}
    exact = {(r["query"], r["id"]) for r in cells.search_many(spark, path, asked, 10, exact=True).collect()}
    recall = len(near & exact) / len(exact)
    assert recall >= 0.9


def test_empty(spark):
    path = store(spark, [])
    assert cells.search_many(spark, path, spark.createDataFrame([(1, [1.0])], "query int, vector array<double>"), 3).count() == 0


def test_rows_and_queries_meet_in_bounded_parts(spark, monkeypatch):
    """Parts, splits, groups of queries and blocks smaller than cells, with many copies, give what comparing all gives; before, each pair was a row with both vectors."""
    for name, value in {"BLOCK": 7, "PART_ROWS": 20, "PART_QUERIES": 4, "MOST_HELD": 10}.items():
        monkeypatch.setattr(cells, name, value)
    random.seed(8)
    rows = [(i, [random.gauss(0, 1) for _ in range(5)]) for i in range(120)]
    rows += [(500 + i, list(rows[3][1])) for i in range(30)]
    path = store(spark, rows, cells=4, sample=60)
    queries = dict(rows[:9])
    asked = spark.createDataFrame(list(queries.items()), "query int, vector array<float>")
    found = cells.search_many(spark, path, asked, 6, probes=1, exact=True)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    assert got == {q: nearest(rows, v, 6) for q, v in queries.items()}
    assert "FlatMapCoGroups" in found._jdf.queryExecution().optimizedPlan().toString()
