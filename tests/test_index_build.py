"""A stored index shuffles postings once, not words, and has the counts of its texts."""

import math
import re
import tempfile
from collections import Counter

from lexmill.operators import search

TEXTS = {1: "the Erth, the erth", 2: None, 3: "", 4: "one", 5: "erth " * 40 + "the ingth.", 6: " .. ,,"}


def test_counts_and_scores(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_BYTES", 1)
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    search.build_index(spark.createDataFrame(list(TEXTS.items()), "id int, t string"), "id", "t", path)
    words = {i: [w for w in re.split("[^a-z0-9.]+", (x or "").lower()) if w] for i, x in TEXTS.items()}
    want = {(i, w, n, len(ws)) for i, ws in words.items() for w, n in Counter(ws).items()}
    assert {(r["id"], r["term"], r["tf"], r["length"]) for r in spark.read.parquet(f"{path}/postings").collect()} == want
    facts = spark.read.parquet(f"{path}/facts").first()
    mean = sum(map(len, words.values())) / 6
    assert (facts["n"], facts["mean"]) == (6, mean)
    got = {r["id"]: r["score"] for r in search.bm25(spark, path, ["one"]).collect()}
    assert set(got) == {4} and math.isclose(got[4], math.log(1 + 5.5 / 1.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 / mean)))


def test_words_are_counted_in_slices():
    import pyarrow as pa

    lists = [["a", "b", "a"], [], None, ["b"], ["c", "c"]]
    found = {}
    slices = list(search.counted(pa.array(lists), 2))
    for at, terms, row, term, tf in slices:
        for r, t, n in zip(row, term, tf):
            found[at + int(r), terms[int(t)].as_py()] = int(n)
    assert len(slices) > 2 and found == {(0, "a"): 2, (0, "b"): 1, (3, "b"): 1, (4, "c"): 2}


def test_postings_are_shuffled_once(spark):
    """Before, each word of each text was shuffled to be counted, and its counts again."""
    path = tempfile.mkdtemp(prefix="spark-") + "/index"
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("index", "index")
    table = spark.range(0, 400, 1, 4).selectExpr("id", "concat('w', id % 7, ' the') AS t")
    search.build_index(table, "id", "t", path)
    stages = {s for j in tracker.getJobIdsForGroup("index") for s in tracker.getJobInfo(j).stageIds}
    assert spark.read.parquet(f"{path}/postings").count() == 800
    assert len([s for s in stages if (info := tracker.getStageInfo(s)) and info.numTasks >= search.BUCKETS]) == 1
