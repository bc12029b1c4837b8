"""Each stage of the pipeline on its own input, against what its operator says and brute force."""

import corpus_pipeline as pipeline
from lexmill.llm import simhash


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_one_of_each_group_stays(spark):
    copy = "one two three four five six seven"
    rows = [(5, copy), (3, copy), (9, copy), (9, copy), (1, "alone and quite different from the rest"), (1, copy + " more words that make it another text"), (None, None), (None, None), (7, "")]
    got = pipeline.without_near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(3, copy), (1, rows[4][1]), (1, rows[5][1]), (-1, "")])
    prints = [simhash.fingerprint((r["text"] or "").encode(), 3, 42) & (1 << 64) - 1 for r in got]
    assert all((a ^ b).bit_count() > 2 for k, a in enumerate(prints) for b in prints[k + 1 :])


def test_contaminated_texts_go(spark, tmp_path):
    item = "this is a benchmark passage of more than thirteen words that should never be in training data"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, f"before {item} after"), (1, "the same id and clean"), (2, item + " w" * 1000), (3, None), (4, "clean")]
    got = pipeline.without_benchmark(spark, docs(spark, rows), str(tmp_path))
    assert got.columns == pipeline.COLUMNS
    assert sorted((r["doc_id"], r["text"] or "") for r in got.collect()) == sorted([(1, rows[1][1]), (2, rows[2][1]), (3, ""), (4, "clean")])


def test_personal_data_is_masked(spark):
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.without_personal_data(spark, docs(spark, [(1, "mail a@b.cc now"), (1, "nothing"), (2, None)]), "").collect() if r["text"] != "nothing"}
    assert got == {1: ("mail [EMAIL] now", 16), 2: (None, None)}


def test_stages_take_empty_tables_and_further_columns(spark, tmp_path):
    """Each stage gives an empty table for an empty one, and keeps columns whose names its operators use, too."""
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    some = docs(spark, [(1, "one text stands here, unlike any other"), (2, None), (3, "and another one")]).selectExpr("*", "'k' as key", "1 as h", "2 as n", "'t' as term", "0.5 as score", "'b' as block")
    for _, stage in pipeline.STAGES:
        none = stage(spark, some.limit(0), str(tmp_path))
        assert none.count() == 0
        out = stage(spark, some, str(tmp_path))
        if stage is not pipeline.packed:
            assert out.columns == some.columns and out.count() <= 3
            assert none.columns == some.columns
        else:
            assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]


def test_quality_stage_keeps_what_the_query_accepts(spark):
    """The stage keeps just the rows whose score by the operator is 0.3 or more."""
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    model = pipeline.quality_mil.train(first, spark.read.parquet(f"{sf}/labels.parquet"), pipeline.remainder(5) != 0)
    want = {r["doc_id"] for r in pipeline.quality_mil.score(first, model).where("score >= 0.3").collect()}
    assert {r["doc_id"] for r in pipeline.good_quality(spark, first, sf).collect()} == want


def test_whole_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    first = spark.read.parquet(f"{sf}/documents.parquet")
    kept = pipeline.good_quality(spark, first, sf)
    assert kept.columns == first.columns and first.count() * 0.6 < kept.count() <= first.count()
    out = pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in kept.collect()}
    assert len({(r["doc_id"], r["piece"]) for r in out}) == len(out)
