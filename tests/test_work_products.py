"""Patches of work products: each operation, places that move with texts, and all or nothing."""

import pytest

from lexmill.operators import work_products as w


def block(i, text="Hello world", parent=None, ordinal=1, **more):
    return {"block_id": i, "parent_id": parent, "ordinal": ordinal, "type": "paragraph", "role": "custom", "text": text, "number": None, "attributes": {}} | more


def record(i, block_id, start=None, stop=None, kind="link"):
    return {"record_id": i, "kind": kind, "block_id": block_id, "start": start, "stop": stop, "attributes": {}}


def run(blocks, operations, records=()):
    return w.fold([dict(b) for b in blocks], [dict(r) for r in records], [{"n": k, **o} for k, o in enumerate(operations)])


def texts(result):
    return {b["block_id"]: (b["parent_id"], b["ordinal"], b["text"]) for b in result["blocks"]}


def places(result):
    return {r["record_id"]: (r["block_id"], r["start"], r["stop"]) for r in result["records"]}


def test_update_and_delete():
    done = run([block("b1")], [{"op": "update_block", "block_id": "b1", "fields": {"text": "Updated", "title": "T", "note": None}}])
    assert texts(done) == {"b1": (None, 1, "Updated")} and done["blocks"][0]["attributes"] == {"title": "T"}
    done = run([block("b1"), block("c", parent="b1")], [{"op": "delete_block", "block_id": "b1", "keep": True}], [record("l", "b1")])
    assert done["blocks"] == [] and done["records"] == [] and [b["block_id"] for b in done["tombstones"]] == ["b1", "c"]
    assert run([block("b1")], [{"op": "delete_block", "block_id": "b1"}])["tombstones"] == []


def test_split_moves_records_and_rejects_straddled_places():
    split = [{"op": "split_block", "block_id": "b1", "position": 5, "other_id": "b2"}]
    done = run([block("b1"), block("z", ordinal=2)], split, [record("a", "b1", 0, 5), record("c", "b1", 6, 11, "citation"), record("e", "b1", 5, 5, "exhibit"), record("f", "b1", None, None, "finding")])
    assert texts(done) == {"b1": (None, 1, "Hello"), "b2": (None, 2, " world"), "z": (None, 3, "Hello world")}
    assert places(done) == {"a": ("b1", 0, 5), "c": ("b2", 1, 6), "e": ("b2", 0, 0), "f": ("b1", None, None)}
    rejected = run([block("b1")], [{"op": "update_block", "block_id": "b1", "fields": {"text": "other words"}}, {"op": "split_block", "block_id": "b1", "position": 3, "other_id": "b2"}], [record("l", "b1", 0, 5)])
    assert "within the place" in rejected["error"] and texts(rejected) == {"b1": (None, 1, "Hello world")} and places(rejected) == {"l": ("b1", 0, 5)}
    assert "past the end" in run([block("b1")], [split[0] | {"position": 12}])["error"]
    assert run([block("b1")], [split[0] | {"position": 11}])["error"] is None
    assert "below it" in run([block("b1"), block("c", parent="b1")], split)["error"]


def test_merge():
    merge = [{"op": "merge_blocks", "block_id": "b1", "other_id": "b2"}]
    done = run([block("b1"), block("b2", "two", ordinal=2)], merge, [record("a", "b2", 1, 3), record("f", "b2", None, None, "finding")])
    assert texts(done) == {"b1": (None, 1, "Hello world\n\ntwo")} and places(done) == {"a": ("b1", 14, 16), "f": ("b1", None, None)}
    assert places(run([block("b1", ""), block("b2", "two", ordinal=2)], merge, [record("a", "b2", 0, 3)])) == {"a": ("b1", 0, 3)}
    assert "no siblings" in run([block("b1"), block("b2", parent="b1")], merge)["error"]
    assert "no siblings" in run([block("b1")], [merge[0] | {"other_id": "b1"}])["error"]
    assert "without its block" in run([block("b1"), block("b2", ordinal=2), block("c", parent="b2")], merge, [record("x", "c")])["error"]


def test_insert_and_move():
    done = run([block("a"), block("b", ordinal=2)], [{"op": "insert_block", "block_id": "n", "after_id": "a", "fields": {"text": "new", "type": "heading", "x": "1"}}, {"op": "move_block", "block_id": "a", "parent_id": "b"}, {"op": "move_block", "block_id": "b"}])
    assert [(b["block_id"], b["parent_id"], b["ordinal"]) for b in done["blocks"]] == [("n", None, 1), ("b", None, 2), ("a", "b", 1)] and done["blocks"][0]["attributes"] == {"x": "1"}
    for bad, why in (({"op": "move_block", "block_id": "a", "parent_id": "a"}, "below itself"), ({"op": "move_block", "block_id": "a", "parent_id": "c"}, "no block c"), ({"op": "insert_block", "block_id": "a"}, "repeated"), ({"op": "insert_block", "block_id": "q", "parent_id": "zz"}, "no block zz"), ({"op": "paint"}, "no operation")):
        assert why in run([block("a"), block("c", parent="a")], [bad])["error"]


def test_records_and_numbers():
    done = run([block("a"), block("h", type="heading", ordinal=2), block("c", parent="a"), block("b", ordinal=3, role="relief")], [
        {"op": "add_record", "record_id": "r", "kind": "citation", "block_id": "a", "start": 0, "stop": 11, "fields": {"status": "new"}},
        {"op": "resolve_record", "record_id": "r", "fields": {"status": "resolved", "target_id": None}},
        {"op": "add_record", "record_id": "gone", "kind": "link", "block_id": "a"}, {"op": "remove_record", "record_id": "gone"}, {"op": "remove_record", "record_id": "never"},
        {"op": "renumber_paragraphs"}, {"op": "apply_template", "other_id": "t1"},
    ])
    assert done["records"] == [record("r", "a", 0, 11, "citation") | {"attributes": {"status": "resolved"}}] and done["template"] == "t1"
    assert {b["block_id"]: b["number"] for b in done["blocks"]} == {"a": 1, "c": 2, "h": None, "b": 3}
    assert "outside" in run([block("a")], [{"op": "add_record", "record_id": "r", "kind": "link", "block_id": "a", "start": 3, "stop": 99}])["error"]
    assert "outside" in run([block("a")], [{"op": "update_block", "block_id": "a", "fields": {"text": "x"}}], [record("r", "a", 0, 5)])["error"]
    assert "no record" in run([block("a")], [{"op": "resolve_record", "record_id": "r"}])["error"]


@pytest.fixture(scope="module")
def tables(spark):
    blocks = [("d1", *block("b1").values()), ("d2", *block("b1").values()), ("d3", *block("x", parent="lost", ordinal=2).values()), ("d3", *block("y", parent="x").values()), ("d3", *block("w", ordinal=1).values()), ("d3", *block("u", parent="v").values()), ("d3", *block("v", parent="u").values())]
    records = [("d1", *record("l", "b1", 6, 11).values())]
    operations = [("d1", 0, "split_block", "b1", None, None, "b2", None, None, 6, None, None, None, None), ("d2", 1, "delete_block", "b1", *[None] * 10), ("d2", 2, "delete_block", "b1", *[None] * 10), ("dx", 1, "insert_block", "n", *[None] * 9, {"text": "t"})]
    return spark.createDataFrame(blocks, f"doc string, {w.BLOCK}"), spark.createDataFrame(records, f"doc string, {w.RECORD}"), spark.createDataFrame(operations, f"doc string, {w.OPERATION}")


def test_tables(tables):
    blocks, records, operations = tables
    results = w.apply_patches(blocks, records, operations).cache()
    assert {r["doc"]: r["error"] for r in results.collect()} == {"d1": None, "d2": "no block b1", "dx": None}
    rows = {(r["doc"], r["block_id"]): r["text"] for r in w.patched(blocks, results, "blocks").collect()}
    assert rows == {("d1", "b1"): "Hello ", ("d1", "b2"): "world", ("d2", "b1"): "Hello world", ("dx", "n"): "t", **{("d3", i): "Hello world" for i in "xywuv"}}
    assert [(r["doc"], r["record_id"], r["block_id"], r["start"], r["stop"]) for r in w.patched(records, results, "records").collect()] == [("d1", "l", "b2", 0, 5)]
    assert w.apply_patches(blocks, records, operations.limit(0)).count() == 0


def test_tree(tables):
    rows = w.block_tree(tables[0].where("doc = 'd3'")).orderBy("place").collect()
    assert [(r["block_id"], r["parent_id"], r["depth"]) for r in rows] == [("w", None, 0), ("x", None, 0), ("y", "x", 1)]


def test_batches_are_folded_in_slices():
    """A batch of long documents is never held whole as Python strings."""
    import json

    import pyarrow as pa

    blocks = [json.dumps([{"block_id": "b", "parent_id": None, "ordinal": 1, "text": "x" * 700_000}])] * 5 + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(blocks, pa.string()), pa.array([None] * 6, pa.string()), pa.array(["[]"] * 6)], names=["doc", "blocks", "records", "operations"])
    out = list(w.folded([batch]))
    assert len(out) >= 5 and [d for b in out for d in b.column(0).to_pylist()] == list(range(6))
    assert len(json.loads(out[0].column(1)[0].as_py())["blocks"][0]["text"]) == 700_000
