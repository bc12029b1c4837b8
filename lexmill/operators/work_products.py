"""Work products: documents as trees of blocks with records that point into their texts, changed by patches as a whole or not at all.

Blocks, records and operations are tables keyed by document. Spark gathers each patched document's rows; the operations are folded over
them one after another by `fold`, and a document whose patch fails anywhere stays as it was. Documents without a patch are not
gathered.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.operators.loading import slices

BLOCK = "block_id string, parent_id string, ordinal int, type string, role string, text string, number int, attributes map<string,string>"
RECORD = "record_id string, kind string, block_id string, start int, stop int, attributes map<string,string>"
OPERATION = "n int, op string, block_id string, parent_id string, after_id string, other_id string, record_id string, kind string, position int, start int, stop int, keep boolean, fields map<string,string>"
#: The blocks that are numbered, by type and role, and the records that have places in texts.
NUMBERED_TYPES = ["numbered_paragraph", "paragraph"]
NUMBERED_ROLES = ["factual_allegation", "legal_allegation", "jurisdiction", "venue", "claim_element", "relief", "procedural", "background", "argument", "fact", "custom"]
PLACED = ["link", "citation", "exhibit"]
#: Fixed value: what joins the texts of merged blocks.
BETWEEN = "\n\n"


class Rejected(Exception):
    """Why a patch does not apply."""


class Document:
    """One document's blocks in order below their parents, and its records."""

    def __init__(self, blocks: list[dict], records: list[dict]):
        self.blocks, self.children = {}, {}
        for b in sorted(blocks, key=lambda b: (b["ordinal"], b["block_id"])):
            if b["block_id"] in self.blocks:
                raise Rejected(f"repeated block {b['block_id']}")
            self.blocks[b["block_id"]] = b
        for b in self.blocks.values():
            if b.get("parent_id") not in self.blocks:  # a lost parent makes a root
                b["parent_id"] = None
            self.children.setdefault(b["parent_id"], []).append(b["block_id"])
        self.records = {r["record_id"]: r for r in records}
        self.tombstones: list[dict] = []
        self.template = None

    def block(self, block_id: str) -> dict:
        if block_id not in self.blocks:
            raise Rejected(f"no block {block_id}")
        return self.blocks[block_id]

    def place(self, block: dict, parent_id: str | None, after_id: str | None) -> None:
        """Puts a block below a parent, after a sibling or last, and numbers the siblings anew."""
        if parent_id is not None:
            self.block(parent_id)
        if block["block_id"] in self.blocks:
            raise Rejected(f"repeated block {block['block_id']}")
        siblings = self.children.setdefault(parent_id, [])
        at = siblings.index(after_id) + 1 if after_id in siblings else len(siblings)
        siblings.insert(at, block["block_id"])
        self.blocks[block["block_id"]] = block | {"parent_id": parent_id}
        for k, sibling in enumerate(siblings):
            self.blocks[sibling]["ordinal"] = k + 1

    def below(self, block_id: str | None) -> list[str]:
        """The blocks below one, itself not, in the order of reading."""
        return [b for child in self.children.get(block_id, []) for b in (child, *self.below(child))]

    def take(self, block_id: str) -> list[dict]:
        """Takes out a block with all below it."""
        block = self.block(block_id)
        taken = [block_id, *self.below(block_id)]
        self.children[block["parent_id"]].remove(block_id)
        return [self.blocks.pop(b) for b in taken]

    def apply(self, o: dict) -> None:
        getattr(self, o["op"] if o["op"] in OPERATIONS else "unknown")(o)

    def unknown(self, o: dict) -> None:
        raise Rejected(f"no operation {o['op']}")

    def insert_block(self, o: dict) -> None:
        fields = dict(o.get("fields") or {})
        own = {k: fields.pop(k, "") for k in ("type", "role", "text")}
        self.place({"block_id": o["block_id"], "number": None, "attributes": fields, **own}, o.get("parent_id"), o.get("after_id"))

    def update_block(self, o: dict) -> None:
        block = self.block(o["block_id"])
        for name, value in (o.get("fields") or {}).items():
            if name in ("type", "role", "text"):
                block[name] = value or ""
            else:
                block["attributes"] = {k: v for k, v in {**(block["attributes"] or {}), name: value}.items() if v is not None}

    def delete_block(self, o: dict) -> None:
        taken = self.take(o["block_id"])
        for b in taken[1:]:
            self.children.pop(b["block_id"], None)
        self.children.pop(o["block_id"], None)
        self.records = {i: r for i, r in self.records.items() if r["block_id"] != o["block_id"]}
        if o.get("keep"):
            gone = {b["block_id"] for b in taken}
            self.tombstones = [b for b in self.tombstones if b["block_id"] not in gone] + taken

    def move_block(self, o: dict) -> None:
        if o.get("parent_id") == o["block_id"]:
            raise Rejected("a block cannot be moved below itself")
        block, *others = self.take(o["block_id"])
        self.place(block, o.get("parent_id"), o.get("after_id"))
        self.blocks |= {b["block_id"]: b for b in others}

    def split_block(self, o: dict) -> None:
        block, at = self.block(o["block_id"]), o["position"]
        if at > len(block["text"]):
            raise Rejected("a split past the end of the text")
        if self.children.get(o["block_id"]):
            raise Rejected("a split of a block with blocks below it")
        mine = [r for r in self.records.values() if r["block_id"] == o["block_id"] and r["kind"] in PLACED and r["start"] is not None]
        if any(r["start"] < at < r["stop"] for r in mine):
            raise Rejected("a split within the place of a record")
        left, right = block["text"][:at], block["text"][at:]
        block["text"] = left
        self.place({**block, "block_id": o["other_id"], "text": right}, block["parent_id"], o["block_id"])
        for r in mine:
            if r["start"] >= at:
                r |= {"block_id": o["other_id"], "start": r["start"] - at, "stop": max(r["stop"] - at, 0)}

    def merge_blocks(self, o: dict) -> None:
        first, second = self.block(o["block_id"]), self.block(o["other_id"])
        if first["parent_id"] != second["parent_id"] or first is second:
            raise Rejected("a merge of blocks that are no siblings")
        self.take(o["other_id"])
        shift = len(first["text"]) + (len(BETWEEN) if first["text"] and second["text"] else 0)
        first["text"] += (BETWEEN if first["text"] and second["text"] else "") + second["text"]
        for r in self.records.values():
            if r["block_id"] == o["other_id"]:
                r["block_id"] = o["block_id"]
                if r["kind"] in PLACED and r["start"] is not None:
                    r |= {"start": r["start"] + shift, "stop": r["stop"] + shift}

    def renumber_paragraphs(self, o: dict) -> None:
        n = 0
        for b in map(self.blocks.__getitem__, self.below(None)):
            if b["type"] in NUMBERED_TYPES and b["role"] in NUMBERED_ROLES:
                n += 1
                b["number"] = n

    def add_record(self, o: dict) -> None:
        text = self.block(o["block_id"])["text"]
        if o.get("start") is not None and not 0 <= o["start"] <= (o["stop"] if o.get("stop") is not None else -1) <= len(text):
            raise Rejected("a record's place outside of the text")
        self.records[o["record_id"]] = {"record_id": o["record_id"], "kind": o["kind"], "block_id": o["block_id"], "start": o.get("start"), "stop": o.get("stop"), "attributes": dict(o.get("fields") or {})}

    def resolve_record(self, o: dict) -> None:
        if o["record_id"] not in self.records:
            raise Rejected(f"no record {o['record_id']}")
        record = self.records[o["record_id"]]
        record["attributes"] = {**(record["attributes"] or {}), **{k: v for k, v in (o.get("fields") or {}).items() if v is not None}}

    def remove_record(self, o: dict) -> None:
        self.records.pop(o["record_id"], None)

    def apply_template(self, o: dict) -> None:
        self.template = o["other_id"]

    def check(self) -> None:
        """What must hold after a patch: records point to blocks and to places in their texts."""
        for r in self.records.values():
            if r["block_id"] not in self.blocks:
                raise Rejected(f"record {r['record_id']} without its block")
            if r["start"] is not None and not 0 <= r["start"] <= r["stop"] <= len(self.blocks[r["block_id"]]["text"]):
                raise Rejected(f"record {r['record_id']} outside of its text")


OPERATIONS = ["insert_block", "update_block", "delete_block", "move_block", "split_block", "merge_blocks", "renumber_paragraphs", "add_record", "resolve_record", "remove_record", "apply_template"]


def fold(blocks: list[dict], records: list[dict], operations: list[dict]) -> dict:
    """A document after all operations, or as it was with the error of the first that fails."""
    was = json.loads(json.dumps([blocks, records]))
    try:
        document = Document(blocks, records)
        for o in sorted(operations, key=lambda o: o["n"]):
            document.apply(o)
        document.check()
    except Rejected as reason:
        return {"error": str(reason), "blocks": was[0], "records": was[1], "tombstones": [], "template": None}
    order = document.below(None)
    return {"error": None, "blocks": [document.blocks[b] for b in order], "records": list(document.records.values()), "tombstones": document.tombstones, "template": document.template}


def folded(batches):
    """doc and result of each document, a slice of a batch at a time."""
    import pyarrow as pa

    for b in batches:
        for at, upto in slices(b.columns[1:]):
            rows = zip(*(c.slice(at, upto - at).to_pylist() for c in b.columns[1:]))
            results = [json.dumps(fold(*(json.loads(x or "[]") for x in row))) for row in rows]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, upto - at), pa.array(results, pa.string())], names=["doc", "result"])


def names(ddl: str) -> list[str]:
    return [c.split(" ")[0] for c in ddl.split(", ")]


def gathered(rows: DataFrame, docs: DataFrame, ddl: str, name: str) -> DataFrame:
    """The rows of the given documents as a JSON array each."""
    one = F.to_json(F.collect_list(F.struct(*names(ddl))), {"ignoreNullFields": "false"})
    return rows.join(docs, "doc", "left_semi").groupBy("doc").agg(one.alias(name))


def apply_patches(blocks: DataFrame, records: DataFrame, operations: DataFrame) -> DataFrame:
    """doc, error, blocks, records, tombstones and template of each document with operations.

    blocks (doc and BLOCK; ids unique in a document, ordinals from 1 among siblings), records (doc and RECORD; places are code points, stop
    exclusive, null: none) and operations (doc and OPERATION, applied in the order of n) are flat tables. insert_block takes type, role,
    text and attributes from fields; move_block and insert_block put a block after after_id, or last; update_block sets fields, a null
    drops an attribute; split_block cuts at position, other_id is the new block; merge_blocks appends other_id to block_id and drops what is below
    other_id; delete_block takes all below with it and the block's own records, keep leaves tombstones; add_record, resolve_record,
    remove_record and renumber_paragraphs do as they say; apply_template sets other_id. Any operation that cannot be done, and a record left
    without its block or outside of its text, rejects the whole patch: error says why, and blocks and records are as before. Blocks
    come in the order of reading. Operations on an unknown document see an empty one.
    """
    docs = operations.select("doc").distinct()
    rows = gathered(operations, docs, OPERATION, "operations").join(gathered(blocks, docs, BLOCK, "blocks"), "doc", "left").join(gathered(records, docs, RECORD, "records"), "doc", "left")
    results = rows.select("doc", "blocks", "records", "operations").mapInArrow(folded, f"doc {rows.schema['doc'].dataType.simpleString()}, result string")
    result = F.from_json("result", f"error string, blocks array<struct<{typed(BLOCK)}>>, records array<struct<{typed(RECORD)}>>, tombstones array<struct<{typed(BLOCK)}>>, template string")
    return results.select("doc", result.alias("r")).select("doc", "r.*")


def typed(ddl: str) -> str:
    return ", ".join(f"{c.split(' ')[0]}:{c.split(' ', 1)[1]}" for c in ddl.split(", "))


def patched(table: DataFrame, results: DataFrame, column: str) -> DataFrame:
    """The blocks or records of all documents: those of patched ones from the results, others as they were."""
    ddl = BLOCK if column == "blocks" else RECORD
    kept = table.select("doc", *names(ddl)).join(results.select("doc"), "doc", "left_anti")
    return kept.unionByName(results.select("doc", F.explode(column).alias("x")).select("doc", "x.*"))


def walked(blocks: pd.Series) -> pd.Series:
    def walk(rows: list[dict]) -> list[dict]:
        document = Document(rows, [])
        depth: dict[str | None, int] = {None: -1}
        found = []
        for k, b in enumerate(document.below(None)):
            depth[b] = depth[document.blocks[b]["parent_id"]] + 1
            found.append({"block_id": b, "parent_id": document.blocks[b]["parent_id"], "depth": depth[b], "place": k})
        return found

    return blocks.map(lambda x: json.dumps(walk(json.loads(x))))


def block_tree(blocks: DataFrame) -> DataFrame:
    """doc, block_id, parent_id, depth and place (in the order of reading, from 0) of each block that hangs on a root; a block whose parent is not there is a root, blocks that are below themselves are left out."""
    rows = gathered(blocks, blocks.select("doc").distinct(), BLOCK, "blocks")
    tree = F.from_json(F.pandas_udf(walked, "string")("blocks"), "array<struct<block_id:string,parent_id:string,depth:int,place:int>>")
    return rows.select("doc", F.explode(tree).alias("b")).select("doc", "b.*")
