"""SimHash near-duplicates: 64-bit fingerprints of word shingles, pigeonhole blocks, links within a Hamming distance, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import in_slices, mapped, materialize, two_columns

BITS = 64
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def fingerprint(data: bytes, width: int, seed: int) -> int:
    """The signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles of width words with repeats."""
    words = data.lower().split()  # of bytes: both look at ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[width - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (signed long) of each row. Null and empty texts and those without words have 0."""

    def of(batches):
        import pyarrow as pa

        for b in batches:
            values = [fingerprint(t, width, seed) for texts in in_slices(b.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    two = two_columns(docs, id_col, text_col)
    return mapped(two, of, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of every choice of blocks - distance blocks: two fingerprints within the distance agree on at least one whole mask (pigeonhole)."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(choice)) for choice in combinations(each, blocks - distance)]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, distance: int, blocks: int, most: int) -> DataFrame:
    """Links (a, b), a < b, that join distinct fingerprints (column fp) at most distance bits apart, enough of them for the components.

    Fingerprints meet in blocks. A block value with at most `most` fingerprints is joined with itself and each pair verified, so a
    fingerprint meets fewer than `most` others there. The fingerprints of larger ones meet instead at every fingerprint that is
    within half the distance of them: two are within the distance if and only if such a place is shared, and a place has a
    bounded number of fingerprints. There each is linked with the smallest, so dense groups give few links. No link is lost.
    """
    if distance != 2:
        raise ValueError("large blocks meet at their one-bit neighbours, which is exact for a distance of 2")
    masks = block_masks(distance, blocks)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "value"))
    counts = keyed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, ["mask", "value"]), "blocks")
    small = shared.where(F.col("n") <= most)
    a, b = small.select("mask", "value", F.col("fp").alias("a")), small.select("mask", "value", F.col("fp").alias("b"))
    pairs = a.join(b, ["mask", "value"]).where((F.col("a") < F.col("b")) & (hamming(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    dense = shared.where(F.col("n") > most).select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    places = dense.select("fp", F.explode(near).alias("place"))
    heads = places.groupBy("place").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = places.join(heads, "place").where(F.col("fp") > F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node and root (the smallest node reachable) of each node in edges (a, b), by alternating large and small stars.

    A round replaces each node's links by links to the smallest of its neighbours; the number of rounds grows with the logarithm
    of the input. Each round is written to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == got:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = got
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42, distance: int = 2, blocks: int = 5, most: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable over links) of each row.

    Equal fingerprints are one node, so copies are never expanded to pairs. Null or empty texts have fingerprint 0 and are linked
    with each other. Repeated rows are kept. A null doc_id keeps its row and never names a component unless nothing else does.
    An empty table gives an empty table.
    """
    marked = materialize(fingerprints(docs, width, seed, id_col, text_col), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), distance, blocks, most))
    reached = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    named = nodes.join(reached, nodes.fp == reached.node)
    by_root = named.groupBy("root").agg(F.min("least").alias("component"))
    linked = named.join(by_root, "root").select("fp", "component")
    alone = nodes.where("n > 1").join(reached, nodes.fp == reached.node, "left_anti").select("fp", F.col("least").alias("component"))
    found = marked.join(linked.union(alone), "fp", "left")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component", "doc_id").alias("component_id"))
