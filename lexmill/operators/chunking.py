"""Chunks of texts for retrieval: budgets, boundaries, overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import CHARS_PER_TOKEN, estimate_tokens
from lexmill.operators.loading import slices, spread

#: Token budgets by kind of chunk; editions before the given year have that much less.
BUDGETS = {"full_statute": 28_000, "full_statute_context": 26_000, "contextual_provision": 16_000, "citation_context": 16_000, "definition_block": 18_000, "exception_block": 16_000, "penalty_block": 14_000}
OLD_EDITION, OLD_LESS = 2020, 1_000
#: Where a text is cut, from the best place to the worst.
BOUNDARIES = [re.compile(p) for p in (r"(?=\n\([0-9a-zA-Z]+\))", r"\n\n+", r"\n", r"(?<=[.;:])\s+", r"\s+")]


def budget(kind: Column, year: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BUDGETS.items() for x in pair])
    return F.try_element_at(table, kind) - F.when(year < OLD_EDITION, OLD_LESS).otherwise(0)


def char_windows(text: Column, size: int) -> Column:
    """Windows of a fixed number of characters, the last one shorter."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_text(text: str, most: int, level: int = 0) -> list[str]:
    """Parts of at most `most` characters, cut at the best boundaries; words longer than that are cut by characters."""
    parts: list[str] = []
    stack = [(text, level)]
    while stack:
        piece, at = stack.pop()
        if len(piece) <= most:
            if piece.strip():
                parts.append(piece.strip())
        elif at >= len(BOUNDARIES):
            parts += [piece[k : k + most] for k in range(0, len(piece), most)]
        else:
            units = [u for u in BOUNDARIES[at].split(piece) if u.strip()]
            joint = "\n" if at < 3 else " "
            packed: list[str] = []
            for u in units:
                if packed and len(packed[-1]) + len(joint) + len(u) <= most:
                    packed[-1] += joint + u
                else:
                    packed.append(u)
            stack += [(p, at + 1) for p in reversed(packed)]
    return parts


def chunks(df: DataFrame, id_col: str, text_col: str, tokens: int, overlap_words: int = 0) -> DataFrame:
    """id, part, parts, text and n_tokens: each text in parts of at most `tokens` planned tokens, each beginning with the last words of the part before."""
    most = int(tokens * CHARS_PER_TOKEN)

    def parts_of(text: str | None) -> list[str]:
        parts = split_text(text or "", most)
        if overlap_words:
            for k in range(1, len(parts)):  # the part before already has its own overlap
                parts[k] = " ".join([*parts[k - 1].split()[-overlap_words:], parts[k]])
        return parts

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for at, upto in slices([b.column(1)]):
                found = [parts_of(t) for t in b.column(1).slice(at, upto - at).to_pylist()]
                sizes = np.array([len(x) for x in found], np.int32)
                row = np.repeat(np.arange(at, upto), sizes)
                part = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(part), pa.array(np.repeat(sizes, sizes)), pa.array([x for one in found for x in one], pa.string())], names=["id", "part", "parts", "text"])

    texts = spread(df).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, part int, parts int, text string")
    return rows.select("id", "part", "parts", "text", estimate_tokens(F.col("text")).alias("n_tokens"))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.;:])\s+", -1), lambda s: F.trim(s) != "")
