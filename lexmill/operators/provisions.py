"""Provisions: a section's text as a tree of labelled parts, with paths, parents and order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import is_all_caps_heading

#: The kinds of labels by depth: (1), (a), (A), (i), (I).
LEVELS = [re.compile(p) for p in (r"[0-9]+", r"[a-z]{1,2}", r"[A-Z]{1,2}", r"[ivxl]+", r"[IVXL]+")]
LABELS = re.compile(r"\s*\(([0-9]+|[a-zA-Z]{1,5})\)")
SCHEMA = "array<struct<order:int,path:array<string>,depth:int,label:string,text:string,implied:boolean>>"


ROMANS = "i ii iii iv v vi vii viii ix x xi xii xiii xiv xv".split()


def depth_of(label: str, open_labels: dict[int, str]) -> int:
    """The depth that a label belongs to, given the labels open at each depth.

    A roman numeral also reads as letters: it is a numeral if it is the first right below the deepest open label, or follows the numeral open there.
    """
    for depth in (3, 4):
        if LEVELS[depth].fullmatch(label) and label.lower() in ROMANS:
            place = ROMANS.index(label.lower())
            if place == 0 and max(open_labels, default=0) == depth - 1 or place and open_labels.get(depth, "").lower() == ROMANS[place - 1]:
                return depth
    return next((d for d in (0, 1, 2) if LEVELS[d].fullmatch(label)), 4)


def parse_section(text: str) -> list[dict]:
    """The parts of one section in order: labels at a line's start open parts, other lines continue the part before.

    All but the last of several labels on one line, as in "(1)(a)", become implied parts without text. A path that comes again gets
    a mark _v2, _v3 and so on.
    """
    parts: list[dict] = []
    labels_open: dict[int, str] = {}  # as they stand in the text
    path: dict[int, str] = {}  # with marks
    seen: dict[tuple, int] = {}
    for line in (text or "").split("\n"):
        line = line.strip()
        if not line:
            continue
        at, labels = 0, []
        while m := LABELS.match(line, at):
            labels.append(m[1])
            at = m.end()
        body = line[at:].strip()
        if not labels:
            if parts:
                parts[-1]["text"] = f"{parts[-1]['text']} {body}".strip()
            else:
                parts.append({"order": 0, "path": [], "depth": 0, "label": "", "text": body, "implied": False})
            continue
        for k, label in enumerate(labels):
            depth = depth_of(label, labels_open)
            for d in [d for d in labels_open if d >= depth]:
                del labels_open[d], path[d]
            labels_open[depth] = path[depth] = label
            key = tuple(path[d] for d in sorted(path))
            seen[key] = n = seen.get(key, 0) + 1
            if n > 1:
                path[depth] = f"{label}_v{n}"
            last = k == len(labels) - 1
            parts.append({"order": len(parts), "path": [path[d] for d in sorted(path)], "depth": len(path), "label": label, "text": body if last else "", "implied": not last})
    return parts


def provision_tree(sections: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, order, path, depth, label, text, implied and parent (the path above, null at the top) of each part of each section."""

    def parsed(texts: pd.Series) -> pd.Series:
        return pd.Series([parse_section(t) for t in texts])

    rows = sections.select(F.col(id_col).alias("id"), F.explode(F.pandas_udf(parsed, SCHEMA)(F.col(text_col))).alias("p")).select("id", "p.*")
    return rows.withColumn("parent", F.when(F.col("depth") > 1, F.slice("path", 1, F.col("depth") - 1)))


def heading_paths(lines: DataFrame, group: str, order: str, text_col: str) -> DataFrame:
    """Lines with the last all-capital heading above them in their group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", F.last(F.when(is_all_caps_heading(F.col(text_col)), F.col(text_col)), ignorenulls=True).over(w))
