"""Best-fit packing of token sequences by linear grouping.

Lengths are at most the capacity, so a table of how many pieces have each length is all that planning needs: it is bounded whatever
the input. The plan is a list of runs: which ranks of a length go to which sequences and offsets. Spark ranks the pieces within
their length and reads their places from the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.bpe import encoder
from lexmill.llm.common import mapped, materialize, two_columns

#: Rows that one ranking group should have, and the fewest groups that a length is dealt over.
RANKED_TOGETHER, LEAST_SALTS = 100_000, 256
#: Configurations that a linear programme may choose from; a number of groups that has more is not tried.
MOST_WAYS = 300_000


class Bins:
    """Runs of open sequences, by the space that they have left."""

    def __init__(self):
        self.by_space: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []

    def add(self, space: int, first: int, count: int) -> None:
        if space and count:
            if not self.by_space.get(space):
                self.by_space[space] = []
                insort(self.spaces, space)
            self.by_space[space].append((first, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """(space, first, count) of a run with the least space that holds the length."""
        at = bisect_left(self.spaces, length)
        if at == len(self.spaces):
            return None
        space = self.spaces[at]
        first, count = self.by_space[space].pop()
        if not self.by_space[space]:
            del self.spaces[at]
        return space, first, count


def group_sizes(segments: list[list[int]], groups: int) -> list[list[list[int]]]:
    """Linear grouping: segments [length, first rank, end rank] by falling length, cut into groups of equal cardinality."""
    total = sum(end - start for _, start, end in segments)
    out: list[list[list[int]]] = []
    room = done = 0
    for length, rank, end in segments:
        while rank < end:
            if not room:
                out.append([])
                room = -(-(total - done) // max(1, groups - len(out) + 1))
            take = min(room, end - rank)
            out[-1].append([length, rank, rank + take])
            rank, room, done = rank + take, room - take, done + take
    return out


def configurations(sizes: list[int], capacity: int) -> np.ndarray:
    """Every way to put one to three of the sizes into one sequence, as rows of three size numbers; len(sizes) stands for nothing. Sizes fall."""
    m = len(sizes)
    with_none = np.array([*sizes, 0], dtype=np.int64)
    a, b = np.triu_indices(m + 1)
    fits = with_none[a] + with_none[b] <= capacity
    pairs = np.stack([a[fits], b[fits]], axis=1)
    pairs = pairs[pairs[:, 0] < m]
    out = []
    for c in range(m + 1):
        two = pairs[(pairs[:, 1] <= c) & (with_none[pairs].sum(axis=1) + with_none[c] <= capacity)]
        out.append(np.concatenate([two, np.full((len(two), 1), c)], axis=1))
    return np.concatenate(out)


def fewest_sequences(ways: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Ways and how often to use each, a fraction, so that all sizes are placed in the fewest sequences: a linear programme, by the simplex method.

    It starts with each size alone. The prices of the sizes under the present ways show the way that saves most, which comes in for the
    one that runs out first, until no way saves anything.
    """
    m = len(counts)
    basis = np.eye(m)
    used = [np.array([i, m, m]) for i in range(m)]
    often = counts.astype(np.float64)
    for _ in range(60 * m):
        price = np.append(np.linalg.solve(basis.T, np.ones(m)), 0.0)
        worth = price[ways].sum(axis=1)
        best = int(np.argmax(worth))
        if worth[best] <= 1 + 1e-9:
            break
        column = np.bincount(ways[best], minlength=m + 1)[:m].astype(np.float64)
        change = np.linalg.solve(basis, column)
        falls = change > 1e-9
        steps = np.where(falls, often / np.where(falls, change, 1.0), np.inf)
        out = int(np.argmin(steps))
        often = np.maximum(often - steps[out] * change, 0.0)
        often[out] = steps[out]
        basis[:, out] = column
        used[out] = ways[best]
    return list(zip(used, often.tolist()))


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, most_ways: int = MOST_WAYS) -> tuple[int, list[tuple[int, int, int, int, int, int]]] | None:
    """The sequences and runs of plan_packing for one number of groups; None if it has too many configurations."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = Bins()
    sequence = counts.get(capacity, 0)
    if sequence:
        runs.append((capacity, 0, sequence, 0, 1, 0))
    segments = [[x, 0, counts[x]] for x in sorted(counts, reverse=True) if capacity // 4 < x < capacity and counts[x]]
    while segments:
        grouped = group_sizes(segments, groups)
        left = np.array([sum(e - s for _, s, e in g) for g in grouped], dtype=np.int64)
        before = left.sum()
        ways = configurations([g[0][0] for g in grouped], capacity)
        if len(ways) > most_ways:
            return None
        solved = fewest_sequences(ways, left)
        for way, often in sorted(solved, key=lambda x: -x[1]):
            pick = [int(i) for i in way if i < len(grouped)]
            times = min(int(often + 0.5), *(int(left[i]) // pick.count(i) for i in set(pick)))
            if not times:
                continue
            slots = []  # actual pieces for each place, in runs
            for i in pick:
                slot, need = [], times
                while need:
                    segment = grouped[i][0]
                    take = min(need, segment[2] - segment[1])
                    slot.append([segment[0], segment[1], take])
                    segment[1] += take
                    need -= take
                    if segment[1] == segment[2]:
                        grouped[i].pop(0)
                slots.append(slot)
                left[i] -= times
            done = 0
            while done < times:
                step = min(slot[0][2] for slot in slots)
                at = 0
                for slot in slots:
                    length, rank, n = slot[0]
                    runs.append((length, rank, rank + step, sequence + done, 1, at))
                    at += length
                    if n == step:
                        slot.pop(0)
                    else:
                        slot[0] = [length, rank + step, n - step]
                bins.add(capacity - at, sequence + done, step)
                done += step
            sequence += times
        segments = [segment for group in grouped for segment in group]
        if left.sum() in (0, before) or left.sum() < 4:
            break
    rest = [*map(tuple, segments)]  # what fractions of ways leave over: a few sequences' worth
    rest += [(x, 0, counts[x]) for x in sorted(counts, reverse=True) if x <= capacity // 4]
    for length, rank, end in rest:
        while rank < end:
            found = bins.take(length)
            if found is None:
                each = capacity // length
                found = capacity, sequence, -(-(end - rank) // each)
                sequence += found[2]
            space, first, n = found
            each = min(space // length, end - rank)
            take = min(n, (end - rank) // each)
            runs.append((length, rank, rank + take * each, first, each, capacity - space))
            rank += take * each
            bins.add(space - each * length, first, take)
            bins.add(space, first + take, n - take)
    return sequence, runs


def plan_packing(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = (8, 24, 64, 120, 300)) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first sequence, pieces of it a sequence, offset) that place every piece.

    Pieces above a quarter of the capacity are large, so at most three fit together. They are rounded up to the largest of their
    group, groups being equal in number; a linear programme finds how often each configuration of rounded sizes is used so that they need the
    fewest sequences; actual pieces are put in their places, which leaves some more space; and what the whole numbers leave over and the
    small pieces, from the longest, go to the sequence with the least sufficient space. Few groups waste space and many leave
    more over, so each of the given numbers of groups is planned (those with over MOST_WAYS configurations are not) until one is
    within a five-thousandth of what all tokens need, and the plan with the fewest sequences is taken.
    """
    least = -(-sum(x * n for x, n in counts.items()) // capacity)
    best = None
    for number in groups:
        plan = grouped_plan(counts, capacity, number)
        best = plan if plan and (best is None or plan[0] < best[0]) else best
        if best and best[0] <= least + least // 5000:
            break
    return best[1] if best else []


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every row's ids with end_id after them; only what is longer than the capacity is cut, the first piece taking the rest."""

    def cut(batches):
        import pyarrow as pa

        encode, end = encoder(path), int(end_id).to_bytes(4, "little")
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for j, (x, y) in enumerate(zip(edges, edges[1:])):
                    row.append(k)
                    piece.append(j)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    two = two_columns(docs, id_col, text_col)
    return mapped(two, cut, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, capacity: int = 2048, groups: tuple[int, ...] = (8, 24, 64, 120, 300)) -> DataFrame:
    """cut (a stored table with doc_id, piece and length, 1 to capacity) with sequence_id and offset.

    Lengths are dealt over salts for ranking, so that one frequent length is no single task. Repeated rows are packed each.
    """
    total = cut.count()
    salts = max(LEAST_SALTS, total // RANKED_TOGETHER)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    cells = materialize(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = cells.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")
    plan = sorted(plan_packing(counts, capacity, groups))
    table = np.array(plan, dtype=np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]
    columns = ranked.columns
    length_at, rank_at = columns.index("length"), columns.index("rank")

    def place(batches):
        import pyarrow as pa

        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (length_at, rank_at))
            run = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1] if len(table) else np.zeros((len(length), 6), np.int64)
            nth, within = np.divmod(rank - run[:, 1], np.maximum(run[:, 4], 1))
            arrays = [b.column(i) for i in range(len(columns)) if i != rank_at]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(run[:, 3] + nth), pa.array(run[:, 5] + within * length)], names=[*(c for c in columns if c != "rank"), "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, groups: tuple[int, ...] = (8, 24, 64, 120, 300), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    Null and empty texts are one piece with only end_id. An empty table gives an empty table; other columns are not looked at.
    """
    placed = pack(materialize(pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity, groups)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
