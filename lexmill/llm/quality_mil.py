"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded, gated attention weighs the passages, and the weighted sum is classified; encoder,
gates and classifier are learned together from labels of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.calibrate import platt, sigmoid
from lexmill.llm.common import in_slices, labelled_sample, mapped, two_columns

#: Bytes in a passage; hashed three-byte buckets of its features, besides which it has EXTRA shares.
PASSAGE, BUCKETS, EXTRA = 512, 512, 9
#: Added to each passage's number of buckets' hits, so that very short texts stay near zero instead of at the extremes.
SMOOTH = 32
#: Bytes of a longer text that are encoded at a time, and of several texts that are scored together.
SLICE, SCORED = 1 << 20, 1 << 18
#: Bytes of the sample that are encoded at a time for fitting, which the driver does.
FIT_SLICE = 1 << 17


def byte_classes() -> np.ndarray:
    """Which bytes are lower case, upper case, digits, white space, other ASCII and line ends."""
    table = np.zeros((256, 6), dtype=np.float32)
    for i, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32))):
        table[list(chars), i] = 1
    table[[c for c in range(33, 127) if not chr(c).isalnum()], 4] = 1
    table[10, 5] = 1
    return table


def repeats(joined: np.ndarray, owner: np.ndarray, text_of: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each passage, and those equal to the word before them in the same text."""
    space = (joined == 32) | ((joined >= 9) & (joined <= 13))
    new = np.concatenate([[True], text_of[1:] != text_of[:-1]])
    start = np.nonzero(~space & (np.concatenate([[True], space[:-1]]) | new))[0]
    if not len(start):
        return np.zeros(total), np.zeros(total)
    place = np.arange(len(joined)) - np.repeat(start, np.diff([*start, len(joined)])) + 1 if start[0] == 0 else np.concatenate([np.zeros(start[0], np.int64), np.arange(start[0], len(joined)) - np.repeat(start, np.diff([*start, len(joined)])) + 1])
    with np.errstate(over="ignore"):
        codes = (joined.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        codes = np.where(space, np.uint64(0), (codes ^ (codes >> np.uint64(31))) * place.astype(np.uint64))
        word = np.add.reduceat(codes, start)
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (text_of[start[1:]] == text_of[start[:-1]])])
    return np.bincount(owner[start], minlength=total), np.bincount(owner[start[same]], minlength=total)


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of every text, and the passages of each text; an empty text is one passage of zeros."""
    per = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    joined = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(joined)) - np.repeat(starts, lengths)
    owner = np.repeat(first[:-1], lengths) + at // PASSAGE
    shares = np.zeros((total, EXTRA), dtype=np.float32)
    grams = np.zeros((total, BUCKETS), dtype=np.float32)
    n = np.maximum(np.bincount(owner, minlength=total), 1).astype(np.float32)
    if len(joined):
        counts = np.bincount(owner * 256 + joined, minlength=total * 256).reshape(total, 256).astype(np.float32)
        shares[:, :6] = counts @ byte_classes() / n[:, None]
        words, same = repeats(joined, owner, np.repeat(np.arange(len(texts)), lengths), total)
        shares[:, 7], shares[:, 8] = words / n, same / (words + 4)
    if len(joined) > 2:
        a, b, c = (joined[i : len(joined) - 2 + i].astype(np.uint32) for i in range(3))
        bucket = ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(23)
        inside = owner[:-2] == owner[2:]
        counts = np.bincount((owner[:-2] * BUCKETS + bucket)[inside], minlength=total * BUCKETS).reshape(total, BUCKETS)
        hits = counts.sum(axis=1)
        shares[:, 6] = ((counts * counts).sum(axis=1) - hits) / np.maximum(hits * (hits - 1), 1)  # high where a passage repeats itself
        grams = np.sqrt(counts.astype(np.float32) / (hits[:, None] + SMOOTH).astype(np.float32))
    return np.concatenate([grams, shares * 4], axis=1).astype(np.float32), per


def grouped(texts: Iterable[bytes], most: int) -> Iterator[list[bytes]]:
    """The texts in lists of about most bytes; a longer one stands alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def sample_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """passages of all texts, worked out FIT_SLICE bytes at a time into one array (a longer text in slices of whole passages, as decision reads it), so that the driver holds little besides the features."""
    per = np.array([max(1, -(-len(t.encode()) // PASSAGE)) for t in texts], dtype=np.int64)
    x = np.empty((int(per.sum()), BUCKETS + EXTRA), dtype=np.float32)
    at = 0
    for group in grouped((t.encode() for t in texts), FIT_SLICE):
        whole = len(group[0]) <= SLICE
        for part in [group] if whole else ([group[0][k : k + SLICE]] for k in range(0, len(group[0]), SLICE)):
            found = passages(part)[0]
            x[at : at + len(found)] = found
            at += len(found)
    return x, per


def encoded(x: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages encoded (h), the two gates, and the attention of each before it is shared out."""
    h = np.tanh(x @ p["E"] + p["e"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    return h, t, g, (t * g) @ p["w"]


def forward(x: np.ndarray, per: np.ndarray, p: dict) -> dict:
    """Every stage's values: h (passages encoded), attention a, text representation z and its score s."""
    h, t, g, raw = encoded(x, p)
    first = np.cumsum(per) - per
    owner = np.repeat(np.arange(len(per)), per)
    e = np.exp(raw - np.maximum.reduceat(raw, first)[owner])
    a = e / np.add.reduceat(e, first)[owner]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": z @ p["c"] + p["b"][0], "first": first, "owner": owner}


def decision(text: bytes, p: dict) -> float:
    """The score of one long text, read in slices of whole passages: only attention sums are kept of each."""
    top, total, weighted = -np.inf, 0.0, np.zeros(len(p["c"]))
    for at in range(0, len(text), SLICE):
        h, _, _, raw = encoded(passages([text[at : at + SLICE]])[0], p)
        before, top = top, max(top, float(raw.max()))
        e = np.exp(raw - top)
        total, weighted = total * np.exp(before - top) + e.sum(), weighted * np.exp(before - top) + e @ h
    return float(weighted / total @ p["c"] + p["b"][0])


def gradients(x: np.ndarray, per: np.ndarray, p: dict, d: np.ndarray) -> dict:
    """Gradients of the loss whose derivative by the scores is d."""
    f = forward(x, per, p)
    h, t, g, a, owner, first = f["h"], f["t"], f["g"], f["a"], f["owner"], f["first"]
    dz = d[:, None] * p["c"][None, :]
    da = (dz[owner] * h).sum(axis=1)
    draw = a * (da - np.add.reduceat(a * da, first)[owner])
    dt, dg = draw[:, None] * p["w"] * g * (1 - t * t), draw[:, None] * p["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
    return {"E": x.T @ dh, "e": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ draw, "c": f["z"].T @ d, "b": np.array([d.sum()])}


def fit(sample: list[tuple[str, int]], width: int = 16, gates: int = 8, rounds: int = 150, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Learns by Adam on two thirds of the sample, classes weighted alike, and calibrates on the rest."""
    rng = np.random.default_rng(seed)
    n = BUCKETS + EXTRA
    shape = {"E": (n, width), "e": (width,), "V": (width, gates), "U": (width, gates), "w": (gates,), "c": (width,), "b": (1,)}
    p = {k: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32) if k not in "eb" else np.zeros(s, np.float32) for k, s in shape.items()}
    if not sample:
        return p | {"platt": (0.0, 0.0)}
    y = np.array([label for _, label in sample], dtype=np.float32)
    held = np.arange(len(y)) % 3 == 2

    def pick(mask):
        return sample_passages([t for (t, _), k in zip(sample, mask) if k])

    (x, per), ty = pick(~held), y[~held]
    pos = max(1.0, float(ty.sum()))
    weight = np.where(ty == 1, len(ty) / (2 * pos), len(ty) / (2 * max(1.0, len(ty) - pos)))
    m, v = ({k: np.zeros(s, np.float32) for k, s in shape.items()} for _ in range(2))
    for k in range(1, rounds + 1):
        d = (weight * (sigmoid(forward(x, per, p)["s"]) - ty) / len(ty)).astype(np.float32)
        for name, grad in gradients(x, per, p, d).items():
            grad = grad + decay * p[name]
            m[name], v[name] = 0.9 * m[name] + 0.1 * grad, 0.99 * v[name] + 0.01 * grad * grad
            p[name] = (p[name] - rate * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    rest = held if held.any() else ~held
    rx, rper = pick(rest)
    return p | {"platt": platt(forward(rx, rper, p)["s"], y[rest])}


def scores(texts: list[bytes], model: dict) -> np.ndarray:
    """Probability of quality 1 of each text, worked out over slices of bounded size."""
    slope, shift = model["platt"]
    found = [np.array([decision(group[0], model)]) if len(group[0]) > SLICE else forward(*passages(group), model)["s"] for group in grouped(texts, min(SCORED, SLICE))]
    return sigmoid(slope * np.concatenate(found) + shift) if found else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, condition=None, max_rows: int = 3000, max_bytes: int = 12_000_000) -> dict:
    """The model learned from a bounded sample: about max_rows labelled texts, max_bytes in all, whose doc_id meets the condition."""
    return fit(labelled_sample(docs, labels, "quality", F.lit(True) if condition is None else condition, max_rows, max_bytes))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row.

    Null texts are scored like empty ones; repeated rows stay; an empty table gives an empty table; other columns are not looked at.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [scores(texts, model) for texts in in_slices(b.column(1), SCORED)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else [], pa.float64())], names=["doc_id", "score"])

    two = two_columns(docs, id_col, text_col)
    return mapped(two, run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, score double")


def accepted(docs: DataFrame, model: dict, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least the threshold. Batches pass through a worker one by one and are copied in slices only.

    Null texts are scored like empty ones; repeated rows are each judged alike; an empty table gives an empty table.
    """
    at = docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa

        for b in batches:
            found = [scores(texts, model) for texts in in_slices(b.column(at).cast(pa.string()), SCORED)]
            yield b.filter(pa.array(np.concatenate(found) >= threshold if found else [], pa.bool_()))

    return mapped(docs, keep, docs.schema)
