"""Quality rules: counts over a text's words and lines, and a hashed n-gram logistic regression scored in Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.calibrate import platt, sigmoid
from lexmill.llm.common import labelled_sample, two_columns

WORD_BUCKETS, CHAR_BUCKETS = 1 << 11, 1 << 11
#: Added to a text's n-grams, so that very short texts stay near zero instead of at the extremes.
SMOOTH = 32
SYMBOLS = b"#*$%&|<>"
#: Words in a window that counts as repeated.
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more; windows with equal 64-bit hashes are compared word by word."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, dtype=np.uint64)
        for j in range(window):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + (h[j : j + n] ^ (h[j : j + n] >> np.uint64(29)))
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    alike = np.unique(np.concatenate([order[1:][same], order[:-1][same]])).tolist()
    found: dict[tuple[bytes, ...], list[int]] = {}
    for i in alike:
        found.setdefault(tuple(words[i : i + window]), []).append(i)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.array([i for places in found.values() if len(places) > 1 for i in places], dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    chars = np.frombuffer(b"".join(words), dtype=np.uint8)
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.split(None, 1):  # has a word
            seen.add(line)
    return len(words), int(((chars & 0xC0) != 0x80).sum()), len(data) - len(data.translate(None, SYMBOLS)), dup, repeated_words(words)


def char_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the three bytes that start at each position."""
    a, b, c = (data[i : len(data) - 2 + i].astype(np.uint32) for i in range(3))
    return ((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B) ^ c * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(21)


def word_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of the words and of adjacent pairs; bucket 0 is for words equal to the one before."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    pairs = (h[:-1] * np.uint32(0x9E3779B1)) ^ h[1:]
    buckets = np.concatenate([h, pairs * np.uint32(0x85EBCA6B)]) >> np.uint32(21)
    buckets[len(h) :][h[:-1] == h[1:]] = 0
    return buckets


def features(data: bytes, words: list[bytes]) -> np.ndarray:
    """Square roots of the relative frequencies of the hashed word and character n-grams; all zero for an empty text."""
    w = np.bincount(word_buckets(words), minlength=WORD_BUCKETS) if words else np.zeros(WORD_BUCKETS)
    c = np.bincount(char_buckets(np.frombuffer(data, np.uint8)), minlength=CHAR_BUCKETS) if len(data) > 2 else np.zeros(CHAR_BUCKETS)
    return np.sqrt(np.concatenate([w / (w.sum() + SMOOTH), c / (c.sum() + SMOOTH)])).astype(np.float32)


def fit(sample: list[tuple[str, int]], rounds: int = 150, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Logistic regression by Adam on two thirds of the sample, calibrated on the rest."""
    if not sample:
        return {"w": np.zeros(WORD_BUCKETS + CHAR_BUCKETS, np.float32), "b": 0.0, "platt": platt(np.zeros(0), np.zeros(0))}
    x = np.stack([features(d := t.encode(), d.split()) for t, _ in sample])
    y = np.array([label for _, label in sample], dtype=np.float32)
    held = np.arange(len(y)) % 3 == 2
    tx, ty = x[~held], y[~held]
    pos = max(1.0, float(ty.sum()))
    weight = np.where(ty == 1, len(ty) / (2 * pos), len(ty) / (2 * max(1.0, len(ty) - pos))).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, rounds + 1):
        error = weight * (sigmoid(tx @ w + b) - ty) / len(ty)
        g, gb = tx.T @ error + decay * w, float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = (w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
        b -= rate * (mb / (1 - 0.9**k)) / (np.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    rest = held if held.any() else ~held
    return {"w": w, "b": float(b), "platt": platt(x[rest] @ w + b, y[rest])}


def apply_rules(docs: DataFrame, model: dict, threshold: float = 0.3, least_words: int = 20, most_repeated: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, quality (the model's probability) and kept of each row.

    Null texts count as empty: no words, so base_failed. Repeated rows stay; an empty table gives an empty table; other columns
    are not looked at.
    """
    (slope, shift), w, b0 = model["platt"], model["w"], model["b"]

    def score(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for data in b.column(1).cast(pa.binary()):
                data = data.as_py() or b""
                words = data.split()
                rows.append((*base_counts(data, words), float(sigmoid(slope * (float(features(data, words) @ w) + b0) + shift))))
            columns = list(zip(*rows)) if rows else [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality"])

    two = two_columns(docs, id_col, text_col)
    scored = two.mapInArrow(score, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000, max_bytes: int = 12_000_000) -> dict:
    """The model fitted on a bounded sample of rows with a quality label: about max_rows texts, max_bytes in all."""
    return fit(labelled_sample(docs, labels, "quality", F.lit(True), max_rows, max_bytes))
