"""Byte-level byte-pair encoding: token counts by heap-and-linked-list merging, and token ids for packing.

A text is cut at the tokenizer's special strings and by its pre-tokenization pattern; each distinct piece is merged once
per Python worker and remembered in a bounded table.
"""

from __future__ import annotations

import heapq
import json
import struct
import sys
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import in_slices, two_columns

#: Fixed value: the published pattern of byte-level BPE pre-tokenization.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pieces, of at most LONGEST characters, that each of a worker's tables and its older one hold; an entry takes about 120 bytes, so that all take 150 MB at most.
#: ENCODED is that number where ids are kept, which are longer, and a piece that was forgotten costs less than in counting: its merges are compiled code.
REMEMBERED, LONGEST, ENCODED = 200_000, 64, 50_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def numbered_merges(merges: list) -> dict[int, int]:
    """Rank of each mergeable pair, keyed by the pair's two symbol numbers. A byte's number is its value; those of merged symbols follow."""
    number = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {}
    for rank, m in enumerate(merges):
        left, right = m.split(" ") if isinstance(m, str) else m
        number.setdefault(left + right, 256 + rank)
        ranks[number[left] << 20 | number[right]] = rank << 20 | number[left + right]
    return ranks


def merges_of(data: bytes, ranks: dict[int, int]) -> int:
    """How many merges byte-pair encoding makes: the adjacent pair of lowest rank (then leftmost) goes first, until none is left."""
    n = len(data)
    if n < 2:
        return 0
    end = 0xFFFFF  # no symbol's number: it pairs with nothing
    parts, after, before = [*data, end], list(range(1, n + 2)), list(range(-1, n))
    get = ranks.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(data[i] << 20 | data[i + 1])) is not None]
    heapq.heapify(heap)
    merged = 0
    while heap:
        entry = heapq.heappop(heap)
        i = entry & 0xFFFFFFFF
        j = after[i]
        rank = entry >> 32
        if get(parts[i] << 20 | parts[j]) != rank:
            continue  # one of the two has been merged meanwhile
        merged += 1
        symbol = rank & 0xFFFFF
        parts[i], parts[j] = symbol, end
        after[i] = k = after[j]
        before[k] = i
        if (r := get(symbol << 20 | parts[k])) is not None:
            heapq.heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := get(parts[h] << 20 | symbol)) is not None:
            heapq.heappush(heap, r << 32 | h)
    return merged


class Remembered(dict):
    """The value of make(key), made when first asked for. When the table is full it becomes the older one, from which keys that are asked for again come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.size, self.older = make, most, 0, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > LONGEST:
                return value
        self[key] = value
        self.size += 1
        if self.size >= self.most:
            self.older, self.size = dict(self), 0
            self.clear()
        return value


class Unsafe(Exception):
    """White space next to a space or line end: the pattern has to see the whole text."""


class Pieces:
    """Walks a text's pieces. piece_value: of one piece; total: of a list of values; special_value: of a special string's id; most: entries that each table remembers.

    A space or line end between two other characters always ends a piece, so most texts are cut there by str.split and
    the pattern only runs on words not seen before. A text with longer white space goes through the pattern whole.
    """

    def __init__(self, path: str, piece_value, total, special_value, most: int):
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.special = {s: special_value(i) for s, i in special.items()}
        self.total, self.pieces = total, regex.compile(PATTERN).findall
        self.piece_value, self.known = piece_value, Remembered(piece_value, most)
        self.first = Remembered(lambda word: self.word("", word), most)
        self.later = Remembered(lambda word: self.word(" ", word), most)
        self.line_end = self.known["\n"]

    def word(self, space: str, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        if word.isalpha():
            return self.piece_value(space + word)
        if word[-1] in ",." and word[:-1].isalpha():
            return self.total([(self.later if space else self.first)[word[:-1]], self.known[word[-1]]])
        return self.whole(space + word)

    def whole(self, text: str):
        return self.total(list(map(self.known.__getitem__, self.pieces(text))))

    def plain(self, text: str) -> list:
        if not text:
            return []
        try:
            values, later = [], self.later.__getitem__
            for k, line in enumerate(text.split("\n")):
                if k:
                    values.append(self.line_end)
                head, *words = line.split(" ")
                values.append(self.first[head])
                values += map(later, words)
            return values
        except Unsafe:
            return [self.whole(text)]

    def of(self, text: str):
        """The value of a whole text; special strings count as one token each, as in the library's default."""
        values, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            values += [*self.plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return self.total(values + self.plain(text[at:]))


def vocabulary(path: str) -> dict:
    """The file's model; anything that these functions would not follow is refused."""
    spec = json.load(open(path, encoding="utf-8"))
    model, before = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec.get("normalizer") or before.get("add_prefix_space") or before.get("use_regex") is False:
        raise ValueError("a byte-level BPE tokenizer with the usual pattern, without normalizer and prefix space, is needed")
    if any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        raise ValueError("merges that are skipped, dropped or marked are not supported")
    if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special strings that take in what is around them are not supported")
    return model


@lru_cache(maxsize=2)
def counter(path: str):
    """A function that counts a text's tokens by merging, without their ids."""
    ranks = numbered_merges(vocabulary(path)["merges"])

    def count(piece: str) -> int:
        data = piece.encode()
        return len(data) - merges_of(data, ranks)

    return Pieces(path, count, sum, lambda i: 1, REMEMBERED).of


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function that gives a text's ids as little-endian unsigned 32-bit numbers."""
    import tiktoken

    values = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {bytes(values[c] for c in token): i for token, i in vocabulary(path)["vocab"].items()}
    one = tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(piece: str) -> bytes:
        found = array("I", one(piece))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    return Pieces(path, ids, b"".join, lambda i: struct.pack("<I", i), ENCODED).of


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    path: the tokenizer's .json, readable on each executor. Null and empty texts have 0 tokens; repeated rows and null ids
    stay as they are; an empty table gives an empty table; other columns are not looked at.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        count = counter(path)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            tokens = [count(t.decode()) for texts in in_slices(b.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    two = two_columns(docs, id_col, text_col)
    counted = two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
