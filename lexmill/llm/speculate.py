"""Byte-pair encoding by guess and proof, and decoding.

A word is first cut greedily into the longest tokens of the vocabulary. That is right for most words, and it is proved without
merging: a sequence of tokens is what merging gives if each token alone merges to itself and no two neighbours would have been
merged across their border earlier. All neighbours of a batch of new words are tested together as arrays; only words with a pair
that fails are merged step by step.

The test of a pair walks back in time. Merges happen in the order of their ranks, since the parts of a merged token have lower
ranks than it. So of two neighbours the later one is undone again and again, until only bytes are left, and at each step the two
symbols at the border must not have a merge that comes before both are used up.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from lexmill.llm.bpe import PATTERN, byte_symbols, vocabulary
from lexmill.llm.common import two_columns

#: Units, and words, that a worker's table and its older one hold, up to LONGEST characters each; an entry takes about 400 bytes, so that all take 160 MB at most.
REMEMBERED, LONGEST = 100_000, 64
#: A text is worked on in parts of about so many characters.
PART = 1 << 20
#: A rank that no merge has.
NEVER = 1 << 40

#: A place before which a text may be cut: a space between two characters that are no white space always begins a word.
SAFE = re.compile(r"(?<=\S)(?= \S)")


class Vocabulary:
    """A byte-level BPE file as arrays over token ids: each token's bytes, the rank of its last merge (-1: a byte) and the two tokens that this merge joins."""

    def __init__(self, path: str):
        import json

        import numpy as np

        model = vocabulary(path)
        value = {c: b for b, c in enumerate(byte_symbols())}
        ids = model["vocab"]
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            if i not in self.special.values():
                self.bytes[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte = [ids[c] for c in byte_symbols()]
        self.merges: dict[int, int] = {}  # left << 20 | right: rank << 20 | token
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            self.merges[ids[left] << 20 | ids[right]] = rank << 20 | ids[left + right]
        self.byte_pairs = [[self.merges.get(a << 20 | b, NEVER << 20) for b in self.byte] for a in self.byte]
        self.made, self.left, self.right = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, np.int64)
        keys = np.array([*self.merges], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], (np.array([*self.merges.values()], np.int64) >> 20)[order]
        self.tokens = {self.bytes[i]: i for i in self.byte}
        for pair, merge in sorted(self.merges.items(), key=lambda x: x[1]):
            a, b, rank, i = pair >> 20, pair & 0xFFFFF, merge >> 20, merge & 0xFFFFF
            if max(self.made[a], self.made[b]) >= rank:
                raise ValueError("a merge comes before one that makes its parts")
            if self.made[i] < 0 and self.merged(self.bytes[i], pair) == [a, b]:  # else the token never comes of its own bytes by this merge
                self.made[i], self.left[i], self.right[i] = rank, a, b
                self.tokens[self.bytes[i]] = i
        longer = defaultdict(set)
        for token in self.tokens:
            if len(token) > 3:
                longer[token[:4]].add(len(token))
        self.longer = {start: [*sorted(n, reverse=True), 3, 2] for start, n in longer.items()}
        self.decimal = [str(i).encode() for i in range(size)]

    def merged(self, data: bytes, last: int = -1) -> list[int]:
        """The tokens that merging gives: the pair of lowest rank, then the leftmost, first. last: a pair whose merge is left out."""
        get, none, table = self.merges.get, NEVER << 20, self.byte_pairs
        parts = list(map(self.byte.__getitem__, data))
        if len(parts) > 200:
            return self.merged_long(parts)
        ranks = [table[a][b] for a, b in zip(data, data[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            if parts[i] << 20 | parts[i + 1] == last:
                ranks[i] = none
                continue
            parts[i : i + 2] = [least & 0xFFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(parts[i] << 20 | parts[i + 1], none)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | parts[i], none)
        return parts

    def merged_long(self, parts: list[int]) -> list[int]:
        """The same for a word of any length, by a heap over a linked list."""
        import heapq

        n, gone = len(parts), 0xFFFFF
        parts, after, before, get = [*parts, gone], list(range(1, n + 2)), list(range(-1, n)), self.merges.get
        heap = [(m, i) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            merge, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] == gone or j >= n or get(parts[i] << 20 | parts[j]) != merge:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = merge & 0xFFFFF, gone
            after[i] = k = after[j]
            before[k] = i
            for at, pair in ((i, parts[i] << 20 | parts[k]), (before[i], parts[before[i]] << 20 | parts[i])):
                if at >= 0 and (m := get(pair)) is not None:
                    heapq.heappush(heap, (m, at))
        return [p for p in parts if p != gone]

    def guessed(self, data: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        found, at, end, get, longer, short = [], 0, len(data), self.tokens.get, self.longer.get, (3, 2)
        while at < end:
            for n in longer(data[at : at + 4], short):
                if (token := get(data[at : at + n])) is not None:
                    break
            else:
                n, token = 1, get(data[at : at + 1])
            found.append(token)
            at += n
        return found

    def compatible(self, left, right):
        """Of arrays of neighbours, those that merging leaves side by side."""
        import numpy as np

        ok = np.ones(len(left), bool)
        at = np.arange(len(left))
        used_left = used_right = np.full(len(left), NEVER)
        while len(at):
            keys = left << 20 | right
            place = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            rank = np.where(self.pairs[place] == keys, self.pair_ranks[place], NEVER)
            clash = (rank < used_left) & (rank <= used_right) & (rank < NEVER)  # of equal ranks the leftmost goes first
            ok[at[clash]] = False
            made_left, made_right = self.made[left], self.made[right]
            back = made_left > made_right
            on = ~clash & ((made_left >= 0) | (made_right >= 0))
            used_left, used_right = np.where(back, made_left, used_left)[on], np.where(back, used_right, made_right)[on]
            left, right = np.where(back, self.right[left], left)[on], np.where(back, right, self.left[right])[on]
            at = at[on]
        return ok

    def encode_words(self, words: list[str]) -> tuple[list[tuple[int, ...]], int]:
        """Each word's tokens, and how many words had to be merged."""
        import numpy as np

        data = [w.encode() for w in words]
        guesses = list(map(self.guessed, data))
        sizes = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(guesses)), sizes)
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs, which = np.unique(flat[inside] << 20 | flat[inside + 1], return_inverse=True)
        failed = np.unique(of[inside[~self.compatible(pairs >> 20, pairs & 0xFFFFF)[which]]])
        for i in failed.tolist():
            guesses[i] = self.merged(data[i])
        return list(map(tuple, guesses)), len(failed)


class Encoder:
    """Token ids of texts. Texts are cut at spaces between two characters that are no white space, which always begin a word; what stands between them is remembered."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        self.known_words: dict[str, tuple[int, ...]] = {}
        #: Of what stands after a space by its string, of a part's beginning by a tuple of its string.
        self.known: dict[str | tuple[str], tuple[int, ...]] = {}
        #: What the tables held when they were last full; what is asked for again comes back from here.
        self.older_words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str | tuple[str], tuple[int, ...]] = {}
        self.guessed = self.failed = 0

    def parts(self, text: str) -> Iterator[str | int]:
        """Special strings as their ids, and what is between them in parts of about PART characters that end where a word does."""
        at, cut = 0, self.vocabulary.cut
        for m in cut.finditer(text) if cut else ():
            yield from self.pieces(text[at : m.start()])
            yield self.vocabulary.special[m[0]]
            at = m.end()
        yield from self.pieces(text[at:] if at else text)

    @staticmethod
    def pieces(text: str) -> Iterator[str]:
        if len(text) <= PART:
            if text:
                yield text
            return
        at = 0
        while at < len(text):
            m = SAFE.search(text, at + PART)
            end = m.start() if m else len(text)
            yield text[at:end]
            at = end

    @staticmethod
    def units(part: str) -> list[str | tuple[str]]:
        """The part cut at its spaces, which are left out."""
        units = part.split(" ")
        units[0] = (units[0],)
        return units

    @staticmethod
    def safe_units(part: str) -> list[str | tuple[str]]:
        """The part cut only at spaces between two characters that are no white space."""
        first, *others = part.split(" ")
        units = [first]
        for u in others:
            if not u or u[0].isspace() or not units[-1] or units[-1][-1].isspace():
                units[-1] += " " + u
            else:
                units.append(u)
        units[0] = (units[0],)
        return units

    def words_of(self, unit: str | tuple[str]) -> list[str]:
        text = unit[0] if isinstance(unit, tuple) else " " + unit
        bare = text[1:] if text[:1] == " " else text
        if bare.isalpha():
            return [text]
        if bare[-1:] in (",", ".") and bare[:-1].isalpha():
            return [text[:-1], bare[-1]]
        return self.words(text)

    @staticmethod
    def bring_back(wanted, known: dict, older: dict) -> dict:
        """Those of wanted that only the older table has, now in the other one, too."""
        again = {u: t for u in wanted if u not in known and (t := older.get(u)) is not None}
        known.update(again)
        return again

    def learn(self, missing: set) -> None:
        """Encodes new units together and remembers them."""
        if len(self.known) + len(missing) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, several, new = self.known, {}, []
        for u in missing:
            if u.__class__ is str and u.isalpha():
                new.append(u)
            else:
                several[u] = self.words_of(u)
        words = set(chain.from_iterable(several.values()))
        # a word after a space that is all letters is remembered as a unit
        plain = {w: w[1:] for w in words if w[:1] == " " and w[1:].isalpha()}
        self.bring_back(plain.values(), known, self.older)
        new += {u for u in plain.values() if u not in known} - missing
        several_words = words - plain.keys()
        self.bring_back(several_words, self.known_words, self.older_words)
        others = [w for w in several_words if w not in self.known_words]
        tokens, failed = self.vocabulary.encode_words([" " + u for u in new] + others)
        self.guessed += len(tokens)
        self.failed += failed
        known.update(zip(new, tokens))
        if len(self.known_words) + len(others) > REMEMBERED:
            self.older_words, self.known_words = self.known_words, {w: t for w in words if (t := self.known_words.get(w)) is not None}
        self.known_words.update(zip(others, tokens[len(new) :]))
        for u, parts in several.items():
            known[u] = tuple(chain.from_iterable([known[plain[w]] if w in plain else self.known_words[w] for w in parts]))

    def forget(self, units) -> None:
        """Long units would make the tables large; those beside a space that may not be safe have to be seen as new again."""
        for u in units:
            n = len(u[0] if isinstance(u, tuple) else u)
            if n > LONGEST:
                for w in self.words_of(u):
                    if len(w) > LONGEST:
                        self.known_words.pop(w, None)
            if n > LONGEST or self.beside_unsafe(u):
                self.known.pop(u, None)

    def batches(self, texts) -> Iterator[Iterator[list[int]]]:
        """Of each text the ids of its parts. Texts of about PART characters together are looked up at once; a longer one goes by parts."""
        held, size = [], 0
        for text in texts:
            if held and size + len(text) > PART:
                yield from self.together(held)
                held, size = [], 0
            if len(text) > PART:
                yield (next(iter(ids)) for ids in (self.looked_up([[p]])[0] for p in self.parts(text)))
                continue
            held.append(text)
            size += len(text)
        yield from self.together(held)

    def together(self, texts: list[str]) -> Iterator[list[list[int]]]:
        yield from self.looked_up([list(self.parts(t)) for t in texts])

    def looked_up(self, texts: list[list[str | int]]) -> list[list[list[int]]]:
        split = [[p if isinstance(p, int) else self.units(p) for p in parts] for parts in texts]
        tokens, missing = self.remembered(split)
        if odd := {u for u in missing if self.beside_unsafe(u)}:
            for parts, at in zip(split, texts):
                for k, p in enumerate(parts):
                    if not isinstance(p, int) and not odd.isdisjoint(p):
                        parts[k] = self.safe_units(at[k])
            tokens, missing = self.remembered(split)
        if missing:
            self.learn(missing)
            tokens |= {u: self.known[u] for u in missing}
        get = tokens.__getitem__
        found = [[[p] if isinstance(p, int) else list(chain.from_iterable(map(get, p))) for p in parts] for parts in split]
        self.forget(missing)
        return found

    def remembered(self, split: list[list]) -> tuple[dict, set]:
        """The remembered units of some texts with their tokens, a small table, and the units that are new."""
        units = set(chain.from_iterable(p for parts in split for p in parts if not isinstance(p, int)))
        get = self.known.get
        tokens = {u: t for u in units if (t := get(u)) is not None}
        tokens |= self.bring_back(units - tokens.keys(), self.known, self.older)
        return tokens, units - tokens.keys()

    @staticmethod
    def beside_unsafe(unit: str | tuple[str]) -> bool:
        """Whether a part with this unit may have a space next to white space, or at its end."""
        text = unit[0] if isinstance(unit, tuple) else unit
        return not text or text[0].isspace() or text[-1].isspace()

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(chain.from_iterable(self.batches([text]))))

    def decode(self, ids) -> str:
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids)).decode("utf-8", "replace")


@contextmanager
def uncollected():
    """Without Python's search for reference cycles, which would walk the tables again and again; there are none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row's whole text. Rows as in round_trip."""

    def run(batches):
        import pyarrow as pa

        one = encoder(path)
        for b in batches:
            for at in range(0, len(b), 1000):
                texts = [t or "" for t in b.column(1).slice(at, 1000).to_pylist()]
                with uncollected():
                    ids = [list(chain.from_iterable(parts)) for parts in one.batches(texts)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1000), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    two = two_columns(docs, id_col, text_col)
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids), special tokens as their strings; a null list is the empty text."""

    def run(batches):
        import pyarrow as pa

        one = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one.decode(i.as_py() or ()) for i in b.column(1)], pa.string())], names=["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined) and decoded_sha256 (of the text that the ids give again) of each row.

    path: the tokenizer's .json, readable on each executor. Ids are worked on in parts, so that a text of any length fits. Null
    texts count as empty ones; repeated rows and null ids stay as they are; an empty table gives an empty table; other columns
    are not looked at.
    """

    def run(batches):
        import codecs

        import pyarrow as pa

        one = encoder(path)
        number, token = one.vocabulary.decimal.__getitem__, one.vocabulary.bytes.__getitem__
        for b in batches:
            rows = []
            texts = (t.as_py() or "" for t in b.column(1))
            with uncollected():
                for parts in one.batches(texts):
                    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
                    for ids in parts:
                        if ids:
                            ids_hash.update((b"," if n else b"") + b",".join(map(number, ids)))
                            text_hash.update(decoder.decode(b"".join(map(token, ids))).encode())
                            n += len(ids)
                    text_hash.update(decoder.decode(b"", True).encode())
                    rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest()))
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    two = two_columns(docs, id_col, text_col)
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
