"""Divergence, collocations, and encoding by guess and proof: against SQL, brute force and the tokenizer's library."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from lexmill.llm import collocations, divergence, queries, speculate

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, p long, rank string, size int, phrase string, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 7, "t", 1, "r", 2, "q", "h") for i, t, lang, source in rows], SCHEMA)


def odd_rows():
    random.seed(4)
    word = lambda: random.choice(["Alpha", "beta", "beta", "gamma", "Éclair", "naïve", "d1gamma", "x\x00y", "to", "to", "be"])
    rows = [(i, " ".join(word() + random.choice(["", "", "", ",", ".", "\n", "\t"]) for _ in range(random.randint(0, 40))), random.choice(["en", "en", "fr", None]), random.choice(["a", "b", "Z", "é", None])) for i in range(120)]
    rows += [(500, None, None, None), (501, "", "xx", "only"), (502, "123 456", "xx", "other"), (503, None, "en", "silent"), (504, "to be to be to be " * 60, "en", "a"), (None, "beta", "fr", "a"), (7, "to be or not", "en", "b"), (7, "to be or not", "en", "b")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, odd_rows())


def by_sql(sql: str):
    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source"), r)) for r in odd_rows()]))
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    return sorted(tuple(r) for r in result.fetchall()), names


def rows_of(df, names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize(("min_docs", "top"), [(3, 2), (1, 50), (10_000, 50)])
def test_divergence_equals_sql(odd, min_docs, top):
    want, names = by_sql(queries.DIVERGENCE.format(min_docs=min_docs, top=top))
    assert rows_of(divergence.audit(odd, min_docs, top), names) == want and want


def test_divergence_of_nothing(odd):
    assert divergence.audit(odd.limit(0)).count() == 0


def batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])


def test_divergence_in_parts(monkeypatch):
    """A long text, small chunks and terms that go over chunks give the same counts."""
    random.seed(1)
    rows = [("en", random.choice("ab"), " ".join(random.choice(["x", "yy", "zzz"]) for _ in range(n))) for n in (3, 500, 0, 40, 7)]

    def counts(text_bytes, chunk_rows):
        monkeypatch.setattr(divergence, "TEXT_BYTES", text_bytes)
        monkeypatch.setattr(divergence, "CHUNK_ROWS", chunk_rows)
        partial = pd.concat([b.to_pandas() for b in divergence.partial_counts([batch(rows)])] * 3).sort_values(["lang", "term"])
        sizes = range(0, len(partial), 2)
        chunks = [pa.RecordBatch.from_pandas(partial[i : i + 2], preserve_index=False) for i in sizes]
        return sorted(tuple(r.values()) for b in divergence.shard_counts(3)(chunks) for r in b.to_pylist())

    assert counts(100, 1) == counts(1 << 20, 1 << 18) == counts(100, 3)


@pytest.mark.parametrize(("least", "top"), [(10, 2000), (2, 5)])
def test_collocations_equal_sql(odd, least, top):
    want, names = by_sql(queries.COLLOCATIONS.format(least=least, top=top))
    assert rows_of(collocations.mine(odd, least, top=top), names) == want and want


def test_collocations_of_pairs_and_of_nothing(odd):
    assert collocations.mine(odd.limit(0)).count() == 0
    pairs = collocations.mine(odd, 5, max_words=2, top=3).collect()
    assert pairs and all(len(r["phrase"].split(" ")) == 2 for r in pairs) and max(Counter(r["lang"] for r in pairs).values()) <= 3
    with pytest.raises(ValueError, match="2 or 3"):
        collocations.mine(odd, max_words=4)


def brute_factors(words, depth, before=0):
    found = Counter()
    for end in range(before, len(words)):
        for n in range(1, depth + 1):
            factor = tuple(words[end - n + 1 : end + 1])
            if end - n + 1 >= 0 and 0 not in factor:
                found[factor] += 1
    return found


@pytest.mark.parametrize("depth", [2, 3])
def test_automaton(depth):
    random.seed(depth)
    for size in (0, 1, 2, 5, 60, 400):
        for before in (0, 2):
            words = np.array([random.choice([0, 1, 1, 2, 3]) for _ in range(size)], np.int32)
            made = collocations.Automaton(words, depth, before)
            got = {tuple(words[e - n + 1 : e + 1].tolist()): c for n, ends, counts in made.factors() for e, c in zip(ends.tolist(), counts.tolist())}
            want = brute_factors(words.tolist(), depth, before)
            assert got == want
            ends_of = {f: frozenset(e for e in range(before, size) if e - len(f) >= -1 and tuple(words[e - len(f) + 1 : e + 1].tolist()) == f) for f in want}
            assert len(made.length) == len(set(ends_of.values())), "one state for each set of end positions"
            for i, link in enumerate(made.link.tolist()):
                longest = tuple(words[made.end[i] - made.length[i] + 1 : made.end[i] + 1].tolist())
                shorter = [longest[k:] for k in range(1, len(longest)) if ends_of[longest[k:]] != ends_of[longest]]
                assert (link < 0) == (not shorter) and (link < 0 or made.length[link] == len(shorter[0]))


def test_shards_go_on_within_a_text(monkeypatch):
    random.seed(2)
    texts = [" ".join(random.choice(["a", "b", "c.", "dé"]) for _ in range(n)) for n in (1000, 0, 30, 2)]
    monkeypatch.setattr(collocations, "TEXT_BYTES", 64)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 100)
    total, words, shards = Counter(), 0, 0
    for _, shard in collocations.shards([pa.RecordBatch.from_arrays([pa.array(["en"] * 4), pa.array(texts)], names=["lang", "text"])]):
        names, ids = ["", *(w.decode() for w in shard.numbers)], list(shard.ids)
        words += shard.words_counted()
        shards += 1
        for n, ends, counts in shard.automaton(3).factors():
            for e, c in zip(ends.tolist(), counts.tolist()):
                total[" ".join(names[i] for i in ids[e - n + 1 : e + 1])] += c
    want = Counter()
    for t in texts:
        for piece in re.split("[.]", t):
            w = piece.split()
            want.update(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    assert shards > 5 and total == want and words == sum(len(re.sub("[.]", "", t).split()) for t in texts)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_round_trip_equals_library(odd, library):
    def digests(text):
        ids = library.encode(text, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = speculate.round_trip(odd, TOKENIZER).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in odd_rows())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(digests(r[1] or "") for r in odd_rows())
    assert speculate.round_trip(odd.limit(0), TOKENIZER).count() == 0


def test_encode_then_decode(odd, library):
    encoded = speculate.encode(odd, TOKENIZER)
    assert sorted(encoded.select("ids").collect()) == sorted((library.encode(r[1] or "", add_special_tokens=False).ids,) for r in odd_rows())
    assert sorted(r["text"] for r in speculate.decode(encoded, TOKENIZER).collect()) == sorted(r[1] or "" for r in odd_rows())
    assert speculate.decode(odd.sparkSession.createDataFrame([(1, None), (2, [50256, 64])], "doc_id int, ids array<int>"), TOKENIZER).orderBy("doc_id").collect()[1]["text"] == "<|endoftext|>a"


def test_encoder_on_odd_texts(library, monkeypatch):
    random.seed(5)
    symbols = ["a", "b", "aa", "the", "ing", "'s", "'ll", " ", "  ", "\n", " ", " ", "é", "日", "12", "_", "<|endoftext|>", "😀", "\x00", "\xa0", "　", "\x1c", "==", "tion", "er", ",", "."]
    texts = ["".join(random.choice(symbols) for _ in range(random.choice([3, 10, 40]))) for _ in range(1500)]
    texts += [random.choice(["a", "ab", "aab", "=", " "]) * random.randint(1, 300) for _ in range(300)]
    texts += ["".join(random.choice("etaoinshrdlucmfw") for _ in range(random.randint(1, 25))) for _ in range(1500)]
    texts += ["x" * 5000 + "a b" * 400, "", " ", "wörd " * 3000]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for part, remembered in ((1 << 20, 300_000), (50, 40)):
        monkeypatch.setattr(speculate, "PART", part)
        monkeypatch.setattr(speculate, "REMEMBERED", remembered)
        e = speculate.Encoder(TOKENIZER)
        assert [[i for p in parts for i in p] for parts in e.batches(texts)] == want
        assert 0 < e.failed < e.guessed and e.decode(want[0]) == texts[0]
        assert all(len(u if isinstance(u, str) else u[0]) <= speculate.LONGEST for u in e.known)


def test_encoder_remembers_within_bounds(monkeypatch):
    """Four tables of about 400 bytes an entry stay small however many words there are, and a full table's words come back."""
    assert 4 * speculate.REMEMBERED * 400 <= 200_000_000
    random.seed(7)
    monkeypatch.setattr(speculate, "PART", 200)
    monkeypatch.setattr(speculate, "REMEMBERED", 100)
    e = speculate.Encoder(TOKENIZER)
    encode = lambda text: e.encode(f"a {text} a")
    word = lambda: "".join(random.choices("etaoinshrdlu", k=12))
    often = "zebra quartz, jigsaw fjord"
    want, sizes = encode(often), []
    for _ in range(60):
        encode(" ".join(word() + random.choice(["", "!x"]) for _ in range(12)))
        began = e.guessed
        assert encode(often) == want and e.guessed == began
        sizes.append(max(map(len, (e.known, e.older, e.known_words, e.older_words))))
    assert max(sizes) <= 150


def test_pairs_by_brute_force():
    """Neighbours are compatible if and only if merging both tokens' bytes gives them again."""
    v = speculate.encoder(TOKENIZER).vocabulary
    random.seed(6)
    some = random.sample(sorted(v.tokens.values()), 300)
    pairs = [(a, b) for a in some for b in random.sample(some, 30)] + [(v.tokens[x], v.tokens[y]) for x in (b"a", b"aa", b"==", b"=", b" ") for y in (b"a", b"aa", b"==", b"====", b"  ") if x in v.tokens and y in v.tokens]
    a, b = np.array(pairs, np.int64).T
    assert v.compatible(a, b).tolist() == [v.merged(v.bytes[x] + v.bytes[y]) == [x, y] for x, y in pairs]
    long = [random.choice(v.byte) for _ in range(400)]
    data = b"".join(v.bytes[i] for i in long)
    assert v.merged(data) == v.merged_long(long)
