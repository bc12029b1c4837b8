"""Phrase collocations: word sequences that stand together more often than their parts would suggest.

A shard is a stretch of a task's texts. Its generalised suffix automaton over words, bounded to factors of up to three words, is
built with array operations: the tree of suffix links of an automaton is the compacted tree of the reversed factors, so sorting
all positions by the word there and the words before it puts each state's end positions side by side. Runs of equal keys are the
deepest states with their counts of end positions; counts go up along the suffix links; a shorter factor that has the same end
positions as a longer one shares its state. Each state stands for its longest factor and the suffixes of it that are longer than
its link's.

Two passes over the texts. The first adds up hashed counts of all factors by ranges of the hash, as arrays, and finds the hashes
that reach the smallest count; a bitmap of these, of a bounded size, goes to the second pass, which gives the factors that may
reach it as words. Their exact counts are then summed by Spark. The bitmap only spares rows: with more factors than it has room
for, more rows come and are dropped by their exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize

#: Words of a shard, at most (with some bytes of text to spare); bytes of text that are cut into words at once.
SHARD_WORDS, TEXT_BYTES = 500_000, 1 << 20
#: Bits of a word's number within a shard: three have to fit in 63.
BITS = 21
#: Bits of the bitmap for each frequent factor, at least, and in all, at most (16 MB).
BITS_A_FACTOR, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27

#: A-Z to lower case, tabs to spaces, what ends a piece to a byte that no text has.
FOLDED = bytes(c | 32 if 65 <= c <= 90 else 32 if c == 9 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
BORDER = b"\xff"


class Automaton:
    """The generalised suffix automaton of a shard's pieces, bounded to `depth` words.

    words: numbers from 1; 0 is a border. before: how many of the first positions only give context: no factor ends there.
    States are rows of length (of the longest factor), end (one of its end positions), count (of end positions) and link (the
    state of the longest suffix with other end positions; -1: none).
    """

    def __init__(self, words, depth: int, before: int = 0):
        import numpy as np

        self.words, self.depth = words, depth
        key = words.astype(np.int64)
        inside = key > 0
        reversed_factor = key << (BITS * (depth - 1))
        for k in range(1, depth):
            inside = inside[1:] & (key[:-k] > 0)
            reversed_factor[k:] |= np.where(inside, key[:-k], 0) << (BITS * (depth - 1 - k))
        at = np.flatnonzero(key > 0)
        at = at[at >= before]
        order = np.argsort(reversed_factor[at], kind="stable")
        at, sorted_keys = at[order], reversed_factor[at][order]
        # nodes of the tree of reversed factors, deepest first; a node's rows are one run
        levels, first = [], np.flatnonzero(np.diff(sorted_keys, prepend=-1))
        runs = sorted_keys[first]
        sizes = np.diff(first, append=len(sorted_keys))
        mask = (1 << BITS) - 1
        for d in range(depth, 0, -1):
            cut = runs >> (BITS * (depth - d))
            starts = np.flatnonzero(np.diff(cut, prepend=-1))
            whole = (cut[starts] & mask) > 0  # else a piece begins before this depth
            counts = np.add.reduceat(sizes, starts) if len(starts) else sizes[:0]
            levels.append((d, starts[whole], counts[whole]))
        length, end, count, run = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*((np.full(len(s), d), at[first[s]], c, s) for d, s, c in levels)))
        # a node whose one child has as many end positions is no state of its own
        node_of = {d: np.full(len(runs) + 1, -1) for d in range(1, depth + 1)}
        base = 0
        for d, s, _ in levels:
            node_of[d][s] = np.arange(base, base + len(s))
            base += len(s)
        parent = np.full(base, -1)
        for d in range(2, depth + 1):
            mine, above = np.flatnonzero(length == d), node_of[d - 1][: len(runs)]
            last = np.maximum.accumulate(np.where(above >= 0, np.arange(len(runs)), -1))
            parent[mine] = above[last[run[mine]]]
        same = np.zeros(base, bool)  # shares its state with a longer factor
        child = np.flatnonzero(parent >= 0)
        same[parent[child[count[child] == count[parent[child]]]]] = True
        link = parent.copy()
        for _ in range(depth):
            skip = (link >= 0) & same[link]
            link[skip] = parent[link[skip]]
        states = np.flatnonzero(~same)
        number = np.full(base + 1, -1)
        number[states] = np.arange(len(states))
        self.length, self.end, self.count, self.link = length[states], end[states], count[states], number[link[states]]

    def factors(self) -> Iterator[tuple]:
        """(n, ends, counts) for each n: all factors of n words, each once, by one end position and their count."""
        import numpy as np

        shortest = np.where(self.link >= 0, self.length[self.link], 0)
        for n in range(1, self.depth + 1):
            has = (n <= self.length) & (n > shortest)
            yield n, self.end[has], self.count[has]


class Shard:
    """Words of one language, numbered as they come."""

    def __init__(self):
        from array import array

        self.numbers: dict[bytes, int] = {}
        self.ids = array("i")
        self.before = self.n = 0

    def add(self, folded: bytes) -> None:
        """Words and borders of a text, or of a part of one that ends between words."""
        numbers = self.numbers
        for w in folded.replace(BORDER, b" \xff ").split():
            self.ids.append(0 if w == BORDER else numbers.setdefault(w, len(numbers) + 1))

    def rest(self) -> Shard:
        """A new shard that knows the last two words as context."""
        new = Shard()
        names = list(self.numbers)
        tail = self.ids[-2:]
        for i in tail:
            new.ids.append(0 if i == 0 else new.numbers.setdefault(names[i - 1], len(new.numbers) + 1))
        new.before = len(tail)
        return new

    def words_counted(self) -> int:
        import numpy as np

        return int(np.count_nonzero(np.frombuffer(self.ids, np.int32)[self.before :]))

    def automaton(self, depth: int) -> Automaton:
        import numpy as np

        return Automaton(np.frombuffer(self.ids, np.int32), depth, self.before)

    def word_hashes(self, seed: int):
        """A 64-bit hash of each number's word; 0 for the border."""
        import numpy as np
        import xxhash

        return np.fromiter((0, *(xxhash.xxh3_64_intdigest(w, seed) for w in self.numbers)), np.uint64, len(self.numbers) + 1)


def parts_of(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of about TEXT_BYTES that end between words."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + TEXT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def shards(batches) -> Iterator[tuple[str, Shard]]:
    """Shards of the rows (lang, text). A text that does not fit in one goes on in the next with two words of context."""
    import pyarrow as pa

    open_shards: dict[str, Shard] = {}
    for b in batches:
        langs = b.column(0).to_pylist()
        for lang, text in zip(langs, b.column(1).cast(pa.binary())):
            for part in parts_of(text.as_py().translate(FOLDED)):
                shard = open_shards.setdefault(lang, Shard())
                shard.add(part)
                if len(shard.ids) >= SHARD_WORDS or len(shard.numbers) >= 1 << (BITS - 1):
                    yield lang, shard
                    open_shards[lang] = shard.rest()
            if lang in open_shards:
                open_shards[lang].add(BORDER)
            if sum(len(s.ids) for s in open_shards.values()) >= SHARD_WORDS:  # many languages
                yield from open_shards.items()
                open_shards = {}
    yield from open_shards.items()


def mixed(words, ends, n: int):
    """A 64-bit hash of the n words that end at each position; words: a hash for each position."""
    import numpy as np

    h = np.full(len(ends), np.uint64(0x9E3779B97F4A7C15 * n & (1 << 64) - 1))
    for k in range(n - 1, -1, -1):
        h = (h ^ words[ends - k]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def lang_seed(lang: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(lang.encode())


def hashed_counts(depth: int, ranges: int, least: int):
    """Rows (range, hashes, counts) of a task's shards: all factors' hashes, sorted, with their counts, by ranges of the hash. Counts stop at a number that is least or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        kind = np.min_scalar_type(least)
        for lang, shard in shards(batches):
            words = shard.word_hashes(lang_seed(lang))[np.frombuffer(shard.ids, np.int32)]
            all_hashes, all_counts = [], []
            for n, ends, counts in shard.automaton(depth).factors():
                all_hashes.append(mixed(words, ends, n))
                all_counts.append(counts)
            h, c = np.concatenate(all_hashes), np.concatenate(all_counts)
            order = np.argsort(h)
            h, c = h[order], np.minimum(c[order], np.iinfo(kind).max).astype(kind)
            cuts = np.searchsorted(h, np.array([(k << 64) // ranges for k in range(ranges)], np.uint64)).tolist() + [len(h)]
            rows = [(k, h[a:b].tobytes(), c[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())], names=["range", "hashes", "counts"])

    return run


def added(hashes: list, counts: list):
    import numpy as np

    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h)
    h, c = h[order], c[order]
    first = np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(first) else c


def frequent_hashes(least: int):
    """The hashes of a range whose counts add up to least or more."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[int, tuple[list, list]] = {}
        new = 0
        for b in batches:
            for k, h, c in zip(*(b.column(i).to_pylist() for i in range(3))):
                hashes, counts = held.setdefault(k, ([], []))
                hashes.append(np.frombuffer(h, np.uint64))
                counts.append(np.frombuffer(c, np.min_scalar_type(least)).astype(np.int64))
                new += len(hashes[-1])
            if new > 4_000_000:
                held = {k: tuple([x] for x in added(*v)) for k, v in held.items()}
                new = 0
        for k, v in held.items():
            h, c = added(*v)
            yield pa.RecordBatch.from_arrays([pa.array(h[c >= least].view(np.int64))], names=["hash"])

    return run


def bitmap(hashes: DataFrame) -> tuple[list[bytes], int]:
    """The frequent hashes as a bitmap in blocks of LEAST_BITS, and its bits; MOST_BITS at most, so that it may go to every task."""
    bits, n = LEAST_BITS, hashes.count()
    while bits < min(MOST_BITS, BITS_A_FACTOR * n):
        bits *= 2

    def blocks(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            at = np.unique(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array((at & 0x7FFF).astype(np.int64))], names=["block", "bit"])

    at = hashes.mapInArrow(blocks, "block int, bit long")
    rows = at.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    found = [bytes(4096)] * (bits >> 15)
    for r in rows:
        found[r["block"]] = bytes(r["bits"])
    return found, bits


def frequent_factors(depth: int, blocks, bits: int):
    """Rows (lang, phrase, size, n) of a task's shards: the factors that the bitmap has; and a row of size 0 with the number of words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen = np.frombuffer(b"".join(blocks.value), np.uint8)
        for lang, shard in shards(batches):
            ids, names = np.frombuffer(shard.ids, np.int32), [b"", *shard.numbers]
            words = shard.word_hashes(lang_seed(lang))[ids]
            yield pa.RecordBatch.from_pylist([{"lang": lang, "phrase": "", "size": 0, "n": shard.words_counted()}], schema=schema())
            for n, ends, counts in shard.automaton(depth).factors():
                at = mixed(words, ends, n) & np.uint64(bits - 1)
                has = (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                ends, counts = ends[has], counts[has]
                for k in range(0, len(ends), 100_000):
                    some = ends[k : k + 100_000]
                    columns = [map(names.__getitem__, ids[some - j].tolist()) for j in range(n - 1, -1, -1)]
                    phrases = list(map(b" ".join, zip(*columns)))
                    arrays = [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(some), np.int32))), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.full(len(some), n, np.int32)), pa.array(counts[k : k + 100_000])]
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema())

    return run


def schema():
    import pyarrow as pa

    return pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("n", pa.int64())])


def phrase_counts(rows: DataFrame, depth: int, least: int) -> DataFrame:
    """lang, phrase, size and n of all phrases of up to depth words that occur least times, and a row of size 0 with each language's number of words."""
    spark = rows.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hashed = rows.mapInArrow(hashed_counts(depth, ranges, least), "range int, hashes binary, counts binary")
    hashes = materialize(hashed.repartition(ranges, "range").mapInArrow(frequent_hashes(least), "hash long"), "hashes")
    blocks, bits = bitmap(hashes)
    shared = spark.sparkContext.broadcast(blocks)
    counted = rows.mapInArrow(frequent_factors(depth, shared, bits), "lang string, phrase string, size int, n long")
    return materialize(counted.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("size") == 0) | (F.col("n") >= least)), "phrases", instead_of=hashes)


def mine(docs: DataFrame, min_count: int = 10, max_words: int = 3, inside_percent: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases of two to max_words (2 or 3) words with min_count occurrences or more.

    Words are runs without spaces and tabs within pieces that end at . , ; : ! ? and line ends, A-Z in lower case. A phrase's
    score is floor(1000000 a a / (l r)) at the cut where that is lowest (the earlier of equal ones), a, l and r being the
    occurrences of the phrase and of the parts before and after the cut; n is the language's number of words. A phrase is left out if
    a longer one that holds it, itself frequent, occurs inside_percent of its times or more. Ties: larger a, then the phrase in
    the order of UTF-8 bytes. Null texts are empty, a null language is `und`; each row counts, repeated ones too; an empty table
    gives no rows; other columns are not looked at. Whole texts are read, long ones in parts with context.
    """
    if max_words not in (2, 3):
        raise ValueError("phrases of 2 or 3 words")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counts = phrase_counts(rows, max_words, min_count)
    phrases = counts.where("size >= 2").select("lang", "phrase", "size", F.col("n").alias("a"))
    kept = phrases.join(subsumed(phrases, inside_percent), ["lang", "phrase"], "left_anti")
    scored = best_cuts(kept, counts)
    totals = counts.where("size = 0").select("lang", "n")
    return first_ranks(scored, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def subsumed(phrases: DataFrame, percent: int) -> DataFrame:
    """Phrases that a longer one holds and nearly replaces. Counts come down from each longer phrase along its suffix link and, for what it begins with, the link of the reversed automaton."""
    longer = phrases.where("size > 2")
    links = F.array(F.expr("substring(phrase, instr(phrase, ' ') + 1)"), F.expr("substring_index(phrase, ' ', size - 1)"))
    most = longer.select("lang", F.explode(links).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    return phrases.join(most, ["lang", "phrase"]).where(F.lit(100) * F.col("most") >= F.lit(percent) * F.col("a")).select("lang", "phrase")


def best_cuts(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """Each phrase with the counts of the two parts at its lowest-scoring cut, and that score."""
    cuts = phrases.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - size)")})
    parts = counts.where("size > 0")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    exact = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(12,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_ranks(scored: DataFrame, top: int) -> DataFrame:
    """The first phrases of each language: first within 64 parts of it, then among what these leave."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranks = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranks.where(F.col("rank") <= top).drop("part")
