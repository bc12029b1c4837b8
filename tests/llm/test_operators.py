"""Small fixtures against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re
import struct
import time
import tracemalloc
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.llm import bpe, common, decontamination, html_extract, packing, pii, quality_mil, quality_rules, simhash, toxicity, warc
from lexmill.llm.common import shared_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, score double, h long, fp string, n_words string"
LONG = "wörd " * 20_000 + "x" * 5_000


def table(spark, rows):
    """Rows of (doc_id, text) with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 0.5, 7, "z", "q") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, None), (2, ""), (3, "A b"), (3, "A b"), (4, LONG), (None, "no id at all here"), (5, "a\n\n b  \tc"), (6, "😀 naïve ½ <|endoftext|> it's"), (7, " \x1c  x")])


def test_token_counts(spark, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    got = bpe.count_tokens(odd, TOKENIZER, limit=1024).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for x in texts)
    assert bpe.count_tokens(odd.limit(0), TOKENIZER).count() == 0
    random.seed(3)
    count, encode = bpe.counter(TOKENIZER), bpe.encoder(TOKENIZER)
    for _ in range(500):
        x = "".join(random.choice(["a", "b", "'s", "'ll", " ", "  ", "\n", " ", "é", "日", "12", "_", "<|endoftext|>", "😀"]) for _ in range(20))
        ids = t.encode(x, add_special_tokens=False).ids
        assert count(x) == len(ids) and encode(x) == struct.pack(f"<{len(ids)}I", *ids)


def check_plan(counts, capacity, groups):
    used, seen = defaultdict(list), defaultdict(set)
    for length, a, b, first, each, offset in packing.plan_packing(counts, capacity, groups):
        for rank in range(a, b):
            assert rank not in seen[length]
            seen[length].add(rank)
            n, k = divmod(rank - a, each)
            used[first + n].append((offset + k * length, length))
    assert all(seen[x] == set(range(n)) for x, n in counts.items())
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def best_fit_decreasing(counts, capacity):
    spaces = []
    for length in sorted(Counter(counts).elements(), reverse=True):
        k = bisect_left(spaces, length)
        insort(spaces, (spaces.pop(k) if k < len(spaces) else capacity) - length)
        number = len(spaces)
    return number


def test_packing_plan():
    """Complete and gapless, and in few sequences: near the least that tokens need, and not above plain best-fit decreasing by more than 2."""
    for seed, (mean, spread, n) in enumerate([(6, 1.2, 3000), (6.8, 0.5, 2000), (6.8, 0.3, 3000), (5, 1, 3000), (7, 0.4, 1000)]):
        random.seed(seed)
        counts = Counter(min(2048, max(1, int(random.lognormvariate(mean, spread)))) for _ in range(n))
        assert check_plan(counts, 2048, (8, 24, 64, 120, 300)) <= best_fit_decreasing(counts, 2048) + 2
        check_plan(counts, 2048, (5,))
    assert check_plan({1: 5000, 2048: 3, 513: 7}, 2048, (5,)) == 8
    assert check_plan({}, 2048, (5,)) == 0
    assert check_plan({1025: 10, 1023: 10, 683: 9, 682: 3}, 2048, (50,)) == 15


def test_configurations_are_optimised():
    """Sizes that only go together in one way: the programme finds it, where filling the largest first does not."""
    ways = packing.configurations([60, 50, 40, 30], 100)
    assert {tuple(w) for w in ways.tolist()} >= {(0, 2, 4), (1, 1, 4), (2, 3, 3)} and all(sum([60, 50, 40, 30, 0][i] for i in w) <= 100 for w in ways)
    used = packing.fewest_sequences(ways, packing.np.array([10, 10, 10, 0]))
    assert abs(sum(often for _, often in used) - 15) < 1e-6


def test_packing(spark, odd):
    got = packing.pack_documents(odd, TOKENIZER, capacity=64).collect()
    encode = bpe.encoder(TOKENIZER)
    want = []
    for r in odd.collect():
        ids = encode(r["text"] or "") + b"\0\0\0\0"
        n = len(ids) // 4
        first = n % 64 or 64
        edges = [0, n] if n <= 64 else [0, *range(first, n + 1, 64)]
        want += [(r["doc_id"] or -1, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(odd.limit(0), TOKENIZER).count() == 0


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, odd):
    random.seed(1)
    base = [random.choice(["alpha", "beta", "Gamma", "δ", "eps"]) + str(random.randint(0, 50)) for _ in range(600)]
    near = []
    for k in range(40):
        words = list(base)
        words[random.randrange(600)] = f"new{k}"
        near.append((100 + k, " ".join(words)))
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()] + near + [(200 + k, f"text number {k} stands alone {k * k}") for k in range(30)]
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = sorted((i, f"{fp:016x}", find(i)) for i, fp in prints)
    for most in (3, 64):  # with a small bound the one-bit neighbours find the links
        got = simhash.near_duplicates(table(spark, rows), most=most).collect()
        assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_ok(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def test_pii(spark, odd):
    random.seed(5)
    pool = list("0123456789") * 3 + list("ab@.-_+ ()😀é%") + ["4111111111111111", "+1 (415) 555-2671", "1.2.3.4", "x@y.zz", "256.1.1.1"]
    rows = [(k, "".join(random.choice(pool) for _ in range(60))) for k in range(10, 400)]
    rows += [(400, "9" * 30_000 + " 1" * 20_000), (401, "a" * 50_000 + "@b.c"), (402, "a@b.c_d@e.f.g@h.i"), (403, "1.2.3.4.5.6.7.8 +" + "1" * 15)]
    docs = table(spark, rows).unionByName(odd)
    got = {(r["doc_id"], r["base_sha256"]): r for r in pii.find(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        found = [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, text) if pii_ok(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        out = got[r["doc_id"], hashlib.sha256(joined.encode()).hexdigest()]
        assert {k: out[f"n_{k}"] for k in PII} == {k: sum(x == k for x, *_ in found) for k in PII}
        assert set(filter(None, joined.split(","))) <= set(out["spans"].split(","))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(table(spark, [(1, "é x@y.zz and 1.2.3.4!"), (2, None), (3, "nothing")])).collect()}
    assert clean == {1: "é [EMAIL] and [IP]!", 2: None, 3: "nothing"}
    assert pii.find(odd.limit(0)).count() == 0


def test_decontamination(spark, odd):
    random.seed(2)
    vocabulary = [f"w{i}" for i in range(30)]
    make = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, make(random.choice([1, 3, 13, 14, 40]))) for i in range(25)] + [(90, None), (91, "..."), (3, make(20)), (92, "w1 w1")]
    docs = [(i, make(random.randint(0, 60))) for i in range(10, 60)] + [(100 + i, f"{make(5)} {t.upper() if t else ''}, {make(50)}") for i, t in items if t] + [(200, " ".join(items[4][1] for _ in range(3)))]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    frame = table(spark, docs + docs[:3]).unionByName(odd)
    want = []
    counts = Counter(x for r in frame.collect() for x in words(r["text"]))
    for r in frame.collect():
        w, hit, ids, near = words(r["text"]), set(), set(), 0
        for t, i in {(t, i) for i, t in items}:
            b = words(t)
            n = min(13, len(b))
            for s in {*range(0, len(b) - n + 1, 13), len(b) - n} if n else ():
                lead = min(range(s, s + n), key=lambda k: (counts[b[k]], k))
                near += any(set(b[s : s + n]) <= set(w[max(0, p - 26) : p + 27]) for p, x in enumerate(w) if x == b[lead])
            for s in range(len(b) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        want.append((r["doc_id"] or -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), near))
    assert max(x[-1] for x in want) > 3
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    got = decontamination.contamination(frame, benchmark).collect()
    assert sorted((r["doc_id"] or -1, *r[1:]) for r in got) == sorted(want)
    assert not decontamination.contamination(odd, benchmark.limit(0)).where("contaminated").count()
    assert decontamination.contamination(odd.limit(0), benchmark).count() == 0


def test_proximity(spark):
    """Terms in another order, with words between, are near; a term too far away is not."""
    docs = spark.createDataFrame([(1, "a x x c x b"), (2, "a " + "x " * 50 + "b c"), (3, None)], "doc_id int, text string")
    got = decontamination.contamination(docs, spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "")], "item_id int, text string"), slop=6)
    assert {r["doc_id"]: (r["n_near"], r["n_hit"]) for r in got.collect()} == {1: (1, 0), 2: (0, 0), 3: (0, 0)}


def test_last_window_that_cannot_occur(spark):
    """An item's last window with a word that no text has is not near, and the window before it does not count in its place; with step 1 all windows count."""
    item = [f"w{k}" for k in range(20)]
    docs = spark.createDataFrame([(1, " ".join(item[:19])), (2, " ".join(reversed(item[:19]))), (3, " ".join(item[:12]))], "doc_id int, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item[:19] + ["unheard"]))], "item_id int, text string")
    near = lambda **kw: {r["doc_id"]: r["n_near"] for r in decontamination.contamination(docs, benchmark, **kw).collect()}
    assert near() == {1: 1, 2: 1, 3: 0}
    assert near(step=1) == {1: 7, 2: 7, 3: 0}
    assert near(step=4) == {1: 2, 2: 2, 3: 0}


def test_quality_rules_counts(spark):
    random.seed(4)
    for _ in range(200):
        text = "".join(random.choice(["a", "b", "cé", " ", " ", "\n", "\t", "#", " ", "\x1c"]) for _ in range(random.randint(0, 120)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in lines
                lines.add(line)
        data = text.encode()
        assert quality_rules.base_counts(data, data.split()) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated))


def labelled(spark, good, bad, label, n=240):
    rows = [(i, good(i) if i % 2 else bad(i)) for i in range(n)]
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(n)], "doc_id long, quality int, toxic int")
    return table(spark, rows), labels


def prose(i, words=60):
    r = random.Random(i)
    return " ".join("".join(r.choice(["an", "er", "th", "in", "ou", "st"]) for _ in range(r.randint(1, 3))) for _ in range(words)) + "."


@pytest.mark.parametrize("module", [quality_mil, quality_rules])
def test_quality_models(spark, odd, module):
    docs, labels = labelled(spark, prose, lambda i: " ".join(w + "###" for w in prose(i).split()), "quality")
    model = module.train(docs, labels, max_rows=200) if module is quality_rules else module.train(docs, labels, F.col("doc_id") % 5 != 0, max_rows=200)
    out = module.apply_rules(docs, model).select("doc_id", F.col("quality").alias("s")) if module is quality_rules else module.score(docs, model).select("doc_id", F.col("score").alias("s"))
    assert sum((r["s"] >= 0.5) == r["doc_id"] % 2 for r in out.collect()) >= 230
    again = module.apply_rules(odd, model) if module is quality_rules else module.score(odd, model)
    assert again.count() == odd.count()
    assert (module.apply_rules if module is quality_rules else module.score)(odd.limit(0), module.fit([])).count() == 0


def test_toxicity(spark, odd):
    insults = ["blorkface", "snarfwit", "grimplet"]
    docs, labels = labelled(spark, lambda i: prose(i) + " you are here", lambda i: prose(i, 30) + f" you {insults[i // 2 % 3]} are {insults[i // 2 % 2]} " + prose(i + 1000, 20), "toxic")
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert sum((scores[i] >= 0.3) == (i % 2 == 0) for i in scores) >= 230
    assert model.score(["what a s n a r f w i t", "s-n-a-r-f-w-i-t you blork*face"]).min() >= 0.3 > model.score([prose(5001), ""]).max()
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score(odd.limit(0), toxicity.train_on([])).count() == 0


def test_warc(spark):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", big), (6, "u", big + " ")]
    path = warc.archive_path(shared_dir(spark))
    warc.write_archive(spark.createDataFrame([(*r, b"x") for r in rows], "page_id long, url string, html string, payload binary"), path)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, path).collect())
    want = [(i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and i < 6 else "response", 6 if h == big and i < 6 else None) for i, _, h in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    exact = {r["page_id"]: bytes(r["record"]) for r in warc.read_archive(spark, path).where("payload_digest != 'x'").collect()}
    head, _, body = exact[3].partition(b"\r\n\r\n")
    assert body == b"small\r\n\r\n" and b"Content-Length: 5" in head and base64.b32encode(hashlib.sha1(b"small").digest()) in head
    head, _, body = exact[1].partition(b"\r\n\r\n")
    assert body == b"\r\n\r\n" and b"WARC-Type: revisit" in head and b"WARC-Refers-To: <urn:page:6>" in head and b"Content-Length: 0" in head
    assert spark.read.parquet(f"{path}/payloads").count() == 4


def test_warc_odd_pages(spark):
    """Line ends in ids and urls, a null id, repeated rows, a long payload; and no rows at all."""
    long = "é" * 700_000
    rows = [("a\r\nb>: c", "http://a\r\nWARC-Type: x", long), ("z", None, long), ("z", "u", long), (None, "u", "tiny"), ("k", "u", None)]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string")
    path = warc.archive_path(shared_dir(spark))
    warc.write_archive(frame, path)
    got = sorted((r["page_id"] or "", r["record_type"], r["refers_to"] or "", r["payload_bytes"], r["url"] or "") for r in warc.read_archive(spark, path).collect())
    assert got == sorted([("a\r\nb>: c", "revisit", "z", 1_400_000, "http://a  WARC-Type: x"), ("z", "response", "", 1_400_000, ""), ("z", "response", "", 1_400_000, "u"), ("", "response", "", 4, "u"), ("k", "response", "", 0, "u")])
    path = warc.archive_path(shared_dir(spark))
    warc.write_archive(frame.limit(0), path)
    assert warc.read_archive(spark, path).count() == 0


def test_warc_finds_damage(spark):
    """A payload whose bytes changed, and a header whose digest is another's, stop the reading."""
    path, bad = warc.archive_path(shared_dir(spark)), warc.archive_path(shared_dir(spark))
    warc.write_archive(spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string"), path)
    payloads, headers = spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/headers")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{bad}/payloads")
    headers.write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, bad).collect()
    swapped = warc.archive_path(shared_dir(spark))
    payloads.write.parquet(f"{swapped}/payloads")
    headers.withColumn("header", F.first("header").over(Window.orderBy("page_id"))).write.parquet(f"{swapped}/headers")
    with pytest.raises(Exception, match="not its payload"):
        warc.read_archive(spark, swapped).collect()


def test_html(spark):
    page = """<html><head><title>t</title></head><body><header>Site</header><nav><a href=/>Home</a></nav><div class="cookie-notice">Cookies!</div>
    <div class="post-17"><h1>Head &amp; more</h1><p>One<br>two <b>bo</b>ld<p>three<script>no()</script><ul><li>a<li>b</ul><div class="comments"><p>reader</div><form>f</form></div><aside>s</aside><footer>end</footer></body></html>"""
    rows = [(i, f"http://h.example/{i}", page.replace("three", f"three {i} " + "text " * 20), "x") for i in range(5)] + [(9, None, None, "x"), (10, "http://h.example/z", "<p>only this", "x"), (11, "http://e.example", "", "x")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, path string")).collect()}
    assert got[2]["text"] == "Head & more One two bold three 2 " + "text " * 20 + "a b"
    assert (got[9]["text"], got[9]["n_chars"], got[10]["text"], got[11]["text"]) == ("", 0, "only this", "")
    assert got[2]["n_chars"] == len(got[2]["text"])


def texts_of(spark, pages):
    rows = [(i, f"http://{host}.example/{i}", html) for i, (host, html) in enumerate(pages)]
    return [r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_html_leaf_blocks_are_no_containers(spark):
    """Paragraphs with over 80 % of the text stand in the body, in a named div, as divs, and in parts; all else of the article stays."""
    long = "running text " * 40
    whole = f"Head {long.strip()} Sub a b {long.strip()} quoted cell"
    rest = "<h2>Sub</h2><ul><li>a<li>b</ul>{}<blockquote>quoted</blockquote><table><tr><td>cell</table>"
    pages = []
    for i in range(3):
        pages += [
            ("flat", f"<body><nav>menu</nav><h1>Head</h1><p>{long}</p>{rest.format(f'<p>{long}</p>')}</body>"),
            ("named", f"<body><div class=x><h1>Head</h1><p class=text>{long}</p>{rest.format(f'<p class=text>{long}</p>')}</div></body>"),
            ("divs", f"<body><h1>Head</h1><div class=text>{long}</div>{rest.format(f'<div class=text>{long}</div>')}</body>"),
            ("parts", f"<body><h1>Head</h1><div class=part><p>{long}</p><h2>Sub</h2></div><ul><li>a<li>b</ul><div class=part><p>{long}</p><p>quoted</p></div><p>cell</p></body>"),
        ]
    assert texts_of(spark, pages) == [whole] * len(pages)


def test_html_names_do_not_drop_the_article(spark):
    """Wrappers and parts whose names have a dropped word hold the article; what else is named so is dropped as before."""
    long = "running text " * 40
    whole = f"Head {long.strip()} last"
    article = f"<h1>Head</h1><p>{long}</p><p>last</p>"
    side = "<div class='main-sidebar'>other pages</div><div class='cookie-notice'>cookies</div><form>name</form><div id=comments><p>a reader</p></div>"
    widgets = "".join(f"<div class='elementor-widget elementor-widget-{kind}'>{x}</div>" for kind, x in (("heading", "<h1>Head</h1>"), ("text", f"<p>{long}</p>"), ("text", "<p>last</p>")))
    pages = []
    for i in range(3):
        pages += [(name, f"<body><nav>menu</nav><div class='{name}'>{article}{side}</div></body>") for name in ("has-sidebar", "no-sidebar", "share-layout", "search-results", "widget")]
        pages += [
            ("form", f"<body><form id=aspnet>{article}{side}</form></body>"),
            ("inline", f"<body><app-root class=search-app>{article}{side}</app-root></body>"),
            ("holds", f"<body><div class=related><article>{article}</article></div><div>{side}</div></body>"),
            ("widgets", f"<body><div class=page>{widgets}{side}</div></body>"),
        ]
    assert texts_of(spark, pages) == [whole] * len(pages)
    assert texts_of(spark, [("h", f"<body><div>{article}<div class=related><article class=card>teaser</article></div>{side}<p>a <span class=share>no</span>b</div></body>")]) == [f"{whole} a b"]


def test_html_hosts_decide_what_is_furniture(spark):
    """No name tells the menu and the box on one host; their repetition does. On another host, where the same elements differ, they stay, as do a single page's; copies of one page are no repetition."""
    def page(k, box):
        return f"<body><div class=xa>Home News About {box}</div><div class=xb><h1>Head</h1><p>{'running text ' * 20}{k}</p><div class=xc>{box}</div><p>last</p></div></body>"

    body = lambda k: f"{'running text ' * 20}{k}"
    pages = [("same", page(k, "Buy now")) for k in range(6)] + [("mixed", page(k, f"box {k}")) for k in range(6)] + [("one", page(1, "Buy now"))] + [("copies", page(1, "Buy now"))] * 5
    got = texts_of(spark, pages)
    assert got[:6] == [f"Head {body(k)} last" for k in range(6)]
    assert got[6:12] == [f"Head {body(k)} box {k} last" for k in range(6)]
    assert got[12:] == [f"Head {body(1)} Buy now last"] * 6


def test_html_the_vote_decides(spark):
    """A host's pages elect the article's container; a page whose own best container is another follows, one without the winner doesn't."""
    usual = [("h", f"<body><div class=main-col><h1>Head</h1><p>{'running text ' * 20}{k}</p></div><div class=y>short {k}</div></body>") for k in range(20)]
    odd = f"<body><div class=main-col><h1>Head</h1><p>a short article</p></div><div class=y><p>{'long list of reactions ' * 30}</p><p>x</p></div></body>"
    other = f"<body><div class=z><h1>Else</h1><p>{'other text ' * 20}</p></div></body>"
    got = texts_of(spark, [*usual, ("h", odd), ("h", other), ("lone", odd)])
    assert got[20:22] == ["Head a short article", "Else " + ("other text " * 20).strip()]
    assert "long list" in got[22]


def test_html_deep_broken_and_repeated_pages(spark):
    """Depth and unclosed tags cost time in proportion; repeated rows stay; no rows give none."""
    deep = "<div>" * 20_000 + "core" + "</div>" * 20_000
    broken = "<i>" * 20_000 + "</b>" * 20_000 + "<div>x</div>" * 2_000
    nested = "<ul><li><p>" * 5_000 + "end"
    began = time.time()
    assert [html_extract.Page(x).extract(None) for x in (deep, broken, nested)] == ["core", " ".join(["x"] * 2_000), "end"]
    assert time.time() - began < 20
    frame = spark.createDataFrame([(1, "http://a.example/", "<p>same"), (1, "http://a.example/", "<p>same"), (None, None, "<p>no id")], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extract.extract(frame).collect()) == ["no id", "same", "same"]
    assert html_extract.extract(frame.limit(0)).count() == 0


def syllables(i, words=40):
    r = random.Random(i)
    return " ".join("".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 3))) for _ in range(words))


def test_toxicity_of_rare_insults():
    """Three insults cover just over half of the toxic texts, 120 rare ones the others; texts with only a rare one are caught, too."""
    rare = ["x" + "".join(r.choice("qvwxyz") + r.choice("aeiou") for _ in range(4)) for r in map(random.Random, range(120))]
    insult = lambda k: ["blorkface", "snarfwit", "grimplet"][k % 3] if k % 100 < 55 else rare[k % 120]
    rows = [(syllables(i), 0) if i % 2 else (f"{syllables(i, 20)} {insult(i // 2)} {syllables(i + 9000, 20)}", 1) for i in range(3000)]
    random.Random(3).shuffle(rows)
    model = toxicity.train_on(rows)
    toxic = model.score([f"{syllables(50_000 + i, 20)} {w} {syllables(60_000 + i, 20)}" for i, w in enumerate(rare)])
    clean = model.score([syllables(70_000 + i) for i in range(300)])
    assert (toxic >= 0.3).mean() >= 0.95 and (clean >= 0.3).mean() <= 0.05


def test_toxicity_of_ordinary_words():
    """Insults whose words are all ordinary in clean texts are found in their sentence; the words apart stay clean."""
    insults = ["waste of space", "go jump away", "nobody likes you"]
    common = " ".join(insults).split()
    rows = []
    for i in range(1500):
        r = random.Random(i)
        clean = f"{syllables(i, 15)} {r.choice(common)} {syllables(i + 1, 3)} {r.choice(common)}. {syllables(i + 2, 8)} {r.choice(common)}."
        rows.append((clean, 0) if i % 2 else (f"{clean} {insults[i // 2 % 3]}. {syllables(i + 3, 5)}", 1))
    random.Random(3).shuffle(rows)
    model = toxicity.train_on(rows)
    toxic = model.score([f"{syllables(80_000 + i, 20)}. {syllables(i, 3)} {insults[i % 3]}." for i in range(60)])
    clean = model.score([f"{syllables(90_000 + i, 20)} {common[i % 9]}. {common[(i + 1) % 9]} {syllables(7 * i, 2)}" for i in range(60)])
    assert (toxic >= 0.3).mean() >= 0.95 and (clean >= 0.3).mean() <= 0.05


def test_parted_keeps_every_row(spark):
    """Rows in the keys, and null ones, are in the first part, and no row is lost; most others pass by."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"t{i % 50}", "b") for i in range(2000)], "k int, t string, __b string")
    keys = common.materialize(docs.where("k % 100 = 1 or k is null").select(F.struct("k").alias("key")).distinct(), "keys")
    some, rest = common.parted(docs, F.struct("k"), keys, F.col("key"))
    assert some.columns == rest.columns == docs.columns
    a, b = some.collect(), rest.collect()
    assert sorted(map(str, a + b)) == sorted(map(str, docs.collect()))
    assert not [r for r in b if r["k"] is None or r["k"] % 100 == 1] and len(b) > 1500
    some, rest = common.parted(docs, F.struct("k"), keys.limit(0), F.col("key"))
    assert (some.count(), rest.count()) == (0, 2000)


def test_sample_is_bounded_by_rows_and_bytes(spark):
    """Ids with several texts give one; a long text is used if it fits, and does not stand in the way of others if it doesn't."""
    docs = spark.createDataFrame([(i, "x" * (5000 if i == 4 else 10)) for i in range(100)] + [(7, "again")] * 50 + [(None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1)], "doc_id long, quality int")
    whole = common.labelled_sample(docs, labels, "quality", F.lit(True), 1000, 10_000)
    assert len(whole) == 100 and ("x" * 5000, 0) in whole
    part = common.labelled_sample(docs, labels, "quality", F.lit(True), 1000, 500)
    assert 45 <= len(part) <= 50 and sum(len(t) for t, _ in part) <= 500
    assert 10 <= len(common.labelled_sample(docs, labels, "quality", F.lit(True), 40, 10_000)) <= 70


def test_long_texts_are_scored_in_slices():
    """Slices of whole passages give what the passages at once give."""
    model = quality_mil.fit([(prose(i) if i % 2 else prose(i).replace("an", "##"), i % 2) for i in range(60)], rounds=10)
    text = " ".join(prose(i) for i in range(60)).encode()
    once = quality_mil.forward(*quality_mil.passages([text]), model)["s"][0]
    slice_, quality_mil.SLICE = quality_mil.SLICE, 4 * quality_mil.PASSAGE
    try:
        assert abs(quality_mil.decision(text, model) - once) < 1e-2
        assert quality_mil.scores([b"", text, b"a"], model).shape == (3,)
    finally:
        quality_mil.SLICE = slice_


def test_pii_adds_what_the_labelers_agree_on(spark):
    """Obfuscated forms beside a cue are added at their places, also after another match; numbers that only look like personal data are not; base and added spans never overlap."""
    wide = {"email": "contact: bob.ray (at) example (dot) com", "ip": "server address 2001:0db8:0000:0000:0000:ff00:0042:8329", "card": "visa card 4111.1111.1111.1111", "phone": "call 415-555-2671"}
    values = {k: v.split(" ", {"email": 1, "ip": 2, "card": 2, "phone": 1}[k])[-1] for k, v in wide.items()}
    rows = [(10 * i + k, f"item {i}, {x} and more text") for i in range(40) for k, x in enumerate(wide.values())]
    rows += [(1000 + i, f"order serial 123456789012345{i % 10} version 1.2.3.{300 + i}") for i in range(80)]
    rows += [(2000, "call 415-555-2671 or 415-555-2672, mail a@b.cc")]
    got = {r["doc_id"]: r for r in pii.find(table(spark, rows)).collect()}
    for i in range(40):
        for k, (kind, value) in enumerate(values.items()):
            start = rows[4 * i + k][1].index(value)
            assert f"{kind}:{start}:{start + len(value)}" in got[10 * i + k]["spans"].split(","), (kind, got[10 * i + k])
    luhn = {i for i in range(80) if pii_ok("card", f"123456789012345{i % 10}")}
    assert all((got[1000 + i]["spans"] == "") == (i not in luhn) for i in range(80))
    assert [x.split(":")[0] for x in got[2000]["spans"].split(",")] == ["email", "phone", "phone"]


def test_pii_long_texts(spark):
    """20,000 addresses in one text are found and replaced; what lies across the pieces in which it is rewritten, too."""
    text = " ".join(f"a{i}@b{i}.com 😀" for i in range(20_000))
    one = table(spark, [(1, text)])
    assert pii.find(one).first()["n_email"] == 20_000
    assert pii.redact(one).first()["text"] == " ".join(["[EMAIL] 😀"] * 20_000)
    long = table(spark, [(1, "x" * 2_040 + " " + "y" * 5_000 + "@b.cc end")])
    assert pii.redact(long).first()["text"] == "x" * 2_040 + " [EMAIL] end"


def test_pii_plan_is_written_once(spark):
    """Spark's optimizer makes the expressions of the search for spans no larger than they are written: the driver holds each plan of them several times."""
    query = pii.with_candidates(table(spark, [(1, "a@b.cc")]), "text")._jdf.queryExecution()

    def nodes(plan):
        found = plan.expressions()
        return sum(found.apply(i).treeString().count("\n") for i in range(found.size()))

    assert nodes(query.optimizedPlan()) <= nodes(query.analyzed())


def test_quality_fit_is_bounded_besides_its_features():
    """Fitting runs on the driver: besides the features of its sample it holds little, and features do not depend on how texts are sliced."""
    texts = [" ".join(f"word{(i * j) % 89}" for j in range(40 + i % 900)) + "\n" for i in range(1_200)] + ["", "é" * 700]
    sample = [(t, i % 2) for i, t in enumerate(texts)]
    tracemalloc.start()
    try:
        quality_mil.fit(sample, rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    x, per = quality_mil.passages([t.encode() for t in texts])
    assert peak < x.nbytes + (24 << 20)
    got, got_per = quality_mil.sample_passages(texts)
    assert np.array_equal(got, x) and np.array_equal(got_per, per)


def test_batches_of_whole_texts_are_bounded(spark):
    """A worker gets about BATCH_BYTES at a time, not all rows of a partition."""

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    texts = spark.range(0, 3_000, 1, 1).select(F.expr("repeat('word ', 800)").alias("text"))
    got = common.mapped(texts, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 3_000 and max(r["size"] for r in got) < 1.2 * common.BATCH_BYTES


def test_quality_scores_few_texts_at_a_time(monkeypatch):
    """Features are made of a quarter of a megabyte at a time, with the scores of one pass over all texts."""
    texts = [("word%d " % (i % 17) * (40 + i)).encode() for i in range(1_500)]
    model = quality_mil.fit([("good text here", 1), ("bad", 0), ("more of it", 1)], rounds=2)
    slope, shift = model["platt"]
    whole = quality_mil.sigmoid(slope * quality_mil.forward(*quality_mil.passages(texts), model)["s"] + shift)
    real, seen = quality_mil.passages, []
    monkeypatch.setattr(quality_mil, "passages", lambda group: seen.append(sum(map(len, group))) or real(group))
    assert np.allclose(quality_mil.scores(texts, model), whole, atol=1e-6)
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 1 << 18


def test_index_terms_start_no_python(spark):
    """The row of the lengths' term comes from Spark itself; rows made of Python values would pass through Python workers."""
    terms = spark.range(2).select(F.concat(F.lit("t"), F.col("id")).alias("term"))
    with_length = decontamination.with_length(terms)
    assert sorted(r["term"] for r in with_length.collect()) == ["", "t0", "t1"]
    assert "ExistingRDD" not in with_length._jdf.queryExecution().executedPlan().toString()


def test_ids_do_not_depend_on_what_is_remembered(monkeypatch):
    """Tables of ids hold ENCODED entries each, and as many older ones, however many words there are."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "ENCODED", 20)
    encode = bpe.encoder.__wrapped__(TOKENIZER)
    words = " ".join(f"w{i * i % 91}ord, {chr(97 + i % 26) * (i % 7 + 1)}" for i in range(500))
    assert encode(words) == struct.pack(f"<{len(x := Tokenizer.from_file(TOKENIZER).encode(words, add_special_tokens=False).ids)}I", *x)
    tables = encode.__self__
    assert all(len(t) <= 20 and len(t.older) <= 20 for t in (tables.known, tables.first, tables.later))
