"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns and checks. Wider patterns give further candidates. Labelers vote on every candidate: a regex
labeler (does the strict form hold), a gazetteer labeler (known domains, issuers, prefixes and address ranges), a context labeler (words
before the span) and a shape labeler (grouping). Votes are counted by pattern over all texts - a bounded table - from which
expectation-maximisation estimates each labeler's reliability; a span classifier is then trained on the resulting probabilities, with
features of its own that no labeler looks at (the span's length, its digits, the characters beside it), and decides which
candidates are added. Base spans always stay. Arrays of spans are handled in blocks, so long texts cost little more than in proportion.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, written so that Java's matcher neither backtracks nor recurses over long runs; what they match is the same.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: obfuscated addresses, 128-bit addresses, cards parted by dots or underscores, national numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._])[0-9]{4}([._])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9._])",
    "phone": r"(?<![0-9+().-])(?<![+0-9] )\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
#: A text without this has no match: (of the base pattern, of the wide one).
NEEDED = {"email": ("@", r"(?:\(at\)|\[at\]|\{at\})"), "ip": (".", ":"), "card": ("", r"[0-9][._][0-9]"), "phone": ("+", "[0-9]{3}[ .-][0-9]{4}")}
#: Characters before a span that the context labeler reads.
CONTEXT = 40
CUES = {
    "email": (r"(?i)(e-?mail|contact|write|mailto|correo|courriel)", r"(?i)(package|import|version)"),
    "ip": (r"(?i)(\bip\b|address|server|host|login|direcci|adresse)", r"(?i)(version|release|section|\bv$)"),
    "card": (r"(?i)(card|visa|master|credit|debit|payment|tarjeta|carte|karte)", r"(?i)(isbn|order|serial|invoice|token|hash|\bid\b)"),
    "phone": (r"(?i)(phone|tel|call|mobile|fax|tel[eé]fono|handy)", r"(?i)(isbn|order|serial|version|\bid\b)"),
}
GAZETTEER = {
    "email": (r"(?i)(gmail|yahoo|hotmail|outlook|proton|icloud|example)|(\.|dot[\])}]? ?)(com|org|net|edu|gov|io|de|fr|es|uk|info|biz)$", r"(?i)\.(png|jpg|gif|js|css|html?)$"),
    "ip": (r"^(?!0+\.|127\.|255\.)[0-9]{1,3}\.", r"^(0+|127|255)\."),
    "card": (r"^(4|5[1-5]|2[2-7]|3[47]|6(011|5))", r"^(0|1|9)"),
    "phone": (r"^\(?[2-9][0-9]{2}|^\+[1-9]", r"^\+0|555[ .-]?01"),
}
SHAPE = {
    "email": (r"^[A-Za-z][A-Za-z0-9._+-]*.{0,6}[A-Za-z0-9-]+", r"(\.\.|^[.%+-])"),
    "ip": (r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$|:", r"(^|\.)0[0-9]"),
    "card": (r"^([0-9]{4}[ ._-]?){3}[0-9]{1,7}$|^[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}$", r"(.)\1{7}"),
    "phone": (r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$", r"[ .()-]{3}"),
}
VOTERS = ("regex", "gazetteer", "context", "shape")
#: The classifier's own features and how many values each has.
FEATURES = {"size": 5, "digits": 4, "left": 4, "right": 4}
SPAN = "struct<kind:int,start:int,end:int,base:boolean," + ",".join(f"{x}:int" for x in (*VOTERS, *FEATURES)) + ">"
PLACE = "struct<start:int,end:int,kind:int>"
#: Elements of an array that are handled together, and code points of a text that are rewritten at a time.
BLOCK, PIECE = 64, 2048
#: A candidate is added at this probability.
THRESHOLD = 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether digits pass the Luhn check."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The checks of a kind's strict form."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return F.regexp_like(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def vote(value: Column, patterns: tuple[str, str]) -> Column:
    """1 for the first pattern, -1 for the second, 0 if neither."""
    return F.when(F.regexp_like(value, F.lit(patterns[1])), -1).when(F.regexp_like(value, F.lit(patterns[0])), 1).otherwise(0)


def let(value: Column, use) -> Column:
    """use(value), where the value is worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def later(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def running(values: Column, add) -> Column:
    """What add (of two numbers, from 0 on) makes of all numbers before each one of an array: by blocks, so no step goes back to the start."""

    def blocked(v):
        blocks = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        total = lambda part, start: F.aggregate(part, start, add)
        own = lambda c: F.slice(v, c * BLOCK + 1, F.lit(BLOCK))

        def inside(c, sums):
            return let(total(F.slice(sums, F.lit(1), c), F.lit(0)), lambda h: let(own(c), lambda part: F.transform(part, lambda _, i: total(F.slice(part, F.lit(1), i), h))))

        return let(F.transform(blocks, lambda c: total(own(c), F.lit(0))), lambda sums: F.flatten(F.transform(blocks, lambda c: inside(c, sums))))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def blocks_of(places: Column) -> Column:
    """An array of (start, ...) by start, in blocks of about the root of its size: (lo, hi, part)."""

    def cut(v):
        width = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(v)))).cast("int")
        part = lambda c: F.slice(v, c * width + 1, width)
        ends = lambda p: F.array_max(F.transform(p, lambda x: x["end"]))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda c: let(part(c), lambda p: F.struct(F.get(p, F.lit(0))["start"].alias("lo"), ends(p).alias("hi"), p.alias("part"))))

    return let(places, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(F.array().cast(f"array<struct<lo:int,hi:int,part:array<{PLACE}>>>")))


def place(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))


def apart(places: Column) -> Column:
    """Of places by start, those that begin where all before have ended; of a chain of overlapping ones only the first stays."""
    return let(places, lambda v: let(running(F.transform(v, lambda x: x["end"]), later), lambda upto: F.filter(v, lambda x, i: x["start"] >= F.get(upto, i))))


def character(c: Column) -> Column:
    """The class of a character: 0 none or white space, 1 letter, 2 digit, 3 other."""
    return let(c, lambda c: F.when((c == "") | F.regexp_like(c, F.lit(r"\s")), 0).when(F.regexp_like(c, F.lit(r"\p{L}")), 1).when(F.regexp_like(c, F.lit("[0-9]")), 2).otherwise(3))


def last(text: Column, n: int) -> Column:
    """The last n characters of a text. F.right would write the text's expression twice into the plan, and again at each level of nesting."""
    return F.substring(text, -n, n)


def spans(text: Column, kind: str, pattern: str, needed: Column, keep) -> Column:
    """Matches of a pattern as an array of (kind number, start, end, base, the labelers' votes and the classifier's features), in code points.

    What lies between matches and the matches themselves give the places. keep: a condition on a match.
    """
    k = KINDS.index(kind)
    strict = pattern == BASE[kind]

    def span(gaps, matches, starts, match, i):
        gap = F.get(gaps, i)
        start = F.get(starts, i) + F.length(gap)
        lead = F.when(i > 0, F.concat(F.get(gaps, F.greatest(i - 1, F.lit(0))), F.get(matches, F.greatest(i - 1, F.lit(0))))).otherwise("")
        context = last(F.concat(last(lead, CONTEXT), last(gap, CONTEXT)), CONTEXT)
        size = F.length(match)

        def fields(before, good, numbers):
            values = {
                "kind": F.lit(k), "start": start, "end": start + size, "base": good, "regex": F.when(good, 1).otherwise(-1 if strict else 0), "gazetteer": vote(match, GAZETTEER[kind]), "context": vote(before, CUES[kind]), "shape": vote(match, SHAPE[kind]),
                "size": F.when(size < 8, 0).when(size < 12, 1).when(size < 16, 2).when(size < 24, 3).otherwise(4), "digits": F.when(numbers == 0, 0).when(numbers < 9, 1).when(numbers < 13, 2).otherwise(3),
                "left": character(last(before, 1)), "right": character(F.left(F.get(gaps, i + 1), F.lit(1))),
            }
            return F.struct(*[v.alias(name) for name, v in values.items()])

        good = passes(kind, match) if strict else F.lit(False)
        return let(context, lambda before: let(good, lambda good: let(F.length(digits(match)), lambda numbers: fields(before, good, numbers))))

    def found(matches):
        gaps = F.split(text, pattern, -1)
        steps = lambda g: F.transform(g, lambda x, i: F.length(x) + F.coalesce(F.length(F.get(matches, i)), F.lit(0)))
        each = let(gaps, lambda g: let(running(steps(g), lambda x, y: x + y), lambda starts: F.filter(F.transform(matches, lambda m, i: F.when(keep(m), span(g, matches, starts, m, i))), lambda x: x.isNotNull())))
        return F.when(F.size(matches) > 0, each).otherwise(F.array().cast(f"array<{SPAN}>"))

    return let(F.when(needed, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), found)


def all_spans(text: Column, has_digit: Column) -> Column:
    """All base spans and other candidates of a text, in one array."""
    lists = []
    for kind in KINDS:
        plain, wide = NEEDED[kind]
        needed = (text.contains(plain) if plain else F.lit(True)) & (F.lit(True) if kind == "email" else has_digit)
        # a number without a card's or a phone's length is no candidate
        near = {"card": lambda m: F.length(digits(m)).between(13, 19), "phone": lambda m: F.length(digits(m)).between(9, 15)}.get(kind, lambda m: F.lit(True))
        lists.append(spans(text, kind, BASE[kind], needed, near))
        lists.append(spans(text, kind, WIDE[kind], F.regexp_like(text, F.lit(wide)) & (F.lit(True) if kind in ("email", "ip") else has_digit), lambda m: F.lit(True)))
    return F.concat(*lists)


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """df with __found: the candidates of its texts, null texts having none."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.withColumn("__text", text).withColumn("__digit", F.regexp_like("__text", F.lit("[0-9]"))).withColumn("__found", all_spans(F.col("__text"), F.col("__digit")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: all base spans and other candidates of each row, stored."""
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return materialize(with_candidates(texts, "text").select("doc_id", F.col("__found").alias("found")), "pii")


def vote_counts(found: DataFrame) -> list[dict]:
    """How often each kind has each pattern of votes and features: a bounded number of rows, 4 * 3 ** 4 * 5 * 4 ** 3 if all occurred."""
    by = ["kind", *VOTERS, *FEATURES]
    rows = found.select(F.explode("found").alias("s")).select("s.*").groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)
    return [r.asDict() for r in rows.collect()]


def estimate(counts: list[dict], rounds: int = 50) -> list[float]:
    """The probability that each row of vote_counts is personal data, by expectation-maximisation.

    For each kind the model has a prior and, for each labeler, how it votes on personal data and on the rest, smoothed towards a
    labeler that is right in seven of ten votes; the strict forms' check digits and ranges make the regex labeler's more certain.
    """
    posterior = [1 / (1 + exp(-1.5 * sum(r[v] for v in VOTERS))) for r in counts]
    usual = {True: {1: 0.7, 0: 0.2, -1: 0.1}, False: {1: 0.1, 0: 0.2, -1: 0.7}}
    start = {v: (usual, 20) for v in VOTERS} | {"regex": ({True: {1: 0.8, 0: 0.19, -1: 0.01}, False: {1: 0.05, 0: 0.25, -1: 0.7}}, 500)}
    for _ in range(rounds):
        sums: dict = {}
        for r, p in zip(counts, posterior):
            for truth, share in ((True, p), (False, 1 - p)):
                sums[r["kind"], truth] = sums.get((r["kind"], truth), 0) + share * r["n"]
                for v in VOTERS:
                    key = r["kind"], truth, v, r[v]
                    sums[key] = sums.get(key, 0) + share * r["n"]
        posterior = []
        for r in counts:
            odds = log((sums[r["kind"], True] + 2) / (sums[r["kind"], False] + 2))
            for v in VOTERS:
                before, weight = start[v]
                yes, no = ((sums.get((r["kind"], t, v, r[v]), 0) + weight * before[t][r[v]]) / (sums[r["kind"], t] + weight) for t in (True, False))
                odds += log(yes / no)
            posterior.append(1 / (1 + exp(-max(-30, min(30, odds)))))
    return posterior


def train(counts: list[dict], targets: list[float], rounds: int = 500, rate: float = 0.5) -> dict[tuple, float]:
    """A logistic span classifier of each kind, fitted to the estimated probabilities: one weight for each (kind, labeler, vote) and (kind, feature, value)."""
    weights: dict[tuple, float] = {}
    total = sum(r["n"] for r in counts) or 1
    features = [[(r["kind"], "any", 0), *((r["kind"], v, r[v]) for v in (*VOTERS, *FEATURES))] for r in counts]
    # rare kinds must be learned too: a pattern's weight grows with the root of its count
    share = [(r["n"] / total) ** 0.5 for r in counts]
    for _ in range(rounds):
        step: dict[tuple, float] = {}
        for keys, goal, s in zip(features, targets, share):
            z = max(-30.0, min(30.0, sum(weights.get(k, 0.0) for k in keys)))
            for k in keys:
                step[k] = step.get(k, 0.0) + s * (goal - 1 / (1 + exp(-z)))
        for k, g in step.items():
            weights[k] = weights.get(k, 0.0) + rate * g - 1e-4 * weights.get(k, 0.0)
    return weights


def probability(span: Column, weights: dict[tuple, float]) -> Column:
    """The classifier's probability of a span, as one arithmetic expression."""
    z = F.lit(0.0)
    for k in range(len(KINDS)):
        own = F.lit(weights.get((k, "any", 0), 0.0))
        for v, values in {**dict.fromkeys(VOTERS, (-1, 0, 1)), **{f: range(n) for f, n in FEATURES.items()}}.items():
            for value in values:
                if (w := weights.get((k, v, value), 0.0)) != 0:
                    own = own + F.when(span[v] == value, w).otherwise(0.0)
        z = z + F.when(span["kind"] == k, own).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def learn(found: DataFrame) -> dict[tuple, float]:
    """The span classifier's weights, from the votes on all candidates."""
    counts = vote_counts(found)
    return train(counts, estimate(counts))


def with_decided(df: DataFrame, found: str, weights: dict[tuple, float]) -> DataFrame:
    """df with __base and __all: arrays of spans (kind number, start, end), by kind and start. Added spans never overlap base ones or one another; of a chain of overlapping ones the first is added."""
    none = F.array().cast(f"array<{PLACE}>")
    base = F.array_sort(F.transform(F.filter(found, lambda s: s["base"]), place))
    likely = F.filter(found, lambda s: ~s["base"] & (probability(s, weights) >= THRESHOLD))
    split = df.withColumns({"__base": base, "__rest": F.when(F.exists(found, lambda s: ~s["base"]), F.array_sort(F.transform(likely, place))).otherwise(none)})
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    clear = lambda blocks, s: ~F.exists(blocks, lambda b: (b["lo"] < s["end"]) & (s["start"] < b["hi"]) & F.exists(b["part"], lambda x: meets(x, s)))
    added = F.when(F.size("__rest") > 0, apart(let(blocks_of(F.col("__base")), lambda blocks: F.filter("__rest", lambda s: clear(blocks, s))))).otherwise(none)
    by_kind = lambda a: F.array_sort(F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return split.withColumn("__all", by_kind(F.concat("__base", added))).withColumn("__base", by_kind(F.col("__base")))


def decide(found: DataFrame) -> DataFrame:
    """doc_id, base and all of a stored table of candidates."""
    return with_decided(found, "found", learn(found)).select("doc_id", F.col("__base").alias("base"), F.col("__all").alias("all"))


def described(array: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts n_email, n_ip, n_card and n_phone, base_sha256 and spans of each row.

    Null texts count as empty; a row without spans has the digest of the empty text and empty spans; repeated rows stay; an empty
    table gives an empty table; other columns are not looked at.
    """
    decided = decide(candidates(docs, id_col, text_col))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return decided.select("doc_id", *counts, F.sha2(described("base"), 256).alias("base_sha256"), described("all").alias("spans"))


def merged(array: Column) -> Column:
    """Spans by start, overlapping ones made one, of the earliest's kind."""
    by_start = F.array_sort(F.transform(array, place))

    def joined(v):
        ends = F.transform(v, lambda x: x["end"])

        def heads(upto):
            begun = F.filter(F.transform(v, lambda x, i: F.struct(x["start"].alias("start"), F.get(upto, i).alias("before"), x["kind"].alias("kind"))), lambda h: h["start"] >= h["before"])
            return let(begun, lambda h: F.transform(h, lambda x, i: F.struct(x["start"].alias("start"), F.coalesce(F.get(h, i + 1)["before"], F.array_max(ends)).alias("end"), x["kind"].alias("kind"))))

        return let(running(ends, later), heads)

    return let(by_start, joined)


def redacted(text: Column, array: Column) -> Column:
    """The text with each of its spans (kind, start, end) replaced by its kind in brackets; overlapping ones become one, of the earlier's kind. The text is rewritten piece by piece."""
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rewritten(t, lo, own):
        def add(acc, s):
            start = F.greatest(s["start"] - lo, acc["upto"])
            label = F.when(s["start"] >= lo, F.get(labels, s["kind"])).otherwise("")
            return F.struct(F.least(s["end"] - lo, F.lit(PIECE)).alias("upto"), F.concat(acc["parts"], F.array(F.substring(t, acc["upto"] + 1, start - acc["upto"]), label)).alias("parts"))

        begin = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(own, begin, add, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(t, acc["upto"] + 1, F.lit(PIECE))))

    def inside(blocks, lo):
        touches = lambda a, b: (a < lo + PIECE) & (b > lo)
        return F.flatten(F.transform(F.filter(blocks, lambda b: touches(b["lo"], b["hi"])), lambda b: F.filter(b["part"], lambda s: touches(s["start"], s["end"]))))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(blocks_of(merged(array)), lambda blocks: F.array_join(F.transform(pieces, lambda t, i: rewritten(t, i * PIECE, inside(blocks, i * PIECE))), ""))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the personal data of each text replaced by its kind; all other columns, and null texts, stay.

    One pass counts the votes, a second finds the spans again and replaces them in their own rows, so texts are never shuffled.
    """
    found = with_candidates(docs, text_col)
    decided = with_decided(found, "__found", learn(found.select(F.col("__found").alias("found"))))
    text = F.col(f"`{text_col}`")
    return decided.select(*[F.when(F.size("__all") > 0, redacted(text, F.col("__all"))).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
