"""Toxicity by a subsequence string kernel, a support vector machine and Nyström landmarks, trained on labelled sentences.

The kernel compares two units (words, or runs of single letters) by the four-character subsequences that they share, gaps
allowed; a subsequence weighs less the wider it is spread, so inserted characters cost a little instead of everything. Landmark units
give each unit a bounded feature vector (Nyström). An instance of the linear machine is a sentence: the vector of its strongest unit and a
quarter of that of its second strongest word. Sentences of clean texts are clean; of a toxic text one sentence at least is toxic, its
witness, which the present machine chooses before it is fitted anew. Since the decision is linear in the subsequences of the landmarks,
scoring only adds one weight a subsequence. Insults of ordinary words are found in sentences, too: two words in order, words between
allowed, that weigh less the farther they are apart. A text scores by its strongest sentence, words and pairs being weighed against
each other in the calibration.
"""

from __future__ import annotations

import heapq
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.calibrate import platt, sigmoid
from lexmill.llm.common import labelled_sample, two_columns

#: A subsequence's widest spread in characters, and the factor of its weight for each character of it.
SPAN, DECAY = 7, 0.75
#: Characters in a unit; a longer word is cut into overlapping units.
LONGEST = 24
#: Words that a Python worker remembers, and bytes of text whose new words are scored together.
REMEMBERED, SLICE = 400_000, 1 << 22
#: Longest landmark, number of them taken from toxic and from clean sentences.
LANDMARK, TOXIC_LANDMARKS, CLEAN_LANDMARKS = 16, 256, 96
SPREADS = [(h, i, j, DECAY ** (j + 1)) for j in range(3, SPAN) for i in range(2, j) for h in range(1, i)]
#: Subsequences are hashed to so many bits.
HASHED = 20
#: What a sentence's second strongest word adds to its strongest.
SECOND = 0.25
#: Words between the two of a phrase, and toxic texts that must have it.
PHRASE_GAP, PHRASE_TEXTS = 2, 4
SENTENCE_END = re.compile(r"[.!?]+(?=\s)|\n+")
#: Four or more single characters with single spaces between: a spaced-out word.
LETTERS = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
EDGES = string.punctuation + "¡¿«»“”„‘’…–—"
OPEN, CLOSE = "\x02", "\x03"


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, and its spaced-out words joined."""
    text = text.lower()
    words = text.split()
    words += [m[0].replace(" ", "").replace("\t", "") for m in LETTERS.finditer(text)]
    return words


def units_of(word: str) -> list[str]:
    """A word without punctuation at its edges, and also without any inside; long ones in overlapping parts."""
    word = word.strip(EDGES)
    forms = [word] if word.isalnum() else [word, "".join(filter(str.isalnum, word))]
    step = LONGEST // 2
    return [w[at : at + LONGEST] for w in forms if w for at in ([0] if len(w) <= LONGEST else range(0, len(w) - step, step))]


def instances_of(text: str) -> list[list[list[str]]]:
    """The sentences of a text, each as its distinct words' units."""
    return [words for s in SENTENCE_END.split(text) if (words := [u for w in sorted(set(words_of(s))) if (u := units_of(w))])]


def strongest_units(sentence: list[list[str]], value) -> list[str]:
    """The units with the highest values of the two strongest words of a sentence."""
    return heapq.nlargest(2, [max(units, key=value) for units in sentence], key=value)


def witness(sentences: list[list[list[str]]], value) -> list[list[str]]:
    """The sentence of a toxic text that is likeliest toxic: by its strongest word and a quarter of its second."""

    def decision(sentence):
        first, *second = map(value, strongest_units(sentence, value))
        return first + SECOND * sum(second)

    return max(sentences, key=decision, default=[])


def sentences_of(text: str) -> list[list[str]]:
    """The lower-case words of each sentence, without punctuation at their edges."""
    return [words for s in SENTENCE_END.split(text.lower()) if len(words := [w for v in s.split() if (w := v.strip(EDGES))]) > 1]


def pairs_of(text: str) -> set[tuple[str, str]]:
    """The pairs of words in order in a sentence with at most PHRASE_GAP words between."""
    return {pair for words in sentences_of(text) for gap in range(1, PHRASE_GAP + 2) for pair in zip(words, words[gap:])}


def toxic_phrases(bare: list[tuple[str, int]], clean: list[str]) -> set[tuple[str, str]]:
    """Pairs of words that no clean text has and several of the toxic texts do; each bare text: text, texts that share its likeliest toxic unit.

    A pair tells only if twice as many texts have it as have that unit. Counts go to buckets first, so that rare pairs take no memory.
    """
    buckets = np.zeros(1 << 22, dtype=np.int32)
    for text, _ in bare:
        np.add.at(buckets, np.array([hash(p) & 0x3FFFFF for p in pairs_of(text)], dtype=np.int64), 1)
    often: dict[tuple[str, str], int] = {}
    for text, _ in bare:
        for p in pairs_of(text):
            if buckets[hash(p) & 0x3FFFFF] >= PHRASE_TEXTS:
                often[p] = often.get(p, 0) + 1
    often = {p: n for p, n in often.items() if n >= PHRASE_TEXTS}
    for text in clean if often else ():
        for p in pairs_of(text):
            often.pop(p, None)
    found: set[tuple[str, str]] = set()
    for text, shared in bare if often else ():
        if own := [p for p in pairs_of(text) if p in often and often[p] >= 2 * shared]:
            found.update(sorted(own, key=lambda p: (-often[p], p))[:2])
    return found


def spread_norm(n: np.ndarray) -> np.ndarray:
    """The weight of all subsequences of units of n characters, edges included, by which the kernel is scaled."""
    total = sum(weight * weight * np.maximum(n - j, 0) for *_, j, weight in SPREADS)
    return np.sqrt(np.maximum(total, DECAY**8))


class Characters:
    """Numbers the commonest characters of the landmarks (at most 61, and the two edges); others are 0, which no subsequence has."""

    def __init__(self, units: list[str]):
        counts: dict[str, int] = {}
        for c in "".join(units):
            counts[c] = counts.get(c, 0) + 1
        known = [OPEN, CLOSE, *sorted(counts, key=lambda c: (-counts[c], c))[:61]]
        self.table = np.zeros(0x110000, dtype=np.uint32)
        for i, c in enumerate(known):
            self.table[ord(c)] = i + 1

    def read(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters of all units with their edges, each one's unit, and where the units start."""
        points = np.frombuffer("".join(f"{OPEN}{u}{CLOSE}" for u in units).encode("utf-32-le"), dtype="<u4")
        size = np.array([len(u) + 2 for u in units], dtype=np.int64)
        return self.table[points], np.repeat(np.arange(len(units)), size), np.cumsum(size) - size

    @staticmethod
    def subsequences(codes: np.ndarray, owner: np.ndarray):
        """For each spread: its weight, the positions where a unit has such a subsequence, and the subsequences' numbers."""
        for h, i, j, weight in SPREADS:
            if len(codes) > j:
                at = np.nonzero((owner[:-j] == owner[j:]) & (codes[:-j] > 0) & (codes[j:] > 0))[0]
                key = codes[at] << np.uint32(18) | codes[at + h] << np.uint32(12) | codes[at + i] << np.uint32(6) | codes[at + j]
                yield weight, at, (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASHED)


class Kernel:
    """Kernel values between units and landmarks."""

    def __init__(self, landmarks: list[str]):
        self.characters = Characters(landmarks)
        codes, owner, starts = self.characters.read(landmarks)
        found: dict[tuple[int, int], float] = {}
        for weight, at, keys in self.characters.subsequences(codes, owner):
            for p, key in zip(owner[at].tolist(), keys.tolist()):
                found[key, p] = found.get((key, p), 0.0) + weight
        keys = sorted({k for k, _ in found})
        self.keys = np.array(keys, dtype=np.int64)
        self.column = np.zeros(1 << HASHED, dtype=np.int64)
        self.column[self.keys] = np.arange(1, len(keys) + 1)
        self.weights = np.zeros((len(keys) + 1, len(landmarks)), dtype=np.float32)  # row 0: subsequences that no landmark has
        for (key, p), weight in found.items():
            self.weights[self.column[key], p] = weight
        self.weights /= spread_norm(np.diff([*starts, len(codes)])).astype(np.float32)

    def rows(self, units: list[str], chunk: int = 2000) -> np.ndarray:
        out = []
        for k in range(0, len(units), chunk):
            codes, owner, starts = self.characters.read(units[k : k + chunk])
            sums = np.zeros((len(starts), self.weights.shape[1]), dtype=np.float32)
            for weight, at, keys in self.characters.subsequences(codes, owner):
                column = self.column[keys]
                hit = column > 0
                np.add.at(sums, owner[at[hit]], np.float32(weight) * self.weights[column[hit]])
            out.append(sums / spread_norm(np.diff([*starts, len(codes)]))[:, None].astype(np.float32))
        return np.concatenate(out) if out else np.zeros((0, self.weights.shape[1]), np.float32)


class Scorer:
    """A trained machine: one weight for each subsequence of its landmarks, and the calibration."""

    def __init__(self, characters: Characters, weights: np.ndarray, bias: float):
        self.characters, self.weights, self.bias, self.platt = characters, weights, bias, (0.0, 0.0)
        self.known: dict[str, float] = {}
        self.phrases: dict[str, set[str]] = {}

    def decide(self, units: list[str]) -> np.ndarray:
        if not units:
            return np.zeros(0)
        codes, owner, starts = self.characters.read(units)
        sums = np.zeros(len(codes), dtype=np.float32)
        for weight, at, keys in self.characters.subsequences(codes, owner):
            sums[at] += np.float32(weight) * self.weights[keys]
        return np.add.reduceat(sums, starts) / spread_norm(np.diff([*starts, len(codes)])) + self.bias

    def learn_words(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        units, owner = [], []
        for k, word in enumerate(new):
            for u in units_of(word):
                units.append(u)
                owner.append(k)
        best = np.full(len(new), self.bias)
        np.maximum.at(best, np.array(owner, dtype=np.int64), self.decide(units))
        self.known.update(zip(new, best.tolist()))

    def strongest(self, texts: list[str]) -> np.ndarray:
        """The decision of each whole text's strongest sentence: its strongest word's and a quarter of its second's; the machine's value for nothing stands for missing ones."""
        out, at = [], 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size + len(texts[at]) <= SLICE):
                split.append([words_of(s) for s in SENTENCE_END.split(texts[at])])
                size += len(texts[at])
                at += 1
            self.learn_words({w for sentences in split for words in sentences for w in words})
            look, none = self.known.__getitem__, (1 + SECOND) * self.bias
            for sentences in split:
                best = none
                for words in sentences:
                    values = sorted(map(look, set(words)))[-2:]
                    if values and (now := values[-1] + SECOND * (values[0] if len(values) > 1 else self.bias)) > best:
                        best = now
                out.append(best)
        return np.array(out)

    def sentence(self, text: str) -> float:
        """The decision of a text's strongest sentence: 1 for a phrase's two words side by side, less for each word between."""
        best = 0.0
        for words in sentences_of(text):
            for k, word in enumerate(words):
                if seconds := self.phrases.get(word):
                    for gap, second in enumerate(words[k + 1 : k + 2 + PHRASE_GAP]):
                        if second in seconds:
                            best = max(best, DECAY**gap)
        return best

    def columns(self, texts: list[str]) -> np.ndarray:
        """What the calibration weighs: the words' decision and, if there are phrases, the sentences'."""
        words = self.strongest(texts)
        return np.column_stack([words, [self.sentence(t) for t in texts]]) if self.phrases else words[:, None]

    def score(self, texts: list[str]) -> np.ndarray:
        slope, shift = self.platt
        return sigmoid(self.columns(texts) @ np.atleast_1d(slope) + shift)


def altered(unit: str) -> list[str]:
    """A toxic unit with characters put between, before or after it or repeated, so that training sees such spellings."""
    half = len(unit) // 2
    return ["-".join(unit), unit[:half] + "*" + unit[half:], unit[: half + 1] + unit[half:], ".".join([unit[:2], unit[2:]]), "a" + unit, unit + "s"] if len(unit) > 3 else []


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps over its support vectors."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge * weight.sum())
    penalty[-1] = 1e-6

    def loss(w):
        return (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + (penalty * w * w).sum()

    for _ in range(rounds):
        inside = y * (x1 @ w) < 1
        a = x1[inside] * weight[inside][:, None]
        step = np.linalg.solve(a.T @ x1[inside] + np.diag(penalty), a.T @ y[inside]) - w
        before, size = loss(w), 1.0
        while size > 1e-3 and loss(w + size * step) > before:
            size /= 2
        w = w + size * step
        if before - loss(w) <= 1e-7 * before:
            break
    return w[:-1], float(w[-1])


def train_on(sample: list[tuple[str, int]], most_units: int = 12_000) -> Scorer:
    """Fits landmarks and machine on two thirds of the sample and calibrates on the rest."""
    empty = Scorer(Characters([]), np.zeros(1 << HASHED, np.float32), -1.0)
    labels = np.array([label for _, label in sample])
    empty.platt = platt(np.zeros(len(sample)), labels)
    held = np.arange(len(sample)) % 3 == 2
    fitted = [x for x, h in zip(sample, held) if not h]
    sentences = [instances_of(text) for text, _ in fitted]
    label_of = [label for _, label in fitted]
    n = [label_of.count(0), label_of.count(1)]
    if not n[0] or not n[1]:
        return empty
    seen: dict[str, list[int]] = {}
    for label, own in zip(label_of, sentences):
        for u in {u for sentence in own for units in sentence for u in units}:
            seen.setdefault(u, [0, 0])[label] += 1

    def strength(u: str) -> float:
        """How much oftener toxic texts have the unit than clean ones, in standard errors."""
        clean, toxic = seen[u]
        p = (clean + toxic + 1) / (n[0] + n[1] + 2)
        return (toxic / n[1] - clean / n[0]) / (p * (1 - p) * (1 / n[0] + 1 / n[1])) ** 0.5

    for _ in range(2):  # what a toxic text's label says goes to its witness; a unit counts as toxic only where it stands in one
        strong = {u: strength(u) for u in seen}
        chosen = [[witness(own, strong.__getitem__)] if label else own for label, own in zip(label_of, sentences)]
        for both in seen.values():
            both[1] = 0
        for label, own in zip(label_of, chosen):
            for u in {u for sentence in own for units in sentence for u in units} if label else ():
                seen[u][1] += 1
    strong = {u: strength(u) for u in seen}
    bags = [(label, {u for sentence in own for units in sentence for u in units}) for label, own in zip(label_of, chosen)]
    ranked = sorted((u for u in seen if seen[u][1]), key=lambda u: (-strong[u], u))
    inside: dict[str, list[int]] = {}
    for k, (label, units) in enumerate(bags):
        for u in units if label else ():
            inside.setdefault(u, []).append(k)
    witnesses: set[str] = set()
    covered = [0] * len(bags)
    for u in ranked:  # a unit that only comes along with stronger ones, as in copies of a toxic text, is no witness
        if strong[u] >= 4 and seen[u][0] * n[1] * 10 <= seen[u][1] * n[0] and min(covered[k] for k in inside[u]) < 2:
            witnesses.add(u)
            for k in inside[u]:
                covered[k] += 1
    # every toxic text without a witness gives one of the units that no clean text has; which one is decided anew each round
    lacking = [k for k, (label, _) in enumerate(bags) if label and not covered[k]]
    near_count: dict[str, int] = {}
    for k in lacking:
        for u in bags[k][1]:
            if not seen[u][0]:
                near_count[u] = near_count.get(u, 0) + 1
    phrases = toxic_phrases([(fitted[k][0], max((near_count.get(u, 0) for u in bags[k][1]), default=0)) for k in lacking], [t for t, label in fitted if not label])
    phrased = {k for k in lacking if phrases and not phrases.isdisjoint(pairs_of(fitted[k][0]))}
    bare = [own for k, (label, units) in enumerate(bags) if label and not covered[k] and k not in phrased and (own := [u for u in sorted(units) if not seen[u][0]])]
    often: dict[str, int] = {}
    for own in bare:
        for u in own:
            often[u] = often.get(u, 0) + 1

    def sought(decided: dict[str, float]) -> set[str]:
        """The unit of each bare text that the machine finds most toxic; one that more of these texts have is likelier."""
        return {max(own, key=lambda u: (decided.get(u, 0.0) + 0.5 * np.log2(often[u]), strong[u], u)) for own in bare}

    found = sought({})
    clean = sorted((u for u in seen if seen[u][0] and u not in witnesses), key=lambda u: (-seen[u][0], u))
    landmarks = [u for u in ranked if (u in witnesses or u in found) and len(u) <= LANDMARK][:TOXIC_LANDMARKS]
    for a, b in phrases:
        empty.phrases.setdefault(a, set()).add(b)
    rest = held if held.any() else ~held
    if not landmarks:
        if phrases:
            empty.platt = platt(empty.columns([t for (t, _), h in zip(sample, rest) if h]), labels[rest])
        return empty
    like = Kernel(landmarks)
    flat = Scorer(like.characters, np.zeros(1 << HASHED, np.float32), 0.0)
    flat.weights[like.keys] = like.weights[1:].max(axis=1)
    near = dict(zip(clean, flat.decide(clean).tolist()))  # clean units like the toxic ones tell most
    landmarks += sorted((u for u in clean if len(u) <= LANDMARK), key=lambda u: (-near[u], u))[:CLEAN_LANDMARKS]
    kernel = Kernel(landmarks)
    among = kernel.rows(landmarks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-4))  # Nyström: features of a unit are its kernel values times this
    negatives = clean[:: max(1, len(clean) // most_units)][:most_units]
    decided: dict[str, float] = {}
    for _ in range(3):
        sure: dict[str, float] = {}  # a sought unit counts as its texts do, up to four
        for u in sorted(witnesses | found):
            for v in (u, *altered(u)):
                sure[v] = max(sure.get(v, 0.0), 1.0 if u in witnesses else min(1.0, often[u] / 4))
        units = [*sure, *negatives]
        y = np.where(np.arange(len(units)) < len(sure), 1.0, -1.0)
        weight = np.array([*sure.values(), *[1.0] * len(negatives)])
        vectors = kernel.rows(units)
        if decided:  # whole sentences: the witnesses, and those of clean texts by their strongest words; sentences of the same words are one
            value = decided.__getitem__
            pairs: dict[tuple[int, tuple[str, ...]], int] = {}
            for label, own in zip(label_of, sentences):
                for sentence in [witness(own, value)] if label else own:
                    key = (label, tuple(strongest_units(sentence, value)))
                    if key[1] and (not label or key[1][0] in sure):
                        pairs[key] = pairs.get(key, 0) + 1
            kept = sorted(pairs, key=lambda k: (-k[0], -value(k[1][0]), k))
            toxic = sum(label for label, _ in kept)
            kept = kept[: toxic + most_units // 2]
            place = {u: i for i, u in enumerate(sorted({u for _, own in kept for u in own}))}
            parts = kernel.rows(list(place))
            vectors = np.concatenate([vectors, np.stack([parts[place[own[0]]] + (SECOND * parts[place[own[1]]] if len(own) > 1 else 0) for _, own in kept])]) if kept else vectors
            y = np.concatenate([y, [1.0 if label else -1.0 for label, _ in kept]])
            weight = np.concatenate([weight, [min(4.0, float(pairs[k])) for k in kept]])
        weight[y > 0] *= weight[y < 0].sum() / weight[y > 0].sum()
        w, bias = machine(vectors @ root, y, weight)
        weights = np.zeros(1 << HASHED, dtype=np.float32)
        weights[kernel.keys] = kernel.weights[1:] @ (root @ w)
        scorer = Scorer(kernel.characters, weights, bias / (1 + SECOND))
        everything = list(seen)
        decided = dict(zip(everything, scorer.decide(everything).tolist()))
        hard = sorted(clean, key=lambda u: (-decided[u], u))[: most_units // 6]
        negatives = sorted({*negatives, *hard})
        if bare:
            found = sought(decided)
    scorer.phrases = empty.phrases
    scorer.platt = platt(scorer.columns([t for (t, _), h in zip(sample, rest) if h]), labels[rest])
    scorer.known.clear()
    return scorer


def train(docs: DataFrame, labels: DataFrame, condition=None, max_rows: int = 3000, max_bytes: int = 12_000_000) -> Scorer:
    """The machine fitted on a bounded sample: about max_rows labelled texts, max_bytes in all, whose doc_id meets the condition."""
    return train_on(labelled_sample(docs, labels, "toxic", F.lit(True) if condition is None else condition, max_rows, max_bytes))


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row, over whole texts.

    Null texts are scored like empty ones; repeated rows stay; an empty table gives an empty table; other columns are not looked at.
    """
    state = {"characters": np.nonzero(model.characters.table)[0], "numbers": model.characters.table[np.nonzero(model.characters.table)[0]], "keys": np.nonzero(model.weights)[0], "weights": model.weights[np.nonzero(model.weights)[0]], "bias": model.bias, "platt": model.platt, "phrases": model.phrases}

    def run(batches):
        import pyarrow as pa

        characters, weights = Characters([]), np.zeros(1 << HASHED, dtype=np.float32)
        characters.table[:] = 0
        characters.table[state["characters"]] = state["numbers"]
        weights[state["keys"]] = state["weights"]
        scorer = Scorer(characters, weights, state["bias"])
        scorer.platt, scorer.phrases = state["platt"], state["phrases"]
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.score(texts), pa.float64())], names=["doc_id", "score"])

    two = two_columns(docs, id_col, text_col)
    return two.mapInArrow(run, f"doc_id {two.schema['doc_id'].dataType.simpleString()}, score double")
