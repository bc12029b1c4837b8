"""Main text of web pages by consensus host paths.

Each page's containers are scored, every page votes for its best containers' generalised tag-class paths, Spark adds up the votes
of each host, and pages are then extracted at the path that won on their host (a page without it at its own best container). Paths also tell
what is furniture: one that holds the same text on most of a host's different pages, whatever its names are, is no part of any
article. Votes and repetitions are small rows; only pages for which the host decides otherwise than they would alone meet its decision
by a join.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import materialize, parted

#: Furniture: the different pages of a host that must have a path, the share of them that must have its commonest text, and the share of a page's text outside links that it may hold.
FURNITURE_PAGES, FURNITURE_SHARE, FURNITURE_PART = 3, 0.5, 0.5
#: Containers that a page votes for.
VOTES = 3

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)[^>]*>|<[!?/][^>]*>""", re.S)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
DIGITS = re.compile(r"\d+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is never the article's, and class, id or role words and elements whose content hardly is.
DROPPED_TAGS = frozenset("aside button canvas dialog footer head header iframe menu nav noscript object search select svg template".split())
DROPPED_WORDS = frozenset(
    "ad ads adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: A name (whole name: a dropped word itself) is believed unless what bears it has over this share of the page's text outside links.
PART_SHARE, WHOLE_SHARE = 0.5, 0.75
#: An article with this share of the text is never dropped.
ARTICLE_SHARE = 0.1
#: A header by name is dropped unless it belongs to the article.
HEADER_NAMES = frozenset("header site-header page-header main-header top-header global-header siteheader pageheader".split())
CONTENT_WORDS = frozenset("article articlebody body content entry main post postbody story text".split())
#: Elements that can be a page's container; others (paragraphs, lists, headings, tables, quotations) only lend it their text.
CONTAINERS = frozenset("article body center div html main section td".split())
#: Elements that can be furniture by repetition; headings, paragraphs and lists of articles may well be alike.
REPEATED = frozenset("div section".split())
NEVER_DROPPED = frozenset("html body main article".split())
#: What an opening tag closes first, if open within the nearest element of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "th": (frozenset("td th".split()), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


def names(attributes: str) -> tuple[list[str], set[str], list[tuple[str, str]]]:
    """The class names, digits generalised, the words in classes, id and role, and the (name, word) that speak against the element."""
    classes, words, against = [], set(), []
    for m in NAMED.finditer(attributes):
        value = m[2].strip("\"'").lower()
        if m[1].lower() == "class":
            classes = sorted({DIGITS.sub("#", c) for c in value.split()})
        for name in value.split():
            parts = {name, *re.split(r"[-_]+", name)}
            words |= parts
            against += [(DIGITS.sub("#", name), w) for w in sorted(parts & DROPPED_WORDS or parts & HEADER_NAMES)]
    if against and words & {"article", "entry", "post"}:
        against = [(n, w) for n, w in against if w not in HEADER_NAMES]
    return classes, words, against


class Page:
    """A page's block elements (parent, path, factor) and its blocks of text (element, text, characters in links).

    A path is a number: a 64-bit hash of its labels, each of a tag and its classes, from the top; 0 is the page itself. An element whose
    names speak against it (an inline one, too) is numbered like a block and judged once the page is read.
    """

    def __init__(self, html: str):
        self.parent, self.path, self.factor = [-1], [0], [0.5]
        self.label, self.depth = [""], [0]
        # how many elements of each tag are open, and where the open blocks stand among them
        self.opened: Counter[str] = Counter()
        self.open_blocks: list[int] = []
        # elements of one path are one text in parts
        self.summed = [False]
        # names against an element; main and article elements
        self.against: dict[int, list[tuple[str, str]]] = {}
        self.wholes: list[tuple[int, str]] = []
        # of each block: its element and its pieces (element, text, in a link)
        self.read: list[tuple[int, list[tuple[int, str, bool]]]] = []
        self.text: list[tuple[int, str, bool]] = []
        # of each open element: tag, its number, its block element's number, dropped, in a link
        self.open: list[tuple[str, int, int, bool, bool]] = [("", 0, 0, False, False)]
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self.data(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            else:
                self.start(tag, m[3])
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    at = close.start() if close else len(html)
        if at < len(html):
            self.data(html[at:])
        self.flush()
        self.judge()

    def data(self, text: str) -> None:
        _, number, _, dropped, link = self.open[-1]
        if not dropped:
            self.text.append((number, unescape(text) if "&" in text else text, link))

    def flush(self) -> None:
        if self.text:
            self.read.append((self.open[-1][2], self.text))
            self.text = []

    def close_to(self, k: int) -> None:
        self.flush()
        self.shorten(k)

    def shorten(self, k: int) -> None:
        for tag, *_ in self.open[k:]:
            self.opened[tag] -= 1
        del self.open[k:]
        while self.open_blocks and self.open_blocks[-1] >= k:
            self.open_blocks.pop()

    def start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
            if tag in CLOSES and any(self.opened[t] for t in CLOSES[tag][0]):
                closed, within = CLOSES[tag]
                for k in range(len(self.open) - 1, 0, -1):
                    if self.open[k][0] in within:
                        break
                    if self.open[k][0] in closed:
                        self.close_to(k)
                        if tag != "tr":
                            break
            if self.open_blocks and self.open[self.open_blocks[-1]][0] == "p":  # a block ends an open paragraph
                self.close_to(self.open_blocks[-1])
        if tag in VOID:
            if tag == "br":
                self.data(" ")
            return
        _, number, within, dropped, link = self.open[-1]
        classes, words, against = names(attributes) if attributes else ([], set(), ())
        if tag in DROPPED_TAGS or tag in RAW:
            dropped = True
        elif tag == "form":
            against = [*against, (f"<form> {len(self.parent)}", "<form>")]  # each form is judged alone
        whole = tag == "main" or tag == "article" and not against
        if tag in NEVER_DROPPED:
            against = ()
        if not dropped and (block or against):
            above = self.path[number]
            self.parent.append(number)
            number = len(self.parent) - 1
            if whole:
                self.wholes.append((number, tag))
            if against:
                self.against[number] = against
            factor = {"article": 1.6, "main": 1.4, "body": 0.8, "html": 0.7}.get(tag, 1.0)
            self.factor.append(factor + (0.3 if words & CONTENT_WORDS else 0) if tag in CONTAINERS else 0)
            self.summed.append(tag in ("article", "main"))
            label = "" if tag in ("html", "body") or not block else ".".join([tag, *classes])
            self.label.append(label)
            self.depth.append(self.depth[self.parent[-1]] + bool(label))
            self.path.append(xxhash.xxh64_intdigest(label, above & (1 << 64) - 1) - (1 << 63) if label else above)
            within = number if block else within
        if block:
            self.open_blocks.append(len(self.open))
        self.opened[tag] += 1
        self.open.append((tag, number, within, dropped, link or tag == "a"))

    def end(self, tag: str) -> None:
        if not self.opened[tag]:
            return
        block = tag in BLOCK
        least = self.open_blocks[-1] if self.open_blocks and not block else 0
        for k in range(len(self.open) - 1, least, -1):
            if self.open[k][0] == tag:
                if block:
                    self.close_to(k)
                else:
                    self.shorten(k)
                return

    def with_ancestors(self, elements) -> set[int]:
        found: set[int] = set()
        for k in elements:
            while k >= 0 and k not in found:
                found.add(k)
                k = self.parent[k]
        return found

    def unwanted(self, path: int | None, furniture: frozenset[int] = frozenset()) -> set[int]:
        """The elements to drop: those of furniture, and those that a name speaks against, if neither they nor those of that name hold most of the page's text.

        What holds main, the largest article or elements with the path (if the name stands in it) stays.
        """
        weight = [0] * len(self.parent)
        for _, pieces in self.read:
            for number, text, link in pieces:
                if not link:
                    weight[number] += len(text.strip())
        for k in range(len(weight) - 1, 0, -1):
            weight[self.parent[k]] += weight[k]
        articles = sorted((k for k, tag in self.wholes if tag == "article" and weight[k] >= ARTICLE_SHARE * weight[0]), key=lambda k: (-weight[k], k))[:1]
        safe = self.with_ancestors(k for k in [*articles, *(k for k, tag in self.wholes if tag == "main")] if weight[k])
        holders = [k for k, p in enumerate(self.path) if path and p == path]
        holding = self.with_ancestors(holders)
        classes = {c for k in self.with_ancestors(holders[:1]) for c in self.label[k].split(".")}
        share: dict[str, int] = {}
        borne: list[frozenset] = [frozenset()]
        for k in range(1, len(weight)):  # within an element of the same name its text counts once
            borne.append(borne[self.parent[k]])
            for name in {n for n, _ in self.against.get(k, ())} - borne[k]:
                share[name] = share.get(name, 0) + weight[k]
                if not name.startswith("<form>"):
                    borne[k] |= {name}
        trusted = {n for n, w in share.items() if w > (WHOLE_SHARE if n in DROPPED_WORDS or n in HEADER_NAMES else PART_SHARE) * weight[0]}
        out: set[int] = set()
        for k, against in self.against.items():
            cleared = {w for n, w in against if n in trusted}
            if k not in safe and any(w not in cleared for _, w in against) and not (k in holding and any(n in classes for n, _ in against)):
                out.add(k)
        if furniture:
            held = Counter()
            for k, p in enumerate(self.path):
                if p in furniture and not p == self.path[max(self.parent[k], 0)]:
                    held[p] += weight[k]
            out |= {k for k, p in enumerate(self.path) if p in furniture and k not in safe and held[p] <= FURNITURE_PART * weight[0]}
        return out

    def judge(self, path: int | None = None, furniture: frozenset[int] = frozenset()) -> None:
        """Makes the blocks, without the dropped elements' text."""
        out = self.unwanted(path, furniture) if self.against or furniture else set()
        dropped = [False] * len(self.parent)
        for k in range(1, len(dropped)) if out else ():
            dropped[k] = k in out or dropped[self.parent[k]]
        running = [k for _, pieces in self.read for k, text, link in pieces if not link and text.strip()] if out else []
        if running and all(dropped[k] for k in running):
            out = set()
        self.blocks = []
        for number, pieces in self.read:
            pieces = [x for x in pieces if not dropped[x[0]]] if out else pieces
            if text := " ".join("".join([t for _, t, _ in pieces]).split()):
                self.blocks.append((number, text, sum(len(t.strip()) for _, t, link in pieces if link)))

    def scores(self) -> list[int]:
        """A score for each element: the text in it outside links, times what its tag and names promise."""
        weight = [0.0] * len(self.parent)
        for number, text, linked in self.blocks:
            weight[number] += max(0, len(text) - 2 * linked)
        for k in range(len(weight) - 1, 0, -1):
            weight[self.parent[k]] += weight[k]
        return [int(100 * w * f) for w, f in zip(weight, self.factor)]

    def votes(self) -> list[tuple[int, int, int]]:
        """The best paths with their scores and depths, of equal ones the shallower.

        Of elements with one path the best counts (of articles their sum), so that a page's parts don't beat what holds them all; where
        each is a single block, the path is one of paragraphs and no container. The page itself, html and body share a path.
        """
        held = [0] * len(self.parent)
        for number, _, _ in self.blocks:
            held[number] += 1
        for k in range(len(held) - 1, 0, -1):
            held[self.parent[k]] += held[k]
        found: dict[int, int] = {}
        times: Counter[int] = Counter()
        most: dict[int, int] = {}
        depth: dict[int, int] = {}
        for path, score, summed, n, deep in zip(self.path, self.scores(), self.summed, held, self.depth):
            if score:
                found[path] = found.get(path, 0) + score if summed else max(found.get(path, 0), score)
                times[path] += 1
                most[path] = max(most.get(path, 0), n)
                depth[path] = deep
        containers = [(p, s, depth[p]) for p, s in found.items() if not p or times[p] == 1 or most[p] > 1]
        return sorted(containers, key=lambda x: (-x[1], x[2], x[0]))[:VOTES]

    def texts_of_paths(self) -> dict[int, int]:
        """A hash of the whole text in the elements of each path that can be furniture (0: the page's)."""
        own: dict[int, list[str]] = {}
        for number, text, _ in self.blocks:
            own.setdefault(number, []).append(text)
        whole = [xxhash.xxh64_intdigest("\n".join(own.get(k, ()))) for k in range(len(self.parent))]
        some = [k in own for k in range(len(self.parent))]
        for k in range(len(whole) - 1, 0, -1):
            if some[k]:
                some[self.parent[k]] = True
                whole[self.parent[k]] = (whole[self.parent[k]] * 31 + whole[k]) & (1 << 64) - 1
        found: dict[int, int] = {}
        for k, path in enumerate(self.path):
            if some[k] and (not k or self.label[k].partition(".")[0] in REPEATED):
                found[path] = (found.get(path, 0) * 31 + whole[k]) & (1 << 64) - 1
        return {path: value - (1 << 63) for path, value in found.items()}

    def extract(self, path: int | None, furniture: frozenset[int] = frozenset()) -> str:
        """The blocks in elements with the path, in page order and without furniture; without such text, those of the page's own best path."""
        if furniture or path is not None and self.against:
            self.judge(path, furniture)
        own = self.votes()
        for wanted in (path, own[0][0] if own else None):
            if wanted is None:
                continue
            inside = [False] * len(self.parent)
            for k, p in enumerate(self.path):
                inside[k] = p == wanted or (k > 0 and inside[self.parent[k]])
            if texts := [text for number, text, _ in self.blocks if inside[number]]:
                return " ".join(texts)
        return " ".join(text for _, text, _ in self.blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


SEEN = "key struct<page:long,host:long>, host string, path long, score long, depth int, text long, whole long"


def page_rows(pages: DataFrame) -> DataFrame:
    """What each page (columns key, host, html) says of its paths, as rows of numbers: its votes (score and depth), and of each path with text a hash of that text and of the whole page's."""

    def look(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for key, host, html in zip(b.column(0), b.column(1), b.column(2)):
                page = Page(html.as_py() or "")
                votes = {path: (score, depth) for path, score, depth in page.votes()}
                texts = page.texts_of_paths()
                whole, key, host = texts.get(0, 0), key.as_py(), host.as_py()
                rows += [(key, host, path, *votes.get(path, (None, None)), texts.get(path), whole) for path in {**texts, **votes, 0: 0}]
            types = [pa.struct([("page", pa.int64()), ("host", pa.int64())]), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "host", "path", "score", "depth", "text", "whole"])

    return materialize(pages.select("key", "host", "html").mapInArrow(look, SEEN), "page-paths")


def host_paths(seen: DataFrame) -> DataFrame:
    """host, path and score of the path that won on each host: the sum of its pages' votes, of equal ones the shallower."""
    summed = seen.where("score is not null").groupBy("host", "path").agg(F.sum(F.col("score").cast("decimal(38,0)")).alias("score"), F.min("depth").alias("depth"))
    return summed.groupBy("host").agg(F.max(F.struct("score", -F.col("depth"), "path"))["path"].alias("path"))


def host_furniture(seen: DataFrame) -> DataFrame:
    """host and path of furniture: over FURNITURE_SHARE of a host's different pages (FURNITURE_PAGES at least) with the path have the same text in it. Copies of a page count once."""
    each = seen.where("text is not null and path <> 0").select("host", "path", "text", "whole").distinct()
    counted = each.groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    told = counted.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.max("n").alias("same"))
    return told.where((F.col("pages") >= FURNITURE_PAGES) & (F.col("same") > FURNITURE_SHARE * F.col("pages"))).select("host", "path")


def decisions(seen: DataFrame) -> DataFrame:
    """key, path and furniture of the pages that their host judges otherwise than they would alone: another path won, or a path of theirs is furniture."""
    rank = F.struct(F.coalesce("score", F.lit(-1)), -F.coalesce("depth", F.lit(0)), -F.col("path").cast("decimal(38,0)"))
    best = seen.groupBy("key", "host").agg(F.max_by("path", rank).alias("own"))
    other = best.join(host_paths(seen), "host").where(F.col("own") != F.col("path")).select("key", "path")
    common = materialize(host_furniture(seen), "furniture")
    theirs = seen.select("key", "host", "path").join(common, ["host", "path"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("path")).alias("furniture"))
    named = theirs.select("key", "furniture").join(best, "key").join(host_paths(seen), "host").select("key", "path", "furniture")
    return materialize(named.unionByName(other.join(theirs, "key", "left_anti").withColumn("furniture", F.array().cast("array<bigint>"))), "decisions")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row, from the whole html.

    Null html gives an empty text; a null url shares the host "". Repeated rows stay; an empty table gives an empty table; other
    columns are not looked at.
    """
    taken = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    taken = taken.withColumn("key", F.struct(F.xxhash64(F.coalesce("html", F.lit(""))).alias("page"), F.xxhash64("host").alias("host")))
    decided = decisions(page_rows(taken))
    some, alone = parted(taken, F.col("key"), decided, F.col("key"))
    joined = some.join(decided, "key", "left").select("page_id", "url", "html", "path", "furniture")
    nothing = [F.lit(None).cast("bigint").alias("path"), F.lit(None).cast("array<bigint>").alias("furniture")]

    def texts(batches):
        import pyarrow as pa

        for b in batches:
            found = [Page(html.as_py() or "").extract(path.as_py(), frozenset(furniture.as_py() or ())) for html, path, furniture in zip(b.column(2), b.column(3), b.column(4))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = joined.unionByName(alone.select("page_id", "url", "html", *nothing))
    return rows.mapInArrow(texts, f"page_id {taken.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
