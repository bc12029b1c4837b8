"""Source divergence audit: how the word use of the sources of a language differs, and which words mark a source.

Two passes of DuckDB over shards. The first counts terms where texts are read and again where Spark has gathered the partial
counts by language and term; the second takes the kept terms of a shard, turns counts into smoothed frequencies and sums the
differences of the sources that share a term. Spark merges the shards' sums and ranks. Rows come sorted by term, so a shard is
worked on in chunks of whole terms and its memory does not grow with it.

Of a pair of sources only the terms that both have are met one by one. A source without a term has the same floor frequency for
each such term, so the other terms follow from each source's histogram of frequencies, by running sums over its sorted values.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize

#: Frequencies are in parts of this; smoothing adds PRIOR to each count.
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of text that are counted at once where texts are read; rows of a shard that are worked on at once.
TEXT_BYTES, CHUNK_ROWS = 8 << 20, 1 << 17

#: Letters stay, A-Z in lower case, as do all bytes of non-ASCII characters; anything else parts terms.
LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def connection():
    import duckdb

    return duckdb.connect(config={"threads": 1})


def found(con, sql: str, names: dict[str, str]):
    """The result as record batches of the given columns and Arrow types."""
    import pyarrow as pa

    table = con.sql(sql).to_arrow_table()
    schema = pa.schema([(name, pa.type_for_alias(kind)) for name, kind in names.items()])
    return table.select(schema.names).cast(schema).to_batches()


def text_parts(batches) -> Iterator[tuple[list, list, list[bytes]]]:
    """Languages, sources and texts, about TEXT_BYTES at a time. A text beyond that comes alone."""
    import pyarrow as pa

    rows, size = ([], [], []), 0
    for b in batches:
        langs, sources = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, b.column(2).cast(pa.binary())):
            t = text.as_py().translate(LETTERS)
            if size and size + len(t) > TEXT_BYTES:
                yield rows
                rows, size = ([], [], []), 0
            for column, value in zip(rows, (lang, source, t)):
                column.append(value)
            size += len(t)
    if rows[0]:
        yield rows


def cut(text: bytes, most: int) -> Iterator[bytes]:
    """The text in parts of about most bytes, cut between terms."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


PARTIAL = {"lang": "string", "source": "string", "term": "string", "n": "int64", "docs": "int64"}


def partial_counts(batches):
    """Occurrences and documents of each term, language and source of a task's texts, by parts of it."""
    import pyarrow as pa

    con = connection()
    for langs, sources, texts in text_parts(batches):
        if len(texts) == 1 and len(texts[0]) > TEXT_BYTES:  # its documents are one, however many parts it is counted in
            con.execute("CREATE OR REPLACE TABLE long (term VARCHAR, n BIGINT)")
            for part in cut(texts[0], TEXT_BYTES):
                con.register("part", pa.table({"text": pa.array([part]).cast(pa.string())}))
                con.execute("INSERT INTO long SELECT term, count(*) FROM (SELECT unnest(string_split(text, ' ')) AS term FROM part) WHERE term <> '' GROUP BY term")
            con.register("of", pa.table({"lang": langs, "source": sources}))
            sql = "SELECT lang, source, term, n, 1 AS docs FROM (SELECT term, sum(n) AS n FROM long GROUP BY term), of"
        else:
            con.register("texts", pa.table({"r": range(len(texts)), "lang": langs, "source": sources, "text": pa.array(texts, pa.binary()).cast(pa.string())}))
            sql = """
                WITH words AS (SELECT r, lang, source, unnest(string_split(text, ' ')) AS term FROM texts),
                by_text AS (SELECT r, lang, source, term, count(*) AS n FROM words WHERE term <> '' GROUP BY ALL)
                SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM by_text GROUP BY ALL"""
        yield from found(con, sql, PARTIAL)
    con.close()


def whole_terms(batches, con, squeezed: str) -> Iterator[None]:
    """Registers as `chunk` the rows of whole terms, again and again. batches are sorted by (lang, term). squeezed: a query over `chunk` that makes a part of one term's rows fewer, so that a term of any size fits."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, n = [], 0

    def joined():
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        held.append(b)
        n += len(b)
        if n < CHUNK_ROWS:
            continue
        rows = joined()
        of_last = pc.and_(pc.equal(rows["lang"], rows["lang"][-1]), pc.equal(rows["term"], rows["term"][-1]))
        whole = rows.filter(pc.invert(of_last))
        rest = rows.filter(of_last)
        if len(whole):
            con.register("chunk", whole)
            yield
        if len(rest) >= CHUNK_ROWS:
            con.register("chunk", rest)
            rest = con.sql(squeezed).to_arrow_table().select(rest.schema.names).cast(rest.schema)
        held, n = rest.to_batches(), 0  # so that at least CHUNK_ROWS new rows come before the next chunk
    if held and sum(map(len, held)):
        con.register("chunk", joined())
        yield


COUNTED = {"lang": "string", "term": "string", "source": "string", "n": "int64", "lang_n": "int64", "first": "int64"}


def shard_counts(min_docs: int):
    """Of a shard's partial counts: each kept term's count by source and in all, and a mark on one of a term's rows."""

    def run(batches):
        con = connection()
        squeezed = "SELECT lang, source, term, sum(n) AS n, sum(docs) AS docs FROM chunk GROUP BY ALL"
        for _ in whole_terms(batches, con, squeezed):
            sql = f"""
                WITH g AS ({squeezed}),
                t AS (SELECT lang, term, sum(n) AS lang_n, min(source) AS least FROM g GROUP BY ALL HAVING sum(docs) >= {min_docs})
                SELECT lang, term, source, n, lang_n, (source = least)::INT AS first FROM g JOIN t USING (lang, term)"""
            yield from found(con, sql, COUNTED)
        con.close()

    return run


SUMMED = {"part": "string", "lang": "string", "source": "string", "item": "string", "value": "int64", "k": "int64"}


def shard_sums(top: int):
    """Of a shard's kept counts with the groups' sizes: differences summed over shared terms (pair), how often each frequency stands (histogram), and each group's first terms (term)."""

    def run(batches):
        con = connection()
        con.execute("CREATE TABLE pairs (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")
        con.execute("CREATE TABLE histogram (lang VARCHAR, source VARCHAR, p BIGINT, k BIGINT)")
        con.execute("CREATE TABLE firsts (lang VARCHAR, source VARCHAR, item VARCHAR, value BIGINT)")
        sums = "SELECT lang, source, item, sum(value)::BIGINT AS value FROM pairs GROUP BY ALL"
        kinds = "SELECT lang, source, p, sum(k)::BIGINT AS k FROM histogram GROUP BY ALL"
        first = f"SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}"
        p = f"(1 + {SCALE}::HUGEINT * (%s + {PRIOR}) // (%s + {PRIOR}::HUGEINT * v))::BIGINT"
        for _ in whole_terms(batches, con, "SELECT * FROM chunk"):
            con.execute(f"CREATE OR REPLACE TEMP TABLE r AS SELECT lang, term, source, {p % ('n', 'total')} AS p, {p % ('0', 'total')} AS p0, {p % ('lang_n', 'lang_total')} AS q FROM chunk")
            con.execute("""
                INSERT INTO pairs SELECT a.lang, a.source, b.source, sum(abs(a.p - b.p) - abs(a.p - b.p0) - abs(a.p0 - b.p) + abs(a.p0 - b.p0))
                FROM r AS a JOIN r AS b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""")
            con.execute("INSERT INTO histogram SELECT lang, source, p, count(*) FROM r GROUP BY ALL")
            con.execute("INSERT INTO firsts SELECT lang, source, term, p - q FROM r WHERE p > q")
            for name, sql in (("pairs", sums), ("histogram", kinds), ("firsts", first)):
                con.execute(f"CREATE OR REPLACE TABLE {name} AS {sql}")
        yield from found(con, "SELECT 'pair' AS part, *, 0 AS k FROM pairs", SUMMED)
        yield from found(con, "SELECT 'histogram' AS part, lang, source, '' AS item, p AS value, k FROM histogram", SUMMED)
        yield from found(con, "SELECT 'term' AS part, *, 0 AS k FROM firsts", SUMMED)
        con.close()

    return run


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {'long' if kind == 'int64' else kind}" for name, kind in columns.items())


def by_term(df: DataFrame) -> DataFrame:
    """The shards: rows by a hash of language and term, each shard sorted by them."""
    return df.repartition("lang", "term").sortWithinPartitions("lang", "term")


def audit(docs: DataFrame, min_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value and rank: of each group of a language and a source its distance to each other source of the language (part pair) and the terms it uses more than the language does (part term, up to rank top).

    A term is a run of letters and non-ASCII characters, A-Z in lower case; terms in fewer than min_docs rows of a language are
    left out. Null texts, languages and sources count as empty ones; a group without terms has its pairs (all 0 in a language
    without kept terms). Equal values rank by item in the order of UTF-8 bytes. Each row counts, repeated ones too. An empty
    table gives no rows. Other columns are not looked at.
    """
    column = lambda name, at: F.coalesce(F.col(f"`{at}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(column("lang", lang_col), column("source", source_col), column("text", text_col))
    counts = materialize(by_term(rows.mapInArrow(partial_counts, ddl(PARTIAL))).mapInArrow(shard_counts(min_docs), ddl(COUNTED)), "counts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("first").alias("v"), F.sum("n").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialize(groups.na.fill(0, ["total", "v", "lang_total"]), "groups")
    sums = materialize(by_term(counts.join(groups, ["lang", "source"])).mapInArrow(shard_sums(top), ddl(SUMMED)), "sums")
    return pair_ranks(groups, sums).unionByName(term_ranks(sums, top))


def ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def term_ranks(sums: DataFrame, top: int) -> DataFrame:
    """A group's first terms are among the first of its shards."""
    rows = sums.where("part = 'term'").select("lang", "source", "part", "item", "value")
    return ranked(rows).where(F.col("rank") <= top)


def floor_frequency() -> Column:
    """What a group gives a term that it doesn't have; 0 in a language without terms, where nothing is summed."""
    return F.expr(f"CASE WHEN v = 0 THEN 0L ELSE 1 + {SCALE * PRIOR}L div (total + {PRIOR}L * v) END")


def pair_ranks(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """Distances of all groups of a language: what the shards summed over shared terms, and the rest from histograms.

    With floors x and y of the two, a term of the first alone adds |p - y| and a term of neither |x - y|.
    """
    g = groups.select("lang", "source", "v", floor_frequency().alias("floor"))
    others = g.join(g.select("lang", F.col("source").alias("item"), F.col("floor").alias("other")), "lang").where("source <> item")
    # sum of |p - other| over a group's terms, for each other group: running sums over the sorted values of both
    histogram = sums.where("part = 'histogram'").groupBy("lang", "source", F.col("value").alias("at")).agg(F.sum("k").alias("k"))
    line = histogram.withColumn("item", F.lit(None).cast("string")).unionByName(others.select("lang", "source", F.col("other").alias("at"), F.lit(0).cast("long").alias("k"), "item"))
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("at", F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("k") * F.col("at")
    lines = line.select("lang", "source", "item", "at", F.sum("k").over(upto).alias("below"), F.sum(mass).over(upto).alias("below_mass"), F.sum("k").over(group).alias("all"), F.sum(mass).over(group).alias("all_mass"))
    spread = lines.where("item IS NOT NULL").select("lang", "source", "item", "all", (F.col("at") * (2 * F.col("below") - F.col("all")) + F.col("all_mass") - 2 * F.col("below_mass")).alias("spread"))
    own = others.join(spread, ["lang", "source", "item"])
    gap = F.abs(F.col("floor") - F.col("other"))
    own = own.select("lang", "source", "item", (F.col("spread") - F.col("all") * gap).alias("part_value"), (F.col("v") * gap).alias("ground"))
    shared = sums.where("part = 'pair'").select("lang", "source", "item", F.col("value").alias("part_value"), F.lit(0).cast("long").alias("ground"))
    turned = lambda df, ground: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "part_value", ground.alias("ground"))
    each = own.unionByName(turned(own, F.lit(0).cast("long"))).unionByName(shared).unionByName(turned(shared, F.col("ground")))
    total = each.groupBy("lang", "source", "item").agg((F.sum("part_value") + F.sum("ground")).alias("value"))
    return ranked(total.select("lang", "source", F.lit("pair").alias("part"), "item", "value"))
