"""Retrieval: exact and range lookup, lexical and vector ranking, reciprocal rank fusion, folding of duplicates, boosts, facets, suggestions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.loading import spread

#: Parameters of the lexical score, and the rank offset of the fusion.
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
#: Buckets of terms in a stored index; a search reads only those of its terms.
BUCKETS = 64
#: Bytes of text for each part of a bucket: a part holds about as many bytes of postings.
PART_BYTES = 4 << 20


def tokens(text: Column) -> Column:
    """Lower-case tokens of ASCII letters, digits and dots."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9.]+", -1), "")


def exact(df: DataFrame, key_col: str, key: str) -> DataFrame:
    return df.where(F.lower(key_col) == key.lower())


def lexical_range(tables: list[DataFrame], key_col: str, start: str, end: str, limit: int) -> DataFrame:
    """Rows of all tables whose key lies between start and end, each once, in order. Bounds reach the scans as filters."""
    found = reduce(DataFrame.unionByName, [t.select(key_col).where(F.col(key_col).between(start, end + "~")) for t in tables])
    return found.distinct().orderBy(key_col).limit(limit)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def file_state(df: DataFrame) -> tuple:
    """Path, size and time of change of each file of a table: what an index built from it is good for."""
    spark = df.sparkSession
    conf = spark._jsc.hadoopConfiguration()
    found = []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)


def counted(words, slice_words: int = 1 << 20):
    """For an Arrow array of lists of words, in slices of about slice_words words (a longer list stands alone): the first row, the slice's
    different words, and for each row and word of it the row's place in the slice, the word's number and its frequency."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(words):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + slice_words, side="right")))
        part = words.slice(at, upto - at)
        coded = pc.list_flatten(part).dictionary_encode()
        many = max(1, len(coded.dictionary))
        pairs, tf = np.unique(pc.list_parent_indices(part).to_numpy().astype(np.int64) * many + coded.indices.to_numpy(), return_counts=True)
        yield at, coded.dictionary, pairs // many, pairs % many, tf
        at = upto


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Stores a full-text index: postings (term, id, tf, length) in buckets of terms, ordered by term, and one row of facts (n, mean). ids are unique; null texts have no words but count.

    A text's words are counted where it is read, so that only postings are shuffled, once; a bucket has as many parts as the texts' size asks for.
    """
    spark = docs.sparkSession
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.col(text_col))).alias("bytes")).first()
    parts = 1 + (size["bytes"] or 0) // (BUCKETS * PART_BYTES)
    words = spread(docs).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words"))

    def postings(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lengths = pc.list_value_length(b.column(1)).cast(pa.int32())
            for at, terms, row, term, tf in counted(b.column(1)):
                rows = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), lengths.take(rows), terms.take(pa.array(term)), pa.array(tf.astype(np.int32))], names=["id", "length", "term", "tf"])

    found = words.mapInArrow(postings, f"id {words.schema['id'].dataType.simpleString()}, length int, term string, tf int")
    placed = found.withColumn("bucket", bucket(F.col("term"))).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    placed.repartition(BUCKETS * parts, "bucket", "part").drop("part").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = spark.read.schema(placed.drop("part").schema).parquet(f"{path}/postings")
    stored.agg(F.sum("tf").alias("words")).select(F.lit(size["n"]).alias("n"), (F.coalesce("words", F.lit(0)) / F.lit(size["n"])).alias("mean")).write.parquet(f"{path}/facts")


def bm25(spark: SparkSession, path: str, terms: list[str], conjunctive: bool = False) -> DataFrame:
    """id and score of texts of a stored index with any (or all) of the terms. Only the terms' postings are read, and only matching rows shuffled."""
    wanted = sorted(set(terms))
    buckets = [r[0] for r in spark.createDataFrame([(t,) for t in wanted], "term string").select(bucket(F.col("term"))).collect()]
    hits = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))
    facts = spark.read.parquet(f"{path}/facts").first()
    n, mean = facts["n"], facts["mean"] or 1.0
    df = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count("*").alias("df")).collect()}
    idf = F.create_map(*[F.lit(x) for t in wanted for x in (t, math.log(1 + (n - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)))])
    tf = F.col("tf")
    part = idf[F.col("term")] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.lit(mean)))
    scored = hits.select("id", part.alias("part")).groupBy("id").agg(F.sum("part").alias("score"), F.count("*").alias("terms"))
    return (scored.where(F.col("terms") == len(wanted)) if conjunctive else scored).select("id", "score")


def cosine(vector: Column, query: Column) -> Column:
    """Cosine of two arrays of one length; 0 where one of them is zero."""
    dot = F.aggregate(F.zip_with(vector, query, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda x, y: x + y)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda x, y: x + y.cast("double") * y.cast("double")))
    return F.when((size(vector) == 0) | (size(query) == 0), 0.0).otherwise(dot / (size(vector) * size(query)))


def vector_search(df: DataFrame, id_col: str, vector_col: str, query: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """id and similarity of the k most similar vectors, filters before ranking. query: one row with a column `query`, which is broadcast."""
    rows = df if where is None else df.where(where)
    scored = rows.crossJoin(F.broadcast(query.limit(1))).select(F.col(id_col).alias("id"), cosine(F.col(vector_col), F.col("query")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "id").limit(k)


def top_ranks(scored: DataFrame, score_col: str, k: int, rank_col: str) -> DataFrame:
    """The k best rows and their ranks. Only those k rows meet in one task."""
    best = scored.orderBy(F.desc(score_col), "id").limit(k)
    return best.withColumn(rank_col, F.row_number().over(Window.orderBy(F.desc(score_col), "id")))


def reciprocal_rank_fusion(lexical: DataFrame, vectors: DataFrame, k: int, window: int = 100) -> DataFrame:
    """id, lexical_rank, vector_rank and score: the sum of 1 / (60 + rank) over the two lists' first `window` rows."""
    a = top_ranks(lexical, "score", window, "lexical_rank").select("id", "lexical_rank")
    b = top_ranks(vectors.withColumnRenamed("similarity", "score"), "score", window, "vector_rank").select("id", "vector_rank")
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = a.join(b, "id", "full_outer").withColumn("score", part("lexical_rank") + part("vector_rank"))
    return fused.orderBy(F.desc("score"), "id").limit(k)


def rank_score(weight: float, rank: Column) -> Column:
    return weight / F.sqrt(rank)


def fold_duplicates(rows: DataFrame, key_col: str = "key") -> DataFrame:
    """One row a key: rows in the order of `arm`, each further one merged as max + 0.35 * max(min, 0) + 0.05; kind of the highest priority.

    rows: key, arm (order of the search arm), kind, priority, score.
    """
    grouped = rows.groupBy(key_col).agg(F.array_sort(F.collect_list(F.struct("arm", F.col("score").cast("double").alias("score"), "kind", "priority"))).alias("hits"))
    first = F.get("hits", F.lit(0))["score"]
    merged = F.aggregate(F.slice("hits", 2, F.size("hits")), first, lambda acc, h: F.greatest(acc, h["score"]) + 0.35 * F.greatest(F.least(acc, h["score"]), F.lit(0.0)) + 0.05)
    best = F.array_max(F.transform("hits", lambda h: F.struct(h["priority"].alias("priority"), h["score"].alias("score"), h["kind"].alias("kind"))))["kind"]
    return grouped.select(key_col, F.size("hits").cast("long").alias("arms"), merged.alias("score"), best.alias("kind"))


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value and n of each column, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("p")).groupBy(F.col("p.facet").alias("facet"), F.col("p.value").alias("value")).agg(F.count("*").alias("n"))


def suggest(sources: list[tuple[DataFrame, str, str]], prefix: str, limit: int) -> DataFrame:
    """label, kind and score: labels that begin with (2) or hold (1) the prefix; of equal ones the best. sources: (table, column, kind)."""
    p = prefix.lower()
    found = []
    for df, column, kind in sources:
        low = F.lower(column)
        found.append(df.where(F.contains(low, F.lit(p))).select(F.col(column).alias("label"), F.lit(kind).alias("kind"), F.when(low.startswith(p), 2.0).otherwise(1.0).alias("score")))
    return reduce(DataFrame.unionByName, found).groupBy("label", "kind").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "label", "kind").limit(limit)


def expand_terms(query: str, sources: list[tuple[DataFrame, str, float]], limit: int) -> DataFrame:
    """Terms that hold the query or are held by it, with their best weight."""
    q = query.lower()
    found = [df.select(F.lower(c).alias("term"), F.lit(w).alias("weight")).where(F.contains("term", F.lit(q)) | F.contains(F.lit(q), F.col("term"))) for df, c, w in sources]
    return reduce(DataFrame.unionByName, found).groupBy("term").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "term").limit(limit)


def rerank(candidates: DataFrame, relevance: DataFrame, head: int) -> DataFrame:
    """Exact hits first, then the first `head` others by given relevance, then the rest by score. candidates: id, score, exact."""
    order = Window.orderBy(F.desc("score"), "id")
    ranked = candidates.where(~F.col("exact")).orderBy(F.desc("score"), "id").limit(head).withColumn("position", F.row_number().over(order)).join(relevance, "id", "left")
    chosen = ranked.select("id", (10 + 10 * F.coalesce("relevance", F.lit(0.0))).alias("reranked"))
    joined = candidates.join(F.broadcast(chosen), "id", "left")
    bucket = F.when(F.col("exact"), 0).when(F.col("reranked").isNotNull(), 1).otherwise(2)
    return joined.select("id", F.when(F.col("exact"), F.greatest("score", F.lit(100.0))).otherwise(F.coalesce("reranked", "score")).alias("score"), bucket.alias("bucket"))


def candidate_window(limit: int, offset: int = 0, rerank: int | None = None, most: int = 250) -> tuple[int, int]:
    """How many candidates to keep, and how many to take before graph features are added."""
    asked = min(limit + offset, most)
    kept = min(max(limit * 4 if rerank is None else rerank, asked), most)
    return kept, max(min(2 * kept, most), asked)


def legal_boosts(rows: DataFrame, history: bool = False) -> DataFrame:
    """rows with `boost`: what exactness, sources, status, hierarchy, kind, links and warnings add to a score.

    rows: exact, source_backed, primary_law, commentary (booleans), status, kind, weight (of the authority), citations, links, warnings (numbers).
    """
    yes = lambda c, v: F.when(F.col(c), v).otherwise(0.0)
    links = lambda c, v: v * F.greatest(F.log10(F.col(c).cast("double")), F.lit(0.0))
    old = F.lower(F.coalesce("status", F.lit(""))).isin("repealed", "renumbered", "stale")
    parts = [
        yes("exact", 50.0), yes("source_backed", 1.0), F.when(F.col("status") == "active", 0.5).otherwise(0.0), F.coalesce(F.col("weight"), F.lit(0.0)),
        F.when(F.col("primary_law"), 0.35).when(F.col("commentary"), -0.1).otherwise(0.0), F.when(F.col("kind") == "provision", 0.35).when(F.col("kind") == "chunk", -0.2).otherwise(0.0),
        F.coalesce(links("citations", 0.2), F.lit(0.0)), F.coalesce(links("links", 0.25), F.lit(0.0)), -0.5 * F.coalesce(F.col("warnings"), F.lit(0)), F.when(old & ~F.lit(history), -2.0).otherwise(0.0),
    ]
    return rows.withColumn("boost", reduce(lambda a, b: a + b, parts))


def expansion_boost(text: Column, terms: list[str]) -> Column:
    """0.2 for each expanded term that a text holds, at most 0.8."""
    low = F.lower(text)
    return F.least(F.lit(0.2) * sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)), F.lit(0.8))


def search_request(spark: SparkSession, path: str, terms: list[str], features: DataFrame, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
    """A page of a search: lexical candidates of a stored index, early filters, boosts from features (id and the columns of legal_boosts), order, page.

    where: a condition on features that a candidate must meet before the window is cut. Only the window meets in one task.
    """
    _, window = candidate_window(limit, offset)
    found = bm25(spark, path, terms)
    if where is not None:
        found = found.join(features.where(where).select("id"), "id", "left_semi")
    ranked = top_ranks(found.orderBy(F.desc("score"), "id").limit(window), "score", window, "rank").withColumn("base", rank_score(2.0, F.col("rank")))
    boosted = legal_boosts(ranked.join(features, "id")).withColumn("total", F.col("base") + F.col("boost"))
    return boosted.select("id", "base", "boost", "total").orderBy(F.desc("total"), "id").offset(offset).limit(limit)
