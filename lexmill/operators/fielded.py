"""Stored full-text indexes over several fields, for many queries at once.

A posting is a term's impact on a row: the sum over fields of weight times saturated, length-normalised frequency. Of each term's
postings the strongest are its head, the others its tail, and the dictionary has the tail's largest impact. So a search reads the
heads of its terms, which gives a score that k rows reach; a row that stands in no head and only in tails of terms whose
largest impacts add up to less cannot be among the first k. Tails of such terms - the frequent, light ones - are only
looked at for rows found otherwise. The result is that of scoring every row.

Heads are taken within salts of a term, and a frequent term's postings are stored in several files, so no term is handled whole.
Postings are read once for all queries and meet them by parts of an index's rows, where each query's scores are summed as an array; no
row is made of a query and a row that it finds but for the first k of each part.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.graph import shared_folder
from lexmill.operators.search import BM25_B, BM25_K1, counted, rank_score, tokens

#: Postings of a term's head, at most, and the salts they are taken from; postings a file is meant to hold.
HEAD, SALTS, FILE_ROWS = 1024, 16, 4_000_000
#: Rows whose words are counted together.
SLICE_ROWS = 1_000
#: Rows of an index that meet its queries in one task, at least and at most, and (query, term) pairs for each of them; pairs of queries that meet them together.
LEAST_PART, MOST_PART, PAIRS_A_ROW, PART_PAIRS = 4_096, 32_768, 8, 4_000_000
#: What each index counts in a merged answer, and the index that a kind of result is looked up in.
INDEX_WEIGHTS = {"statute": 1.05, "provision": 1.15, "definition": 1.1, "semantic": 1.0, "specialized": 0.95, "history": 0.9, "chunk": 0.85}
RESULT_INDEXES = {
    "statute": "statute", "provision": "provision", "definition": "definition", "definedterm": "definition", "semantic": "semantic", "obligation": "semantic", "exception": "semantic", "deadline": "semantic", "penalty": "semantic",
    "notice": "semantic", "requirednotice": "semantic", "remedy": "semantic", "history": "history", "sourcenote": "history", "source_note": "history", "temporaleffect": "history", "temporal_effect": "history", "sessionlaw": "history", "amendment": "history",
    "chunk": "chunk", "actor": "actor", "taxrule": "specialized", "moneyamount": "specialized", "ratelimit": "specialized", "legalaction": "specialized", "legalactor": "specialized",
}
ACTOR_WEIGHT = 0.95
#: Limits of each index in a merged answer.
LEAST_EACH, MOST_EACH = 10, 40
#: The buckets that ids of results are resolved in, by kind; other kinds are looked up in all.
ID_BUCKETS = {
    "identity": ["statute", "court_rule", "legaltextidentity", "utcrrule"],
    "provision": ["provision", "court_rule_provision", "utcrprovision"],
    "chunk": ["chunk", "retrievalchunk"],
    "definition": ["definition", "definedterm"],
    "semantic": ["semantic", "legalsemanticnode", "obligation", "exception", "deadline", "penalty", "remedy", "requirednotice", "notice", "proceduralrequirement", "formtext"],
    "history": ["sourcenote", "source_note", "statusevent", "status_event", "temporaleffect", "temporal_effect", "sessionlaw", "session_law", "amendment", "lineageevent", "lineage_event"],
    "specialized": ["taxrule", "tax_rule", "moneyamount", "money_amount", "ratelimit", "rate_limit", "legalactor", "legal_actor", "legalaction", "legal_action"],
    "chapter": ["chapter", "court_rule_chapter", "chapterversion"],
}


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(docs: DataFrame, path: str, fields: dict[str, float], id_col: str = "id", index_col: str | None = None, head: int = HEAD, salts: int = SALTS, file_rows: int = FILE_ROWS, terms: DataFrame | None = None) -> None:
    """Stores postings (index, term, id, impact, head) by bucket of the term, a dictionary (index, term, df, tail, rest_rows) and facts (index, n, buckets).

    fields: text columns with their weights; index_col: what parts the rows into indexes with frequencies of their own (none: one
    index). ids are unique in an index; null texts have no words but count. Buckets follow from the number of words.
    terms: a table with a column term, for an index that is built for known searches; postings of other terms are not stored. Numbers of rows and lengths are of all
    rows and words in either case, so searches for those terms give the same.
    """
    index = F.coalesce(F.col(index_col).cast("string"), F.lit("")) if index_col else F.lit("")
    words = docs.select(index.alias("index"), F.col(id_col).alias("id"), *[tokens(F.col(f).cast("string")).alias(f"words_{k}") for k, f in enumerate(fields)])
    lengths = [F.size(f"words_{k}") for k in range(len(fields))]
    facts = words.groupBy("index").agg(F.count("*").alias("n"), F.sum(sum(lengths[1:], lengths[0])).alias("words"), *[F.avg(x).alias(f"mean_{k}") for k, x in enumerate(lengths)])
    spark, temporary = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    facts.write.parquet(f"{temporary}/facts")
    facts = spark.read.parquet(f"{temporary}/facts")
    total = facts.agg(F.sum("words")).first()[0] or 0
    buckets = max(1, -(-total // file_rows))
    # words are counted where the row is read, so that only postings are shuffled, once
    means = facts.select("index", F.array(*[F.col(f"mean_{k}") for k in range(len(fields))]).alias("means"))
    weights = [float(w) for w in fields.values()]

    def impacts(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            lists = b.columns[3:]
            mean = pc.list_flatten(b.column(2)).to_numpy(zero_copy_only=False).reshape(len(b), len(weights))
            for at in range(0, len(b), SLICE_ROWS):
                n = min(SLICE_ROWS, len(b) - at)
                found = []
                for k, column in enumerate(lists):
                    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
                    for begin, terms, row, term, tf in counted(column.slice(at, n)):
                        row = row + begin + at
                        m = np.where(mean[row, k] > 0, mean[row, k], 1.0)
                        found.append((terms, row, term, weights[k] * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length[row] / m))))
                words = pa.chunked_array([f[0].take(pa.array(f[2])) for f in found], pa.string()).combine_chunks().dictionary_encode()
                many = max(1, len(words.dictionary))
                pairs, place = np.unique(np.concatenate([f[1] for f in found]) * many + words.indices.to_numpy(), return_inverse=True)
                impact = np.bincount(place, np.concatenate([f[3] for f in found]), len(pairs))
                rows = pa.array(pairs // many)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), words.dictionary.take(pa.array(pairs % many)), pa.array(impact)], names=["index", "id", "term", "impact"])

    told = words.join(means, "index").select("index", "id", "means", *[f"words_{k}" for k in range(len(fields))])
    found = told.mapInArrow(impacts, f"index string, id {told.schema['id'].dataType.simpleString()}, term string, impact double")
    if terms is not None:
        found = found.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").select("index", "id", "term", "impact")
    placed = found.withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("split", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).repartition("bucket", "split")
    place = F.row_number().over(Window.partitionBy("bucket", "split", "index", "term").orderBy(F.desc("impact"), "id"))
    by_bucket = ["bucket"] if total else []  # an empty table needs a file for its columns
    placed = placed.withColumn("head", place <= -(-head // salts)).select("index", "term", "id", "impact", "head", "bucket")
    placed.sortWithinPartitions("bucket", F.desc("head"), "term").write.partitionBy(*by_bucket).parquet(f"{path}/postings")
    postings = spark.read.schema(placed.schema).parquet(f"{path}/postings")
    dictionary = postings.groupBy("index", "term", "bucket").agg(F.count("*").alias("df"), F.coalesce(F.max(F.when(~F.col("head"), F.col("impact"))), F.lit(0.0)).alias("tail"), F.count_if(~F.col("head")).alias("rest_rows"))
    dictionary.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy(*by_bucket).parquet(f"{path}/terms")
    facts.select("index", "n", F.lit(buckets).alias("buckets")).write.parquet(f"{path}/facts")
    folder = spark._jvm.org.apache.hadoop.fs.Path(temporary)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def wanted_terms(spark: SparkSession, path: str, queries: DataFrame, text_col: str, indexes: list[str] | None) -> DataFrame:
    """query, index, bucket, term, idf, rest (the most that the term's tail adds), df and rest_rows (of the tail) of the different terms of each query that an index has."""
    facts = spark.read.parquet(f"{path}/facts")
    facts = facts if indexes is None else facts.where(F.col("index").isin(indexes))
    buckets = facts.agg(F.max("buckets")).first()[0] or 1
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term")).withColumn("bucket", bucket(F.col("term"), buckets))
    known = asked.join(spark.read.parquet(f"{path}/terms"), ["bucket", "term"]).join(F.broadcast(facts.select("index", "n")), "index")  # a row an index
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return known.select("query", "index", "bucket", "term", idf.alias("idf"), (idf * F.col("tail")).alias("rest"), "df", "rest_rows")


def first_k(scored: DataFrame, k: int) -> DataFrame:
    """The first k rows of each query and index, first within parts of them, with their rank."""
    part = F.pmod(F.xxhash64("id"), F.lit(16))
    order = [F.desc("score"), "id"]
    some = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("query", "index", "part").orderBy(*order))).where(F.col("rank") <= k)
    return some.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("query", "index").orderBy(*order))).where(F.col("rank") <= k)


def bounds(terms: DataFrame, heads: DataFrame, k: int) -> DataFrame:
    """terms with opens: whether the term's tail may hold a row that no head has and that is among the first k. The lightest terms whose rests stay under the score that k rows reach by heads alone do not open."""
    reached = first_k(heads.groupBy("query", "index", "id").agg(F.sum("part").alias("score")), k).groupBy("query", "index").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    light = F.sum("rest").over(Window.partitionBy("query", "index").orderBy("rest", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    compared = terms.withColumn("light", light).join(reached.where(F.col("n") >= k).select("query", "index", "least"), ["query", "index"], "left")
    return compared.withColumn("opens", F.coalesce(F.col("light") * (1 + 1e-9) >= F.col("least") * (1 - 1e-9), F.lit(True)))


def best(postings: DataFrame, terms: DataFrame, facts: DataFrame, pairs: int, k: int) -> DataFrame:
    """query, index, id, score (rounded to nine digits) and sum (not rounded): of each query the first k rows of each part of an index, by the given postings (index, term, id, impact).

    terms: query, index, term and idf; facts: index and n (rows). Parts of an index's rows and groups of queries meet in a task each. Parts are larger
    the more (query, term) pairs there are, up to a bound, so that the pairs, which go to each part, stay fewer than the postings.
    """
    kinds = f"query {terms.schema['query'].dataType.simpleString()}, index string, id {postings.schema['id'].dataType.simpleString()}, score double, sum double"
    rows_each, groups = min(MOST_PART, max(LEAST_PART, pairs // PAIRS_A_ROW)), max(1, -(-pairs // PART_PAIRS))
    sizes = F.broadcast(facts.select("index", F.ceil(F.col("n") / rows_each).cast("int").alias("parts")))  # a row an index
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    left = postings.join(sizes, "index").select("index", part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("asked"), "term", "id", "impact")
    asked = F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int")
    of_term = terms.groupBy("index", asked.alias("asked"), "term").agg(F.first("idf").alias("idf"), F.collect_list("query").alias("queries"))
    right = of_term.join(sizes, "index").select("index", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asked", "term", "idf", "queries")

    def meet(rows, some):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        some = some.sort_by("term")  # sums have one order in all parts
        ids, asked = (c.combine_chunks().dictionary_encode(null_encoding="encode") for c in (rows["id"], pc.list_flatten(some["queries"])))
        by_id = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
        n, many = len(by_id), len(some)
        place = np.empty(n, np.int64)
        place[by_id] = np.arange(n)
        term = pc.fill_null(pc.index_in(rows["term"], value_set=some["term"].combine_chunks()), -1).to_numpy().astype(np.int64)
        wanted = term >= 0
        keys, of = np.unique(term[wanted] * n + place[ids.indices.to_numpy()[wanted]], return_inverse=True)
        weight = np.bincount(of, rows["impact"].to_numpy()[wanted], len(keys)) * some["idf"].to_numpy()[keys // n]
        row, ends = keys % n, np.searchsorted(keys, np.arange(many + 1) * n)
        # the terms of each query, in their order
        owner = np.repeat(np.arange(many), pc.list_value_length(some["queries"]).to_numpy())
        order = np.argsort(asked.indices.to_numpy(), kind="stable")
        upto = np.cumsum(np.bincount(asked.indices.to_numpy(), minlength=len(asked.dictionary)))
        found = []
        for q, (a, z) in enumerate(zip([0, *upto], upto)):
            total, seen = np.zeros(n), np.zeros(n, bool)
            for t in owner[order[a:z]]:
                at = row[ends[t] : ends[t + 1]]
                total[at] += weight[ends[t] : ends[t + 1]]
                seen[at] = True
            at = np.flatnonzero(seen)
            score = np.floor(total[at] * 1e9 + 0.5) / 1e9
            if len(at) > k:
                high = score >= -np.partition(-score, k - 1)[k - 1]
                at, score = at[high], score[high]
            first = np.argsort(-score, kind="stable")[:k]  # rows are in the order of their ids
            found.append((np.full(len(first), q), at[first], score[first], total[at[first]]))
        query, at, score, total = map(np.concatenate, zip(*found)) if found else [np.zeros(0, int)] * 4
        index = pa.array([some["index"][0].as_py()] * len(at) if found else [], pa.string())
        return pa.Table.from_arrays([asked.dictionary.take(pa.array(query)), index, ids.dictionary.take(pa.array(by_id[at])), pa.array(score, pa.float64()), pa.array(total, pa.float64())], names=["query", "index", "id", "score", "sum"])

    keys = ["index", "part", "asked"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, kinds)


def search_many(spark: SparkSession, path: str, queries: DataFrame, k: int, text_col: str = "text", indexes: list[str] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """query, index, id, score and rank: of each query (column query, unique) the k best rows of each index, by the sum over its different terms; equal scores by id.

    Scores are rounded to nine digits. rows: a table with a column id; only rows in it are found (filters act before ranking).
    A query without known terms has no rows.
    """
    terms = wanted_terms(spark, path, queries, text_col, indexes).persist()
    pairs, facts = terms.count(), spark.read.parquet(f"{path}/facts")
    stored = spark.read.parquet(f"{path}/postings")
    stored = stored if rows is None else stored.join(rows.select("id").distinct(), "id", "left_semi")
    place = ["bucket", "index", "term"]
    heads = stored.where("head").join(F.broadcast(terms.select(*place).distinct()), place)
    bounded = bounds(terms, best(heads, terms, facts, pairs, k).select("query", "index", "id", F.col("sum").alias("part")), k)
    # a term that some query opens is read for all
    opened = bounded.groupBy(*place).agg(F.max("opens").alias("opens"), F.first("df").alias("df"), F.first("rest_rows").alias("rest_rows")).persist()
    shut = F.sum(F.when(~F.col("opens"), F.col("rest_rows")))
    sizes = opened.agg(F.coalesce(shut, F.lit(0)).alias("shut"), F.coalesce(F.sum("df") - F.coalesce(shut, F.lit(0)), F.lit(0)).alias("open")).first()
    tails = stored.where("NOT head").join(F.broadcast(opened.select(*place, "opens")), place)
    columns = ["index", "term", "id", "impact"]
    found = heads.select(*columns).unionByName(tails.where("opens").select(*columns))
    others = tails.where("NOT opens").select(*columns)
    if sizes["shut"] > sizes["open"]:  # else looking up what was found costs more than reading all
        others = others.join(found.select("index", "id").distinct(), ["index", "id"], "left_semi").select(*columns)
    return first_k(best(found.unionByName(others), terms, facts, pairs, k), k).select("query", "index", "id", "score", "rank")


def fan_out(spark: SparkSession, path: str, queries: DataFrame, limit: int, result_type: str | None = None, text_col: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """query, id, index, score and rank: hits of all indexes, each scored by its index's weight over the root of its rank there, merged to the first `limit` of a query.

    A known result_type asks its own index only, for `limit` hits; else each of the seven gives 10 to 40.
    """
    limit = max(1, limit)
    index = RESULT_INDEXES.get((result_type or "").lower())
    weights = {index: ACTOR_WEIGHT if index == "actor" else INDEX_WEIGHTS[index]} if index else INDEX_WEIGHTS
    each = limit if index else min(max(limit, LEAST_EACH), MOST_EACH)
    hits = search_many(spark, path, queries, each, text_col, list(weights), rows=rows)
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("index")]
    scored = hits.select("query", "id", "index", rank_score(weight, F.col("rank")).alias("score"))
    ranks = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "index", "id")))
    return ranks.where(F.col("rank") <= limit)


def id_buckets(results: DataFrame, kind_col: str = "kind", id_col: str = "id") -> DataFrame:
    """bucket and id: where the ids of results are to be looked up, each once; ids of unknown kinds in every bucket."""
    known = F.lit(None).cast("array<string>")
    for name, kinds in ID_BUCKETS.items():
        known = F.when(F.lower(kind_col).isin(kinds), F.array(F.lit(name))).otherwise(known)
    every = F.array(*map(F.lit, ID_BUCKETS))
    return results.select(F.explode(F.coalesce(known, every)).alias("bucket"), F.col(id_col).alias("id")).distinct()
