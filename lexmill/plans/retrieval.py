"""Retrieval queries over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmill.operators import planning, search
from lexmill.operators.graph import shared_folder
from lexmill.plans.registry import Registry

query = Registry()
TERMS = ["the", "erth", "ingth"]
TOKENS = "[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9.]+') IF x <> '']"
BM25 = f"""
    w AS (SELECT doc_id, {TOKENS} AS words FROM documents),
    c AS (SELECT doc_id, len(words) AS length, {", ".join(f"len([x FOR x IN words IF x = '{t}']) AS tf{i}" for i, t in enumerate(sorted(TERMS)))} FROM w),
    f AS (SELECT count(*) AS n, avg(length) AS mean, {", ".join(f"count_if(tf{i} > 0) AS df{i}" for i in range(3))} FROM c),
    lex AS (SELECT doc_id AS id, {" + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / mean))" for i in range(3))} AS score FROM c, f WHERE tf0 + tf1 + tf2 > 0)"""
VECTORS = """
    q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
    vec AS (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q.v) AS similarity FROM embeddings, q)"""


#: Where each table's index is, by session and the table's files as they stand: it is built when first asked for and searched until a file changes.
INDEXES: dict[tuple, str] = {}


def index_of(t):
    """The session and the path of the stored index of the documents."""
    docs = t("documents")
    spark = docs.sparkSession
    key = (spark.sparkContext.applicationId, search.file_state(docs))
    if key not in INDEXES:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        search.build_index(docs, "doc_id", "text", path)
        INDEXES[key] = path
    return spark, INDEXES[key]


def bm25_scores(t, conjunctive=False):
    return search.bm25(*index_of(t), TERMS, conjunctive)


def first_vector(t):
    return t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("query"))


@query(f"WITH {BM25} SELECT id, round(score, 6) AS score FROM lex ORDER BY score DESC, id LIMIT 50")
def fulltext_search(t):
    """The 50 texts with the best lexical scores for three terms."""
    return bm25_scores(t).orderBy(F.desc("score"), "id").limit(50).select("id", F.round("score", 6).alias("score"))


@query(f"WITH w AS (SELECT doc_id, {TOKENS} AS words FROM documents) SELECT doc_id AS id FROM w WHERE list_contains(words, 'the') AND list_contains(words, 'erth') AND list_contains(words, 'ingth')")
def conjunctive_search(t):
    """Texts that have all terms."""
    return bm25_scores(t, conjunctive=True).select("id")


@query(f"WITH {VECTORS} SELECT id, round(similarity, 6) AS similarity FROM vec ORDER BY vec.similarity DESC, id LIMIT 20")
def vector_search(t):
    return search.vector_search(t("embeddings"), "vec_id", "embedding", first_vector(t), 20).select("id", F.round("similarity", 6).alias("similarity"))


@query("WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings, q WHERE label = 1 ORDER BY list_cosine_similarity(embedding::DOUBLE[], q.v) DESC, vec_id LIMIT 10")
def vector_search_filtered(t):
    """The filter comes before the ranking."""
    return search.vector_search(t("embeddings"), "vec_id", "embedding", first_vector(t), 10, F.col("label") == 1).select("id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {BM25}, {VECTORS},
    a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS lexical_rank FROM lex QUALIFY lexical_rank <= 100),
    b AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) AS vector_rank FROM vec QUALIFY vector_rank <= 100)
    SELECT id, lexical_rank::INT AS lexical_rank, vector_rank::INT AS vector_rank, round(score, 9) AS score FROM (
      SELECT id, lexical_rank, vector_rank, coalesce(1.0::DOUBLE / (60 + lexical_rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + vector_rank), 0.0::DOUBLE) AS score FROM a FULL JOIN b USING (id)) ORDER BY score DESC, id LIMIT 20"""
)
def hybrid_search(t):
    """Lexical and vector rankings fused by reciprocal ranks."""
    vectors = search.vector_search(t("embeddings"), "vec_id", "embedding", first_vector(t), 100)
    return search.reciprocal_rank_fusion(bm25_scores(t), vectors, 20).select("id", "lexical_rank", "vector_rank", F.round("score", 9).alias("score"))


@query(
    f"""WITH {BM25}, {VECTORS},
    a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM lex QUALIFY r <= 100),
    b AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS r FROM vec QUALIFY r <= 100),
    s AS (SELECT id, 2.0::DOUBLE / sqrt(r) AS x FROM a), v AS (SELECT id, greatest(similarity, 0) + 0.75::DOUBLE / sqrt(r) AS x FROM b)
    SELECT id AS key, CASE WHEN s.x IS NOT NULL AND v.x IS NOT NULL THEN 2 ELSE 1 END AS arms,
      round(CASE WHEN s.x IS NULL THEN v.x WHEN v.x IS NULL THEN s.x ELSE greatest(s.x, v.x) + 0.35::DOUBLE * greatest(least(s.x, v.x), 0) + 0.05::DOUBLE END, 6) AS score,
      CASE WHEN s.x IS NOT NULL THEN 'keyword' ELSE 'vector' END AS kind FROM s FULL JOIN v USING (id)"""
)
def folded_search(t):
    """Rank scores of two arms, folded to one row a key."""
    lex = search.top_ranks(bm25_scores(t), "score", 100, "rank").select(F.col("id").alias("key"), F.lit(1).alias("arm"), F.lit("keyword").alias("kind"), F.lit(2).alias("priority"), search.rank_score(2.0, F.col("rank")).alias("score"))
    near = search.vector_search(t("embeddings"), "vec_id", "embedding", first_vector(t), 100)
    vec = search.top_ranks(near, "similarity", 100, "rank").select(F.col("id").alias("key"), F.lit(2).alias("arm"), F.lit("vector").alias("kind"), F.lit(1).alias("priority"), (F.greatest("similarity", F.lit(0.0)) + search.rank_score(0.75, F.col("rank"))).alias("score"))
    return search.fold_duplicates(lex.unionByName(vec)).select("key", "arms", F.round("score", 6).alias("score"), "kind")


@query(
    f"""WITH {BM25},
    top AS (SELECT id, score, id % 10 = 0 AS exact FROM lex ORDER BY score DESC, id LIMIT 60),
    r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS p FROM top WHERE NOT exact QUALIFY p <= 24)
    SELECT top.id, round(CASE WHEN exact THEN greatest(score, 100) WHEN r.id IS NOT NULL THEN 10 + 10 * coalesce(l.quality::DOUBLE, 0) ELSE score END, 6) AS score, CASE WHEN exact THEN 0 WHEN r.id IS NOT NULL THEN 1 ELSE 2 END AS bucket
    FROM top LEFT JOIN r USING (id) LEFT JOIN labels l ON l.doc_id = top.id"""
)
def reranked_search(t):
    """Exact hits, then a head of candidates by given relevance, then the rest."""
    top = bm25_scores(t).orderBy(F.desc("score"), "id").limit(60).withColumn("exact", F.col("id") % 10 == 0)
    relevance = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("relevance"))
    return search.rerank(top, relevance, 24).select("id", F.round("score", 6).alias("score"), "bucket")


@query("SELECT * FROM customer WHERE lower(c_name) = lower('customer#000000042')")
def exact_lookup(t):
    return search.exact(t("customer"), "c_name", "customer#000000042")


@query("SELECT DISTINCT k FROM (SELECT c_name AS k FROM customer UNION ALL SELECT s_name FROM supplier) WHERE k BETWEEN 'Customer#000000010' AND 'Customer#000000020~' ORDER BY k LIMIT 100")
def citation_range(t):
    """Keys in a lexical range over two tables."""
    return search.lexical_range([t("customer").select(F.col("c_name").alias("k")), t("supplier").select(F.col("s_name").alias("k"))], "k", "Customer#000000010", "Customer#000000020", 100)


@query("SELECT 'p_brand' AS facet, p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL")
def facet_counts(t):
    return search.facets(t("part"), ["p_brand", "p_size", "p_type"])


@query(
    """SELECT label, kind, max(score) AS score FROM (
      SELECT c_name AS label, 'customer' AS kind, CASE WHEN starts_with(lower(c_name), 'customer#00000001') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM customer WHERE contains(lower(c_name), 'customer#00000001')
      UNION ALL SELECT n_name, 'nation', CASE WHEN starts_with(lower(n_name), 'customer#00000001') THEN 2.0 ELSE 1.0 END FROM nation WHERE contains(lower(n_name), 'customer#00000001'))
    GROUP BY ALL ORDER BY score DESC, label, kind LIMIT 30"""
)
def suggestions(t):
    return search.suggest([(t("customer"), "c_name", "customer"), (t("nation"), "n_name", "nation")], "Customer#00000001", 30)


@query(
    """SELECT term, max(weight) AS weight FROM (SELECT lower(n_name) AS term, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT lower(r_name), 2.0::DOUBLE FROM region)
    WHERE contains(term, 'a') OR contains('a', term) GROUP BY term ORDER BY weight DESC, term LIMIT 10"""
)
def expanded_terms(t):
    return search.expand_terms("a", [(t("nation"), "n_name", 1.0), (t("region"), "r_name", 2.0)], 10)


@query(
    r"""SELECT doc_id, CASE WHEN regexp_matches(q, '(?i)^definition\s+of|defines?\b|meaning\s+of') THEN 'definition' WHEN regexp_matches(q, '(?i)deadline|within\s+[0-9]+\s+days') THEN 'deadline'
      WHEN regexp_matches(q, '(?i)penalty|fine') THEN 'penalty' WHEN regexp_matches(q, '(?i)notice|notify') THEN 'notice' ELSE 'general' END AS intent
    FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'definition of ' WHEN 1 THEN 'within 30 days ' WHEN 2 THEN 'penalty for ' WHEN 3 THEN 'notice to ' ELSE 'zzz ' END || doc_id AS q FROM labels)"""
)
def query_intents(t):
    """Intents of queries, the first rule that matches deciding."""
    words = F.array(*[F.lit(x) for x in ("definition of ", "within 30 days ", "penalty for ", "notice to ", "zzz ")])
    q = F.concat(F.get(words, (F.col("doc_id") % 5).cast("int")), F.col("doc_id").cast("string"))
    return t("labels").select("doc_id", planning.intent(q).alias("intent"))


@query(
    f"""WITH {BM25},
    top AS (SELECT id, 2.0::DOUBLE / sqrt(row_number() OVER (ORDER BY score DESC, id)) AS base FROM (SELECT lex.* FROM lex JOIN documents ON doc_id = id WHERE lang = 'en' ORDER BY score DESC, id LIMIT 160)),
    l2 AS (SELECT d.doc_id AS id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)),
    b AS (SELECT id, base, (CASE WHEN id % 50 = 0 THEN 50 ELSE 0 END) + (CASE WHEN quality = 1 THEN 1 ELSE 0 END) + (CASE WHEN id % 4 > 0 THEN 0.5::DOUBLE ELSE -2 END) + 0.1::DOUBLE * (id % 5)
       + (CASE WHEN id % 7 = 0 THEN 0.35::DOUBLE WHEN id % 7 = 1 THEN -0.1::DOUBLE ELSE 0 END) + (CASE WHEN id % 2 = 0 THEN 0.35::DOUBLE ELSE -0.2::DOUBLE END)
       + 0.2::DOUBLE * log10(id % 10 + 1) + 0.25::DOUBLE * log10(n_chars) - 0.5::DOUBLE * (id % 3) AS boost FROM top JOIN l2 USING (id))
    SELECT id, round(base, 6) AS base, round(boost, 6) AS boost, round(base + boost, 6) AS total FROM b ORDER BY base + boost DESC, id LIMIT 20"""
)
def search_request(t):
    """A page of a search with early filters and all boosts."""
    key = F.col("doc_id")
    facts = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select(
        key.alias("id"), (key % 50 == 0).alias("exact"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("source_backed"), F.when(key % 4 == 0, "Repealed").otherwise("active").alias("status"), (0.1 * (key % 5)).alias("weight"),
        (key % 7 == 0).alias("primary_law"), (key % 7 == 1).alias("commentary"), F.when(key % 2 == 0, "provision").otherwise("chunk").alias("kind"), (key % 10 + 1).alias("citations"), F.col("n_chars").alias("links"), (key % 3).alias("warnings"), "lang",
    )
    found = search.search_request(*index_of(t), TERMS, facts, 20, where=F.col("lang") == "en")
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("base", "boost", "total")])
