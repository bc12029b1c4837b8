"""The operators' queries over the test tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, collocations, decontamination, divergence, html_extract, packing, pii, quality_mil, quality_rules, simhash, speculate, toxicity, warc
from lexmill.llm.common import read, remainder, shared_dir

TOKENIZER = "byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text for toxicity; learns from labels of three quarters of the ids."""
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder(4) != 2)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to an archive and reads the rebuilt records back."""
    path = warc.archive_path(shared_dir(spark))
    warc.write_archive(read(spark, sf_dir, "pages"), path, dedup_bytes=1000)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.find(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text."""
    return bpe.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text for quality; learns from labels of four fifths of the ids."""
    docs = read(spark, sf_dir, "documents")
    model = quality_mil.train(docs, read(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality_mil.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a verdict for every text."""
    docs = read(spark, sf_dir, "documents")
    return quality_rules.apply_rules(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and the groups that they link."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every text shares with the benchmark."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token pieces and their places in sequences."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=2048)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language, and each source's own terms."""
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=30, top=50).select("lang", "source", "part", "item", "value", "rank")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's phrases of two and three words that stand together most."""
    return collocations.mine(read(spark, sf_dir, "documents"), min_count=10, max_words=3, inside_percent=50, top=2000)


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids and what they decode to, as digests."""
    return speculate.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can state of op13_bpe_round_trip: the decoded text is the text."""
    return op13_bpe_round_trip(spark, sf_dir).select("doc_id", "decoded_sha256")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op7_quality_rules that SQL can state, without the model's verdict."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op3_pii_weak_supervision, without the places."""
    return op3_pii_weak_supervision(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES = {f.__name__: f for f in (quality_rule_counts, personal_data_counts, decoded_texts, op1_toxicity, op2_warc_archive, op3_pii_weak_supervision, op4_token_counts, op5_quality_classifier, op6_html_extraction, op7_quality_rules, op8_simhash_near_dedup, op9_benchmark_decontamination, op10_best_fit_packing, op11_source_divergence, op12_phrase_collocations, op13_bpe_round_trip)}

DIVERGENCE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
    kept AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM t GROUP BY ALL HAVING count(*) >= {min_docs}),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT g.lang, g.source, kept.term, lang_n, coalesce(sum(t.n), 0)::HUGEINT AS n
          FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term GROUP BY ALL),
    s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total, sum(lang_n) OVER (PARTITION BY lang, source)::HUGEINT AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
    f AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (total + 5 * v) AS p, 1 + 1000000000 * (lang_n + 5) // (lang_total + 5 * v) AS q FROM s),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(fa.p - fb.p)), 0)::BIGINT AS value
             FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
             LEFT JOIN f AS fa ON fa.lang = a.lang AND fa.source = a.source LEFT JOIN f AS fb ON fb.lang = b.lang AND fb.source = b.source AND fb.term = fa.term GROUP BY ALL),
    term AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM f WHERE n > 0 AND p > q)
    SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
    UNION ALL
    SELECT * FROM (SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term) WHERE rank <= {top}
"""

COLLOCATIONS = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    g AS (SELECT lang, k, array_to_string(w[s : s + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS s FROM p, (SELECT unnest([1, 2, 3]) AS k))),
    f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL HAVING count(*) >= {least}),
    n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
    sub AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
    gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN sub ON c.lang = sub.lang AND c.phrase = sub.phrase WHERE 100 * sub.a >= 50 * c.a),
    cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS cut FROM c ANTI JOIN gone USING (lang, phrase)),
    s AS (SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, cut, 1000000 * cuts.a * cuts.a // (x.a * y.a) AS score
          FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f AS y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 : cuts.k], ' ')),
    low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
    top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM top JOIN n USING (lang) WHERE rank <= {top}
"""

ORACLE_SQL: dict[str, str] = {
    "op11_source_divergence": DIVERGENCE.format(min_docs=30, top=50),
    "op12_phrase_collocations": COLLOCATIONS.format(least=10, top=2000),
    "decoded_texts": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "quality_rule_counts": r"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, s, w[s : s + 7] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM w WHERE len(w) >= 8)),
        rep AS (SELECT doc_id, s FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM rep) GROUP BY doc_id),
        c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
              [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN pos USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
               n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
    """,
    "personal_data_counts": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        i AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS m FROM d)
              WHERE list_max([coalesce(try_cast(p AS HUGEINT), 999) FOR p IN string_split(m, '.')]) <= 255 GROUP BY doc_id),
        n AS (SELECT doc_id, reverse(regexp_replace(m, '[^0-9]', '', 'g')) AS r FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+')) AS m FROM d)),
        c AS (SELECT doc_id, count(*) AS n FROM n WHERE length(r) BETWEEN 13 AND 19
              AND list_sum([CASE WHEN k % 2 = 1 THEN substring(r, k + 1, 1)::INT * 2 // 10 + substring(r, k + 1, 1)::INT * 2 % 10 ELSE substring(r, k + 1, 1)::INT END FOR k IN range(length(r))]) % 10 = 0 GROUP BY doc_id),
        p AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')) AS m FROM d) WHERE length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15 GROUP BY doc_id)
        SELECT d.doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email, coalesce(i.n, 0)::BIGINT AS n_ip, coalesce(c.n, 0)::BIGINT AS n_card, coalesce(p.n, 0)::BIGINT AS n_phone
        FROM d LEFT JOIN i USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)
    """,
    "op9_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, w[s + 1 : s + least(len(w), 13)] AS win
               FROM (SELECT *, unnest(range(0, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM bw),
        dw AS (SELECT doc_id, n, s, w[s + 1 : s + n] AS win
               FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS s FROM d CROSS JOIN sizes)),
        hit AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
        places AS (SELECT doc_id, w[p] AS t, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
        freq AS (SELECT t, count(*) AS n FROM places GROUP BY t),
        firsts AS (SELECT DISTINCT item_id, w, s FROM (SELECT item_id, w, unnest(list_append(range(0, greatest(len(w) - 12, 1), 13), greatest(len(w) - 13, 0))) AS s FROM b WHERE len(w) > 0)),
        terms AS (SELECT item_id, w, s, t, min(k) AS k FROM (SELECT item_id, w, s, w[s + k] AS t, k FROM (SELECT item_id, w, s, unnest(range(1, least(len(w), 13) + 1)) AS k FROM firsts)) GROUP BY ALL),
        win AS (SELECT item_id, w, s, list(t) AS ts, min_by(t, (coalesce(n, 0), k)) AS lead FROM terms LEFT JOIN freq USING (t) GROUP BY ALL),
        near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT places.doc_id, item_id, win.w, s FROM places JOIN win ON t = lead JOIN d USING (doc_id)
                 WHERE len(list_intersect(ts, d.w[greatest(p - 26, 1) : p + 26])) = len(ts)) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
               CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
    """,
    "op2_warc_archive": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d, coalesce(html, '') AS h FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM q
    """,
}
