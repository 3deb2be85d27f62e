"""The corpus queries, by their contracts, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from postaudit.llm import bpe, descent, divergence, exact, langid, mixing, passages, phrases, quality, simhash, suffix, vptree, warc
from postaudit.llm.common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sums AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
    FROM sized GROUP BY source),
ranked AS (
    SELECT *, row_number() OVER o AS place,
           1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pool,
           sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shares
    FROM sums WINDOW o AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
first AS (SELECT * FROM ranked WHERE pool * weight <= 2 * source_size * shares ORDER BY place LIMIT 1),
goals AS (
    SELECT r.source, r.source_size,
           CASE WHEN r.place < f.place THEN (2 * r.source_size)::DOUBLE ELSE r.weight * f.pool / f.shares END AS target
    FROM ranked r, first f),
rated AS (
    SELECT doc_id, size, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
           ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS chance
    FROM sized JOIN goals ON sized.source IS NOT DISTINCT FROM goals.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.mark_repeats(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.tokenise(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, digests_only=True)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op9_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH good AS (
    SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings
    WHERE len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec) AS score
    FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


def op10_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH hashed AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
    SELECT *, list_aggregate([lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0') for i in range(1, 41)],
                             'string_agg', '') AS bits,
           max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first_id
    FROM hashed)
SELECT page_id, payload_bytes,
       list_aggregate(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + strpos(
           '00000 00001 00010 00011 00100 00101 00110 00111 01000 01001 01010 01011 01100 01101 01110 01111 '
           || '10000 10001 10010 10011 10100 10101 10110 10111 11000 11001 11010 11011 11100 11101 11110 11111 ',
           bits[5 * i + 1:5 * i + 5] || ' ') // 6] for i in range(0, 32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM bits
"""


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, 1 + least(5, len(w)))) AS size FROM split),
grams AS (SELECT lang, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM sized),
counts AS (
    SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, count(*) AS f
    FROM grams GROUP BY ALL HAVING count(*) >= 100),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang),
several AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1),
kept AS (
    SELECT * FROM several s WHERE NOT EXISTS (
        SELECT 1 FROM several b WHERE b.lang = s.lang AND b.size > s.size AND 100 * b.a >= 100 * s.a
          AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM kept),
scored AS (
    SELECT c.lang, c.phrase, c.k, c.a, h.f AS l, t.f AS r, words.n,
           (1000::HUGEINT * c.a * words.n // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c
    JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[c.k + 1:], ' ')
    JOIN words ON words.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH docs AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           row_number() OVER () AS row FROM documents),
split AS (
    SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x{00}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS q FROM split GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
vocab AS (SELECT lang, count(*) AS v, sum(q)::BIGINT AS n FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM split JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.n, 0) AS lang_n,
           coalesce((SELECT sum(c) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS n
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN vocab v ON v.lang = g.lang),
chances AS (
    SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
           (1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v))::BIGINT AS p,
           (1 + 1000000000::HUGEINT * (k.q + 2) // (g.lang_n + 2 * g.v))::BIGINT AS q
    FROM groups g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p)::HUGEINT * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
    FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q)::HUGEINT * (p - q) // (p + q))::BIGINT AS value
    FROM chances WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_dedup(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_mix_sources": op3_mix_sources,
        "op4_language_id": op4_language_id,
        "op5_run_length_dedup": op5_run_length_dedup,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_vantage_point_search": op9_vantage_point_search,
        "op10_warc_packages": op10_warc_packages,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_source_divergence": op12_source_divergence,
        "op13_embedding_near_dedup": op13_embedding_near_dedup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": OP3_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_vantage_point_search": OP9_SQL,
        "op10_warc_packages": OP10_SQL,
        "op11_phrase_collocations": OP11_SQL,
        "op12_source_divergence": OP12_SQL,
    }
