"""One query per operator over its whole table, and their SQL twins where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugewatch.llm import (
    decontaminate,
    importance,
    jaccard,
    language,
    mixing,
    ranked_search,
    secret_scan,
    suffix_dedup,
    token_counts,
    token_files,
    topk,
    toxicity,
    warc,
)
from gaugewatch.llm.common import bucket_of, table
from gaugewatch.session import scratch_dir


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scan.scan_history(table(spark, sf_dir, "documents"))
    spans = secret_scan.span_text()
    counts = [F.size(rule.kind).cast("long").alias(f"n_{rule.kind}") for rule in secret_scan.RULES]
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans")
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.coalesce(bucket_of("id", 5) != 0, F.lit(False)))
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return token_files.token_digests(spark, path)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: run for name, run in list(globals().items()) if name.startswith("op")
}

_SPANS = r"""
SELECT {turn} AS turn, '{kind}' AS kind, doc_id,
       unnest(list_transform(range(1, len(pieces) + 1), lambda i: {{
         'stop': list_sum(list_transform(pieces[1:i], lambda p: length(p)))::BIGINT,
         'size': length(regexp_extract(pieces[i], '{pattern}', 0)),
         'held': length(regexp_extract(pieces[i], '{pattern}', {group}))}})) AS m
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:{pattern})', 0) AS pieces FROM documents)
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')"

ORACLES: dict[str, str] = {
    "op2_exact_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.row AS query_row, q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "op3_secret_scan": "WITH found AS ("
    + " UNION ALL ".join(
        _SPANS.format(turn=turn, kind=rule.kind, pattern=rule.pattern.replace("'", "''"), group=rule.group)
        for turn, rule in enumerate(secret_scan.RULES)
    )
    + """),
good AS (
  SELECT doc_id, turn, kind, m.stop - m.size AS start, m.stop AS stop FROM found
  WHERE m.held >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 ELSE 24 END),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c,
         count(*) FILTER (kind = 'hex') AS h,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, turn) AS spans
  FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)""",
    "op4_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format('[^ \\t-\\r]+')} AS words FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op6_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS words FROM documents),
b AS (SELECT item_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS words FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
         array_to_string(words[i:i + 9], ' ') AS words_in
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM win),
places AS (
  SELECT doc_id, i, size, array_to_string(words[i:i + size - 1], ' ') AS words_in
  FROM d, sizes, unnest(range(1, len(words) - size + 2)) AS t(i)),
hit AS (SELECT doc_id, i, size, item_id FROM places JOIN win USING (size, words_in)),
hitwords AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hitwords USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS keeper FROM h GROUP BY digest)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), '')
    AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM h JOIN k USING (digest)""",
    "op9_source_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place FROM documents),
w AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM d GROUP BY source),
steps AS (  -- each step fixes the sources above their limit and shares the rest anew
  SELECT 0 AS step, [NULL]::VARCHAR[] AS fixed, 1.5 * (SELECT sum(source_size) FROM w) / (SELECT sum(weight) FROM w) AS level
  UNION ALL
  SELECT step + 1, f.names, (1.5 * (SELECT sum(source_size) FROM w) - f.full) / f.weight FROM steps,
    LATERAL (SELECT list(coalesce(source, chr(0))) FILTER (level * weight > 2.0 * source_size) AS names,
                    coalesce(sum(2.0 * source_size) FILTER (level * weight > 2.0 * source_size), 0) AS full,
                    sum(weight) FILTER (level * weight <= 2.0 * source_size) AS weight FROM w) f
  WHERE step < (SELECT count(*) FROM w) AND f.weight > 0 AND len(f.names) > 0),
t AS (SELECT source, source_size, least((SELECT max(level) FROM steps) * weight, 2.0 * source_size) AS target FROM w),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS passes,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (passes * size + greatest(0, least(size, floor(target)::BIGINT - passes * source_size - before)))::BIGINT AS taken FROM c""",
    "op13_ranked_search": f"""
WITH d AS (SELECT doc_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS words FROM documents),
b AS (SELECT item_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS words FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, unnest(words) AS term FROM b),
p AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS weight
  FROM p, c GROUP BY term, n_docs),
i AS (
  SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))) AS impact
  FROM p JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50""",
}
