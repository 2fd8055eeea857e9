"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, editprint, html, langid, mixing, pii, ppm, sharding, simhash, tokens
from .common import bucket_of, table


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket_of("doc_id", 4, 2))
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_pii_spans(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark, sf_dir):
    return mixing.digest(table(spark, sf_dir, "documents"))


def op5_edit_fingerprint(spark, sf_dir):
    return editprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.digest(table(spark, sf_dir, "documents"))


def op7_hilbert_shards(spark, sf_dir):
    return sharding.digest(table(spark, sf_dir, "documents"))


def op8_ppm_score(spark, sf_dir):
    return ppm.digest(table(spark, sf_dir, "documents"))


def op9_html_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_token_files(spark, sf_dir):
    return tokens.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_pii_spans": op2_pii_spans,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_edit_fingerprint": op5_edit_fingerprint,
    "op6_simhash": op6_simhash,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_ppm_score": op8_ppm_score,
    "op9_html_text": op9_html_text,
    "op10_token_files": op10_token_files,
}

# Windows are compared by equality of the joined words; the words of a document are numbered within its own list.
SQL = {
    "op3_decontaminate": r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, len, array_to_string(w[s:s + len - 1], ' ') AS win
    FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len FROM bw),
dw AS (
    SELECT doc_id, len, s, array_to_string(w[s:s + len - 1], ' ') AS win
    FROM (SELECT doc_id, w, len, unnest(generate_series(1, len(w) - len + 1)) AS s FROM d, lens WHERE len(w) >= len)),
hit AS (SELECT doc_id, s, item_id, len FROM dw JOIN bw USING (len, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + len - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op4_mixing": r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (
    SELECT *, CAST([3.0, 1.0, 2.0][rank % 3 + 1] AS DOUBLE) AS w, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
r AS (
    SELECT *, sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest FROM w),
t AS (
    SELECT source, rank, source_size, least(cap, coalesce(max(CASE WHEN rest / w_rest * w <= cap THEN rest / w_rest END) OVER () * w, cap)) AS target FROM r),
q AS (
    SELECT d.doc_id, d.source, d.size, t.rank, t.source_size, t.target, turn,
        sum(size) OVER (PARTITION BY d.source ORDER BY turn, d.doc_id ROWS UNBOUNDED PRECEDING) AS served FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
    SELECT doc_id, size, rank, pass, turn, CAST(served + pass * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) AS p(pass) WHERE size > 0),
c AS (
    SELECT doc_id, sum(size) OVER (ORDER BY finish, rank, pass, turn, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM e),
k AS (SELECT doc_id, count(*) AS copies FROM c WHERE cum <= (SELECT sum(source_size) * 1.5::DOUBLE FROM s) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, round(target, 6) AS target, CAST(coalesce(copies, 0) * size AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
""",
}
