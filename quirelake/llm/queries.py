"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .common import read
from .decontamination import contaminated_pairs
from .fill_middle import fill_in_middle, restored
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .nearest import nearest
from .ngram_join import jaccard_join
from .pii import replace_pii
from .quality import fit_quality, score_quality
from .ranked_search import search_documents
from .secret_scan import ACCESS, ASSIGN, BREAK, ENDPOINT, HEX, IDENT, KEY, REACH, WEAK, listed, scan_secrets
from .substring_dedup import dedup_substrings
from .toxicity import fit_toxicity, score_toxicity
from .url_filter import judge_urls


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs))
    return scored.select("doc_id", F.col("quality").alias("score"), "weak_label", (F.col("quality") >= 0.5).alias("keep"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(read(spark, sf_dir, "documents"), key="surrogates").select("doc_id", "n_replaced", "text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short_items=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(read(spark, sf_dir, "documents"), length=100)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), usable=~held_out)
    return score_toxicity(docs, model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted")
    )


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"), n=3, share=(90, 100))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_linked", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"), seed=42)
    text = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_url_filter, op4_pii, op5_decontamination, op6_substring_dedup, op7_source_mixing, op8_nearest, op9_toxicity, op10_ngram_jaccard, op11_secret_scan, op12_ranked_search, op13_fill_in_middle, pipeline)}


_LINES = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_MIX = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id) AS shuffle FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sums),
levels AS (
  SELECT *, (3 * s)::DOUBLE / w AS full_at,
    (sum(s) OVER () - coalesce(sum(3 * s) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::DOUBLE AS level
  FROM weighed WINDOW o AS (ORDER BY (3 * s)::DOUBLE / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, s, rk, CASE WHEN full_at > level
    THEN (SELECT arg_min(level, full_at) FROM levels WHERE full_at > level) * w ELSE (3 * s)::DOUBLE END AS target FROM levels),
queue AS (
  SELECT doc_id, size, s, target, rk, shuffle,
    sum(size) OVER (PARTITION BY rk ORDER BY shuffle, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS sofar
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
entries AS (
  SELECT queue.*, copy, CASE WHEN target > 0 THEN (copy * s + sofar)::DOUBLE / target ELSE 0 END AS finish
  FROM queue, (VALUES (0), (1), (2)) AS c(copy)),
cut_off AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rk, shuffle, doc_id, copy ROWS UNBOUNDED PRECEDING)
    <= (SELECT sum(size) FROM sizes) AS takes FROM entries)
SELECT doc_id, size, s AS source_size, target, (count(*) FILTER (takes) * size)::BIGINT AS taken
FROM cut_off GROUP BY doc_id, size, s, target
"""


_NEAREST = r"""
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
smallest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id JOIN smallest ON d.doc_id = x
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_SECRETS = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matched AS (
  SELECT r, t, 'assign' AS pattern, regexp_extract_all(t, {_quoted(ASSIGN)}) AS ms, string_split_regex(t, {_quoted(ASSIGN)}) AS gaps FROM docs UNION ALL
  SELECT r, t, 'access', regexp_extract_all(t, {_quoted(ACCESS)}), string_split_regex(t, {_quoted(ACCESS)}) FROM docs UNION ALL
  SELECT r, t, 'hex', regexp_extract_all(t, {_quoted(HEX)}), string_split_regex(t, {_quoted(HEX)}) FROM docs UNION ALL
  SELECT r, t, 'weak', regexp_extract_all(t, {_quoted(WEAK)}), string_split_regex(t, {_quoted(WEAK)}) FROM docs UNION ALL
  SELECT r, t, 'break', regexp_extract_all(t, {_quoted(BREAK)}), string_split_regex(t, {_quoted(BREAK)}) FROM docs),
hits AS (SELECT r, pattern, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS nth FROM matched WHERE len(ms) > 0),
kinds AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, pattern ORDER BY nth)::BIGINT AS e,
    CASE WHEN pattern = 'assign' THEN CASE WHEN length(regexp_extract(m, {_quoted(ASSIGN)}, 2)) >= 6 THEN 'assign' END
         WHEN pattern <> 'weak' THEN pattern
         WHEN regexp_full_match(m, {_quoted(ENDPOINT)}) THEN 'endpoint' WHEN regexp_full_match(m, {_quoted(KEY)}) THEN 'key' WHEN regexp_full_match(m, {_quoted(IDENT)}) THEN 'ident'
         WHEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') THEN 'blob' END AS kind
  FROM hits),
places AS (
  SELECT r, kind, e - length(m) AS s, e, list_position(['assign', 'access', 'hex', 'ident', 'key', 'blob', 'endpoint'], kind) AS o
  FROM kinds WHERE kind IS NOT NULL),
parts AS (
  SELECT *, (SELECT count(*) FROM places b WHERE b.r = p.r AND b.kind = 'break' AND b.s <= p.s) AS scope FROM places p WHERE kind <> 'break'),
clear AS (SELECT * FROM parts p WHERE o < 4 OR NOT EXISTS (SELECT 1 FROM parts q WHERE q.r = p.r AND q.o < 4 AND q.s < p.e AND p.s < q.e)),
seen AS (
  SELECT p.r, p.s, p.e, p.kind, p.o, bool_or(q.kind = 'access') AS i, bool_or(q.kind IN ('assign', 'hex')) AS x, bool_or(q.kind = 'ident') AS wi,
         bool_or(q.kind IN ('key', 'blob')) AS wx, bool_or(q.kind = 'endpoint') AS ep
  FROM clear p JOIN clear q ON p.r = q.r AND p.scope = q.scope AND (p.o, p.s, p.e) <> (q.o, q.s, q.e) AND p.s - q.e <= {REACH} AND q.s - p.e <= {REACH}
  WHERE p.o >= 4 GROUP BY ALL),
every AS (
  SELECT r, s, e, kind, o FROM places WHERE o < 4 UNION ALL
  SELECT r, s, e, kind, o FROM seen
  WHERE CASE WHEN kind = 'ident' THEN x OR (wx AND ep) WHEN kind = 'endpoint' THEN (i OR wi) AND (x OR wx) ELSE i OR (wi AND ep) END),
lists AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         count(*) FILTER (o >= 4) AS n_linked, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o < 4) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
  FROM every GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists ON docs.r = lists.r
"""

_RANKED = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM lengths),
factors AS (SELECT doc_id, (100 - 25 + (25 * n * docs) // terms)::BIGINT AS m FROM lengths, totals),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, totals GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN factors USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

_FILL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
numbers AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS changes, ('0x' || h[25:32])::BIGINT % 100 AS kind FROM d),
parts AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(u[greatest(x, y) + 1:], '') AS suffix,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR changes >= 50 THEN 'plain'
              WHEN kind < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op7_source_mixing": _MIX, "op8_nearest": _NEAREST, "op10_ngram_jaccard": _JACCARD, "op11_secret_scan": _SECRETS, "op12_ranked_search": _RANKED, "op13_fill_in_middle": _FILL}
