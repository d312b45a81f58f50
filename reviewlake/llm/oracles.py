"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

from __future__ import annotations

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP4 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, len(regexp_extract_all(role, m)) + len(regexp_extract_all(text, m)) AS n_escaped
  FROM turns, (SELECT '(?:[<\[]\\*(?:\||/?s>|/?INST\]))|(?:<\\*</?SYS>>)|(?:\[\\*</?SYS>>)' AS m)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(text) + n_escaped + length('<|turn|><|says|><|end|>') + 1)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP5 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), {_LOWER}) AS k FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, pos, line, coalesce(doc_id <> last, false) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP6 = f"""
WITH base AS (
  SELECT doc_id, coalesce(source, '(none)') AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), positions AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM base WHERE len(w) >= 5
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS five FROM positions
), twice AS (
  SELECT doc_id, five FROM windows GROUP BY doc_id, five HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, i FROM windows SEMI JOIN twice USING (doc_id, five)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM repeated) GROUP BY doc_id
), lines AS (
  SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM base
), filled AS (
  SELECT doc_id, host, line, translate(trim(line, {_BLANKS}), {_LOWER}) AS k FROM lines WHERE trim(line, {_BLANKS}) <> ''
), again AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY doc_id
), frequent AS (
  SELECT host, k, min(doc_id) AS first FROM filled GROUP BY host, k HAVING count(DISTINCT doc_id) > 20
), gone AS (
  SELECT doc_id, sum(len(regexp_extract_all(k, '[^\\x20\\x09-\\x0D]+'))) AS n
  FROM filled JOIN frequent USING (host, k) WHERE doc_id <> first GROUP BY doc_id
), counts AS (
  SELECT b.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(again.n, 0) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM base b LEFT JOIN again USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_removed_words >= 10
    AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept
FROM counts
"""

OP9 = """
WITH RECURSIVE sizes AS (
  SELECT source, count(*) AS n, pow(count(*), 0.7)::DECIMAL(28, 6) AS w FROM documents GROUP BY source
), rated AS (
  SELECT source, (SELECT sum(n) FROM sizes) / (SELECT sum(w)::DOUBLE FROM sizes) * w::DOUBLE / n AS rate FROM sizes
), law AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rated
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM law WHERE k < rate + 10 * sqrt(rate) + 20
), drawn AS (
  SELECT doc_id, source, text,
    ('0x' || substr(md5('20240301:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.source, any_value(d.text) AS text, any_value(rate) AS rate, count(*) FILTER (c <= u) AS copies
  FROM drawn d JOIN law USING (source) GROUP BY d.doc_id, d.source
), copied AS (
  SELECT *, unnest(range(copies)) AS copy FROM counted
)
SELECT doc_id, source, copy::INT AS copy, copies::INT AS copies, round(rate, 9) AS rate,
  substr(md5('20240301 order:' || doc_id || ':' || copy), 1, 16) AS shuffle_key,
  strlen(coalesce(text, ''))::INT AS n_bytes
FROM copied
"""

OP11 = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), holders AS (
  SELECT digest, max(page_id) AS holder FROM payloads WHERE n >= 1000 GROUP BY digest
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM payloads LEFT JOIN holders USING (digest)
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12 = f"""
WITH words AS (
  SELECT doc_id, unnest({_TERMS}) AS term FROM documents
), counts AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), total AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term, docs
), wanted AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM wanted JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat_formatting": OP4, "op5_line_dedup": OP5, "op6_quality_rules": OP6, "op9_mixing": OP9,
        "op11_warc_bundles": OP11, "op12_lexical_search": OP12,
    }
