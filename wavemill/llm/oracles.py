"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

#: The words of each document; "text" may be null.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op5_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents
), line AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), win AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS p0 FROM d WHERE len(words) >= 8
), keyed AS (
  SELECT rid, p0, array_to_string(words[p0:p0 + 7], ' ') AS w FROM win JOIN d USING (rid)
), twice AS (
  SELECT rid, unnest(p0s) AS p0 FROM (SELECT rid, list(p0) AS p0s FROM keyed GROUP BY rid, w HAVING count(*) > 1)
), covered AS (
  SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest(range(p0, p0 + 8)) AS pos FROM twice) GROUP BY rid
), m AS (
  SELECT doc_id,
    len(words)::BIGINT AS n_words,
    length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::BIGINT AS n_upper,
    (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS n_letters,
    (length(text) - length(replace(text, '!', '')))::BIGINT AS n_exclaim,
    len(list_filter(words, lambda w: length(w) > 40))::BIGINT AS n_long_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
), b AS (
  SELECT *,
    ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
     + 4 * (10 * n_symbols > n_words)::BIGINT
     + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
     + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::BIGINT
     + 32 * (2 * n_upper > n_letters)::BIGINT
     + 64 * (5 * n_exclaim > n_words)::BIGINT
     + 128 * (20 * n_long_words > n_words)::BIGINT)::BIGINT AS fail_bits
  FROM m
)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
""",
    "op6_chat_snapshots": r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id
), whole AS (
  SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns
), proper AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)
)
SELECT conv_id, len(turns)::BIGINT AS n_turns, n_copies::BIGINT AS n_copies,
  array_to_string(list_transform(turns, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), '') AS rendered
FROM whole ANTI JOIN proper USING (turns)
""",
    "op4_substring_dedup": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents
), win AS (
  SELECT rid, doc_id, p0, array_to_string(words[p0:p0 + 12], ' ') AS w
  FROM (SELECT *, unnest(range(1, len(words) - 11)) AS p0 FROM d WHERE len(words) >= 13)
), least AS (
  SELECT w, min(doc_id) AS least FROM win GROUP BY w
), gone AS (
  SELECT rid, list(DISTINCT pos) AS gone
  FROM (SELECT rid, unnest(range(p0, p0 + 13)) AS pos FROM win JOIN least USING (w) WHERE doc_id > least) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words
    ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(gone, k)), lambda k: words[k]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (rid)
""",
}
