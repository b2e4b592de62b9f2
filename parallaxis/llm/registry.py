"""The subpackage's queries and their SQL."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .exact_dedup import op2_exact_dedup
from .jaccard_join import op10_jaccard_join
from .language_id import op6_language_id
from .lm_scoring import op5_lm_scoring
from .packing import op4_packing
from .pii_surrogates import op8_pii_surrogates
from .quality_rules import op1_quality_rules
from .secret_scan import op9_secret_scan
from .toxicity import op7_toxicity


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_packing": op4_packing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_language_id": op6_language_id,
        "op7_toxicity": op7_toxicity,
        "op8_pii_surrogates": op8_pii_surrogates,
        "op9_secret_scan": op9_secret_scan,
        "op10_jaccard_join": op10_jaccard_join,
    }


_QUALITY = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, source, t,
         list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+7], ' ')) AS c FROM places
  ) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) AS r(k) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT source, count(*) AS n, unnest([
    {'r': 'short', 'k': sum(CAST(n_words < 20 AS BIGINT))},
    {'r': 'repeats', 'k': sum(CAST(100 * n_repeat_words > 30 * n_words AS BIGINT))},
    {'r': 'symbols', 'k': sum(CAST(100 * n_symbols > 10 * word_chars AS BIGINT))},
    {'r': 'dup_lines', 'k': sum(CAST(100 * n_dup_lines > 30 * n_lines AS BIGINT))}], recursive := true)
  FROM m WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT r, greatest(least(avg(k / n), 0.999), 0.001) AS mu, var_pop(k / n) AS v FROM f GROUP BY r
), strength AS (
  SELECT r, mu, greatest(least(CASE WHEN v > 0 THEN mu * (1 - mu) / v - 1 ELSE 1000 END, 1000), 2) AS s FROM prior
), shrunk AS (
  SELECT source, (k + mu * s) / (n + s) AS p, n + s + 1 AS z FROM f JOIN strength USING (r)
), bad AS (
  SELECT DISTINCT source FROM shrunk WHERE p - 2 * sqrt(p * (1 - p) / z) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.source IS NULL AS kept,
       bad.source IS NOT NULL AS host_rejected
FROM m LEFT JOIN bad ON m.source = bad.source
"""

_EXACT = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM d WINDOW same AS (PARTITION BY t)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _QUALITY, "op2_exact_dedup": _EXACT}
