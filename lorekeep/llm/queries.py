"""The queries of this subpackage: name to function, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from .bpe import op3_bpe
from .decontaminate import op6_decontaminate
from .lot_matching import op12_lot_matching
from .page_text import op13_page_text
from .periodic_runs import op11_periodic_runs
from .pitman_yor import op9_pitman_yor
from .quality_model import op1_quality_model
from .quality_rules import op4_quality_rules
from .simhash import op5_simhash
from .substring import op7_substring_dedup
from .surrogates import op8_surrogates
from .token_files import op10_token_counts
from .warc import op2_warc

QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_warc": op2_warc,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_simhash": op5_simhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_surrogates": op8_surrogates,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_token_counts": op10_token_counts,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lot_matching": op12_lot_matching,
    "op13_page_text": op13_page_text,
}

#: The fixed rules of quality_rules in SQL: words, windows and lines counted by grouping, rules as bits in their order.
_OP4 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT k, p, [w[p], w[p + 1], w[p + 2]] AS win FROM m, unnest(range(1, len(w) - 1)) AS u(p)),
r AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, win) AS n FROM g) WHERE n > 1),
c AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY k),
x AS (SELECT m.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
        length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_capitals,
        len(list_filter(w, lambda y: regexp_matches(y, '\p{L}'))) AS n_letter_words,
        len(list_filter(l, lambda y: regexp_matches(y, '^[\x20\x09-\x0D]*[-*•◦]'))) AS n_bullet_lines,
        len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
      FROM m LEFT JOIN c USING (k)),
f AS (SELECT *, [n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, word_chars < 3 * n_words, word_chars > 10 * n_words,
        n_dup_lines > 3 AND 10 * n_dup_lines > 3 * n_lines, 10 * n_capitals > 4 * word_chars, 10 * n_letter_words < 6 * n_words,
        n_lines > 3 AND 10 * n_bullet_lines > 9 * n_lines, n_lines > 3 AND 10 * n_ellipsis_lines > 3 * n_lines] AS b FROM x),
y AS (SELECT *, list_filter(range(1, 11), lambda i: b[i]) AS failed, list_filter(range(1, 8), lambda i: b[i]) AS now FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, b[1] OR b[2] AS base_failed,
  len(now) = 0 AS kept, CAST(coalesce(list_sum(list_transform(failed, lambda i: 1 << (i - 1))), 0) AS BIGINT) AS failures, len(failed) = 0 AS kept_v3,
  CASE WHEN len(now) = 1 THEN ['few_words', 'repeated_windows', 'symbols', 'short_words', 'long_words', 'duplicate_lines', 'capitals'][now[1]] END AS only_rule
FROM y
"""

#: Base32 of a SHA-1: each 5 hexadecimal digits are 4 characters.
_OP2 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS s FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY s) AS keep FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
"""

#: Every 20-word window, numbered among its equals by document and start; words under a window that is not the first go.
_OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
k AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS win FROM d, unnest(range(1, len(w) - 18)) AS u(p)),
l AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS r FROM k) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM l, range(20) AS x(o)),
s AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.p) FILTER (WHERE g.p IS NULL) AS kept, count(g.p) AS gone
      FROM t LEFT JOIN g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

ORACLES = {"op2_warc": _OP2, "op4_quality_rules": _OP4, "op7_substring_dedup": _OP7}
