"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import SEED, SLICE_DIGITS, WEIGHTS  # noqa: F401
from .quality_rules import RULES, STOP_WORDS, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"


def _op3() -> str:
    pick = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    # The clamped sources are the first ones by source_size / weight; the level is that of the first prefix it fits.
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5('{SEED}:' || doc_id::VARCHAR) AS o FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {pick} END AS weight FROM src),
pre AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k,
    coalesce(sum(2.0 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
    1.5 * sum(source_size) OVER () AS total FROM ranked),
lev AS (SELECT *, greatest(0.0, total::DOUBLE - given::DOUBLE) / weights::DOUBLE AS level FROM pre),
cut AS (SELECT min(k) AS k0 FROM lev WHERE 2.0 * source_size > weight * level),
target AS (SELECT l.source, l.source_size, CASE WHEN c.k0 IS NULL OR l.k < c.k0 THEN 2.0::DOUBLE * l.source_size
    ELSE l.weight * (SELECT level FROM lev WHERE k = c.k0) END::DOUBLE AS target FROM lev l, cut c),
lots AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS w FROM target),
run AS (SELECT s.*, l.source_size, l.target, l.w, round(l.target - l.w * l.source_size)::BIGINT - coalesce(sum(s.size) OVER
    (PARTITION BY s.source ORDER BY s.o, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remains
  FROM sized s JOIN lots l ON s.source IS NOT DISTINCT FROM l.source),
m AS (SELECT *, least(greatest(remains, 0), size)::BIGINT AS more FROM run)
SELECT doc_id, size, source_size, target, (w * size + more)::BIGINT AS taken,
  (w + CASE WHEN more = size AND size > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
  (CASE WHEN more < size THEN more ELSE 0 END)::BIGINT AS part FROM m"""


def _op8() -> str:
    stop = ", ".join(f"'{w}'" for x in STOP_WORDS for w in dict.fromkeys((x, x.capitalize())))
    tests = []
    for r in RULES:
        for sign, bound in ((">=", r.low), ("<=", r.high)):
            if bound is not None:
                tests.append(f"(n_words < {r.min_words} OR {r.value}::DOUBLE {sign} {bound}::DOUBLE * {r.base}::DOUBLE)")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS w FROM t),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
g AS (SELECT doc_id, i, string_agg(word, ' ') OVER five AS gram, count(*) OVER five AS n FROM x
      WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g WHERE n = {WINDOW}),
p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM d WHERE c > 1),
r AS (SELECT doc_id, sum(least({WINDOW}, coalesce(j - i, {WINDOW}))) AS n_repeat FROM p GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_stop FROM x WHERE word IN ({stop}) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
n AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
        count(*) FILTER (WHERE regexp_matches(line, '^\s*[-*•]\s')) AS n_bullet_lines,
        count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|…)\s*$')) AS n_ellipsis_lines
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
a AS (SELECT t.doc_id, len(w.w)::BIGINT AS n_words, length(list_aggregate(w.w, 'string_agg', ''))::BIGINT AS wc,
        len(regexp_extract_all(t.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t.text, '!'))::BIGINT AS n_exclaim,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_stop, 0) AS n_stop,
        coalesce(n_lines, 0) AS n_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
      FROM t JOIN w USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, coalesce(wc, 0)::BIGINT AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept FROM b"""


ORACLES = {"op3_mixing": _op3(), "op8_quality_rules": _op8()}
