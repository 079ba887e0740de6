"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, TUNING


def _first(rule: str, value: str) -> str:
    low, ladder = RULES[rule]
    return "CASE " + " ".join(f"WHEN {value} {'<' if low else '>'} {c} THEN {k}" for k, c in enumerate(ladder, 1)) + f" ELSE {len(ladder) + 1} END"


def quality_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """Counts, groups, the chain of each stratum, its exact tests and the verdict (the labels' bound is above the small tables)."""
    values = {"few_words": "n_words", "long_words": "100 * word_chars // n", "short_words": "100 * word_chars // n", "symbols": "1000 * n_symbols // n", "dup_lines": "1000 * n_dup_lines // ln", "repeats": "1000 * n_repeat_words // n"}
    firsts = ", ".join(f"{_first(r, values[r])} AS f_{r}" for r in RULES)
    long = " UNION ALL ".join(f"SELECT unit, doc_id, tunes, quality, '{r}' AS rule, {len(RULES[r][1])} AS rungs, f_{r} AS first FROM grouped" for r in RULES)
    rejected = " OR ".join(f"f_{r} <= coalesce((SELECT last FROM cut WHERE cut.key = k.key AND cut.rule = '{r}'), 0)" for r in RULES)
    return rf"""
WITH t AS (SELECT doc_id, lang AS stratum, coalesce('=' || lang, 'null') AS key, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t),
ld AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY doc_id),
c AS (SELECT w.doc_id, stratum, key, w.w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines
  FROM w LEFT JOIN ld ON w.doc_id = ld.doc_id LEFT JOIN rw ON w.doc_id = rw.doc_id),
k AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {firsts} FROM (SELECT *, greatest(n_words, 1) AS n, greatest(n_lines, 1) AS ln FROM c)),
lab AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
graded AS (SELECT k.*, lab.quality, list_min(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS grp FROM k JOIN lab ON k.doc_id = lab.doc_id WHERE NOT base_failed),
once AS (SELECT *, strpos('0123456789abcdef', substr(sha256(grp), 1, 1)) <= {TUNING} AS tunes FROM (SELECT *, row_number() OVER (PARTITION BY key, grp ORDER BY doc_id) AS r FROM graded) WHERE r = 1),
totals AS (SELECT key, count(*) FILTER (NOT tunes AND quality = 1) AS n FROM once GROUP BY key),
units AS (SELECT key, CASE WHEN n < ln({delta} / (SELECT count(*) FROM totals)) / ln(1 - {alpha}) THEN '' ELSE key END AS unit FROM totals),
grouped AS (SELECT once.*, unit FROM once JOIN units ON once.key = units.key),
long AS ({long}),
goods AS (SELECT unit, count(*) FILTER (tunes AND quality = 1) AS tuning, count(*) FILTER (NOT tunes AND quality = 1) AS held FROM grouped GROUP BY unit),
rungs AS (SELECT unit, rule, j, count(*) FILTER (quality = 0 AND first <= j) AS bad, count(*) FILTER (quality = 1 AND first <= j) AS good FROM (SELECT *, unnest(range(1, rungs + 1)) AS j FROM long WHERE tunes) GROUP BY unit, rule, j),
worth AS (SELECT unit, rule, max(j) AS upto, arg_max(bad, j) AS bad FROM rungs JOIN goods USING (unit) WHERE bad > 0 AND bad >= good AND 2 * good <= {alpha} * tuning GROUP BY unit, rule),
chain AS (SELECT *, coalesce(sum(upto) OVER (PARTITION BY unit ORDER BY bad DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM worth),
step AS (SELECT unit, doc_id, min(start + first) AS step FROM long JOIN chain USING (unit, rule) WHERE NOT tunes AND quality = 1 AND first <= upto GROUP BY unit, doc_id),
tested AS (SELECT unit, j, held AS total, (SELECT count(*) FROM step WHERE step.unit = s.unit AND step <= j) AS wrong FROM (SELECT unit, unnest(range(1, CAST(max(start + upto) AS BIGINT) + 1)) AS j FROM chain GROUP BY unit) s JOIN goods USING (unit)),
failed AS (SELECT unit, j, CASE WHEN total = 0 THEN 1.0 ELSE list_sum(list_transform(range(CAST(wrong AS BIGINT) + 1), lambda i: exp(lgamma(total + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = total THEN 0 ELSE lgamma(total - i + 1) END + i * ln({alpha}) + (total - i) * ln(1 - {alpha})))) END > {delta} / (SELECT count(*) FROM goods) AS failed FROM tested),
lasts AS (SELECT unit, coalesce(min(j) FILTER (failed) - 1, max(j)) AS last FROM failed GROUP BY unit),
cut AS (SELECT key, rule, greatest(0, least(upto, last - start)) AS last FROM chain JOIN lasts USING (unit) JOIN units USING (unit))
SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT (base_failed OR {rejected}) AS kept FROM k
"""


def decontamination_sql(width: int = 10) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({width}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, j, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS j FROM b)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT k FROM b))),
m AS (SELECT doc_id, i, dw.k, item_id, j FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
runs AS (SELECT doc_id, k, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS r, item_id, i - j AS d FROM m),
best AS (SELECT doc_id, max(n) AS longest FROM (SELECT doc_id, count(*) + max(k) - 1 AS n FROM runs GROUP BY doc_id, item_id, d, r) GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def substring_sql(depth: int = 100) -> str:
    """Hex digits stand for bytes: two for each."""
    return rf"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, substr(h, 2 * s + 1, {2 * depth}) AS w FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) // 2 - {depth} + 1 AS BIGINT))) AS s FROM d)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
runs AS (SELECT doc_id, min(s) AS a, max(s) + {depth} AS b FROM (SELECT doc_id, s, sum(CASE WHEN s > p + {depth} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT doc_id, s, lag(s, 1, s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM later)) GROUP BY doc_id, g),
kept AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
text AS (SELECT d.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY x) AS k FROM kept JOIN d ON kept.doc_id = d.doc_id GROUP BY d.doc_id),
n AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN text ON d.doc_id = text.doc_id
"""
