"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tesserspark.llm.decontamination import WINDOW
from tesserspark.llm.mixing import CELL_ROWS
from tesserspark.llm.quality import CLASSES, COMMON_WORDS, QualityRules

OP2 = rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, list_aggregate(list_slice(w, i, i + least(len(w), {WINDOW}) - 1), 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT rid, i, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, d.n, item_id FROM dwin d JOIN iwin USING (n, win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
found AS (SELECT rid, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""

_SPLIT = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RULES = QualityRules()


def _word_counts() -> str:
    ranks = []
    for j in range(len(next(iter(COMMON_WORDS.values())))):
        case = " ".join(f"WHEN '{code}' THEN len(list_filter(w, lambda x: x = '{listed[j]}'))" for code, listed in COMMON_WORDS.items())
        ranks.append(f"CASE lang {case} ELSE 0 END")
    return "[" + ", ".join(ranks) + "]"


def _distance(p: str, q: str) -> str:
    """Square root of the base-2 Jensen-Shannon divergence of two lists."""
    half = lambda a: f"CASE WHEN {a}[i] > 0 THEN {a}[i] * log2({a}[i] / (({p}[i] + {q}[i]) / 2)) ELSE 0 END"
    return f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {half(p)} + {half(q)})) / 2, 0))"


OP8 = rf"""
WITH raw AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_SPLIT} AS w, CASE WHEN lang IN ({", ".join(f"'{k}'" for k in COMMON_WORDS)}) THEN lang ELSE 'other' END AS lang FROM documents),
f AS (
  SELECT *, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars,
    [length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')), length(t) - length(regexp_replace(t, '[0-9]', '', 'g')), length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')),
     length(t) - length(regexp_replace(t, '[!"''()+,\-./:;=?@\[\\\]^_`{{}}~]', '', 'g')), length(regexp_replace(t, '[\x00-\x7F]', '', 'g'))] AS cc,
    {_word_counts()} AS wc, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM raw),
win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, list_aggregate(list_slice(w, i, i + 7), 'string_agg', ' ')) AS c
  FROM (SELECT rid, w, unnest(range(1, n - 6)) AS i FROM f WHERE n >= 8)),
rep AS (SELECT rid, count(DISTINCT p) AS r FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win WHERE c > 1) GROUP BY rid),
shares AS (
  SELECT *, list_concat(list_transform(cc, lambda x: x / greatest(chars, 1)), [(chars - list_sum(cc)) / greatest(chars, 1)]) AS pc,
    list_concat(list_transform(wc, lambda x: x / greatest(n, 1)), [(n - list_sum(wc)) / greatest(n, 1)]) AS pw FROM f),
ref AS (
  SELECT lang, list_concat(list_transform(cc, lambda x: x / chars), [(chars - list_sum(cc)) / chars]) AS qc, list_concat(list_transform(wc, lambda x: x / n), [(n - list_sum(wc)) / n]) AS qw
  FROM (SELECT lang, sum(chars) AS chars, sum(n) AS n, [{", ".join(f"sum(cc[{k}])" for k in range(1, len(CLASSES) + 1))}] AS cc, [{", ".join(f"sum(wc[{k}])" for k in range(1, 9))}] AS wc
        FROM f WHERE chars >= {_RULES.min_chars} AND n >= {_RULES.min_words} AND lang <> 'other' GROUP BY lang)),
judged AS (
  SELECT s.*, CASE WHEN s.lang = 'other' THEN (SELECT min({_distance('s.pc', 'ref.qc')}) FROM ref) ELSE {_distance('s.pc', 'r.qc')} END AS dc, {_distance('s.pw', 'r.qw')} AS dw FROM shares s LEFT JOIN ref r ON r.lang = s.lang)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(cc[3] AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, n < 20 OR 100 * coalesce(r, 0) > 30 * n AS base_failed,
  NOT (n < 20 OR 100 * coalesce(r, 0) > 30 * n) AND NOT ((chars >= {_RULES.min_chars} AND coalesce(dc, 0) > {_RULES.max_char_distance}) OR (n >= {_RULES.min_words} AND coalesce(dw, 0) > {_RULES.max_word_distance} + {_RULES.short_allowance} / n)) AS kept
FROM judged LEFT JOIN rep USING (rid)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_SPLIT}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, count(*) AS source_rows FROM d GROUP BY source),
w AS (SELECT *, [1.0::DOUBLE, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 3.0::DOUBLE * source_size AS top FROM s),
l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(top) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY top / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, source_rows, least(top, coalesce((SELECT first(level ORDER BY top / w, level) FROM l WHERE top >= level * w) * w, top)) AS target FROM l),
k AS (
  SELECT d.*, source_size, target, source_rows, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR) || '|', '') || CAST(size AS VARCHAR)) AS luck
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, rate - floor(rate) AS f, size * source_rows > source_size AS large,
    rank() OVER (PARTITION BY source, CAST('0x' || left(luck, 8) AS BIGINT) % CAST(ceil(source_rows / {CELL_ROWS}) AS BIGINT) ORDER BY size, luck, doc_id) - 1 AS place FROM k),
e AS (SELECT *, floor((place + 1) * f + 0.5) - floor(place * f + 0.5) AS x FROM p),
r AS (
  SELECT source, CASE WHEN sum(CASE WHEN large THEN 0 ELSE size END) > 0
    THEN greatest(0.0, least(1.0, (any_value(target) - sum(floor(rate) * size) - coalesce(sum(CASE WHEN large THEN x * size END), 0)) / sum(CASE WHEN large THEN 0 ELSE size END))) ELSE 0 END AS sr
  FROM e GROUP BY source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN f = 0 THEN 0 WHEN large THEN x ELSE floor((place + 1) * sr + 0.5) - floor(place * sr + 0.5) END) AS BIGINT) AS taken
FROM e JOIN r ON e.source IS NOT DISTINCT FROM r.source
"""
