"""DuckDB SQL for the queries that SQL can express on whole tables.

The others are held against brute-force versions in ``tests/llm``: they need hashes, lattices, alignments, mixtures, raking or
ring walks that SQL lacks.
"""

from __future__ import annotations

from .common import ASCII_LOWER, ASCII_UPPER
from .quality import MAX_REPEAT_PERCENT, METRICS, MIN_ROWS, MIN_WORDS, PER_E

ORACLE: dict[str, str] = {}

ORACLE["op7_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
 i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
 iw AS (SELECT DISTINCT item_id, n, w[p + 1 : p + n] AS win FROM (SELECT item_id, w, least(8, len(w)) AS n, unnest(range(len(w) - least(8, len(w)) + 1)) AS p FROM i WHERE len(w) > 0)),
 dw AS (SELECT rid, p, n, w[p + 1 : p + n] AS win FROM (SELECT rid, w, n, unnest(range(len(w) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
 hits AS (SELECT rid, p, dw.n, item_id FROM dw JOIN iw USING (n, win)),
 marks AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
 found AS (SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, item_id::VARCHAR AS name FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN marks USING (rid) LEFT JOIN found USING (rid)"""

_BUCKETS = " UNION ALL ".join(
    f"SELECT rid, lang, source, failed, '{k}' AS metric, floor(ln(({num} + 1) / ({den} + 1)) * {PER_E})::BIGINT AS bucket, {reach} AS reach, {str(below).lower()} AS below FROM m"
    for k, (num, den, reach, below) in METRICS.items()
)


def _quartiles(name: str, by: str) -> str:
    keys = f"{by}, " if by else ""
    at = lambda p: f"min(CASE WHEN upto * 100 >= al * {p} THEN bucket END)"
    return f"{name} AS (SELECT {keys}metric, max(al) AS n, {at(25)} AS q25, {at(75)} AS q75 FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}metric) AS al FROM (SELECT {keys}metric, bucket, count(*) AS n FROM b WHERE NOT failed GROUP BY ALL)) GROUP BY {keys}metric)"


ORACLE["op9_quality_rules"] = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
 win AS (SELECT rid, p, w[p + 1 : p + 8] AS k FROM (SELECT rid, w, unnest(range(len(w) - 7)) AS p FROM t WHERE len(w) >= 8)),
 twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
 rep AS (SELECT rid, sum(least(8, coalesce(nxt - p, 8))) AS n FROM (SELECT rid, p, lead(p) OVER (PARTITION BY rid ORDER BY p) AS nxt FROM twice) GROUP BY rid),
 m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS failed FROM (SELECT rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(regexp_extract_all(text, '\\p{{Lu}}'))::BIGINT AS n_upper, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter FROM t LEFT JOIN rep USING (rid))),
 b AS ({_BUCKETS}),
 {_quartiles("g", "lang, source")}, {_quartiles("l", "lang")}, {_quartiles("a", "")},
 q AS (SELECT b.*, CASE WHEN g.n >= {MIN_ROWS} THEN g.q25 WHEN l.n >= {MIN_ROWS} THEN l.q25 ELSE a.q25 END AS lo, CASE WHEN g.n >= {MIN_ROWS} THEN g.q75 WHEN l.n >= {MIN_ROWS} THEN l.q75 ELSE a.q75 END AS hi
  FROM b LEFT JOIN g ON b.lang IS NOT DISTINCT FROM g.lang AND b.source IS NOT DISTINCT FROM g.source AND b.metric = g.metric LEFT JOIN l ON b.lang IS NOT DISTINCT FROM l.lang AND b.metric = l.metric LEFT JOIN a ON b.metric = a.metric),
 v AS (SELECT rid, bool_and(coalesce(bucket <= hi + reach * (hi - lo) AND (NOT below OR bucket >= lo - reach * (hi - lo)), true)) AS good FROM q GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND good AS kept FROM m JOIN v USING (rid)"""

_ESCAPED = "length(regexp_replace({}, '<(\\\\*)\\|', '<\\\\\\1|', 'g'))"
_ORDER = "ORDER BY turn NULLS FIRST, role, txt"
ORACLE["op10_chat_format"] = f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, NULL, 1, 'assistant', '\\### Assistant: </turn> ok'),
 e AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id, alone {_ORDER}) THEN 0 ELSE 1 END AS starts FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || txt || chr(10), '' {_ORDER})) AS turns_sha256,
 coalesce(sum(length(txt)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(txt, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 (sum(starts * (24 + {_ESCAPED.format("role")})) + sum({_ESCAPED.format("txt")}) + 8 * sum(1 - starts))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id, alone"""
