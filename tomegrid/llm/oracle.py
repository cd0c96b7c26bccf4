"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

#: Unicode white space for RE2.
WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
GAP = r"[\t \x{000B}\x{000C}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BREAK = r"(?:\r\n|\n|\r)"


def _words(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _longest(parts: str) -> str:
    return f"coalesce(list_max(list_transform({parts}, lambda x: length(regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')))), 0)"


_KEYED = rf"""
c AS (SELECT row_id, split_part(content, chr(10), 1) AS head, CASE WHEN contains(content, chr(10)) THEN substr(content, strpos(content, chr(10)) + 1) ELSE '' END AS body FROM chunked WHERE content IS NOT NULL),
k AS (SELECT row_id, {_words("body")} AS w,
  list_sort(list_filter(list_transform(string_split_regex(head, '\.(?:{WS}+|$)'), lambda x: {_words("x")}), lambda x: x <> '')) AS f FROM c)
"""
ORACLES: dict[str, str] = {
    "p1_found": rf"""WITH t AS (SELECT row_id, content AS t FROM chunked WHERE length(content) > 1000),
m AS (SELECT row_id,
  {_longest(f"string_split_regex(t, '{BREAK}(?:{GAP}*{BREAK})+')")} AS b,
  {_longest(f"string_split_regex(t, '{BREAK}')")} AS l,
  {_longest(f"string_split_regex(regexp_replace(t, '([.!?;…]){WS}+', chr(92) || '1' || chr(10), 'g'), '{BREAK}')")} AS s,
  {_longest(f"string_split_regex(t, '{WS}+')")} AS w FROM t)
SELECT row_id, CASE WHEN b <= 900 THEN 'block' WHEN l <= 900 THEN 'line' WHEN s <= 900 THEN 'sentence' WHEN w <= 900 THEN 'word' ELSE 'none' END AS boundary FROM m""",
    "p2_found": rf"""WITH {_KEYED},
e AS (SELECT row_id, w, f, string_split(w, ' ') AS p FROM k WHERE w <> ''),
s AS (SELECT row_id, w, f, list_distinct(list_transform(range(1, len(p) - 1), lambda i: p[i] || ' ' || p[i + 1] || ' ' || p[i + 2])) AS g FROM e WHERE len(list_distinct(p)) >= 20),
u AS (SELECT row_id, unnest(g) AS x FROM s),
j AS (SELECT a.row_id AS ra, b.row_id AS rb, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.row_id < b.row_id GROUP BY ALL)
SELECT ra AS row_id_a, rb AS row_id_b FROM j JOIN s a ON a.row_id = ra JOIN s b ON b.row_id = rb
WHERE i * 5 >= 3 * (len(a.g) + len(b.g) - i) AND NOT (a.w = b.w AND a.f = b.f)""",
    "p3_found": f"WITH {_KEYED} SELECT min(row_id) AS kept_id, count(*) AS copies FROM k WHERE w <> '' GROUP BY w, f HAVING count(*) > 1",
    "p7_found": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM exam_items WHERE text IS NOT NULL),
x AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda n: array_to_string(w[n:n + 11], ' '))) AS g FROM i),
y AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda n: array_to_string(w[n:n + 11], ' '))) AS g FROM d)
SELECT DISTINCT doc_id, item_id FROM y JOIN x USING (g)""",
}
