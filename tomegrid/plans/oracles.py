"""DuckDB SQL for the core queries."""

from __future__ import annotations

from tomegrid.operators.rag import RULES
from tomegrid.plans.registry import IMAGE_QUERY, K, TEXT_DIM, TEXT_QUERY

#: Unicode white space for RE2.
WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ORACLES: dict[str, str] = {}


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


_LINES = r"""
lines AS (
  SELECT file_name AS doc, unnest(range(len(p))) AS pos, unnest(p) AS line
  FROM (SELECT file_name, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS p FROM md_files WHERE text IS NOT NULL))
"""
_CLASSIFIED = rf"""{_LINES},
c0 AS (SELECT doc, pos, {_strip("line")} AS l FROM lines),
c1 AS (SELECT *, CASE
    WHEN l = '' THEN 'blank'
    WHEN regexp_matches(l, '^###{WS}+.+$') THEN 'document'
    WHEN regexp_matches(l, '^##{WS}+Раздел{WS}+\d+{WS}*.*$') THEN 'section'
    WHEN regexp_matches(l, '^#{WS}+Глава{WS}+\d+\.\d+{WS}*[-–:]{WS}*.*$') AND NOT contains(l, 'Таблица') AND NOT contains(l, 'Примечание') THEN 'chapter'
    WHEN regexp_matches(l, '^#{WS}+.+$') AND NOT contains(l, 'Глава') AND NOT contains(l, 'Таблица') AND NOT contains(l, 'Примечание') THEN 'paragraph'
    WHEN regexp_matches(l, '^\(\d+\.\d+\.\d+\){WS}+.*$') OR regexp_matches(l, '^\d+\.\d+\.\d+\.{WS}+.*$') THEN 'clause'
    ELSE 'text' END AS kind FROM c0),
c2 AS (SELECT doc, pos, l, kind,
    CASE WHEN kind = 'document' THEN regexp_extract(l, '^###{WS}+(.+)$', 1) END AS sd,
    CASE WHEN kind = 'section' THEN rtrim('Раздел ' || regexp_extract(l, '^##{WS}+Раздел{WS}+(\d+)', 1) || ' ' || regexp_extract(l, '^##{WS}+Раздел{WS}+\d+{WS}*(.*)$', 1)) END AS ss,
    CASE WHEN kind = 'chapter' THEN 'Глава ' || regexp_extract(l, '^#{WS}+Глава{WS}+(\d+\.\d+)', 1)
      || CASE WHEN regexp_extract(l, '^#{WS}+Глава{WS}+\d+\.\d+{WS}*[-–:]{WS}*(.*)$', 1) <> '' THEN ' - ' || regexp_extract(l, '^#{WS}+Глава{WS}+\d+\.\d+{WS}*[-–:]{WS}*(.*)$', 1) ELSE '' END END AS sc,
    CASE WHEN kind = 'paragraph' THEN regexp_extract(l, '^#{WS}+(.+)$', 1) END AS sp,
    CASE WHEN kind = 'clause' THEN regexp_extract(l, '^\(?(\d+\.\d+\.\d+)', 1) END AS sl
  FROM c1)
"""
_CARRIED = f"""{_CLASSIFIED},
c3 AS (SELECT *,
    sum((kind IN ('section'))::INT) OVER w AS ec, sum((kind IN ('section','chapter'))::INT) OVER w AS ep, sum((kind IN ('section','chapter','paragraph'))::INT) OVER w AS el
  FROM c2 WINDOW w AS (PARTITION BY doc ORDER BY pos)),
c4 AS (SELECT doc, pos, l, kind AS k0,
    coalesce(last_value(sd IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') AS document,
    coalesce(last_value(ss IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos), '') AS section,
    coalesce(last_value(sc IGNORE NULLS) OVER (PARTITION BY doc, ec ORDER BY pos), '') AS chapter,
    coalesce(last_value(sp IGNORE NULLS) OVER (PARTITION BY doc, ep ORDER BY pos), '') AS paragraph,
    coalesce(last_value(sl IGNORE NULLS) OVER (PARTITION BY doc, el ORDER BY pos), '') AS clause
  FROM c3),
c5 AS (SELECT *, CASE WHEN k0 <> 'text' THEN k0 WHEN paragraph <> '' OR clause <> '' THEN 'content' ELSE 'orphan' END AS kind FROM c4)
"""
_CHUNKS = f"""{_CARRIED},
d1 AS (SELECT *, kind NOT IN ('blank', 'orphan') AS rec FROM c5),
d2 AS (SELECT *,
    last_value(CASE WHEN rec AND paragraph <> '' THEN paragraph END IGNORE NULLS) OVER b AS pp,
    last_value(CASE WHEN rec AND chapter <> '' THEN chapter END IGNORE NULLS) OVER b AS pc
  FROM d1 WINDOW b AS (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d3 AS (SELECT *, (rec AND ((paragraph <> '' AND paragraph IS DISTINCT FROM pp) OR (chapter <> '' AND chapter IS DISTINCT FROM pc)))::INT AS top FROM d2),
d4 AS (SELECT *, sum(top) OVER (PARTITION BY doc ORDER BY pos) AS run FROM d3),
d5 AS (SELECT *, last_value(nullif(clause, '') IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pl FROM d4),
d6 AS (SELECT *, (top = 1 OR (rec AND clause <> '' AND pl IS NOT NULL AND clause <> pl))::INT AS brk FROM d5),
d7 AS (SELECT *, sum(brk) OVER (PARTITION BY doc ORDER BY pos) AS chunk, kind IN ('clause', 'content') AS says FROM d6),
d8 AS (SELECT doc, chunk,
    string_agg(CASE WHEN says THEN l ELSE '' END, chr(10) ORDER BY pos) FILTER (WHERE says OR NOT rec) AS t,
    max(document) FILTER (WHERE FALSE) AS unused,
    coalesce(arg_max(document, pos) FILTER (WHERE rec AND document <> ''), '') AS document,
    coalesce(arg_max(section, pos) FILTER (WHERE rec AND section <> ''), '') AS section,
    coalesce(arg_max(chapter, pos) FILTER (WHERE says), '') AS chapter,
    coalesce(arg_max(paragraph, pos) FILTER (WHERE says), '') AS paragraph,
    coalesce(arg_max(clause, pos) FILTER (WHERE says), '') AS clause
  FROM d7 GROUP BY doc, chunk HAVING bool_or(says))
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY chunk) AS ordinal, document, section, chapter, paragraph, clause, {_strip("t")} AS text FROM d8
"""
ORACLES |= {
    "scan_glob_filter": r"SELECT path, NOT contains(path, '/') AS top_level FROM file_catalog WHERE is_file AND regexp_matches(lower(path), '\.(png|jpg|jpeg|gif|bmp|webp)$')",
    "doc_lines": f"WITH {_LINES} SELECT doc, pos, line FROM lines",
    "jsonl_scan": "SELECT id, coalesce(content, '') AS text FROM chunked",
    "docx_rels": "SELECT DISTINCT doc, r_id, rel_type, target, member FROM docx_rels WHERE contains(lower(rel_type), 'image') AND r_id <> '' AND target <> ''",
    "table_rows_to_md": "SELECT chapter, '| N | Название |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || title_id || ' | ' || replace(title, chr(10), '<br>') || ' |', chr(10) ORDER BY title_id) AS md FROM toc GROUP BY chapter",
    "chunk_sink_roundtrip": r"SELECT regexp_replace(coalesce(metadata.source_file, 'none'), '\.md$', '') || '.chunked.jsonl' AS file_name, count(*) AS chunks, sum(length(coalesce(content, '')))::BIGINT AS chars FROM chunked GROUP BY 1",
    "markdown_tree": r"SELECT b || file_name AS file_name, length(t) AS chars, md5(t) AS digest FROM (SELECT file_name, regexp_replace(text, '\r\n?', chr(10), 'g') || chr(10) AS t FROM md_files WHERE text <> ''), (VALUES ('a/'), ('b/c +d%/')) v(b)",
    "scan_files": """WITH f AS (SELECT CASE WHEN length(file_name) % 2 = 0 THEN 'sub dir/' || file_name ELSE file_name END AS file_name FROM md_files)
SELECT file_name, TRUE AS recursive FROM f UNION ALL SELECT file_name, FALSE FROM f WHERE NOT contains(file_name, '/')""",
    "classify_lines": f"WITH {_CLASSIFIED} SELECT doc, pos, kind, coalesce(sd, '') AS set_document, coalesce(ss, '') AS set_section, coalesce(sc, '') AS set_chapter, coalesce(sp, '') AS set_paragraph, coalesce(sl, '') AS set_clause FROM c2",
    "carry_forward_metadata": f"WITH {_CARRIED} SELECT doc, pos, kind, document, section, chapter, paragraph, clause FROM c5",
    "chunk_documents": f"WITH {_CHUNKS}",
    "chunk_documents_strict": f"WITH {_CHUNKS}",
    "stream_ingest": f"WITH {_CHUNKS}",
}
ORACLES["chunk_objects"] = f"""WITH x AS (WITH {_CHUNKS}),
h AS (SELECT *, concat_ws('. ', nullif(document, ''), nullif(section, ''), nullif(chapter, ''), nullif(paragraph, ''), CASE WHEN clause <> '' THEN 'Пункт ' || clause END) AS h,
  left(md5(concat_ws(chr(1), doc, ordinal::VARCHAR, text)), 8) AS m FROM x)
SELECT doc, ordinal, CASE WHEN clause <> '' THEN 'pue_' || clause || '_' || m WHEN paragraph <> '' THEN 'pue_para_' || paragraph || '_' || m ELSE 'pue_unknown_' || m END AS id,
  CASE WHEN h = '' THEN text ELSE h || '.' || chr(10) || chr(10) || text END AS content, doc AS source_file,
  contains(text, '# Таблица') OR contains(text, '|') AS contains_tables, contains(text, '![') AS contains_images, TRUE AS stamped FROM h"""
ORACLES["docx_to_md"] = rf"""WITH {_LINES},
m AS (SELECT doc, pos, trim(regexp_replace(line, '[\s\x{{00A0}}]+', ' ', 'g')) AS x FROM lines)
SELECT f.file_name AS doc, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY pos), '') AS text
FROM md_files f LEFT JOIN m ON m.doc = f.file_name AND x <> '' AND NOT regexp_matches(x, '^#{{1,6}}$') WHERE f.text IS NOT NULL GROUP BY f.file_name"""
ORACLES["html_to_markdown"] = rf"""WITH {_LINES},
m AS (SELECT doc, pos, trim(regexp_replace(line, '[\s\x{{00A0}}]+', ' ', 'g')) AS x FROM lines)
SELECT f.file_name, '# ' || f.file_name || coalesce(string_agg(chr(10) || chr(10) || x, '' ORDER BY pos), '') AS md
FROM md_files f LEFT JOIN m ON m.doc = f.file_name AND x <> '' WHERE f.text IS NOT NULL GROUP BY f.file_name
UNION ALL SELECT file_name, NULL FROM md_files WHERE text IS NULL"""
_REFS = rf"""
SELECT DISTINCT doc, ref FROM (
  SELECT file_name AS doc, {_strip("unnest(regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1))").replace(chr(92) * 2, chr(92))} AS ref FROM md_files)
WHERE starts_with(ref, 'image_')
"""
ORACLES |= {
    "image_refs": _REFS,
    "image_copy_plan": f"SELECT r.doc, r.ref, EXISTS (SELECT 1 FROM file_catalog f WHERE f.is_file AND f.path = r.ref) AS exists FROM ({_REFS}) r",
}
_MEMBERS = r"""
i AS (SELECT DISTINCT doc, r_id, target FROM docx_rels WHERE contains(lower(rel_type), 'image') AND r_id <> '' AND target <> ''),
t AS (SELECT *, regexp_extract(target, '([^/]*)$', 1) AS base FROM i),
c AS (
  SELECT doc, r_id, target, 0 AS p, CASE
    WHEN starts_with(target, 'media/') THEN 'word/' || target
    WHEN starts_with(target, '../media/') THEN 'word/' || substr(target, 4)
    WHEN contains(target, '/') THEN CASE WHEN starts_with(target, 'word/') THEN target ELSE 'word/' || target END
    ELSE 'word/media/' || target END AS member FROM t
  UNION ALL SELECT doc, r_id, target, 1, 'word/media/' || base FROM t
  UNION ALL SELECT doc, r_id, target, 2, 'word/' || target FROM t
  UNION ALL SELECT doc, r_id, target, 3, target FROM t),
m AS (SELECT DISTINCT doc, member FROM docx_rels WHERE member IS NOT NULL),
r AS (SELECT doc, r_id, target, arg_min(c.member, p) AS member FROM c JOIN m USING (doc, member) GROUP BY ALL)
"""
ORACLES |= {
    "path_resolve_priority": f"WITH {_MEMBERS} SELECT doc, r_id, target, member FROM r",
    "image_name_dedup": rf"""WITH {_MEMBERS},
n AS (SELECT doc, r_id, target, TRY_CAST(regexp_extract(r_id, '(\d+)', 1) AS INT) AS n, regexp_extract(target, '([^/]*)$', 1) AS base FROM r),
p AS (SELECT *, CASE WHEN contains(base, '.') THEN base ELSE printf('image%03d.png', row_number() OVER (PARTITION BY doc ORDER BY n, r_id, target)) END AS name FROM n),
a AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY n, r_id, target) - 1 AS again FROM p)
SELECT doc, r_id, target, CASE WHEN again > 0 THEN regexp_extract(name, '^(.*)(\.[^.]*)$', 1) || '_' || again || regexp_extract(name, '^(.*)(\.[^.]*)$', 2) ELSE name END AS img_name FROM a""",
    "img_tag_to_md": r"SELECT file_name, regexp_replace(text, '!\[\]\(((?:[^)\n]*/)?([^)/\n]+))\)', '![\2](\1)', 'g') AS md FROM md_files",
    "md_data_uri_extract": "SELECT title_id, 'x ![image](image_toc/img_' || left(md5(title), 8) || '.png) y' AS md FROM toc",
    "data_uri_extract": """WITH t AS (SELECT * FROM toc UNION ALL SELECT * FROM toc WHERE title_id % 3 = 0), r AS (SELECT chapter, title_id, row_number() OVER (PARTITION BY chapter ORDER BY title_id, title) - 1 AS pos, title AS b FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY chapter, left(md5(b), 8) ORDER BY pos) - 1 AS n FROM r)
SELECT chapter, pos, 'img_' || left(md5(b), 8) || CASE WHEN n > 0 THEN '_' || n ELSE '' END || '.png' AS img_name, strlen(b) AS bytes, md5(b) AS md5 FROM n""",
    "clean_hidden_tags_md": rf"SELECT file_name, regexp_replace(regexp_replace(regexp_replace(text, '\. ', '. #G0 12 ', 'g'), '{WS}*#[A-Za-z](?:[0-9]+(?:{WS}+[0-9]+)*)?{WS}*', '', 'g'), '{WS}{{3,}}', chr(10) || chr(10), 'g') AS md FROM md_files",
    "clean_hidden_tags_para": rf"WITH {_LINES} SELECT doc, pos, {_strip(f"regexp_replace(regexp_replace(regexp_replace(line, '\\. ', '. #G0 12 ', 'g'), '{WS}*#[A-Za-z](?:[0-9]+(?:{WS}+[0-9]+)*)?{WS}*', '', 'g'), '{WS}{{2,}}', ' ', 'g')")} AS line FROM lines".replace("\\\\. ", "\\. "),
    "merge_split_headers": rf"""WITH {_LINES},
a AS (SELECT doc, pos, line, {_strip("line")} AS l FROM lines),
b AS (SELECT *, regexp_matches(line, '^#{{1,6}}{WS}+.+$') AS head, l = '' OR contains(l, '|') OR regexp_matches(l, '^(#{{1,6}}{WS}|[-*+]{WS}|\d+\.{WS}|```|[-*]{{3,}}$)') AS stops, regexp_matches(l, '[.!?;:]$') AS ended FROM a),
c AS (SELECT *, sum((head OR stops)::INT) OVER (PARTITION BY doc ORDER BY pos) AS g FROM b),
d AS (SELECT *, first_value(head) OVER w AS headed, coalesce(max(ended::INT) OVER (PARTITION BY doc, g ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shut, first_value(pos) OVER w AS start
  FROM c WINDOW w AS (PARTITION BY doc, g ORDER BY pos)),
e AS (SELECT *, CASE WHEN headed AND shut = 0 THEN start ELSE pos END AS unit, headed AND shut = 0 AS joined FROM d)
SELECT doc, unit AS pos, CASE WHEN bool_or(joined) THEN regexp_replace(string_agg(l, ' ' ORDER BY pos), '^(#{{1,6}}){WS}+', '\1 ') ELSE any_value(line) END AS line FROM e GROUP BY doc, unit""",
    "context_header": """SELECT row_id, CASE WHEN h = '' THEN '' ELSE h || '.' END AS header FROM (SELECT row_id, concat_ws('. ', nullif(metadata.Document, ''), nullif(metadata.Section, ''), nullif(metadata.Chapter, ''), nullif(metadata.Paragraph, ''),
CASE WHEN metadata.Clause <> '' THEN 'Пункт ' || metadata.Clause END) AS h FROM chunked WHERE metadata IS NOT NULL)""",
    "chunk_flags": "SELECT row_id, contains(content, '# Таблица') OR contains(content, '|') AS contains_tables, contains(content, '![') AS contains_images FROM chunked WHERE content IS NOT NULL",
    "chunk_ids": """WITH c AS (SELECT row_id, coalesce(metadata.Clause, '') AS l, coalesce(metadata.Paragraph, '') AS p, left(md5(concat_ws(chr(1), coalesce(metadata.source_file, ''), row_id::VARCHAR, content)), 8) AS m FROM chunked WHERE content IS NOT NULL)
SELECT row_id, CASE WHEN l <> '' THEN 'pue_' || l || '_' || m WHEN p <> '' THEN 'pue_para_' || p || '_' || m ELSE 'pue_unknown_' || m END AS chunk_id FROM c""",
    "model_dim_lookup": "WITH a AS (SELECT model_name FROM model_dims UNION SELECT model_name || '-next' FROM model_dims) SELECT a.model_name, coalesce(min(m.text_dim), 768) AS text_dim FROM a LEFT JOIN model_dims m ON a.model_name = m.model_name GROUP BY a.model_name",
    "chapter_from_filename": r"""WITH n AS (SELECT DISTINCT metadata.source_file AS s FROM chunked WHERE metadata.source_file IS NOT NULL), u AS (SELECT s FROM n UNION ALL SELECT regexp_replace(s, '\.md$', '.chunked.jsonl') FROM n)
SELECT s AS source_file, CASE WHEN ends_with(s, '.chunked.jsonl') THEN left(s, length(s) - 14) ELSE regexp_replace(s, '(.)\.[^.]*$', '\1') END AS chapter FROM u""",
}
_CLEAN = rf"""regexp_extract(trim(trim({_strip("trim(" + _strip("x") + ", '<>')")}, '"'), ''''), '^{WS}*([^\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]*)', 1)"""
_EXTRACTED = rf"""
x AS (SELECT row_id, metadata, content, regexp_extract_all(coalesce(content, ''), '!\[[^\]]*\]\(([^)]+)\)', 1, 'i') || regexp_extract_all(coalesce(content, ''), '<img[^>]+src=[''"]([^''"]+)[''"]', 1, 'i') AS named FROM chunked),
y AS (SELECT row_id, metadata, content, CASE WHEN len(named) > 0 THEN named ELSE regexp_extract_all(coalesce(content, ''), '([^\s\)\]]+\.(?:png|jpg|jpeg|gif|webp))', 1, 'i') END AS refs FROM x),
z AS (SELECT row_id, metadata, content, list_sort(list_distinct(list_filter(list_transform(refs, lambda x: {_CLEAN}), lambda r: r <> '' AND NOT regexp_matches(lower(r), '^(https?://|data:)')))) AS refs FROM y)
"""
ORACLES |= {
    "extract_image_refs": f"WITH {_EXTRACTED} SELECT row_id, array_to_string(refs, chr(10)) AS refs FROM z WHERE len(refs) > 0",
    "merge_image_paths": f"WITH {_EXTRACTED} SELECT row_id, array_to_string(CASE WHEN row_id % 2 = 0 THEN list_sort(list_distinct(refs || ['extra/z.png'])) ELSE refs END, chr(10)) AS image_paths FROM z",
    "image_paths_json": f"WITH {_EXTRACTED} SELECT row_id, CAST(to_json(refs) AS VARCHAR) AS image_paths, len(refs) > 0 AS has_image FROM z",
    "chunk_image_paths": rf"""WITH {_EXTRACTED},
r AS (SELECT row_id, regexp_replace(regexp_replace(metadata.source_file, '-r\d+\.md$', '.md'), '(.)\.[^.]*$', '\1') AS chapter, replace(unnest(refs), chr(92), '/') AS ref FROM z),
c AS (SELECT row_id, ref, 0 AS p, ref AS path FROM r UNION ALL SELECT row_id, ref, 1, 'image_' || chapter || '/' || ref FROM r WHERE NOT starts_with(ref, '/')),
b AS (SELECT row_id, ref, arg_min(c.path, p) AS path FROM c JOIN (SELECT DISTINCT path FROM file_catalog WHERE is_file) f USING (path) GROUP BY row_id, ref)
SELECT row_id, string_agg(DISTINCT path, chr(10) ORDER BY path) AS image_paths FROM b GROUP BY row_id""",
    "load_chunks": rf"""WITH {_EXTRACTED},
p AS (SELECT row_id, coalesce(metadata.source_file, '') AS s, regexp_replace(coalesce(metadata.source_file, ''), '(.)\.[^.]*$', '\1') AS chapter, coalesce(content, '') AS text, refs FROM z)
SELECT coalesce(nullif(c.id, ''), p.chapter || '_' || p.row_id) AS chunk_id, p.text, array_to_string(p.refs, chr(10)) AS image_paths, p.s AS source_file, p.chapter, len(p.refs) > 0 AS has_image,
  512 AS image_dim, coalesce(k.n, 0) AS components, {TEXT_DIM} AS text_dim
FROM p JOIN chunked c USING (row_id) LEFT JOIN (
  SELECT row_id, count(*)::INT AS n FROM (
    SELECT row_id, ('0x' || left(md5(w), 7))::BIGINT % {TEXT_DIM} AS pos, sum(CASE WHEN ('0x' || substr(md5(w), 8, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS v
    FROM (SELECT row_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM p) GROUP BY ALL) WHERE v <> 0 GROUP BY row_id) k USING (row_id)""",
    "load_summary": f"WITH {_EXTRACTED} SELECT coalesce(metadata.source_file, '') AS source_file, count(*) AS chunks, sum(len(refs))::BIGINT AS images, CAST(ceil(count(*) / 32.0) AS BIGINT) AS batches FROM z GROUP BY 1",
    "skip_existing_anti": "SELECT row_id, id AS chunk_id FROM chunked c WHERE NOT EXISTS (SELECT 1 FROM chunked s WHERE s.row_id % 2 = 0 AND s.id = c.id)",
    "embed_hashing": rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, md5(w) AS m FROM t), s AS (SELECT doc_id, ('0x' || left(m, 7))::BIGINT % {TEXT_DIM} AS pos, CASE WHEN ('0x' || substr(m, 8, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS g FROM h),
b AS (SELECT doc_id, pos, sum(g)::DOUBLE AS v FROM s GROUP BY ALL), n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM b GROUP BY doc_id)
SELECT doc_id, CAST(pos AS INT) AS pos, round(v / n, 6) AS value FROM b JOIN n USING (doc_id) WHERE v <> 0""",
    "embed_image_bytes": "SELECT title_id, 512 AS dim, 1.0::DOUBLE AS norm FROM toc",
    "l2_normalize": """WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 * (vec_id % 7)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM e)
SELECT vec_id, CAST(unnest(range(len(v))) AS INT) AS pos, round(unnest(list_transform(v, lambda x: CASE WHEN n = 0 THEN 0 ELSE x / n END)), 6) AS value FROM n""",
    "vector_mean": "WITH u AS (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings) SELECT label, CAST(pos AS INT) AS pos, round(avg(v), 6) AS value FROM u GROUP BY label, pos",
}
_COS = "CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0 ELSE round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6) END"
_ROWS = f"""
rows AS (SELECT vec_id AS id, embedding::DOUBLE[] AS tv, CASE WHEN vec_id % 5 <> 0 THEN list_reverse(embedding::DOUBLE[]) ELSE list_resize([]::DOUBLE[], {TEXT_DIM}, 0.0) END AS iv, label AS chapter, vec_id % 5 <> 0 AS has_image FROM embeddings),
ts AS (SELECT r.*, {_COS.format(a="r.tv", b="q.tv")} AS score FROM rows r, (SELECT tv FROM rows WHERE id = {TEXT_QUERY}) q),
vs AS (SELECT r.*, {_COS.format(a="r.iv", b="q.iv")} AS score FROM rows r, (SELECT iv FROM rows WHERE id = {IMAGE_QUERY + 1}) q)
"""
_BEST = "ORDER BY score DESC, id LIMIT "
ORACLES |= {
    "topk_cosine": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS.format(a="e.embedding::DOUBLE[]", b="q.embedding::DOUBLE[]")} AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= {K}""",
    "topk_single": f"WITH {_ROWS} SELECT id, score FROM ts {_BEST} {K}",
    "topk_filter_eq": f"WITH {_ROWS} SELECT id, score, chapter FROM ts WHERE chapter = 3 {_BEST} {K}",
    "topk_filter_and": f"WITH {_ROWS} SELECT id, score, chapter FROM ts WHERE chapter = 3 AND has_image {_BEST} {K}",
    "topk_image_zero": f"WITH {_ROWS} SELECT id, score, has_image FROM vs {_BEST} {K}",
    "hit_format": f"WITH {_ROWS} SELECT id, score, CASE WHEN id % 2 = 0 THEN 't' || id ELSE '' END AS text, has_image::INT AS n_images, CASE WHEN has_image THEN 'p' || id ELSE '' END AS image_paths, 'text' AS search_type FROM (SELECT * FROM ts {_BEST} {K})",
    "backfill_text_join": f"WITH {_ROWS} SELECT t.id, t.score, coalesce(d.text, '') AS text FROM (SELECT * FROM ts {_BEST} {K}) t LEFT JOIN documents d ON d.doc_id = t.id",
    "hybrid_fusion": f"""WITH {_ROWS}, t AS (SELECT id, score FROM ts {_BEST} {2 * K}), i AS (SELECT id, score FROM vs {_BEST} {2 * K})
SELECT coalesce(t.id, i.id) AS id, coalesce(t.score, i.score) AS score, round(coalesce(t.score, 0) * 0.7 + coalesce(i.score, 0) * 0.3, 6) AS fused_score, CASE WHEN t.id IS NOT NULL THEN 'text' ELSE 'image' END AS search_type
FROM t FULL JOIN i ON t.id = i.id ORDER BY fused_score DESC, 1 LIMIT {K}""",
    "hybrid_text_only": f"WITH {_ROWS} SELECT id, score FROM ts {_BEST} {K}",
    "collection_stats": "SELECT 'chunks' AS name, count(*) AS num_entities, 'id,text_vector,image_vector,chapter,has_image' AS fields, 'text_vector,image_vector' AS indexes FROM embeddings",
    "parse_meta": """SELECT 'About. text_model=' || model_name || ', text_dim=' || text_dim AS description, model_name AS text_model, text_dim FROM model_dims
UNION ALL SELECT '', NULL, NULL FROM model_dims UNION ALL SELECT 'text_model=' || model_name, NULL, NULL FROM model_dims""",
    "meta_mismatch": "SELECT model_name, CASE WHEN text_dim <> 768 THEN model_name ELSE 'default' END AS used, CASE WHEN text_dim <> 768 THEN text_dim ELSE 384 END AS dim, text_dim NOT IN (768, 384) AS mismatch FROM model_dims",
    "hit_snippets": f"WITH {_ROWS}, t AS (SELECT * FROM ts {_BEST} {K}) SELECT row_number() OVER (ORDER BY score DESC, id) AS rank, id, round(score, 4) AS score, left('text ' || id, 6) AS snippet, 'x.png,' || id || '.png,z.png' AS images, 4 AS n_images FROM t",
    "rerank_two_stage": f"""WITH {_ROWS},
s AS (SELECT q.id AS query_id, r.id, {_COS.format(a="r.tv", b="q.tv")} AS score, r.iv AS a, q.iv AS b FROM rows q JOIN rows r ON q.id % 20 = 0 AND q.id <> r.id),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 20),
g AS (SELECT query_id, id, CAST({_COS.format(a="a", b="b")} AS DOUBLE) AS rerank_score FROM f)
SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM g QUALIFY rank <= 5""",
    "rag_prompt": rf"""WITH c AS (SELECT row_id, metadata.Clause AS clause, regexp_extract(metadata.Clause, '^(\d+\.\d+)\.', 1) AS chapter, content FROM chunked WHERE content IS NOT NULL AND metadata.Clause <> ''),
b AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY length(content), row_id) AS rank FROM c QUALIFY rank <= 3)
SELECT item_id AS query_id, '{RULES}' || chr(10) || string_agg('Контекст из п. ' || clause || ': "' || content || '"', chr(10) ORDER BY rank) || chr(10) || 'Вопрос: ' || any_value(e.text) AS prompt
FROM exam_items e JOIN b ON e.chapter = b.chapter GROUP BY item_id""",
    "status_label": """SELECT row_id, CASE WHEN regexp_matches(content, '(?i)(должн|запреща|не допускается|необходимо|обязательн)') THEN 'mandatory'
WHEN regexp_matches(content, '(?i)(рекоменду|допускается|разрешается|может|могут|следует)') THEN 'recommended' ELSE 'none' END AS status FROM chunked WHERE content IS NOT NULL""",
    "dialog_context": """SELECT user_id, event_id, coalesce(array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS history FROM events""",
    "embed_prefix": "WITH m AS (SELECT regexp_replace(model_name, 'enc-mid', 'e5-mid') AS model_name FROM model_dims) SELECT model_name, CASE WHEN contains(model_name, 'e5') THEN 'query: x' ELSE 'x' END AS asked, CASE WHEN contains(model_name, 'e5') THEN 'passage: x' ELSE 'x' END AS told FROM m",
}
