"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from .corpora import EVERY, QUERY_WORDS
from .queries import K, TAGS

_NL = "chr(10)"
_LINES = f"SELECT doc_id, 'd/' || doc_id || '.txt' AS path, replace(text, {_NL}, {_NL} || {_NL}) AS content FROM documents"
_CONV = f"""SELECT conv_id AS doc_id, 'c/' || conv_id || '.md' AS path,
  string_agg(repeat('#', CAST(1 + turn % 3 AS INTEGER)) || ' ' || role || {_NL} || {_NL} || text, {_NL} || {_NL} ORDER BY turn, role, text) AS content
  FROM conversations WHERE role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id"""
_FM = f"""SELECT doc_id, source || '/' || lang || '/' || doc_id || '.md' AS path,
  '---' || {_NL} || 'tags: [' || lang || ', ' || source || ']' || {_NL} || '---' || {_NL} || text AS content, text, lang, source FROM documents"""


def _split(corpus: str) -> str:
    """CTEs up to paras(path, seq, start_line, end_line, text, heading)."""
    slots = ", ".join(f"last_value(CASE WHEN depth = {p} THEN title END IGNORE NULLS) OVER w AS s{p}" for p in range(1, 7))
    crumb = " || ".join(f"CASE WHEN dd >= {p} THEN {repr(' > ') + ' || ' if p > 1 else ''}s{p} ELSE '' END" for p in range(1, 7))
    return f"""corpus AS ({corpus}),
l0 AS (SELECT path, string_split(content, {_NL}) AS a FROM corpus),
l1 AS (SELECT path, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM l0),
l2 AS (SELECT *, regexp_full_match(line, '\\s*') AS blank, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS lv, trim(regexp_replace(line, '^#{{1,6}} ', '')) AS tt FROM l1),
l3 AS (SELECT *, CASE WHEN lv > 0 AND tt <> '' THEN lv END AS level, CASE WHEN lv > 0 AND tt <> '' THEN tt END AS title FROM l2),
l4 AS (SELECT *, count(level) OVER (PARTITION BY path ORDER BY i) AS t, sum(CASE WHEN blank THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY i) AS g FROM l3),
l5 AS (SELECT *, CASE WHEN level IS NOT NULL THEN t + min(CASE WHEN level IS NOT NULL THEN level - t END) OVER (PARTITION BY path ORDER BY i) END AS depth FROM l4),
l6 AS (SELECT *, coalesce(last_value(depth IGNORE NULLS) OVER w, 0) AS dd, {slots} FROM l5 WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paras AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY min(i)) - 1 AS INTEGER) AS seq, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line,
  string_agg(line, {_NL} ORDER BY i) AS text, arg_max({crumb}, i) AS heading FROM l6 WHERE NOT blank GROUP BY path, g)"""


#: The words of the registered queries.
_WORDS = f"""q0 AS (SELECT doc_id AS query_id, array_to_string(string_split(text, ' ')[1:{QUERY_WORDS}], ' ') AS query FROM documents WHERE doc_id % {EVERY} = 0 AND text IS NOT NULL),
q1 AS (SELECT query_id, unnest(regexp_split_to_array(lower(query), '\\s+')) AS word FROM q0),
q AS (SELECT query_id, word, count(*) AS times FROM q1 WHERE length(word) >= 3 GROUP BY ALL)"""


_SNIP = "CASE WHEN length(o) > 120 THEN substr(o, 1, 120) || '…' ELSE o END"
_ONE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_PARA = f"para AS (SELECT doc_id AS para_id, 'd/' || doc_id || '.txt' AS path, coalesce(text, '') AS text, 1 AS a, len(string_split(text, {_NL})) AS b FROM documents)"
#: Overlapping occurrences: of a word that ends as it begins, place by place; of others, by what replacing takes away.
_BORDER = "len(list_filter(range(1, length(word)), lambda k: starts_with(word, right(word, k)))) > 0"
_COUNT = f"CASE WHEN {_BORDER} THEN len(list_filter(range(1, length(t) - length(word) + 2), lambda x: substr(t, x, length(word)) = word)) ELSE (length(t) - length(replace(t, word, ''))) // length(word) END"


def _bm25(q: str) -> str:
    return f"""{q},
p AS (SELECT doc_id AS para_id, lower(coalesce(text, '')) AS t, greatest(0, length(coalesce(text, '')) - 2) AS n FROM documents),
tf AS (SELECT para_id, n, word, {_COUNT} AS tf FROM p, (SELECT DISTINCT word FROM q) WHERE contains(t, word)),
st AS (SELECT count(*) AS cn, avg(n) AS av FROM p),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (SELECT query_id, para_id, round(sum(times * greatest(ln((cn - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / av))), 9) AS score
  FROM tf JOIN df USING (word) JOIN q USING (word), st GROUP BY query_id, para_id)"""


_TAGGED = f"(SELECT doc_id FROM documents WHERE lower(lang) = '{TAGS[0]}' AND lower(source) = '{TAGS[1]}')"
_QV = f"qv AS (SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % {EVERY} = 0 AND embedding IS NOT NULL AND vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL))"


def _vec(where: str = "") -> str:
    return f"""{_QV},
ve AS (SELECT vec_id AS para_id, embedding FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND embedding IS NOT NULL {where}),
vd AS (SELECT query_id, para_id, round(sqrt(list_sum(list_transform(range(1, len(qvec) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE))))), 9) AS distance FROM ve, qv)"""


def _top(source: str, order: str, k: int, cols: str = "*", where: str = "") -> str:
    return f"SELECT {cols} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {order}, para_id) AS INTEGER) AS rank FROM {source} {where}) WHERE rank <= {k}"


def _hybrid(k: int, bm_where: str = "", vec_where: str = "") -> str:
    return f"""WITH {_bm25(_WORDS)}, {_vec(vec_where)},
tc AS ({_top('bm', 'score DESC', 50, where='WHERE query_id IN (SELECT query_id FROM qv)' + bm_where)}), vc AS ({_top('vd', 'distance', 50)}),
f AS (SELECT query_id, para_id, sum(w) AS s FROM (SELECT query_id, para_id, 0.5::DOUBLE / (60.0::DOUBLE + rank) AS w FROM tc UNION ALL SELECT query_id, para_id, 1.0::DOUBLE / (60.0::DOUBLE + rank) FROM vc) GROUP BY ALL)
{_top('f', 's DESC', k, 'query_id, para_id, rank, round(s, 9) AS score')}"""


_TEXT_HITS = f"""WITH {_bm25(_WORDS)}, {_PARA},
h AS ({_top('bm', 'score DESC', K, 'query_id, para_id, rank, CAST(1.0 AS DOUBLE) / rank AS score')}),
hits AS (SELECT query_id, rank, h.score, path AS doc, 0 AS para, a || '-' || b AS lines, {_ONE} AS o, text FROM h JOIN para USING (para_id))"""

_OLD = "SELECT 'd/' || doc_id || '.txt' AS path, text AS content, 1000 + doc_id AS mtime, sha256('v4' || chr(0) || text) AS hash FROM documents WHERE doc_id % 10 <> 3"
_NEW = """SELECT path, content, mtime, sha256('v4' || chr(0) || content) AS hash FROM (SELECT 'd/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 10 = 5 THEN text || ' changed' ELSE text END AS content,
  1000 + doc_id + CASE WHEN doc_id % 10 IN (5, 6) THEN 1 ELSE 0 END AS mtime FROM documents WHERE doc_id % 10 <> 7)"""
_SNAPS = f"old AS ({_OLD}), new AS ({_NEW})"

_EVAL = f"""WITH b AS (SELECT item_id, text FROM benchmark WHERE length(text) > 0),
w0 AS (SELECT item_id AS query_id, list_filter(string_split(text, ' '), lambda w: length(w) >= 5)[1:2] AS ws FROM b),
w1 AS (SELECT query_id, unnest(regexp_split_to_array(lower(array_to_string(ws, ' ')), '\\s+')) AS word FROM w0),
{_bm25("q AS (SELECT query_id, word, count(*) AS times FROM w1 WHERE length(word) >= 3 GROUP BY ALL)")},
h AS ({_top('bm', 'score DESC', K)}),
cases AS (SELECT item_id || '|d/' || doc_id || '.txt' AS case_id, item_id AS query_id, doc_id FROM documents d JOIN b ON contains(d.text, b.text)),
j AS (SELECT case_id, EXISTS (SELECT 1 FROM h WHERE h.query_id = cases.query_id AND h.para_id = cases.doc_id) AS recalled FROM cases)"""

_MARKUP = r"(?si)<script[ \t\n\f\r/>].*?(</script[^>]*>|$)|<style[ \t\n\f\r/>].*?(</style[^>]*>|$)|<!--.*?(-->|$)|<[a-z/!?][^>]*(>|$)"


def _page_text(head: str) -> str:
    """Text of the pages behind a text; markup first, then the references that pages hold, & last."""
    x = f"regexp_replace(coalesce(html, ''), '{_MARKUP}', ' ', 'g')"
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return f"SELECT page_id, trim(regexp_replace('{head}' || {x}, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS text FROM pages"


ORACLE: dict[str, str] = {
    "para_split": f"WITH {_split(_LINES + ' UNION ALL ' + _CONV)} SELECT path, seq, start_line, end_line, text FROM paras",
    "heading_breadcrumb": f"WITH {_split(_CONV)} SELECT path, seq, heading FROM paras",
    "frontmatter_tags": "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '' WHEN lower(lang) = lower(source) THEN lower(lang) ELSE lower(lang) || ',' || lower(source) END AS tags FROM documents",
    "auto_tags": "SELECT doc_id, lower(source) || ',' || lower(lang) || ',md' AS tags FROM documents",
    "doc_tags_merged": f"WITH f AS ({_FM}) SELECT DISTINCT doc_id, path, unnest([lower(lang), lower(source), 'md']) AS tag FROM f",
    "frontmatter_body_lines": f"""WITH n AS (SELECT *, [3, 7, 3, 3, 0][doc_id % 5 + 1] AS n_front, replace(text, chr(13) || chr(10), {_NL}) AS t FROM documents)
SELECT doc_id, CAST(n_front AS INTEGER) AS n_front, sha256('v4' || chr(0) || repeat({_NL}, n_front) || CASE WHEN n_front = 0 THEN '---' || {_NL} || 'tags: [' || lang || ', ' || source || ']' || {_NL} ELSE '' END || t) AS body_hash FROM n""",
    "add_frontmatter": f"SELECT doc_id, md5(CASE WHEN starts_with(text, '---') THEN text ELSE '---' || {_NL} || 'tags: [' || lang || ', ' || source || ']' || {_NL} || '---' || {_NL} || text END) AS digest FROM documents",
    "content_hash": "SELECT doc_id, sha256('v4' || chr(0) || text) AS hash FROM documents",
    "snippet": f"SELECT doc_id, {_SNIP} AS snippet FROM (SELECT doc_id, {_ONE} AS o FROM documents)",
    "fts_query_string": """SELECT item_id, array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: '"' || replace(w, '"', '""') || '"'), ' OR ') AS fts FROM benchmark""",
    "embed_text": f"WITH {_split(_CONV)} SELECT path, seq, md5('title: ' || CASE WHEN heading = '' THEN 'none' ELSE heading END || ' | text: ' || text) AS digest FROM paras",
    "bm25_scores": f"WITH {_bm25(_WORDS)} SELECT query_id, para_id, score FROM bm",
    "text_search_topk": f"WITH {_bm25(_WORDS)} {_top('bm', 'score DESC', K, 'query_id, para_id, rank, CAST(1.0 AS DOUBLE) / rank AS score')}",
    "text_search_tagged": f"WITH {_bm25(_WORDS)} {_top('bm', 'score DESC', K, 'query_id, para_id, rank, CAST(1.0 AS DOUBLE) / rank AS score', f'WHERE para_id IN {_TAGGED}')}",
    "vector_search_topk": f"WITH {_vec()} {_top('vd', 'distance', K, 'query_id, para_id, rank, distance')}",
    "vector_search_scores": f"WITH {_vec()}, t AS ({_top('vd', 'distance', K, 'query_id, para_id, rank, distance')}) SELECT query_id, para_id, rank, round(1.0::DOUBLE / (1.0::DOUBLE + distance), 9) AS score FROM t",
    "query_embed_text": "SELECT item_id, md5('task: search result | query: ' || text) AS digest FROM benchmark",
    "document_hashes": f"WITH {_SNAPS} SELECT coalesce(new.path, old.path) AS path, coalesce(new.hash, old.hash) AS hash, coalesce(coalesce(new.hash, old.hash) = old.hash, false) AS same FROM old FULL JOIN new ON old.path = new.path",
    "vector_search_tagged": f"WITH {_vec(f'AND vec_id IN {_TAGGED}')} {_top('vd', 'distance', K, 'query_id, para_id, rank, distance')}",
    "hybrid_search_topk": _hybrid(K),
    "hybrid_search_tagged": _hybrid(K, f" AND para_id IN {_TAGGED}", f"AND vec_id IN {_TAGGED}"),
    "rrf_fuse": _hybrid(100),
    "hydrate_hits": f"{_TEXT_HITS} SELECT query_id, rank, score, doc, para, lines, {_SNIP} AS snippet, CAST(NULL AS VARCHAR) AS heading FROM hits",
    "get_document": f"WITH c AS ({_LINES}) SELECT path, md5(content) AS digest FROM c",
    "get_paragraph_context": f"WITH {_split(_LINES)} SELECT p.path, p.seq AS para, string_agg(q.text, {_NL} || {_NL} ORDER BY q.seq) AS content FROM paras p JOIN paras q ON p.path = q.path AND q.seq BETWEEN p.seq - 1 AND p.seq + 1 GROUP BY p.path, p.seq",
    "get_line_range": f"WITH c AS ({_LINES}), a AS (SELECT path, string_split(content, {_NL}) AS x FROM c) SELECT path, array_to_string(x[3:5], {_NL}) AS content FROM a WHERE len(x) >= 3",
    "expand_bodies_budget": f"""{_TEXT_HITS}, z AS (SELECT *, sum(CASE WHEN rank <= 5 THEN length(text) ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM hits),
y AS (SELECT *, cum - CASE WHEN rank <= 5 THEN length(text) ELSE 0 END AS prev FROM z)
SELECT query_id, rank, CASE WHEN rank <= 5 AND cum <= 4000 THEN text WHEN rank <= 5 AND prev <= 4000 THEN substr(text, 1, CAST(4000 - prev AS INTEGER)) END AS body, rank <= 5 AND prev <= 4000 AND cum > 4000 AS body_truncated FROM y""",
    "tag_and_filter": f"WITH f AS ({_FM}), t AS (SELECT doc_id, path, unnest([lower(lang), lower(source), 'md']) AS tag FROM f) SELECT doc_id, path FROM t WHERE tag IN ('en', 'src1') GROUP BY doc_id, path HAVING count(DISTINCT tag) = 2",
    "upsert_classify": f"WITH {_SNAPS} SELECT coalesce(old.path, new.path) AS path, CASE WHEN new.hash IS NULL THEN 'absent' WHEN old.hash IS NULL THEN 'new' WHEN old.hash <> new.hash THEN 'changed' WHEN old.mtime <> new.mtime THEN 'touched' ELSE 'unchanged' END AS status FROM old FULL JOIN new ON old.path = new.path",
    "upsert_apply": f"WITH {_SNAPS} SELECT coalesce(new.path, old.path) AS path, coalesce(new.mtime, old.mtime) AS mtime, coalesce(new.hash, old.hash) AS hash FROM old FULL JOIN new ON old.path = new.path",
    "touch_mtime": f"WITH {_SNAPS} SELECT new.path AS path, new.mtime AS mtime FROM old JOIN new ON old.path = new.path WHERE old.hash = new.hash AND old.mtime <> new.mtime",
    "delete_cascade": f"WITH {_SNAPS}, {_split('SELECT path, content FROM old WHERE path IN (SELECT path FROM new)')} SELECT path, count(*) AS paragraphs, 2 AS tags, count(*) AS vectors FROM paras GROUP BY path",
    "prune_missing": f"WITH {_SNAPS} SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)",
    "mark_stale": f"WITH {_SNAPS} SELECT old.path AS doc, new.path IS NULL OR new.mtime <> old.mtime AS stale FROM old LEFT JOIN new ON old.path = new.path",
    "list_paths": f"WITH f AS ({_FM}) SELECT path FROM f",
    "abs_key_guard": f"WITH f AS ({_FM}) SELECT CASE doc_id % 3 WHEN 0 THEN '/' ELSE 'C:/' END || path AS path FROM f WHERE doc_id % 3 < 2",
    "eval_recall": f"{_EVAL} SELECT round(avg(CASE WHEN recalled THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS recall, CAST(count(*) FILTER (recalled) AS BIGINT) AS hits, count(*) AS cases FROM j",
    "eval_misses": f"{_EVAL} SELECT case_id FROM j WHERE NOT recalled",
    "l2_normalize_vectors": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x * 3 AS FLOAT)) AS v FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS m FROM e),
u AS (SELECT vec_id, list_transform(v, lambda x: CAST(CAST(x AS DOUBLE) / m AS FLOAT)) AS v FROM n)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm, round(CAST(v[1] AS DOUBLE), 5) AS first, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CAST(round(CAST(v[i] AS DOUBLE) * 1e3) AS BIGINT) * i)) AS BIGINT) AS weighted FROM u""",
    "ingest_filter_files": """WITH f AS (SELECT doc_id, 'd/' || doc_id || ['.md', '.py', '.txt', '.GO', ''][CAST(doc_id % 5 + 1 AS INTEGER)] AS path, length(text) AS n FROM documents)
SELECT path, CASE WHEN doc_id % 5 IN (1, 3) THEN 'excluded' WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 OR n = 0 THEN 'skipped' ELSE 'indexed' END AS verdict FROM f""",
    "html_convert": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(coalesce(html, ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""",
    "html_text_pages": _page_text(""),
    "html_text_hard": _page_text("1 < 2 a <b>bold</b> ééé…¬areference;"),
    "hash_embed": """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS x, unnest(range(1, length(text) + 1)) AS i FROM documents WHERE length(text) > 0),
o AS (SELECT doc_id, unicode(x) % 13 AS v, coalesce(sum(octet_length(encode(x))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c),
s AS (SELECT doc_id, sum(v) AS total, sum((place % 768) * v) AS weighted FROM o GROUP BY doc_id)
SELECT doc_id, 768 AS dim, CAST(coalesce(total, 0) AS BIGINT) AS total, CAST(coalesce(weighted, 0) AS BIGINT) AS weighted FROM documents LEFT JOIN s USING (doc_id)""",
    "knn_join": """WITH q AS (SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
d AS (SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(qvec) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE)) * (CAST(embedding[i] AS DOUBLE) - CAST(qvec[i] AS DOUBLE))))), 9) AS distance
  FROM embeddings, q WHERE len(embedding) = len(qvec))
SELECT * FROM (SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10""",
    "bm25_from_postings": f"WITH {_bm25(_WORDS)} SELECT query_id, para_id, score FROM bm",
    "text_topk_from_postings": f"WITH {_bm25(_WORDS)} {_top('bm', 'score DESC', K, 'query_id, para_id, rank, score')}",
    "get_paragraph_context_wide": f"WITH {_split(_LINES)} SELECT p.path, p.seq AS para, md5(string_agg(q.text, {_NL} || {_NL} ORDER BY q.seq)) AS digest FROM paras p JOIN paras q ON p.path = q.path AND q.seq BETWEEN p.seq - 50 AND p.seq + 50 GROUP BY p.path, p.seq",
    "catalog_state": f"""WITH {_SNAPS}, {_split('SELECT path, content FROM new')}, n AS (SELECT path, count(*) AS paragraphs, CAST(sum(greatest(0, length(text) - 2)) AS BIGINT) AS places FROM paras GROUP BY path)
SELECT path, mtime, hash, coalesce(paragraphs, 0) AS paragraphs, coalesce(places, 0) AS places FROM new LEFT JOIN n USING (path)""",
    "catalog_statuses": f"WITH {_SNAPS} SELECT new.path AS path, CASE WHEN old.hash IS NULL THEN 'new' WHEN old.hash <> new.hash THEN 'changed' WHEN old.mtime <> new.mtime THEN 'touched' ELSE 'unchanged' END AS status FROM new LEFT JOIN old ON old.path = new.path",
    "track_listings": f"WITH {_SNAPS} SELECT coalesce(old.path, new.path) AS path, CASE WHEN new.hash IS NULL THEN 'absent' WHEN old.hash IS NULL THEN 'new' WHEN old.hash <> new.hash THEN 'changed' WHEN old.mtime <> new.mtime THEN 'touched' ELSE 'unchanged' END AS status FROM old FULL JOIN new ON old.path = new.path",
}
