"""DuckDB SQL of the corpus operators' queries, where SQL can express them."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every subset of a URL's tokens is a bit mask; a passing one without a passing proper subset is a rule.
OP9 = rf"""
WITH parsed AS (SELECT page_id, url, coalesce({_LOWER.format(r"regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1)")}, '') host, coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) verdict FROM (SELECT DISTINCT page_id, host, path FROM parsed) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
tokens AS (SELECT page_id, list_distinct(list_concat(
  list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x),
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g')),
  list_transform(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || regexp_extract(x, '^([^=]*)', 1)))) own FROM parsed WHERE url IS NOT NULL),
sets AS (SELECT page_id, list_sort(list_transform(list_filter(generate_series(1, len(own)), lambda i: (m >> (i - 1)) & 1 = 1), lambda i: own[i])) s FROM (SELECT page_id, own, unnest(generate_series(1, (1 << len(own)) - 1)) m FROM tokens)),
labelled AS (SELECT page_id, verdict = 'block' bad FROM fit), total AS (SELECT count(*) n, avg(CAST(bad AS INTEGER)) share FROM labelled),
passing AS (SELECT s, count(*) FILTER (bad) / count(*) confidence FROM sets JOIN labelled USING (page_id) GROUP BY s
  HAVING count(*) FILTER (bad) >= (SELECT greatest(20, ceil(0.002 * n)) FROM total) AND count(*) FILTER (bad) / count(*) >= 0.8 AND count(*) FILTER (bad) / count(*) > (SELECT share FROM total)),
mined AS (SELECT s, confidence FROM passing a WHERE NOT EXISTS (SELECT 1 FROM passing b WHERE len(b.s) < len(a.s) AND list_has_all(a.s, b.s))),
fired AS (SELECT page_id, max(confidence) confidence FROM sets JOIN mined USING (s) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END) verdict, CASE WHEN f.verdict IS NULL THEN confidence END confidence
FROM parsed LEFT JOIN fit f USING (page_id) LEFT JOIN fired USING (page_id)"""

_UNIT = "list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i])) / (a.n * b.n)"

#: Every two vectors are compared, and the links closed step by step.
OP3 = f"""
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) v FROM embeddings),
ok AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) n FROM x WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
links AS (SELECT a.vec_id a, b.vec_id b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.v) = len(b.v) AND {_UNIT} >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) n_links, least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) component_id FROM embeddings)
SELECT vec_id, n_links, component_id, vec_id = component_id kept FROM c"""

_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows as lists of words, by their number of words; hits in a row on one diagonal are one longer match.
OP10 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} w FROM documents), i AS (SELECT item_id, {_WORDS} w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT item_id, q, n, list_slice(w, q, q + n - 1) s FROM (SELECT item_id, w, least(len(w), 10) n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) q FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
po AS (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) s FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, po.n, item_id, q FROM po JOIN wins ON wins.n = po.n AND wins.s = po.s),
words AS (SELECT doc_id, count(DISTINCT h) n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) h FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) n_items, string_agg(id, ',' ORDER BY id) ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) id FROM hits) GROUP BY 1),
runs AS (SELECT doc_id, min(p) p, count(*) + n - 1 l FROM (SELECT doc_id, item_id, n, p, p - q diagonal, p - row_number() OVER (PARTITION BY doc_id, item_id, n, p - q ORDER BY p) part FROM hits) GROUP BY doc_id, item_id, n, diagonal, part),
longest AS (SELECT doc_id, max(l) l, arg_min(p, {{'l': -l, 'p': p}}) p FROM runs GROUP BY 1)
SELECT doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(l, 0)::BIGINT longest_run, coalesce(p - 1, -1)::BIGINT longest_run_at
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)"""

#: The pages have one article each, of headings and paragraphs, and four character references. White space is ASCII's here.
OP5 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ', 'g'), '</?b>', '', 'g') t FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(t, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') l FROM a)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, len(array_to_string(l, chr(10)))::BIGINT n_chars FROM b"""
