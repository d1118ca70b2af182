"""ANSI SQL of the queries that SQL can state, for an independent engine."""

_SCORE = """
scored AS (
  SELECT *, len(k) AS n, len(list_distinct(k)) AS u FROM (SELECT *, list_transform(regexp_extract_all(chunk, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS k FROM chunks)),
val AS (
  SELECT {id}, index, chunk, CASE WHEN n = 0 THEN 0 ELSE round((({sum}) + CASE WHEN contains(lower(chunk), '{q}') THEN 2.0 ELSE 0.0 END) * (1.0 + 1.0 / (1.0 + ln(greatest(2.0, n)))), 6) END AS score
  FROM scored)
"""


def _score(q: str, id_: str) -> str:
    part = lambda t: f"(len(list_filter(k, lambda x: x = '{t}'))::DOUBLE / n * 4.0 + len(list_filter(k, lambda x: x = '{t}'))::DOUBLE / u)"
    return _SCORE.format(id=id_, q=q.lower(), sum=" + ".join(part(t) for t in q.lower().split()))


def _slide(size: int, step: int, id_: str, src: str) -> str:
    return f"""
w AS (SELECT {id_}, list_filter(regexp_split_to_array(text, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> '') AS w FROM {src}),
chunks AS (SELECT {id_}, i::INT AS index, array_to_string(list_slice(w, i * {step} + 1, i * {step} + {size}), ' ') AS chunk
  FROM (SELECT *, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= {size} THEN 1 ELSE ceil((len(w) - {size}) / {step}::DOUBLE)::INT + 1 END)) AS i FROM w))"""


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)"
_TRACK = "'_ga','_gl','_hsenc','_hsmi','dm_i','fbclid','gclid','gbraid','hs_amp','igshid','mkt_tok','msclkid','oly_anon_id','oly_enc_id','rb_clickid','s_cid','wickedid','wbraid','yclid','jsessionid','phpsessid','session','session_id','sessionid'"


def _key(url: str) -> str:
    q = f"list_filter(list_transform(list_filter(string_split(regexp_extract({url}, '\\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: {{'k': lower(trim(split_part(x, '=', 1))), 'v': CASE WHEN contains(x, '=') THEN split_part(x, '=', 2) ELSE '' END}}), lambda x: x.v <> '' AND x.k NOT IN ({_TRACK}) AND NOT regexp_matches(x.k, '^(utm_|mc_|pk_|vero_)'))"
    s = f"array_to_string(list_transform(list_sort({q}), lambda x: x.k || '=' || x.v), '&')"
    path = _PATH.replace("url,", f"{url},")
    return f"(lower(regexp_extract({url}, '^([A-Za-z]+)://', 1)) || '://' || {_HOST.replace('url,', url + ',')} || regexp_replace(CASE WHEN {path} = '' THEN '/' ELSE {path} END, '/{{2,}}', '/', 'g') || CASE WHEN {s} = '' THEN '' ELSE '?' || {s} END)"


_BLOCK = """
SELECT DISTINCT page_id, reason FROM (
SELECT page_id, CASE
  WHEN status_code IN (403,429,503,520,521,522,523,524,525,526,527,528,529,530) OR status_code >= 500 THEN 'http_status:' || status_code
  WHEN regexp_replace(b, '\\s+', '', 'g') = '' THEN 'empty_body'
  {servers} {titles} {marks} END AS reason
FROM (SELECT page_id, status_code, lower(coalesce(html, '')) AS b, lower(coalesce(headers['server'], '')) AS s FROM page_store)) WHERE reason IS NOT NULL
"""


def _block() -> str:
    from corpusloom.functions.fetching import BODY_MARKS, SERVER_WORDS, SERVERS, TITLE_MARKS

    said = " OR ".join(f"contains(b, '{w}')" for w in SERVER_WORDS)
    return _BLOCK.format(
        servers=" ".join(f"WHEN contains(s, '{x}') AND ({said}) THEN 'server_challenge:{x}'" for x in SERVERS),
        titles=" ".join(f"WHEN regexp_matches(b, '<title>\\s*(?:\\d+\\s+)?{m}\\b|<h1[^>]*>\\s*(?:\\d+\\s+)?{m}\\b') THEN 'body_marker:{m}'" for m in TITLE_MARKS),
        marks=" ".join(f"WHEN contains(b, '{m}') THEN 'body_marker:{m}'" for m in BODY_MARKS),
    )


SQL = {
    "tokenize_counts": "SELECT lower(t) AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS t FROM documents) GROUP BY 1",
    "sentence_chunks": r"SELECT doc_id, (i - 1)::INT AS index, c[i] AS chunk FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS c FROM documents))",
    "sliding_chunks": "WITH " + _slide(120, 90, "doc_id", "documents") + " SELECT doc_id, index, chunk FROM chunks",
    "rank_chunks_topk": "WITH " + _slide(40, 30, "doc_id", "documents") + "," + _score("the report of", "doc_id") + " SELECT doc_id, index, score, chunk AS text FROM val WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, index) <= 3",
    "research_merge": "WITH d AS (SELECT doc_id - 1 AS source_rank, text FROM documents)," + _slide(40, 30, "source_rank", "d") + "," + _score("the archive", "source_rank")
    + ", top AS (SELECT * FROM val WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY source_rank ORDER BY score DESC, index) <= 5), one AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY source_rank, index) = 1) SELECT source_rank, index, round(score + greatest(0.0, 1.0 - 0.1 * source_rank), 6) AS score, chunk AS text FROM one ORDER BY score DESC, source_rank, index LIMIT 10",
    "ngram_counts": "WITH t AS (SELECT substr(trim(regexp_replace(lower(text), '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), 1, 50000) AS t FROM documents), g AS (SELECT CASE WHEN length(t) < 4 THEN t ELSE substr(t, i::INT, 4) END AS gram FROM (SELECT t, unnest(range(1, greatest(2, length(t) - 2))) AS i FROM t WHERE length(t) > 0)) SELECT gram, count(*) AS n FROM g GROUP BY 1",
    "url_parts": f"SELECT DISTINCT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, {_HOST} AS host, {_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM page_store",
    "url_dedupe_key": f"SELECT DISTINCT url, {_key('url')} AS url_key FROM page_store",
    "url_first_seen": f"WITH k AS (SELECT DISTINCT page_id, url, {_key('url')} AS url_key FROM page_store) SELECT url_key, page_id, url FROM k QUALIFY row_number() OVER (PARTITION BY url_key ORDER BY page_id) = 1",
    "url_scope_filter": f"SELECT DISTINCT page_id, url FROM page_store WHERE {_HOST} IN ('example', 'indigo-page.test', 'delta-weekly.test') OR regexp_matches({_HOST}, '\\.(indigo-page\\.test|delta-weekly\\.test|example)$')",
    "url_pattern_filter": "SELECT DISTINCT page_id, url FROM page_store WHERE contains(url, '/blog/') OR regexp_matches(url, '-\\d{6}$') OR contains(url, 'utm_(')",
    "url_score_best_first": "SELECT url, score FROM (SELECT url, " + " + ".join(f"CASE WHEN contains(lower(url), '{t}') THEN 1.0::DOUBLE ELSE 0.0 END + CASE WHEN contains(translate(lower(url), '-_', '//'), '{t}') THEN 0.5::DOUBLE ELSE 0.0 END" for t in ("blog", "notes", "on")) + " AS score FROM (SELECT DISTINCT url FROM page_store)) ORDER BY score DESC, url LIMIT 100",
    "canonical_keys": f"SELECT DISTINCT page_id, CASE WHEN coalesce(final_url, '') <> '' AND regexp_replace({_HOST}, '^www\\.', '') = regexp_replace({_HOST.replace('url,', 'final_url,')}, '^www\\.', '') THEN {_key('final_url')} ELSE {_key('url')} END AS url_key FROM page_store",
    "budget_admission": f"WITH x AS (SELECT DISTINCT page_id, url, {_PATH} AS path FROM page_store), p AS (SELECT *, CASE WHEN starts_with(path, '/guides') THEN 25 WHEN starts_with(path, '/blog') THEN 40 WHEN starts_with(path, '/p') THEN 60 END AS l, CASE WHEN starts_with(path, '/guides') THEN '/guides' WHEN starts_with(path, '/blog') THEN '/blog' WHEN starts_with(path, '/p') THEN '/p' END AS pre FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY pre ORDER BY page_id, url) AS rn FROM p) SELECT page_id, path FROM r WHERE pre IS NULL OR rn <= l ORDER BY page_id, url LIMIT 300",
    "path_delay": f"SELECT DISTINCT page_id, path, greatest(50, 100, CASE WHEN starts_with(path, '/blog/notes') THEN 900 WHEN starts_with(path, '/blog') THEN 500 ELSE 0 END) AS delay_ms FROM (SELECT page_id, url, {_PATH} AS path FROM page_store)",
    "host_stats": "WITH p AS (SELECT * FROM page_store QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY url) = 1) SELECT host, count(*) AS pages, count(*) FILTER (status_code >= 400) AS failed, round(avg(elapsed_ms), 3) AS avg_ms, count(DISTINCT url) AS urls FROM p GROUP BY host",
    "block_reason": _block(),
    "retry_status": "SELECT DISTINCT page_id, coalesce(status_code IN (408,409,425,429,500,502,503,504,520,521,522,523,524), false) AS retry FROM page_store",
    "page_md5": "SELECT DISTINCT page_id, md5(html) AS md5 FROM page_store WHERE html IS NOT NULL",
    "grep_body": "SELECT DISTINCT page_id FROM page_store WHERE contains(lower(html), 'cookie-bar') OR regexp_matches(html, '(?i)og:image')",
    "html_content_type": "SELECT DISTINCT page_id, coalesce(regexp_matches(lower(content_type), 'html|xhtml|xml|svg'), false) AS is_html FROM page_store",
    "revalidation_headers": "SELECT DISTINCT page_id, nullif(coalesce(headers['etag'], headers['ETag']), '') AS if_none_match, nullif(coalesce(headers['last-modified'], headers['Last-Modified']), '') AS if_modified_since FROM page_store WHERE nullif(coalesce(headers['etag'], headers['ETag']), '') IS NOT NULL OR nullif(coalesce(headers['last-modified'], headers['Last-Modified']), '') IS NOT NULL",
    "exact_dup_first_seen": "SELECT md5(text) AS md5, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "title_jaccard": "SELECT doc_id, round(len(list_intersect(t, u))::DOUBLE / greatest(1, len(list_distinct(list_concat(t, u)))), 6) AS jaccard FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(title, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS t, list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: lower(x))) AS u FROM documents WHERE title IS NOT NULL)",
    "auto_throttle": "SELECT event_type, greatest(10, least(5000, trunc(avg(value) * 0.5)::INT)) AS delay_ms FROM events GROUP BY 1",
    "backoff_schedule": "SELECT event_id, (500 * pow(2, event_id % 8))::BIGINT AS backoff_ms FROM events",
    "autoscale_decision": "WITH x AS (SELECT event_id, (event_id % 9)::INT AS cur, (event_id % 101) AS cpu, (event_id * 7 % 101) AS mem FROM events), y AS (SELECT *, cpu >= 85 OR mem >= 90 AS o, cpu <= 55 AND mem <= 60 AS u FROM x) SELECT event_id, CASE WHEN o THEN greatest(1, cur - 1) WHEN u THEN least(8, cur + 1) ELSE greatest(1, least(8, cur)) END AS value, CASE WHEN o AND greatest(1, cur - 1) < cur THEN 'decrease' WHEN NOT o AND u AND least(8, cur + 1) > cur THEN 'increase' ELSE 'keep' END AS action FROM y",
    "cache_latest": "SELECT url, mode, cache_id, fetched_at FROM (SELECT DISTINCT cache_id, url, mode, fetched_at FROM page_cache) QUALIFY row_number() OVER (PARTITION BY url, mode ORDER BY fetched_at DESC, cache_id DESC) = 1",
    "cache_fresh": "SELECT DISTINCT cache_id, 1760400900.0::DOUBLE - fetched_at <= 900 AS fresh FROM page_cache",
    "cache_json_fields": "SELECT DISTINCT cache_id, page_data->>'$.final_url' AS final_url, (page_data->>'$.status_code')::INT AS status_code FROM page_cache WHERE json_valid(page_data)",
    "json_field_select": "SELECT event_id, props->>'$.k' AS k FROM events",
    "dataset_flatten": "SELECT event_id::VARCHAR AS event_id, coalesce(event_type, '') AS e_event_type, coalesce(user_id::VARCHAR, '') AS e_who_user_id FROM events",
    "quiet_gap_sessions": "WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM y GROUP BY user_id, g",
    "search_attach_left_join": "SELECT a.article_id, a.url AS link, p.page_id FROM (SELECT DISTINCT article_id, url FROM article_meta) a LEFT JOIN (SELECT final_url, min(page_id) AS page_id FROM page_store GROUP BY 1) p ON a.url = p.final_url",
    "author_names": r"SELECT DISTINCT author, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(author, '(?i)^\s*by\s+', ''), '\|.*$', ''), '[\[(].*$', ''), '\d+\s*$', '')) AS name FROM article_meta WHERE author IS NOT NULL",
    "tech_search": "SELECT * FROM (VALUES ('Apache', 'https://httpd.apache.org', 'Web servers'), ('Caddy', 'https://caddyserver.com', 'Web servers'), ('Nginx', 'https://nginx.org', 'Web servers')) t(name, website, categories)",
    "traversal_bench_stats": "SELECT user_id % 4 AS concurrency, count(*) AS samples, round(avg(value), 4) AS avg_seconds, min(value) AS min_seconds, max(value) AS max_seconds, round(median(value), 4) AS median_seconds FROM events GROUP BY 1",
}


_ONCE = "p AS (SELECT page_id, min(host) AS host, min(url) AS url, min(html) AS html FROM page_store GROUP BY page_id)"
#: Source without comments and without what scripts, styles and templates hold; start tags by place; entities of attributes and titles.
_BARE = r"regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->', '', 'gs'), '(<(script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'gsi')"
_PLAIN = "replace(replace(replace(replace(replace({}, '&#x27;', ''''), '&quot;', '\"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&')"
_ABSOLUTE = r"CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {0} WHEN {0} LIKE '/%' THEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*') || {0} ELSE {0} END"
_LINKS = rf"""{_ONCE},
a AS (SELECT page_id, host, url, unnest(regexp_extract_all({_BARE}, '<a\s[^>]*?href="([^"]*)"', 1, 'i')) AS href, generate_subscripts(regexp_extract_all({_BARE}, '<a\s[^>]*?href="([^"]*)"', 1, 'i'), 1) AS i FROM p),
l AS (SELECT page_id, host, url, min(i) AS i, regexp_replace(link, '#.*$', '') AS link FROM (SELECT page_id, host, url, i, {_ABSOLUTE.format(_PLAIN.format('trim(href)'))} AS link FROM a) WHERE regexp_matches(link, '^https?://') GROUP BY ALL),
links AS (SELECT page_id, host, url, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM l)"""
_KEYS = f"keyed AS (SELECT page_id, host, {_key('url')} AS key FROM p)"
_EDGES = f"e AS (SELECT DISTINCT k.key AS src, d.dst FROM keyed k JOIN (SELECT page_id, {_key('link')} AS dst FROM links) d USING (page_id) WHERE d.dst IS NOT NULL AND k.key <> d.dst AND regexp_extract(k.key, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(d.dst, '^[a-z]+://([^/?#]*)', 1))"

SQL |= {
    "page_links": f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, link FROM links",
    "tag_pattern": rf"WITH {_ONCE} SELECT page_id, url, array_to_string(list_transform(regexp_extract_all({_BARE}, '<([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>', 1), lambda x: lower(x)), ',') AS tag_pattern, NULL::VARCHAR AS error FROM p",
    "link_edges": f"WITH {_LINKS}, {_KEYS}, {_EDGES} SELECT src, dst FROM e",
    "site_traversal": f"WITH RECURSIVE {_LINKS}, {_KEYS}, {_EDGES}, t AS (SELECT arg_min(key, page_id) AS key, 0 AS depth FROM keyed WHERE key IS NOT NULL GROUP BY host UNION SELECT e.dst, t.depth + 1 FROM t JOIN e ON t.key = e.src WHERE t.depth < 3) SELECT key, min(depth)::INT AS depth FROM t GROUP BY key",
    "page_metadata": rf"""WITH {_ONCE}, b AS (SELECT page_id, url, {_BARE} AS html FROM p),
m AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<meta name="description" content="([^"]*)"', 1) AS description, regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1) AS image, regexp_extract(html, '<link rel="canonical" href="([^"]*)"', 1) AS canonical FROM b)
SELECT page_id, {_PLAIN.format('trim(title)')} AS title, {_PLAIN.format('trim(description)')} AS description, {_ABSOLUTE.format(_PLAIN.format('image'))} AS image, {_PLAIN.format('canonical')} AS canonical_url FROM m""",
    "search_union_dedupe": f"WITH u AS (SELECT DISTINCT 0 AS source, page_id AS ord, url FROM page_store UNION ALL SELECT DISTINCT 1, article_id, url FROM article_meta) SELECT source, ord, url AS link FROM u QUALIFY row_number() OVER (PARTITION BY {_key('url')} ORDER BY source, ord) = 1",
    "contacts_text": r"""WITH e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS value FROM documents),
n AS (SELECT doc_id, 'phone' AS kind, regexp_replace(unnest(regexp_extract_all(text, '\+?\d[\d\s().-]{6,}\d')), '[^0-9+]', '', 'g') AS value FROM documents)
SELECT DISTINCT * FROM e UNION ALL SELECT DISTINCT * FROM n WHERE length(replace(value, '+', '')) >= 7""",
    "reading_time": r"SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, round_even(n / 220.0, 0)::INT) END AS minutes FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS n FROM documents)",
    "prefix_rules": r"WITH p AS (SELECT DISTINCT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM page_store) SELECT page_id, CASE WHEN path LIKE '/posts%' THEN '/posts' WHEN path LIKE '/docs/%' THEN '/docs/' WHEN path LIKE '/news/%' THEN '/news/' WHEN path LIKE '/n%' THEN '/n' WHEN path LIKE '/p%' THEN '/p' END AS prefix FROM p",
    "retry_after": "WITH p AS (SELECT page_id, any_value(headers) AS h FROM page_store GROUP BY page_id) SELECT page_id, greatest(0, try_cast(trim(coalesce(h['retry-after'], h['Retry-After'])) AS DOUBLE) * 1000)::BIGINT AS wait_ms FROM (SELECT page_id, h FROM p)",
    "fragments_stripped": r"SELECT DISTINCT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)(\?|$)', '\1/\2') AS url FROM page_store",
    "merged_headers": "SELECT DISTINCT page_id, (coalesce(len(list_filter(map_keys(headers), lambda k: k NOT IN ('accept', 'server'))), 0) + 2)::INT AS n, 'text/html' AS accept, 'own' AS server FROM page_store",
    "template_rows": "SELECT DISTINCT page_id, coalesce(host, '') || '/' || coalesce(mode, '') || '-' || coalesce(status_code::VARCHAR, '') || '.txt' AS name FROM page_store",
    "event_windows": "SELECT time_bucket(INTERVAL '5 minutes', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_pairs": "SELECT a.event_id, b.event_id AS finish_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL '10 minutes'",
    "robots_rules": "SELECT DISTINCT url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) NOT LIKE '/news/%' AS allowed, 2.0::DOUBLE AS delay FROM page_store",
}
