"""The registered queries as SQL for a second engine, to check results against.

Written apart from the operators: windows, self-joins and plain patterns where the
operators fold arrays.
"""

from __future__ import annotations

from crawlq.functions.html import TOKEN, VOID_TAGS
from crawlq.functions.text import STOP_WORDS
from crawlq.plans import inputs as I

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(values) -> str:
    return ", ".join(_text(v) for v in values)


def _src(sql: str) -> str:
    return sql.replace("{pages}", "pages").replace("{events}", "events")


def _unescape(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {_text(name)}, {_text(char)})"
    return x


def _attr(name: str, raw: str = "raw") -> str:
    found = rf"(?i)\s{name}\s*=\s*\""
    return (
        f"(CASE WHEN regexp_matches({raw}, {_text(found)}) "
        f"THEN {_unescape(f'regexp_extract({raw}, {_text(found)} || ' + _text('([^\"]*)\"') + ', 1)')} END)"
    )


PX = f"px AS ({_src(I.DECORATED_PAGES)})"
LINE = "line AS (SELECT page_id, url, lower(replace(html, chr(10), '')) AS t FROM px)"
TAGS = f"""{PX}, tok AS (
  SELECT page_id, url, unnest(x) AS raw, unnest(range(len(x))) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, {_text(TOKEN)}) AS x FROM px)
), tag0 AS (
  SELECT *, CASE WHEN NOT starts_with(raw, '<') OR raw = '<' THEN 'text'
    WHEN starts_with(raw, '<!--') AND ends_with(raw, '-->') THEN 'comment'
    WHEN starts_with(raw, '<!') THEN 'decl' WHEN starts_with(raw, '</') THEN 'close'
    WHEN regexp_matches(raw, '(?is)^<script\\b.*</script\\s*>$') THEN 'script'
    WHEN regexp_matches(raw, '(?is)^<style\\b.*</style\\s*>$') THEN 'style' ELSE 'open' END AS kind
  FROM tok
), tags AS (
  SELECT page_id, url, pos, kind, raw,
    CASE WHEN kind IN ('text', 'comment', 'decl') THEN '' ELSE lower(regexp_extract(raw, '^</?([a-zA-Z][^\\s/>]*)', 1)) END AS tag
  FROM tag0
)"""
# Matching end tag: the next tag of the same name on the same nesting level.
HIDDEN = f"""{TAGS}, hide AS (
  SELECT page_id, pos, kind, tag, kind = 'open' AND (
    tag IN ('style', 'script', 'head', 'title', 'meta', 'noscript', 'select', 'option')
    OR (tag NOT IN ('body', 'html') AND (coalesce(lower({_attr('aria-hidden')}) = 'true', false)
      OR coalesce(regexp_matches(lower({_attr('style')}), 'display\\s*:\\s*[^;]*none'), false)))) AS hides
  FROM tags WHERE kind IN ('open', 'close')
), depth AS (
  SELECT *, sum(CASE kind WHEN 'open' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS d
  FROM hide WHERE tag NOT IN ({_words(VOID_TAGS)})
), paired AS (
  SELECT *, lead(pos) OVER (PARTITION BY page_id, tag, CASE kind WHEN 'open' THEN d ELSE d + 1 END ORDER BY pos) AS nxt
  FROM depth
), spans AS (
  SELECT p.page_id, p.pos AS lo, coalesce(p.nxt, l.n) AS hi
  FROM paired p JOIN (SELECT page_id, max(pos) AS n FROM tags GROUP BY 1) l USING (page_id)
  WHERE p.kind = 'open' AND p.hides
), ranges AS (
  SELECT * FROM spans s WHERE NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.page_id = s.page_id AND o.lo < s.lo AND o.hi >= s.hi)
), visible AS (
  SELECT t.* FROM tags t WHERE NOT EXISTS (
    SELECT 1 FROM ranges r WHERE r.page_id = t.page_id AND t.pos BETWEEN r.lo AND r.hi)
    AND NOT EXISTS (SELECT 1 FROM hide h WHERE h.page_id = t.page_id AND h.pos = t.pos AND h.hides)
)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"


def _items(where: str, name: str, source: str = "tags", empty: bool = False) -> str:
    """Attribute rows of some tags."""
    test = "item IS NOT NULL" if empty else "item IS NOT NULL AND trim(item) <> ''"
    return f"SELECT page_id, pos, item FROM (SELECT page_id, pos, {_attr(name)} AS item FROM {source} WHERE {where}) WHERE {test}"


# --- URLs ---------------------------------------------------------------------------------------


def _parts(source: str, url: str = "url", name: str = "parts") -> str:
    """CTEs that add the URL parts to `source` under `name`."""
    return f"""{name}_1 AS (
  SELECT *, trim(coalesce({url}, '')) AS u_t FROM {source}
), {name}_2 AS (
  SELECT *, CASE WHEN regexp_matches(u_t, '^[A-Za-z0-9+.\\-]+:[0-9]+$') AND NOT starts_with(u_t, 'http:') THEN ''
    ELSE regexp_extract(u_t, '^([A-Za-z0-9+.\\-]+):', 1) END AS u_s FROM {name}_1
), {name}_3 AS (
  SELECT *, CASE WHEN u_s = '' THEN u_t ELSE substr(u_t, length(u_s) + 2) END AS u_r FROM {name}_2
), {name}_4 AS (
  SELECT *, lower(u_s) AS scheme, regexp_extract(u_r, '^//([^/?#]*)', 1) AS netloc,
    regexp_extract(u_r, '^(?://[^/?#]*)?([^?#]*)', 1) AS u_p,
    regexp_extract(u_r, '^[^?#]*\\?([^#]*)', 1) AS query, regexp_extract(u_r, '#(.*)$', 1) AS fragment
  FROM {name}_3
), {name}_5 AS (
  SELECT *, regexp_replace(netloc, '^.*@', '') AS u_h, regexp_extract(u_p, '([^/]*)$', 1) AS u_l FROM {name}_4
), {name}_6 AS (
  SELECT *, CASE WHEN scheme IN ('', 'http', 'https') AND instr(u_l, ';') > 0 THEN length(u_l) - instr(u_l, ';') + 1 ELSE 0 END AS u_c
  FROM {name}_5
), {name} AS (
  SELECT * EXCLUDE (u_t, u_s, u_r, u_p, u_h, u_l, u_c), left(u_p, length(u_p) - u_c) AS path,
    CASE WHEN u_c > 0 THEN substr(u_l, instr(u_l, ';') + 1) ELSE '' END AS params,
    nullif(lower(CASE WHEN starts_with(u_h, '[') THEN regexp_extract(u_h, '^\\[([^\\]]*)', 1) ELSE split_part(u_h, ':', 1) END), '') AS hostname,
    TRY_CAST(nullif(regexp_extract(regexp_replace(u_h, '^\\[[^\\]]*\\]', ''), ':([0-9]+)$', 1), '') AS BIGINT) AS port
  FROM {name}_6
)"""


URLS = f"urls AS ({_src(I.CRAWL_URLS)}), {_parts('urls')}"
HOSTS = "hosts AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages)"
REDUCED = "coalesce(hostname, '') || path || '?' || query"
TRIMMED = "regexp_replace(trim(split_part(" + REDUCED + ", '?', 1)), '^(www\\.)+', '')"
V4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
# The derived URLs hold IPv6 hosts of one form only.
V6 = r"^[0-9a-f]{1,4}(:[0-9a-f]{1,4})*::[0-9a-f]{1,4}$"
KIND = f"CASE WHEN hostname LIKE '%:%:%' AND regexp_matches(hostname, '{V6}') THEN 'ipv6' WHEN regexp_matches(coalesce(hostname, ''), '{V4}') THEN 'ipv4' ELSE 'name' END"

ORACLES["url_parts"] = _with(
    URLS, "SELECT url_id, url, scheme, netloc, hostname, port, path, params, query, fragment FROM parts"
)
ORACLES["url_status"] = _with(
    URLS, "SELECT url_id, CASE WHEN hostname IS NULL THEN 'no_host' ELSE 'ok' END AS status FROM parts"
)
ORACLES["host_kind_counts"] = _with(URLS, f"SELECT {KIND} AS kind, count(*) AS n FROM parts GROUP BY 1")
PARAMS = """pairs AS (
  SELECT url_id, i, trim(split_part(p, '=', 1)) AS k, CASE WHEN instr(p, '=') > 0 THEN trim(substr(p, instr(p, '=') + 1)) ELSE '' END AS v
  FROM (SELECT url_id, unnest(string_split(query, '&')) AS p, unnest(range(len(string_split(query, '&')))) AS i FROM parts)
), params AS (
  SELECT url_id, k, arg_max(v, i) AS v, min(i) AS i FROM pairs WHERE k <> '' GROUP BY 1, 2
)"""
ORACLES["url_query_params"] = _with(f"{URLS}, {PARAMS}", "SELECT url_id, k, v FROM params")
ORACLES["ext_counts"] = _with(
    URLS,
    "SELECT CASE WHEN regexp_matches(path, '.\\.[0-9a-zA-Z]{1,5}$') THEN lower('.' || regexp_extract(path, '\\.([0-9a-zA-Z]+)$', 1)) ELSE '' END AS ext, count(*) AS n FROM parts GROUP BY 1",
)


def _token_sql(normalize: bool, prefix: bool) -> str:
    zero = (lambda x: f"trim(regexp_replace({x}, '[0-9]', '0', 'g'))") if normalize else (lambda x: x)
    cut = (lambda x: f"left({x}, 8)") if prefix else (lambda x: x)
    return f"""{URLS}, {PARAMS}, hosted AS (
  SELECT url_id, CASE WHEN {KIND} <> 'name' THEN [hostname]
    ELSE list_transform(list_filter(string_split({zero('hostname')}, '.'), lambda t: trim(t) <> ''), lambda t: {cut('trim(t)')}) END AS x
  FROM parts WHERE hostname IS NOT NULL
), pathed0 AS (
  SELECT url_id, CASE WHEN starts_with(p, '/') THEN p ELSE '/' || p END AS p FROM (SELECT url_id, {zero('path')} AS p FROM parts)
), pathed1 AS (
  SELECT url_id, string_split(p, '/') AS s, regexp_extract(p, '([^/]*)$', 1) AS last FROM pathed0
), pathed AS (
  SELECT url_id, list_concat(
    list_transform(list_filter(s[2:len(s) - 1], lambda t: trim(t) <> ''), lambda t: '/' || trim(t) || '/'),
    CASE WHEN last = '' THEN [] WHEN regexp_matches(last, '.\\.[^.]*$') THEN [last, regexp_extract(last, '(\\.[^.]*)$', 1)] ELSE [last] END) AS x
  FROM pathed1
), ordered AS (
  SELECT url_id, k, v, row_number() OVER (PARTITION BY url_id ORDER BY i) - 1 AS ord FROM params
), tokens AS (
  SELECT url_id, 'host' AS kind, unnest(range(len(x))) AS ord, unnest(x) AS token FROM hosted
  UNION ALL SELECT url_id, 'path', unnest(range(len(x))), unnest(x) FROM pathed
  UNION ALL SELECT url_id, 'query_key', ord, {zero('k')} FROM ordered
  UNION ALL SELECT url_id, 'query_value', ord, {cut(zero('v'))} FROM ordered
)"""


ORACLES["url_tokens"] = _with(_token_sql(True, True), "SELECT url_id, kind, ord, token FROM tokens")
ORACLES["url_tokens_raw"] = _with(_token_sql(False, False), "SELECT url_id, kind, ord, token FROM tokens")
ORACLES["url_token_counts"] = _with(
    _token_sql(False, False),
    "SELECT kind, token, count(*) AS n_tokens, count(DISTINCT url_id) AS n_urls FROM tokens GROUP BY 1, 2",
)
LEVEL = "CAST(len(list_filter(string_split(trim(path), '/'), lambda s: trim(s) <> '')) AS DOUBLE) - CASE WHEN ends_with(trim(path), '/') THEN 0 ELSE 0.5::DOUBLE END"
ORACLES["path_depth_stats"] = _with(
    URLS,
    f"SELECT coalesce(hostname, '') AS host, count(*) AS n, avg({LEVEL}) AS avg_level, max({LEVEL}) AS max_level FROM parts GROUP BY 1",
)
ORACLES["dedup_urls"] = _with(
    URLS, f"SELECT {TRIMMED} AS reduced, min(url) AS url, count(*) AS n FROM parts GROUP BY 1"
)
ORACLES["dedup_urls_frag"] = _with(
    URLS,
    f"SELECT trim({REDUCED} || CASE WHEN contains(url, '#') THEN '#' || fragment ELSE '' END) AS reduced, min(url) AS url, count(*) AS n FROM parts GROUP BY 1",
)
ORACLES["match_urls"] = _with(
    f"{URLS}, {_parts('pages', name='known')}, targets AS (SELECT {TRIMMED} AS r, min(url) AS target_url, count(*) AS n FROM known GROUP BY 1)",
    f"SELECT url_id, url, n IS NOT NULL AS matched, target_url, coalesce(n, 0) AS n_targets FROM (SELECT *, {TRIMMED} AS r FROM parts) LEFT JOIN targets USING (r)",
)
STRUCTURE = "coalesce(nullif(regexp_extract(split_part({r}, '?', 1), '^[^/]*(/(?:.*/)?)[^/]*$', 1), ''), '/')"
ORACLES["site_rollup"] = _with(
    URLS,
    f"SELECT scheme || '://' || netloc || '/' AS site, count(*) AS pages, count(DISTINCT {STRUCTURE.format(r=REDUCED)}) AS n_directories, avg(CASE WHEN scheme <> '' THEN 1 ELSE 0 END) AS scheme_share FROM parts GROUP BY 1",
)
ORACLES["resolve_links"] = _with(
    f"""links AS ({_src(I.CRAWL_LINKS)}), {_parts('(SELECT url_id, base, link, base AS bu FROM links)', 'bu', 'b')},
{_parts('(SELECT url_id AS lid, link AS lu FROM links)', 'lu', 'l')},
j AS (
  SELECT b.*, l.scheme AS ls, l.netloc AS ln, l.path AS lp, l.params AS lx, l.query AS lq, l.fragment AS lf,
    list_concat(string_split(b.path, '/')[1:len(string_split(b.path, '/')) - 1], string_split(l.path, '/')) AS seg
  FROM b JOIN l ON b.url_id = l.lid
), j1 AS (
  SELECT *, seg[len(seg)] AS fin, CASE WHEN seg[len(seg)] IN ('.', '..') THEN seg[1:len(seg) - 1] ELSE seg END AS steps FROM j
), j2 AS (
  SELECT *, list_reduce(list_transform(steps, lambda s: [s]), lambda a, x: CASE WHEN x[1] = '.' THEN a
    WHEN x[1] = '..' AND a[len(a)] NOT IN ('', '..') THEN a[1:len(a) - 1] ELSE list_concat(a, x) END) AS walked FROM j1
), j3 AS (
  SELECT *, array_to_string(CASE WHEN fin = '..' AND walked <> [''] THEN list_concat(walked[1:len(walked) - 1], [''])
    WHEN fin IN ('.', '..') THEN list_concat(walked, ['']) ELSE walked END, '/') AS merged FROM j2
)""",
    """SELECT url_id, base, link, CASE WHEN trim(link) = '#' THEN base || '#' WHEN trim(link) = '' THEN base
  WHEN ls <> '' AND ls <> scheme THEN trim(link)
  ELSE scheme || '://' || CASE WHEN ln <> '' THEN ln ELSE netloc END
    || CASE WHEN ln <> '' OR starts_with(lp, '/') THEN lp WHEN lp = '' THEN path ELSE merged END
    || CASE WHEN ln = '' AND lp = '' AND lq = '' THEN CASE WHEN query <> '' THEN '?' || query ELSE '' END
         WHEN lq <> '' THEN '?' || lq ELSE '' END
    || CASE WHEN lf <> '' THEN '#' || lf ELSE '' END END AS resolved FROM j3""",
)

# --- Sources and sinks --------------------------------------------------------------------------
TLDS = f"tlds AS (SELECT DISTINCT lower(trim(v)) AS tld FROM (SELECT unnest([{_words(I.TLD_LINES)}]) AS v) WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#'))"
for _name, _not in (("tld_known", ""), ("tld_unknown", "NOT ")):
    ORACLES[_name] = _with(
        f"{HOSTS}, {TLDS}",
        f"SELECT * FROM (SELECT host, regexp_extract(host, '([^.]*)$', 1) AS tld FROM hosts) WHERE tld {_not}IN (SELECT tld FROM tlds)",
    )
HEADER_LINES = _src(I.HEADER_LINES).replace("explode(sequence(0, 6))", "unnest(range(7))")
HEADERS = f"""lines AS (
  SELECT url, ord, trim(line) AS line FROM ({HEADER_LINES}) WHERE trim(line) <> ''
), blocks AS (
  SELECT *, sum(CASE WHEN contains(line, ':') THEN 0 ELSE 1 END) OVER (PARTITION BY url ORDER BY ord) AS b FROM lines
), lastb AS (
  SELECT * FROM blocks QUALIFY b = max(b) OVER (PARTITION BY url)
), headers AS (
  SELECT url, name, arg_max(value, ord) AS value FROM (
    SELECT url, ord, CASE WHEN contains(line, ':') THEN lower(trim(split_part(line, ':', 1))) ELSE '_response' END AS name,
      CASE WHEN contains(line, ':') THEN trim(substr(line, instr(line, ':') + 1)) ELSE line END AS value FROM lastb) GROUP BY 1, 2
)"""
ORACLES["parse_headers"] = _with(HEADERS, "SELECT url, name, value FROM headers")
ARCHIVE = f"""{HEADERS}, bodies AS (
  SELECT url, 'content' AS part, html AS body FROM pages
  UNION ALL SELECT url, 'header', '{{' || string_agg('"' || name || '":"' || value || '"', ',' ORDER BY name) || '}}' FROM headers GROUP BY url
)"""
ORACLES["archive_refs"] = _with(ARCHIVE, "SELECT url, part, sha1(body) AS sha1 FROM bodies")
ORACLES["archive_blobs"] = _with(ARCHIVE, "SELECT DISTINCT sha1(body) AS sha1, body FROM bodies")
_META = """'{"http_code":' || (200 + page_id % 3) || ',"finish_download":' || (page_id % 4 <> 0) || '}'"""
ORACLES["archive_meta_refs"] = f"SELECT url, 'meta' AS part, sha1({_META}) AS sha1 FROM pages"
_AGAIN = "CASE WHEN page_id % 5 = 0 THEN html || '<!-- again -->' ELSE html END"
RUNS = f"""parts AS (
  SELECT 0 AS run, url, 'content' AS part, html AS body FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 0, url, 'meta', {_META} FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT 1, url, 'content', {_AGAIN} FROM pages
  UNION ALL SELECT 1, url, 'meta', {_META} FROM pages
), bodies AS (SELECT body, min(run) AS run FROM parts GROUP BY body)"""
ORACLES["archive_runs"] = _with(
    RUNS,
    """SELECT CAST(run AS BIGINT) AS run, n_refs, n_blobs, n_chars FROM (SELECT run, count(*) AS n_refs FROM parts GROUP BY run)
JOIN (SELECT run, count(*) AS n_blobs, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM bodies GROUP BY run) USING (run)""",
)
ORACLES["archive_read"] = _with(
    RUNS, "SELECT url, part, md5(body) AS body_md5 FROM parts QUALIFY row_number() OVER (PARTITION BY url, part ORDER BY run DESC, sha1(body) DESC) = 1"
)
ORACLES["read_page_files"] = "SELECT page_id, md5(html || chr(10)) AS html_md5 FROM pages"
ORACLES["daily_files"] = """SELECT CAST(d AS DATE) AS day, 'https://files.example.org/daily/Daily_' || strftime(d, '%Y_%m_%d') || '.zip' AS file_name
FROM (SELECT unnest(generate_series(date_trunc('day', min(o_orderdate)), date_trunc('day', max(o_orderdate)), INTERVAL 1 DAY)) AS d FROM orders)"""
SPINE = """spine AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1995-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
daily AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS cnt FROM orders GROUP BY 1)"""
ORACLES["daily_gapfill"] = _with(SPINE, "SELECT day, coalesce(cnt, 0) AS cnt FROM spine LEFT JOIN daily USING (day)")
ORACLES["daily_missing"] = """SELECT day FROM (
  SELECT CAST(unnest(generate_series(DATE '2001-12-31' - 199, DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS day
) WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)"""

# --- Pages --------------------------------------------------------------------------------------
ORACLES["page_tags"] = _with(TAGS, "SELECT page_id, pos, kind, tag, raw FROM tags")
ORACLES["tag_counts"] = _with(
    TAGS, "SELECT kind, tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM tags GROUP BY 1, 2"
)
ORACLES["stored_tag_counts"] = ORACLES["tag_counts"]
ORACLES["hidden_ranges"] = _with(HIDDEN, "SELECT page_id, lo, hi FROM ranges")
ORACLES["visible_tags"] = _with(
    HIDDEN, "SELECT page_id, pos, kind, tag, raw FROM visible WHERE kind = 'open' AND tag IN ('a', 'input', 'img')"
)
ORACLES["stored_visible_tags"] = ORACLES["visible_tags"]
_HREF = r"""<\s*[^>]+\s+href\s*=\s*['"]([^'"]*)['"]"""
ORACLES["href_items"] = _with(
    f"{PX}, {LINE}",
    f"SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS item FROM (SELECT page_id, regexp_extract_all(t, {_text(_HREF)}, 1) AS x FROM line)",
)
TITLES = f"""{PX}, titled AS (
  SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<title[^>]*>([^<]+)</title\\s*>', 1), lambda t: lower({_unescape('t')})) AS x FROM px
), title_w AS (
  SELECT page_id, unnest(range(len(w))) AS pos, unnest(w) AS item
  FROM (SELECT page_id, regexp_extract_all(array_to_string(x, ' '), '[0-9a-zA-Z]+') AS w FROM titled)
)"""
ORACLES["titles"] = _with(TITLES, "SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS item FROM titled")
ORACLES["titles_case_sensitive"] = _with(
    PX,
    f"""SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS item FROM (
  SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<title[^>]*>([^<]+)</title\\s*>', 1), lambda t: {_unescape('t')}) AS x FROM px)""",
)
ORACLES["title_words"] = _with(TITLES, "SELECT page_id, pos, item FROM title_w")
_REL = f"replace(lower({_attr('rel')}), ' ', '')"
ICONS = _items(f"tag = 'link' AND {_REL} = 'shortcuticon'", "href")
SHEETS = _items(f"tag = 'link' AND {_REL} = 'stylesheet'", "href")
SCRIPTS = _items(
    f"tag = 'script' AND coalesce(lower({_attr('type')}), 'text/javascript') = 'text/javascript'",
    "src",
    "(SELECT page_id, pos, tag, regexp_extract(raw, '^[^>]*>') AS raw FROM tags WHERE kind IN ('script', 'open'))",
)
IMAGES = _items("tag = 'img' AND kind = 'open'", "src")
ORACLES["shortcut_icons"] = _with(TAGS, ICONS)
ORACLES["stylesheets"] = _with(TAGS, SHEETS)
ORACLES["script_srcs"] = _with(TAGS, SCRIPTS)
STYLES = f"""SELECT page_id, pos, array_to_string(item, '|') AS item FROM (
  SELECT page_id, pos, list_sort(list_distinct(list_filter(list_transform(string_split({_attr('style')}, ';'), lambda s: trim(lower(split_part(s, ':', 1)))), lambda k: k <> ''))) AS item
  FROM tags WHERE kind = 'open' AND tag = 'div' AND {_attr('style')} IS NOT NULL) WHERE len(item) >= 3"""
ORACLES["div_style_keys"] = _with(TAGS, STYLES)
_SHOWN = f"SELECT page_id, pos, regexp_replace({_unescape('raw')}, '^\\s+|\\s+$', '', 'g') AS item FROM visible WHERE kind = 'text'"
ORACLES["visible_text"] = _with(HIDDEN, f"SELECT * FROM ({_SHOWN}) WHERE item <> ''")
ORACLES["visible_text_len"] = _with(
    HIDDEN,
    f"SELECT page_id, count(*) AS n_texts, CAST(sum(length(item)) AS BIGINT) AS n_chars FROM ({_SHOWN}) WHERE item <> '' GROUP BY 1",
)


def _word_sql(source: str) -> str:
    return f"""words AS (
  SELECT page_id, unnest(range(len(w))) AS pos, unnest(w) AS item FROM (
    SELECT page_id, list_filter(regexp_extract_all(t, '[0-9a-zA-Z]+'), lambda w: w NOT IN ({_words(STOP_WORDS)})) AS w FROM {source}))"""


ORACLES["page_words"] = _with(f"{PX}, {LINE}, {_word_sql('line')}", "SELECT page_id, pos, item FROM words")
ORACLES["word_counts"] = _with(
    f"{PX}, {LINE}, {_word_sql('line')}", "SELECT item AS word, count(*) AS n FROM words GROUP BY 1"
)
ORACLES["document_word_counts"] = _with(
    f"line AS (SELECT doc_id AS page_id, lower(replace(text, chr(10), '')) AS t FROM documents), {_word_sql('line')}",
    "SELECT item AS word, count(*) AS n FROM words GROUP BY 1",
)
ORACLES["a_hrefs"] = _with(HIDDEN, _items("kind = 'open' AND tag = 'a'", "href", "visible", empty=True))
ANCHORS = """anchors AS (
  SELECT page_id, pos, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS nxt, kind FROM tags WHERE tag = 'a'
), around AS (
  SELECT v.* FROM visible v JOIN anchors a ON a.page_id = v.page_id AND a.pos = v.pos AND a.kind = 'open'
  WHERE EXISTS (SELECT 1 FROM tags i WHERE i.tag = 'img' AND i.page_id = a.page_id AND i.pos > a.pos AND i.pos < coalesce(a.nxt, 1000000000))
)"""
ORACLES["a_hrefs_with_img"] = _with(f"{HIDDEN}, {ANCHORS}", _items("true", "href", "around"))
ORACLES["all_img_srcs"] = _with(TAGS, IMAGES)
ORACLES["img_file_names"] = _with(
    TAGS, f"SELECT DISTINCT page_id, split_part(regexp_extract(item, '([^/]*)$', 1), '?', 1) AS item, CAST(1 AS BIGINT) AS cnt FROM ({IMAGES})"
)
ORACLES["img_srcs"] = _with(HIDDEN, _items("tag = 'img' AND kind = 'open'", "src", "visible"))
ORACLES["form_actions"] = _with(TAGS, _items("tag = 'form' AND kind = 'open'", "action"))
ORACLES["form_flags"] = _with(
    TAGS,
    f"SELECT page_id, bool_or(tag = 'form' AND kind = 'open') AS has_form, bool_or(tag = 'form' AND kind = 'open' AND {_attr('action')} IS NOT NULL) AS has_form_action FROM tags GROUP BY 1",
)
INPUTS = f"inputs AS (SELECT page_id, pos, coalesce(lower({_attr('type')}), 'text') AS type, {_attr('name')} AS name FROM visible WHERE kind = 'open' AND tag = 'input')"
ORACLES["visible_inputs"] = _with(f"{HIDDEN}, {INPUTS}", "SELECT * FROM inputs WHERE type NOT IN ('hidden', 'submit')")
ORACLES["textareas"] = _with(
    HIDDEN, f"SELECT page_id, pos, {_attr('name')} AS name FROM visible WHERE kind = 'open' AND tag = 'textarea'"
)
_MARKUP = {
    "image_input": r"""<\s*input\s+[^>]*type\s*=\s*['"]image['"][^>]*>""",
    "select": r"<\s*select\s*[^>]+>",
    "option": r"<\s*option\s*[^>]+>",
}
ORACLES["markup_items"] = _with(
    f"{PX}, {LINE}",
    " UNION ALL ".join(
        f"SELECT page_id, '{what}' AS what, unnest(range(len(x))) AS pos, unnest(x) AS item FROM (SELECT page_id, regexp_extract_all(t, {_text(p)}) AS x FROM line)"
        for what, p in _MARKUP.items()
    ),
)
REFRESH = f"""body AS (SELECT page_id, min(pos) AS b FROM tags WHERE tag = 'body' AND kind = 'open' GROUP BY 1),
refresh AS (
  SELECT page_id, pos, url, regexp_extract({_attr('content')}, '(?:URL|url)\\s*=\\s*(.*)', 1) AS item
  FROM tags LEFT JOIN body USING (page_id)
  WHERE tag = 'meta' AND lower(trim({_attr('http-equiv')})) = 'refresh' AND pos < coalesce(b, 1000000000)
    AND regexp_matches({_attr('content')}, '(?:URL|url)\\s*=')
)"""
ORACLES["meta_refresh"] = _with(f"{TAGS}, {REFRESH}", "SELECT page_id, pos, item FROM refresh")
BASES = f"""bases AS (
  SELECT page_id, url, coalesce((SELECT arg_min({_attr('href')}, pos) FROM tags t WHERE t.page_id = px.page_id AND tag = 'base'), url) AS base_url FROM px
)"""
ORACLES["base_tag_url"] = _with(
    TAGS, f"SELECT page_id, (SELECT arg_min({_attr('href')}, pos) FROM tags t WHERE t.page_id = px.page_id AND tag = 'base') AS base_url FROM px"
)
ORACLES["base_url"] = _with(f"{TAGS}, {BASES}", "SELECT page_id, base_url FROM bases")
ORACLES["charset_counts"] = _with(
    PX,
    "SELECT lower(coalesce(nullif(regexp_extract(html, '(?i)<meta\\s+[^<]*content\\s*=[''\"][^''\"]*charset\\s*=([-_0-9a-zA-Z]+)', 1), ''), 'utf-8')) AS charset, count(*) AS n FROM px GROUP BY 1",
)
FLAGS = """flags AS (
  SELECT page_id, url, regexp_matches(t, '<\\s*html(\\s+[^>]*)?>') AS has_html, contains(t, 'search') AS has_search,
    contains(t, 'subscri') AS has_subscri, contains(t, 'login') AS has_keyword FROM line)"""
ORACLES["page_flags"] = _with(
    f"{PX}, {LINE}, {FLAGS}", "SELECT page_id, has_html, has_search, has_subscri, has_keyword FROM flags"
)
_PAGE_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))"
ORACLES["site_flag_counts"] = _with(
    f"{PX}, {LINE}, {FLAGS}",
    f"SELECT {_PAGE_HOST} AS host, count(*) AS pages, "
    + ", ".join(f"count(*) FILTER (WHERE has_{f}) AS n_{f}" for f in ("html", "search", "subscri", "keyword"))
    + " FROM flags GROUP BY 1",
)
_DECODED = "array_to_string(regexp_extract_all(t, 'document.write\\s*\\(\\s*unescape\\s*\\(([^)]+)', 1), ' ')"
for _ in range(5):
    _DECODED = f"url_decode({_DECODED})"
ORACLES["write_unescape_forms"] = _with(
    f"{PX}, {LINE}",
    f"SELECT page_id, contains(d, '<form') AND contains(d, '<input') AS writes_form FROM (SELECT page_id, {_DECODED} AS d FROM line)",
)

# --- Page pairs ---------------------------------------------------------------------------------
PAIRS = f"pairs AS ({_src(I.PAGE_PAIRS)})"


SCHEMED = "schemed AS (SELECT page_id, contains(base_url, '://') AS schemed FROM bases)"
_STATUS = "(SELECT schemed FROM schemed WHERE page_id = a_id) = (SELECT schemed FROM schemed WHERE page_id = b_id)"


def _on_pair_pages(sql: str) -> str:
    """The same over the pages of pairs."""
    assert PX in sql
    return sql.replace(PX, f"px AS ({_src(I.PAIR_PAGES)})")


def _pair_sql(ctes: str, items: str) -> str:
    """`items`: rows (page_id, item, cnt)."""
    sql = _with(
        f"{ctes}, {BASES}, {SCHEMED}, {PAIRS}, items AS ({items}), lens AS (SELECT page_id, sum(cnt) AS n FROM items GROUP BY 1)",
        f"""SELECT a_id, b_id, CASE WHEN NOT ok THEN NULL WHEN la = 0 AND lb = 0 THEN -1000.0::DOUBLE ELSE c::DOUBLE / greatest(1, least(la, lb)) END AS common_ratio_of_min,
  CASE WHEN ok THEN c END AS common_count, CASE WHEN ok THEN la END AS len_a, CASE WHEN ok THEN lb END AS len_b,
  CASE WHEN ok THEN 'ok' ELSE 'scheme_mismatch' END AS status FROM (
  SELECT a_id, b_id, {_STATUS} AS ok, CAST(coalesce(x.n, 0) AS BIGINT) AS la, CAST(coalesce(y.n, 0) AS BIGINT) AS lb,
    CAST(coalesce((SELECT sum(i.cnt) FROM items i JOIN items k ON k.item = i.item WHERE i.page_id = a_id AND k.page_id = b_id), 0) AS BIGINT) AS c
  FROM pairs LEFT JOIN lens x ON x.page_id = a_id LEFT JOIN lens y ON y.page_id = b_id)""",
    )
    return _on_pair_pages(sql)


_FULL = "SELECT page_id, item, count(*) AS cnt FROM {0} GROUP BY 1, 2"
_DIR = "regexp_extract(split_part({0}, '?', 1), '^(.*/)[^/]*$', 1)"
_BASE_DIR = "regexp_extract(base_url, '^[a-z]+://[^/?#]+(/[^?#]*/|/)', 1)"
_SET = (
    "SELECT DISTINCT page_id, CASE WHEN starts_with(item, '/') THEN "
    + _DIR.format("item")
    + f" ELSE {_BASE_DIR} || "
    + _DIR.format("item")
    + " END AS item, 1 AS cnt FROM ({0}) JOIN bases USING (page_id)"
)
ORACLES["sim_title_text"] = _pair_sql(TITLES.replace(PX, TAGS), _FULL.format("title_w"))
ORACLES["sim_stylesheet"] = _pair_sql(TAGS, _SET.format(SHEETS))
ORACLES["sim_script"] = _pair_sql(TAGS, _SET.format(SCRIPTS))
ORACLES["sim_img"] = _pair_sql(
    TAGS,
    f"SELECT DISTINCT page_id, {_PAGE_HOST} || regexp_replace(item, '/[^/]*$', '') AS item, 1 AS cnt FROM ({IMAGES}) JOIN px USING (page_id)",
)
ORACLES["sim_div_style"] = _pair_sql(TAGS, _FULL.format(f"({STYLES})"))
_BASE_HOST = _PAGE_HOST.replace("url", "base_url")
ORACLES["same_icon"] = _with(
    f"""{TAGS}, {BASES}, {SCHEMED}, {PAIRS}, icons AS (SELECT DISTINCT page_id, {_BASE_HOST} || item || '?' AS icon FROM ({ICONS}) JOIN bases USING (page_id)),
profile AS (SELECT page_id, schemed, CASE WHEN contains(url, '://') THEN {_PAGE_HOST} || '/' ELSE '' END || 'favicon.ico?' AS dflt, coalesce((SELECT list_sort(list(icon)) FROM icons i WHERE i.page_id = bases.page_id), []) AS x FROM bases JOIN schemed USING (page_id))""",
    f"""SELECT a_id, b_id, CASE WHEN a.schemed = b.schemed THEN list_has_any(a.x, b.x) END AS same,
  CASE WHEN a.schemed = b.schemed THEN list_has_any(CASE WHEN len(a.x) = 0 THEN [a.dflt] ELSE a.x END, CASE WHEN len(b.x) = 0 THEN [b.dflt] ELSE b.x END) END AS same_with_default,
  CASE WHEN a.schemed = b.schemed THEN len(a.x) END AS n_a, CASE WHEN a.schemed = b.schemed THEN len(b.x) END AS n_b,
  CASE WHEN a.schemed = b.schemed THEN array_to_string(a.x, '|') END AS icons_a, CASE WHEN a.schemed = b.schemed THEN array_to_string(b.x, '|') END AS icons_b,
  CASE WHEN a.schemed = b.schemed THEN 'ok' ELSE 'scheme_mismatch' END AS status
FROM pairs JOIN profile a ON a.page_id = a_id JOIN profile b ON b.page_id = b_id""",
)
ORACLES["same_icon"] = _on_pair_pages(ORACLES["same_icon"])
ORACLES["best_targets_title"] = _with(
    f"{TITLES}, items AS ({_FULL.format('title_w')}), lens AS (SELECT page_id, CAST(sum(cnt) AS BIGINT) AS n FROM items GROUP BY 1)",
    """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY common_ratio_of_min DESC, b_id) AS rank FROM (
    SELECT i.page_id AS a_id, k.page_id AS b_id, CAST(sum(i.cnt) AS BIGINT) AS common_count, x.n AS len_a, y.n AS len_b,
      sum(i.cnt)::DOUBLE / greatest(1, least(x.n, y.n)) AS common_ratio_of_min
    FROM items i JOIN items k ON i.item = k.item AND i.page_id <> k.page_id
      JOIN lens x ON x.page_id = i.page_id JOIN lens y ON y.page_id = k.page_id GROUP BY 1, 2, 4, 5)) WHERE rank <= 3""",
)

# --- Forms --------------------------------------------------------------------------------------
COUNTS = f"""{HIDDEN}, {LINE}, {INPUTS}, kinds AS (
  SELECT page_id, count(*) FILTER (WHERE type = 'text') AS n_text, count(*) FILTER (WHERE type = 'password') AS n_password,
    count(*) FILTER (WHERE type = 'submit') AS n_submit, count(*) FILTER (WHERE type = 'email') AS n_email FROM inputs GROUP BY 1
), counts AS (
  SELECT page_id, url, coalesce(n_text, 0) AS n_text, coalesce(n_password, 0) AS n_password, coalesce(n_submit, 0) AS n_submit,
    coalesce(n_email, 0) AS n_email, len(regexp_extract_all(t, {_text(_MARKUP['image_input'])})) AS n_image,
    len(regexp_extract_all(t, {_text(_MARKUP['select'])})) AS n_select, len(regexp_extract_all(t, {_text(_MARKUP['option'])})) AS n_option,
    contains(t, 'mail') AS has_mail
  FROM line LEFT JOIN kinds USING (page_id)
), classes AS (
  SELECT page_id, url, n_submit > 0 AND n_text + n_password >= CASE WHEN n_select >= 2 AND n_option >= 17 THEN 2 ELSE 4 END AS is_card_form,
    n_text = 1 AND (n_submit = 1 OR n_image = 1) AS is_signin_form, n_text + n_email = 1 AND has_mail AS is_email_form FROM counts
)"""
ORACLES["page_form_counts"] = _with(COUNTS, "SELECT * EXCLUDE (url) FROM counts")
ORACLES["classify_forms"] = _with(COUNTS, "SELECT * EXCLUDE (url) FROM classes")
ORACLES["site_form_counts"] = _with(
    COUNTS,
    f"SELECT {_PAGE_HOST} AS host, count(*) AS pages, count(*) FILTER (WHERE is_card_form) AS n_card, count(*) FILTER (WHERE is_signin_form) AS n_signin, count(*) FILTER (WHERE is_email_form) AS n_email FROM classes GROUP BY 1",
)


def _control_attr(name: str) -> str:
    return f"nullif(regexp_extract(raw, '\\b{name} *= *[\"'']([^\"'']+)[\"'']', 1), '')"


_INPUT = r"""<input[^>]+type=['"][^>"']+['"][^>]+>"""
CONTROLS = f"""{PX}, found AS (
  SELECT page_id, list_concat(
    list_filter(regexp_extract_all(html, {_text(_INPUT)}), lambda m: NOT regexp_matches(m, 'type=[''"]hidden')),
    regexp_extract_all(html, '<select[^>]+>')) AS x FROM px
), control AS (
  SELECT page_id, pos, regexp_extract(raw, '^<(\\w+)', 1) AS label, {', '.join(f'{_control_attr(n)} AS {n}' for n in ('type', 'name', 'id', 'size', 'maxlength', 'autocomplete', 'readonly'))}
  FROM (SELECT page_id, unnest(range(len(x))) AS pos, unnest(x) AS raw FROM found)
), numbered AS (
  SELECT *, CASE WHEN size IS NULL THEN 0 ELSE TRY_CAST(size AS INT) END AS ns, CASE WHEN maxlength IS NULL THEN 0 ELSE TRY_CAST(maxlength AS INT) END AS nm FROM control
), win0 AS (
  SELECT page_id, pos, list(type) OVER w AS types, list(coalesce(nm, 0)) OVER w AS ms, list(coalesce(ns, 0)) OVER w AS ss,
    bool_and(coalesce(type IN ('text', 'password'), false)) OVER w AS ok
  FROM numbered WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
), fours AS (
  SELECT page_id, pos, types, ms, ss FROM win0
  WHERE ok AND len(types) = 4 AND ((types[1] = 'text' AND types[4] = 'text') OR (types[2] = 'password' AND types[3] = 'password'))
), off AS (
  SELECT * FROM numbered WHERE lower(autocomplete) = 'off' AND ns IS NOT NULL AND nm IS NOT NULL
), cards AS (
  SELECT l.page_id, l.pos AS long_pos, s.pos AS short_pos FROM off l JOIN off s ON l.page_id = s.page_id AND s.pos BETWEEN l.pos AND l.pos + 4
  WHERE (l.ns BETWEEN 16 AND 20 OR l.nm BETWEEN 16 AND 20) AND (s.ns BETWEEN 3 AND 4 OR s.nm BETWEEN 3 AND 4)
), named AS (
  SELECT *, lower(coalesce(name, '')) || ' ' || lower(coalesce(id, '')) AS label_text, label = 'input' AND type = 'text' AS is_text FROM control
), flagged AS (
  SELECT px.page_id, coalesce((bool_or(label = 'select' AND contains(label_text, 'month')) AND bool_or(label = 'select' AND contains(label_text, 'year')))
      OR bool_or(is_text AND contains(label_text, 'date')), false) AS has_expiry,
    coalesce(bool_or(is_text AND readonly IS NULL AND contains(label_text, 'credit')) AND bool_or(is_text AND readonly IS NULL AND contains(label_text, 'card')), false) AS asks_for_card
  FROM px LEFT JOIN named USING (page_id) GROUP BY 1
), verdicts AS (
  SELECT page_id, pos, CASE WHEN ms = [4, 4, 4, 4] THEN '4 continuous vsinputs with equal maxlength'
    WHEN ss = [4, 4, 4, 4] THEN '4 continuous vsinputs with equal size' END AS v FROM fours
)"""
ORACLES["form_controls"] = _with(CONTROLS, "SELECT * FROM control")
ORACLES["four_in_a_row"] = _with(
    CONTROLS,
    "SELECT page_id, pos, array_to_string(types, '|') AS types, array_to_string(ms, '|') AS maxlengths, array_to_string(ss, '|') AS sizes FROM fours",
)
ORACLES["card_and_code_pairs"] = _with(CONTROLS, "SELECT page_id, long_pos, short_pos FROM cards")
ORACLES["card_form_flags"] = _with(CONTROLS, "SELECT page_id, has_expiry, asks_for_card FROM flagged")
ORACLES["card_form_reason"] = _with(
    CONTROLS,
    """SELECT page_id, CASE WHEN has_expiry THEN coalesce(
    (SELECT arg_min(v, pos) FROM verdicts w WHERE w.page_id = f.page_id AND v IS NOT NULL),
    CASE WHEN EXISTS (SELECT 1 FROM cards c WHERE c.page_id = f.page_id) THEN 'long text with short text in acceptable distance' END,
    CASE WHEN asks_for_card THEN 'require creditcard input form' END) END AS reason FROM flagged f""",
)

# --- Fetches ------------------------------------------------------------------------------------
_SITE = "regexp_extract(px.url, '^(https?://[^/?#]+)', 1)"
_MOVED = "nullif(regexp_extract(lower(html), '<script>window.location=\"([^\"]+)\"', 1), '')"
ORACLES["page_redirects"] = _with(
    f"{TAGS}, {REFRESH}",
    f"SELECT page_id, {_SITE} || coalesce((SELECT arg_min(item, pos) FROM refresh r WHERE r.page_id = px.page_id), {_MOVED}) AS redirect_url FROM px",
)
ORACLES["page_redirects_pattern"] = _with(PX, f"SELECT page_id, {_SITE} || {_MOVED} AS redirect_url FROM px")
CHAINS = f"""RECURSIVE fetches AS ({_src(I.FETCHES)}), hops AS (
  SELECT url AS hop, final_url, http_code, nullif(regexp_extract(html, 'url=([^"]+)"', 1), '') AS nxt, error
  FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC) AS r FROM fetches) WHERE r = 1
), chain AS (
  SELECT DISTINCT url AS root, url AS cur, [url] AS path, CAST(NULL AS BIGINT) AS http_code, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS VARCHAR) AS failed_url FROM fetches
  UNION ALL
  SELECT root, CASE WHEN hop IS NOT NULL AND error IS NULL AND nxt <> cur AND NOT list_contains(path, nxt) THEN nxt END,
    CASE WHEN hop IS NULL OR error IS NOT NULL THEN path ELSE list_concat(path, CASE WHEN final_url <> cur THEN [final_url] ELSE [] END,
      CASE WHEN nxt <> cur AND NOT list_contains(path, nxt) AND nxt <> final_url THEN [nxt] ELSE [] END) END,
    CASE WHEN hop IS NULL OR error IS NOT NULL THEN chain.http_code ELSE hops.http_code END,
    CASE WHEN hop IS NULL THEN 'no fetch captured' ELSE error END, CASE WHEN hop IS NULL OR error IS NOT NULL THEN cur END
  FROM chain LEFT JOIN hops ON hops.hop = chain.cur WHERE cur IS NOT NULL
), ended AS (SELECT * FROM chain WHERE cur IS NULL)"""
ORACLES["redirect_chains"] = _with(
    CHAINS,
    "SELECT root, array_to_string(path, '|') AS path, reason IS NULL AS is_redirect_complete, reason IS NULL AS finish_download, reason AS failed_download_reason, http_code, failed_url FROM ended",
)
ORACLES["distinct_roots"] = _with(f"fetches AS ({_src(I.FETCHES)})", "SELECT DISTINCT url FROM fetches")
ORACLES["final_content"] = _with(
    CHAINS,
    """SELECT e.root AS url, e.path[len(e.path)] AS final_url, f.html AS body FROM ended e LEFT JOIN (
  SELECT final_url, arg_max(html, fetched_at) AS html FROM fetches WHERE error IS NULL GROUP BY 1) f ON f.final_url = e.path[len(e.path)]""",
)
# The root takes path, completeness and code of every good hop and the reason of a failed one, which the failed hop gets too;
# the content length belongs to the final URL of each fetch.
ORACLES["fetch_state"] = _with(
    f"""{CHAINS}, lengths AS (
  SELECT final_url AS url, length(arg_max(html, fetched_at)) AS n FROM fetches WHERE error IS NULL GROUP BY 1
), states AS (
  SELECT root AS url, CASE WHEN failed_url IS DISTINCT FROM root THEN array_to_string(path, '|') END AS redirect_url_list,
    CASE WHEN failed_url IS DISTINCT FROM root THEN reason IS NULL END AS is_redirect_complete, reason IS NULL AS finish_download,
    reason AS failed_download_reason, CASE WHEN failed_url IS DISTINCT FROM root THEN http_code END AS http_code FROM ended
  UNION ALL
  SELECT DISTINCT failed_url, CAST(NULL AS VARCHAR), CAST(NULL AS BOOLEAN), false, reason, CAST(NULL AS BIGINT) FROM ended
  WHERE failed_url IS NOT NULL AND failed_url NOT IN (SELECT root FROM ended)
)""",
    """SELECT coalesce(s.url, l.url) AS url, redirect_url_list, is_redirect_complete, finish_download, failed_download_reason,
  l.n AS final_url_content_length, http_code FROM states s FULL JOIN lengths l ON s.url = l.url""",
)
META = f"changes AS ({_src(I.URL_CHANGES)})"
_STATE = ", ".join(
    f"arg_max({c}, fetched_at) FILTER (WHERE {c} IS NOT NULL) AS {c}"
    for c in ("is_redirect_complete", "finish_download", "failed_download_reason", "final_url_content_length", "http_code")
)
ORACLES["fetch_meta"] = _with(META, f"SELECT url, {_STATE} FROM changes GROUP BY 1")
ORACLES["stream_fetch_meta"] = ORACLES["fetch_meta"]

# --- Domains ------------------------------------------------------------------------------------
_BODY = "array_to_string(string_split(host, '.')[1:len(string_split(host, '.')) - 1], '')"


def _scores(source: str) -> str:
    return f"""scored0 AS (
  SELECT *, length({_BODY}) AS c, length({_BODY}) - length(regexp_replace({_BODY}, '[aeiou]', '', 'g')) AS v,
    length({_BODY}) - length(replace({_BODY}, '-', '')) AS d FROM {source}
), scored AS (
  SELECT * EXCLUDE (c, v, d), CAST(v AS DOUBLE) / (CAST(c - v - d AS DOUBLE) + 1e-307) AS ratio_nonvowel,
    CAST(v AS DOUBLE) / (CAST(c - d AS DOUBLE) + 1e-307) AS ratio_total FROM scored0
)"""


ORACLES["dga_scores"] = _with(f"{HOSTS}, {_scores('hosts')}", "SELECT * FROM scored")
ORACLES["read_host_lines"] = ORACLES["dga_scores"]
ORACLES["dga_site_summary"] = _with(
    f"{HOSTS}, {_scores('hosts')}",
    "SELECT regexp_extract(host, '([^.]*)$', 1) AS suffix, count(*) AS n_hosts, count(*) FILTER (WHERE ratio_total < 0.3) AS n_suspect, round(avg(ratio_total), 9) AS avg_ratio_total FROM scored GROUP BY 1",
)
ORACLES["dga_lowest"] = _with(
    f"{HOSTS}, {_scores('hosts')}", "SELECT * FROM scored ORDER BY ratio_total, host LIMIT 20"
)
ORACLES["stream_dga_scores"] = _with(
    f"per_page AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages), {_scores('per_page')}",
    "SELECT * FROM scored",
)

# --- Selection ----------------------------------------------------------------------------------


def _kth(value: str, k: int, by: str) -> str:
    return f"SELECT {by}, {value} AS kth FROM (SELECT {by}, {value}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS r FROM lineitem) WHERE r = {k}"


ORACLES["kth_smallest_grouped"] = _kth("l_extendedprice", 5000, "l_returnflag")
ORACLES["kth_smallest_ties"] = _kth("l_quantity", 900, "l_linestatus")
ORACLES["kth_smallest_narrowed"] = _kth("l_extendedprice", 700, "l_returnflag")
ORACLES["kth_smallest_global"] = (
    "SELECT l_extendedprice AS kth FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 1233"
)
ORACLES["kth_smallest_text"] = (
    "SELECT lang, text AS kth FROM (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY text) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 20"
)
ORACLES["kth_smallest_wide"] = "SELECT CAST(l_partkey AS VARCHAR) AS kth FROM lineitem ORDER BY l_partkey LIMIT 1 OFFSET 2999"
ORACLES["price_band_combos"] = _with(
    """RECURSIVE lines AS (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_extendedprice AS p,
    l_orderkey % 5 = 0 AND l_linenumber = 1 AS taken, l_orderkey % 7 < 2 AND l_linenumber = 2 AS barred FROM lineitem
), orders0 AS (
  SELECT l_orderkey, coalesce(sum(p) FILTER (WHERE taken), 0) AS total FROM lines GROUP BY 1
), sets AS (
  SELECT l_orderkey, 0 AS size, CAST([] AS DOUBLE[]) AS ps, total, CAST(0 AS BIGINT) AS last FROM orders0
  UNION ALL SELECT s.l_orderkey, s.size + 1, list_append(s.ps, l.p), s.total + l.p, l.r
    FROM sets s JOIN lines l ON l.l_orderkey = s.l_orderkey AND l.r > s.last AND NOT l.taken AND NOT l.barred
)""",
    "SELECT l_orderkey, size, array_to_string(list_transform(list_sort(ps), lambda p: printf('%.2f', p)), '|') AS prices, round(total, 2) AS total FROM sets WHERE total > 60000 AND total < 120000",
)
