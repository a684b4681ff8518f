"""DuckDB SQL for what is read from the table of pages.

It knows no tree: tags are cut by pattern, which is enough for the markup that
these pages have (paragraphs, headings, breaks, one block of navigation and a
footer); the hand-made pages of the tests hold what needs one."""

from __future__ import annotations

from corvane.functions import patterns as P
from corvane.plans import oracle as O
from corvane.plans import structure_sql as T

S, L = P.sql, P.literal
_PARAGRAPHS = "p|div|section|article|blockquote|main|figure|ul|ol|form|details"
_ENTITIES = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def cut(x: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({x}, {L(pattern)}, {by}, 'g')"


def decoded(x: str) -> str:
    for name, sign in _ENTITIES:
        x = f"replace({x}, {L(name)}, {L(sign)})"
    return x


def _without(x: str, *tags: str) -> str:
    for tag in tags:
        x = cut(x, rf"(?is)<{tag}\b.*?</{tag}\s*>")
    return x


def _flat(x: str) -> str:
    return T.strip(cut(x, r"\s+", "' '"))


_body = "regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)"
_head = "regexp_extract(marked, '(?is)<h1[^>]*>(.*?)</h1\\s*>', 1)"
_marked = _without(cut(_body, r"(?s)<!--.*?-->"), "script", "style", "noscript", "iframe", "svg", "template", "header", "footer", "nav")
_titled = f"CASE WHEN {_head} <> '' THEN replace(marked, regexp_extract(marked, '(?is)<h1[^>]*>.*?</h1\\s*>', 0), chr(10) || chr(10) || '# ' || {_flat(_head)} || chr(10) || chr(10)) ELSE marked END"
_lines = cut(cut(_titled, r"(?i)<br[^>]*>", "chr(10)"), rf"(?i)</?(?:{_PARAGRAPHS})\b[^>]*>", "chr(10)")
_text = T.strip(cut("line", r"[ \t]+", "' '"))
#: url, markdown of each page
PAGES = f"""pages_marked AS MATERIALIZED (SELECT page_id, url, html, {_marked} AS marked FROM pages),
pages_lines AS (SELECT page_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT page_id, string_split({decoded(cut(_lines, '<[^>]+>'))}, chr(10)) AS l FROM pages_marked) a),
pages_clean AS (SELECT page_id, i, {_text} AS line FROM pages_lines),
pages_kept AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY page_id ORDER BY i), '') AS before FROM pages_clean),
pages_md AS (SELECT page_id, {T.strip("string_agg(line, chr(10) ORDER BY i)")} AS markdown FROM pages_kept WHERE NOT (line = '' AND before = '') AND NOT (starts_with(line, '#') AND line = before) GROUP BY page_id),
pages_read AS (SELECT page_id, url, {O._noise("coalesce(markdown, '')")} AS text, {T.strip(decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS own, {decoded(cut(_without(cut(_body, r'(?s)<!--.*?-->'), 'script', 'style'), '<[^>]+>'))} AS body, {T.strip(decoded("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"))} AS h1, coalesce(markdown, '') AS markdown FROM pages_marked LEFT JOIN pages_md USING (page_id)),
pages_named AS (SELECT *, coalesce(nullif(own, ''), nullif({O.HOST}, ''), nullif({O.PATH}, ''), 'Untitled Page') AS title FROM pages_read),
pages_typed AS (SELECT *, {O.case([*((O.has(O.PATH, rule), L(kind)) for kind, rule in P.PATH_TYPES), (f"{O.PATH} IN ({', '.join(map(L, P.HOME_PATHS))})", "'homepage'"), *((O.has('lower(own)', rule), L(kind)) for kind, rule in P.TITLE_TYPES), *((O.has('lower(body)', rule), L(kind)) for kind, rule in P.BODY_TYPES)], "'general_page'")} AS page_type, {O.word_count('text')} AS words FROM pages_named),
pages_gated AS (SELECT *, {O._gate('url', 'title', 'text', 'words')} AS skip_reason FROM pages_typed),
pages_done AS (SELECT *, CASE WHEN skip_reason IS NULL THEN 'completed' ELSE 'skipped' END AS status FROM pages_gated)"""

_scan = lambda x: x.replace("(text,", "(body,")
_first = lambda x: f"array_to_string(({O.uniq(x)})[1:5], '|')"
_which = f"(SELECT *, {O._which} AS w FROM pages_done WHERE status = 'completed')"
_signed = f"(SELECT *, try_cast(replace({O._amount}, ',', '') AS DOUBLE) AS v, {O._sign} AS sign FROM {_which} a)"
FACTS = f"""facts AS MATERIALIZED (SELECT page_id, url, title, page_type, h1, CASE WHEN v > 0 AND v < 1000000 THEN v END AS price, CASE WHEN v > 0 AND v < 1000000 THEN {O._name} END AS currency,
  CASE WHEN {O.has('text', P.OUT_OF_STOCK)} THEN false WHEN {O.has('text', P.IN_STOCK)} THEN true END AS in_stock, array_to_string({O._chosen('text', P.PAGE_COLORS, '(?i)' + chr(92) + 'b@' + chr(92) + 'b', str)}, '|') AS colors, array_to_string({O.uniq(O._page_sizes)}, '|') AS sizes,
  {_first(_scan(O._emails))} AS emails, {_first(_scan(O._phones))} AS phones FROM {_signed} b)"""


def oracle_sql() -> dict[str, str]:
    header = "'Document Title: ' || CASE WHEN f.title IN ('', 'Untitled Page') THEN 'Page' ELSE f.title END || ' | Page Type: ' || regexp_replace(f.page_type, '^([^_]*)_', '\\1 ') || CASE WHEN coalesce(f.url, '') <> '' THEN ' | URL: ' || f.url ELSE '' END || CASE WHEN f.h1 <> '' THEN ' | Topics: ' || f.h1 ELSE '' END"
    said = f"CASE WHEN f.title <> '' THEN '[Page: ' || f.title || ']' || chr(10) ELSE '' END || '[Document Context: ' || {header} || ']' || chr(10) || chr(10) || c.chunk"
    h = "sha256(f.url || '::' || c.parent || '_' || c.no || '::' || sha256(c.chunk))"
    point = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || CASE (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
    chunked = T.children("(SELECT page_id AS id, text FROM pages_done WHERE status = 'completed')").removeprefix("WITH RECURSIVE ")
    n, price = "chr(10)", "CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END"
    product = f"'Product: ' || p_name || {n} || 'SKU: ' || p_partkey || {n} || 'Brand: ' || p_brand || {n} || 'Price: USD ' || {price} || {n} || 'Availability: InStock' || {n} || 'Rating: ' || (p_partkey % 5 + 1) || ' (' || (p_partkey + 1) || ' reviews)' || {n} || 'Size: ' || p_size"
    service = f"'Service: ' || p_name || {n} || 'Description: ' || p_type || {n} || 'Price: USD ' || {price} || {n} || 'Area Served: ' || p_brand"
    shop = f"'Business Name: ' || p_name || {n} || 'Phone: ' || p_partkey || {n} || 'Address: ' || p_brand || ', ' || p_size"
    nation = "'| ' || n_nationkey || ' | ' || n_name || ' \\| x |'"
    return {
        "table_markdown": f"SELECT 'https://e.com/region/' || n_regionkey AS url, 'Nations' || {n} || {n} || '| key | name |' || {n} || '| --- | --- |' || {n} || string_agg({nation}, {n} ORDER BY n_nationkey) || {n} || '| \\| in \\| \\| --- \\| | in |'  || {n} || '| in |' AS markdown FROM nation GROUP BY n_regionkey",
        "jsonld_lines": f"SELECT 'https://e.com/part/' || p_partkey AS url, CASE p_partkey % 3 WHEN 0 THEN {product} WHEN 1 THEN {service} ELSE {shop} END AS ld_text, CASE p_partkey % 3 WHEN 0 THEN 'product' WHEN 1 THEN 'service' ELSE 'localbusiness' END AS types, CAST(NULL AS VARCHAR) AS error FROM part",
        "html_markdown": f"WITH {PAGES}\nSELECT url, markdown, CAST(NULL AS VARCHAR) AS error FROM pages_read",
        "ingest_status": f"WITH {PAGES}\nSELECT status, page_type, count(*) AS pages, CAST(sum(words) AS BIGINT) AS words FROM pages_done GROUP BY status, page_type",
        "business_name": f"WITH {PAGES}\nSELECT CASE WHEN status = 'completed' THEN nullif(trim(regexp_extract(title, '^([^-|–]*)', 1)), '') END AS business_name FROM pages_done ORDER BY page_id LIMIT 1",
        "chunk_points": f"""WITH RECURSIVE {PAGES},\n{FACTS},\n{chunked},
made AS (SELECT {h} AS h, f.*, c.parent || '_' || c.no AS child_index, 'parent_' || p.no || '_' || {T.quarter('p.chunk')} AS parent_id, c.chunk AS text, {said} AS contextual_text FROM children c JOIN parents p ON p.id = c.id AND p.no = c.parent JOIN facts f ON f.page_id = c.id)
SELECT {point} AS id, url, child_index, parent_id, text, contextual_text, title, page_type, {T.quarter('contextual_text')} AS tokens, price, currency, in_stock, colors, sizes, emails, phones FROM made""",
    }
