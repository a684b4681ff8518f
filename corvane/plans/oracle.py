"""DuckDB SQL for the queries, made from the same fixed values.

Each piece is written for that engine: its own pattern syntax, its own list
functions, joins and windows.
"""

from __future__ import annotations

from corvane.functions import patterns as P
from corvane.functions import urls as U
from corvane.operators.detect import COMMON
from corvane.operators import chat
from corvane.plans import fixtures as X
from corvane.plans import queries as Q

S, L = P.sql, P.literal


def trim(x: str) -> str:
    edges = S(r"^\s+|\s+$")
    return f"regexp_replace({x}, {edges}, '', 'g')"


def squeeze(x: str) -> str:
    runs = S(r"\s+")
    return trim(f"regexp_replace({x}, {runs}, ' ', 'g')")


def case(rules: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rules) + f" ELSE {otherwise} END"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {S(pattern)})"


def uniq(x: str) -> str:
    """Distinct values, each at its first place."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def words(x: str) -> str:
    runs = S(r"\s+")
    return f"len(list_filter(string_split_regex({x}, {runs}), lambda w: w <> ''))"


def word_count(x: str) -> str:
    return f"CAST({words(x)} + len(regexp_extract_all({x}, {S(P.CJK)})) AS INTEGER)"


TEXTS = f"(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT * FROM {X.values(X.TEXTS)})"
URLS = f"(SELECT 'p' || page_id AS id, url FROM pages UNION ALL SELECT * FROM {X.values(X.URLS)})"
QUERIES = f"(SELECT 'b' || item_id AS id, text AS query FROM benchmark UNION ALL SELECT * FROM {X.values(X.QUERIES)})"


def _sitemap(fetched: str, root: str, site: str) -> str:
    """url, depth of the pages reached from a map, level by level."""
    loc = L(r"(?i)<loc>\s*(?:<!\[CDATA\[)?\s*(https?://[^\s\]<]+)\s*(?:\]\]>)?\s*</loc>")
    is_map = "(ends_with(url, '.xml') OR contains(url, 'sitemap'))"
    levels = []
    for d in range(3):
        at = f"address = {L(root)}" if d == 0 else f"address IN (SELECT url FROM m{d - 1})"
        levels.append(f"l{d} AS (SELECT address AS place, generate_subscripts(locs, 1) AS pos, unnest(locs) AS url FROM (SELECT address, regexp_extract_all(xml, {loc}, 1) AS locs FROM f WHERE {at})), p{d} AS (SELECT {d} AS depth, place, pos, url FROM l{d} WHERE NOT {is_map} AND {bare('url')} = {L(site)} AND {CRAWLABLE}), m{d} AS (SELECT url FROM l{d} WHERE {is_map} GROUP BY url ORDER BY min((place, pos)) LIMIT 15)")
    return f"WITH f AS (SELECT address, xml FROM {fetched} x), {', '.join(levels)} SELECT url, min(depth) AS depth FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY url"


def _tiers(third: int, kept: str, typed: str) -> str:
    """Dense search of a third of the queries under a filter, then under the types,
    then under none."""
    some = [f"(SELECT * FROM {x} WHERE query % 3 = {third})" for x in (_dense(kept), _dense(typed, None), _dense("true", None))]
    parts = [f"SELECT query, id, score, rank, {t} AS tier FROM {x}" + "".join(f" {'WHERE' if k == 0 else 'AND'} query NOT IN (SELECT query FROM {some[k]})" for k in range(t)) for t, x in enumerate(some)]
    return " UNION ALL ".join(parts)


def texts(columns: str) -> str:
    return f"SELECT id, {columns} FROM {TEXTS} t"


# --- URLs ---
ABS = L(U.ABSOLUTE)
_own = f"regexp_extract(url, {ABS}, 3)"
_rel = "regexp_replace(url, '[?#](?s:.*)$', '')"
PATH = f"lower(CASE WHEN coalesce(url, '') = '' THEN '' WHEN regexp_matches(url, {ABS}) THEN CASE WHEN {_own} = '' THEN '/' ELSE {_own} END WHEN starts_with({_rel}, '/') THEN {_rel} ELSE '/' || {_rel} END)"
HOST_RAW = f"lower(regexp_extract(url, {ABS}, 2))"
HOST = f"CASE WHEN {HOST_RAW} = 'localhost' THEN '' ELSE {HOST_RAW} END"
SCHEME = f"lower(regexp_extract(url, {ABS}, 1))"
CRAWLABLE = f"coalesce(regexp_matches(url, {ABS}) AND {has('url', '(?i)^https?://')} AND NOT {has(PATH, P.FILE_EXTENSION)} AND NOT {has(PATH, P.ASSET_PATH)}, false)"


def bare(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, {ABS}, 2)), '^www\\.', '')"


_SITE = "'https://www.example.com/'"
_page_type = case([*((has(PATH, rule), L(kind)) for kind, rule in P.PATH_TYPES), (f"{PATH} IN ({', '.join(map(L, P.HOME_PATHS))})", "'homepage'")], "'general_page'").replace("url", "u0")


def _gate(url: str, title: str, text: str, n: str) -> str:
    head = f"(coalesce({title}, '') || chr(10) || substr({text}, 1, 1000))"
    rules = [(has(url, p), L(f"Excluded utility or sitemap URL pattern ({P.script(p)})")) for p in P.EXCLUDED_URLS]
    rules.append((f"{trim(f'coalesce({text}, chr(32))')} = ''", "'Empty page body text'"))
    rules.append((f"{n} < {P.LEAST_WORDS}", f"'Low word count (' || {n} || ' words < {P.LEAST_WORDS} threshold)'"))
    rules += [(has(head, p), L(f"Soft-404 or HTTP error page detected ({P.script(p)})")) for p in P.ERROR_PAGES]
    return case(rules)


# --- text ---
_emails = f"regexp_extract_all(text, {S(P.EMAIL)})"
_phones = f"list_filter(list_transform(regexp_extract_all(text, {S(P.PHONE)}), lambda p: {trim('p')}), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 7 AND 15 AND NOT {has('p', P.DATE_LIKE)} AND NOT {has('p', P.ADDRESS_LIKE)})"


def _noise(x: str) -> str:
    for pattern, by in P.NOISE:
        x = f"regexp_replace({x}, {S(pattern)}, {L(by)}, 'g')"
    return trim(x)


_which = case([(has("text", p), str(k)) for k, p in enumerate(P.PRICES)])
_amount = f"CASE w {' '.join(f'WHEN {k} THEN regexp_extract(text, {S(p)}, {2 if k < 2 else 1})' for k, p in enumerate(P.PRICES))} END"
_sign = f"upper(CASE w {' '.join(f'WHEN {k} THEN regexp_extract(text, {S(p)}, 1)' for k, p in enumerate(P.PRICES))} END)"
_name = case([(f"sign = {L(s)}", L(n)) for s, n in P.CURRENCIES], "nullif(sign, '')")
ECOM_PRICE = f"""WITH a AS (SELECT id, text, {_which} AS w FROM {TEXTS} t), b AS (SELECT id, try_cast(replace({_amount}, ',', '') AS DOUBLE) AS v, {_sign} AS sign FROM a)
SELECT id, CASE WHEN v > 0 AND v < 1000000 THEN CAST(floor(v * 100.0 + 0.5) AS BIGINT) END AS price_cents, CASE WHEN v > 0 AND v < 1000000 THEN {_name} END AS currency FROM b"""


def _chosen(x: str, values, pattern: str, name) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(x, pattern.replace('@', v))} THEN {L(name(v))} END" for v in values) + "], lambda c: c IS NOT NULL)"


_ALPHA = r"(?i)\b(?:size\s+@|@\s+size|size\s*:\s*@)\b"
_up = lambda s: s.upper() if len(s) <= 3 else s
_page_sizes = f"CASE WHEN text IS NOT NULL THEN list_concat({_chosen('text', P.PAGE_SIZES, _ALPHA, _up)}, regexp_extract_all(text, {S(P.PAGE_NUMBER_SIZE)}, 1)) END"

# --- queries ---


def _num(pattern: str, group: int) -> str:
    return f"try_cast(regexp_extract(q, {S(pattern)}, {group}) AS DOUBLE)"


_MOST = case([(has("q", P.RANGE), _num(P.RANGE, 2)), (has("q", P.AT_MOST[0]), _num(P.AT_MOST[0], 1)), (has("q", P.AT_MOST[1]), _num(P.AT_MOST[1], 1))])
_LEAST = case([(has("q", P.RANGE), _num(P.RANGE, 1)), (has("q", P.AT_LEAST), _num(P.AT_LEAST, 1))])
_Q = f"(SELECT id, query, lower(query) AS q FROM {QUERIES} x)"
_cents = lambda x: f"CAST(floor({x} * 100.0 + 0.5) AS BIGINT)"
_colors = _chosen("q", P.QUERY_COLORS, r"(?i)\b@\b", str)


def _glue(*shapes: tuple[str, str]) -> str:
    return L(P.re2(r"\b") + "(?:") + " || " + " || '|' || ".join(f"{S(a)} || n || {S(b)}" for a, b in shapes) + f" || {L(')' + P.re2(chr(92) + 'b'))}"


_named = _glue((r"size\s*[:=]?\s*", ""), ("", r"\s*size"), (r"waist\s*[:=]?\s*", ""), ("", r"\s*waist"), (r"uk\s+", ""), (r"us\s+", ""), (r"eu\s+", ""))
_alone = _glue((r"\s*", ""))
_numbers = f"list_filter(regexp_extract_all(q, {S(P.NUMBER_SIZE)}, 1), lambda n: NOT (coalesce(try_cast(n AS DOUBLE) = most, false) OR coalesce(try_cast(n AS DOUBLE) = least, false) OR regexp_matches(q, {_alone})) AND regexp_matches(q, {_named}))"
_lone = f"upper(regexp_extract(q, {S(P.STANDALONE_SIZE)}, 1))"
_stock = f"({has('q', P.WANTS_STOCK)} AND NOT {has('q', P.WANTS_NO_STOCK)})"
FACETS = f"""WITH a AS (SELECT id, query, q, {_MOST} AS most, {_LEAST} AS least FROM {_Q} y), b AS (SELECT *, list_concat({_chosen('q', P.QUERY_SIZES, _ALPHA, _up)}, {_numbers}) AS s0 FROM a),
c AS (SELECT *, CASE WHEN q IS NULL THEN NULL WHEN {has('q', P.NO_SIZE)} THEN [] WHEN len(s0) = 0 AND {_lone} <> '' THEN [{_lone}] ELSE {uniq('s0')} END AS sizes, {_colors} AS colors, {_stock} AS in_stock, {has('q', P.COMPARES)} AS comparison FROM b)"""


def _parts(x: str, by: str, lead: str | None = None) -> str:
    cut = f"string_split_regex({x}, {S(by)})"
    if lead:
        cut = f"list_transform({cut}, lambda p: regexp_replace(p, {S(lead)}, ''))"
    cut = f"list_filter(list_transform({cut}, lambda p: {trim('p')}), lambda p: p <> '')"
    return f"CASE WHEN len({cut}) >= 2 THEN array_to_string({cut}[1:3], '|') ELSE '' END"


_after = lambda w: trim(f"regexp_replace(q, {S(chr(94) + '.*?' + chr(92) + 'b' + w + chr(92) + 'b')}, '')")
_compared = case([
    (f"NOT {has('q', P.COMPARES)}", "''"), (has("q", r"\bvs\b"), _parts("q", r"\bvs\b", r"^(?:compare|difference between|\s)+")), (has("q", r"compare\b"), _parts(_after("compare"), r"\s+(?:and|with|to|vs)\s+")),
    (has("q", r"difference between\b"), _parts(_after("difference between"), r"\s+(?:and|with)\s+")),
], "''")
_short = squeeze(f"regexp_replace(q, {S(P.FLUFF)}, '', 'g')")
_clean = f"CASE WHEN length({_short}) < 3 THEN q ELSE {_short} END"

# --- conversations ---
_TURNS = """(SELECT 'c' || conv_id || '_' || turn AS id, text, last_user, has_history, role FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS last_user, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS has_history
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'user')"""
MESSAGES = f"(SELECT id, text, last_user, has_history FROM {_TURNS} UNION ALL SELECT * FROM {X.values(X.MESSAGES)})"
_T = f"(SELECT id, text, last_user, has_history, {trim('text')} AS t FROM {MESSAGES} m)"
_intent = case([
    (has("t", P.GRATITUDE), "'gratitude'"), (f"{has('t', P.GREETING)} OR {has('t', P.SMALL_TALK)}", "'greeting'"), *((has("t", p), L(n)) for n, p in P.INTENTS), (f"coalesce({has('last_user', P.INTENTS[0][1])}, false)", "'product'"),
    (f"{words('t')} + len(regexp_extract_all(t, {S(P.CJK)})) < 3 AND NOT has_history", "'vague'"),
], "'general'")
_branch = case([(f"intent = {L(a)}", L(b)) for a, b in P.BRANCHES], "'semantic'")
INTENT = f"(SELECT *, {_intent} AS intent FROM {_T} z)"
_reason = f"""CASE WHEN intent IN ('greeting', 'contact', 'vague') OR t = '' OR {has('t', P.CORRECTION)} OR {has('t', P.DIRECT)} THEN NULL WHEN {words('t')} <= 3 THEN 'short' WHEN {has('t', P.AMBIGUOUS)} THEN 'pronoun' WHEN {has('t', P.DISCOVERY)} THEN 'catalog' END"""
_low = trim("lower(coalesce(text, ''))")
_english = f"({_low} = '' OR (NOT regexp_matches({_low}, '[^\\x20-\\x7E]') AND ({has(_low, P.ENGLISH_PHRASE)} OR list_has_any(string_split_regex({_low}, '[^a-z]+'), [{', '.join(map(L, P.ENGLISH_WORDS))}]))))"
_g = "trim(regexp_replace(lower(text), '[,!?.'']', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13))"
_said = lambda text: L(text.replace("@", "Acme"))
_reply = case([*((f"regexp_matches({_g}, {L(rule)})", _said(text)) for rule, text in P.GREETING_REPLIES), ("has_history", _said(P.GREETING_AGAIN))], _said(P.GREETING_FIRST))

# --- retrieval ---
_VEC = "(SELECT vec_id // 50 AS query, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)"


def _dense(where: str = "true", least: str | None = "50000", limit: int = 30) -> str:
    keep = f" AND score >= {least}" if least else ""
    return f"""(SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.query, e.vec_id AS id, CAST(floor(list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * 1e6 + 0.5) AS BIGINT) AS score
FROM {_VEC} q, embeddings e WHERE {where}) WHERE true{keep}) WHERE rank <= {limit})"""


_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9À-ɏ]+'), lambda w: w <> '')"
BM25 = f"""(WITH d AS (SELECT doc_id AS id, {_TOKENS} AS words FROM documents), n AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d), c AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(words) AS len, unnest(words) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term), q AS (SELECT item_id AS query, unnest(list_distinct({_TOKENS})) AS term FROM benchmark),
s AS (SELECT query, id, CAST(floor(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) * 1e6 + 0.5) AS BIGINT) AS score FROM c JOIN f USING (term) JOIN q USING (term), n GROUP BY query, id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 30)"""
FUSED = f"""(SELECT query, id, coalesce(d.rank, 999) AS dense_rank, coalesce(s.rank, 999) AS sparse_rank, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0) AS raw FROM {_dense()} d FULL OUTER JOIN {BM25} s USING (query, id))"""
RRF = f"(SELECT query, id, dense_rank, sparse_rank, CAST(floor(raw * 1e6 + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY query ORDER BY raw DESC, dense_rank, sparse_rank, id) AS rank FROM {FUSED})"
_RANKED = f"(SELECT * FROM {X.values(X.RANKED)} UNION ALL SELECT b.query + 1000, b.id, CAST(b.rank AS INTEGER), b.score / 1e8::DOUBLE, d.source, 'p' || (b.id % 5), d.text, NULL FROM {BM25} b JOIN documents d ON d.doc_id = b.id)"
_KEY = "coalesce(nullif(url, ''), nullif(parent_id, ''), CAST(id AS VARCHAR))"
DIVERSE = f"(SELECT * EXCLUDE (own, rank, r), r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS r FROM (SELECT *, row_number() OVER (PARTITION BY query, {_KEY} ORDER BY rank, id) AS own FROM {_RANKED}) WHERE own <= 2) WHERE r <= 12)"
SELECTED = f"""(SELECT * EXCLUDE (enough, best, rank, r), r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, rank, id) AS r FROM (SELECT *, max(CAST(score >= 0.10 AS INT)) OVER (PARTITION BY query) = 1 AS enough FROM
(SELECT * REPLACE (CASE WHEN best <= 0 THEN greatest(0.85 - (rank - 1) * 0.02, 0.75) ELSE score END AS score) FROM (SELECT *, max(coalesce(score, 0)) OVER (PARTITION BY query) AS best FROM {DIVERSE}))) WHERE NOT enough OR score >= 0.10) WHERE r <= CASE WHEN enough THEN 5 ELSE 3 END)"""
_sig = lambda x: f"(1.0 / (1.0 + exp(-({x}))))"
_safe = "greatest(least(score, 0.999999), 1e-10)"
PARENT_TEXT = "coalesce(nullif(parent_text, ''), nullif(text, ''))"
PARENTS = f"(SELECT * REPLACE ({PARENT_TEXT} AS text) FROM (SELECT *, row_number() OVER (PARTITION BY query, coalesce(nullif(parent_id, ''), CAST(id AS VARCHAR)) ORDER BY rank, id) AS own FROM {SELECTED}) WHERE own = 1)"

# --- accounts ---
_MODELS = (("view", "openai/gpt-4o-mini"), ("click", "openai/text-embedding-3-small"), ("purchase", "cohere/rerank-v3.5"), ("signup", "jina-reranker-v3"))
_RATES = "(SELECT * FROM (VALUES " + ", ".join(f"({L(m)}, {', '.join(f'{v!r}::DOUBLE' for v in r)})" for m, *r in P.RATES) + ") AS r(model, fixed, rin, rout, rcache))"
USED = f"""(SELECT event_id, ts, 'bot_' || (user_id % 20) AS bot, CASE event_type {' '.join(f'WHEN {L(a)} THEN {L(b)}' for a, b in _MODELS)} ELSE 'unknown/model' END AS model, CAST(floor(coalesce(value, 0) * 10) AS BIGINT) AS input_tokens, CAST(floor(coalesce(value, 0)) AS BIGINT) AS output_tokens, CAST(coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS BIGINT) AS cache_tokens FROM events)"""
_d = dict(zip(("fixed", "rin", "rout", "rcache"), P.DEFAULT_RATE, strict=True))
_r = {k: f"coalesce(r.{k}, {v!r}::DOUBLE)" for k, v in _d.items()}
COSTED = f"""(SELECT *, CAST(floor(i * 1e8 + 0.5) AS BIGINT) AS input_cost, CAST(floor(o * 1e8 + 0.5) AS BIGINT) AS output_cost, CAST(floor(c * 1e8 + 0.5) AS BIGINT) AS cache_cost, CAST(floor(CASE WHEN f > 0 THEN f ELSE i + o + c END * 1e8 + 0.5) AS BIGINT) AS total_cost FROM (
SELECT u.*, {_r['fixed']} AS f, CASE WHEN {_r['fixed']} > 0 THEN 0.0::DOUBLE ELSE greatest(input_tokens - cache_tokens, 0) * {_r['rin']} END AS i, CASE WHEN {_r['fixed']} > 0 THEN 0.0::DOUBLE ELSE output_tokens * {_r['rout']} END AS o, CASE WHEN {_r['fixed']} > 0 THEN 0.0::DOUBLE ELSE cache_tokens * {_r['rcache']} END AS c FROM {USED} u LEFT JOIN {_RATES} r USING (model)))"""
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_tokens", "input_cost", "output_cost", "cache_cost", "total_cost"))
_UUID = "sha256(url || '::' || ix || '::' || sha256(text))"


def oracle_sql() -> dict[str, str]:
    sizes = "array_to_string(sizes, '|')"
    out = {
        "url_parts": f"SELECT id, {SCHEME} AS scheme, {HOST} AS host, {PATH} AS path, CASE WHEN regexp_matches(url, {ABS}) THEN {SCHEME} || '://' || {HOST_RAW} END AS origin FROM {URLS} t",
        "url_crawlable": f"SELECT id, {CRAWLABLE} AS crawlable FROM {URLS} t",
        "url_same_domain": f"SELECT id, coalesce(regexp_matches(url, {ABS}) AND {bare('url')} = {bare(_SITE)}, false) AS same FROM {URLS} t",
        "crawl_queue": f"SELECT url, row_number() OVER (ORDER BY first, url) AS place FROM (SELECT url, min(CAST(substr(id, 2) AS BIGINT) + CASE WHEN id[1] = 'u' THEN 1099511627776 ELSE 0 END) AS first FROM {URLS} t GROUP BY url HAVING {CRAWLABLE} ORDER BY 2, 1 LIMIT 500)",
        "page_type": f"SELECT id, {_page_type} AS page_type FROM (SELECT id, coalesce(url, '') AS u0 FROM {URLS} t)",
        "quality_gate": f"SELECT id, {_gate('url', 'title', 'text', 'n')} AS skip_reason FROM (SELECT *, {word_count('coalesce(text, chr(32))')} AS n FROM (SELECT 'd' || doc_id AS id, source AS url, '' AS title, text FROM documents UNION ALL SELECT * FROM {X.values(X.GATE)}))",
        "is_html": f"SELECT 'p' || page_id AS id, {has('html', P.HTML_TAG)} AS is_html FROM pages UNION ALL {texts(f'coalesce({has('text', P.HTML_TAG)}, false) AS is_html')}",
        "page_title": "SELECT 'p' || page_id AS id, trim(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&amp;', '&'), chr(32) || chr(9) || chr(10) || chr(13)) AS title FROM pages",
        "word_count": texts(f"{word_count('text')} AS words"),
        "content_hash": texts("sha256(text) AS content_hash"),
        "token_count": texts("CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens"),
        "strip_noise": texts(f"{_noise('text')} AS stripped"),
        "contact_emails": texts(f"array_to_string(({uniq(_emails)})[1:5], '|') AS emails"),
        "contact_phones": texts(f"array_to_string(({uniq(_phones)})[1:5], '|') AS phones"),
        "md_title": texts(f"{trim(f'regexp_extract({trim(chr(116) + chr(101) + chr(120) + chr(116))}, {S('(?m)^#' + chr(92) + 's+(.+)')}, 1)')} AS title"),
        "ecom_price": ECOM_PRICE,
        "ecom_colors": texts(f"array_to_string({_chosen('text', P.PAGE_COLORS, '(?i)' + chr(92) + 'b@' + chr(92) + 'b', str)}, '|') AS colors"),
        "ecom_sizes": texts(f"array_to_string({uniq(_page_sizes)}, '|') AS sizes"),
        "ecom_stock": texts(f"CASE WHEN {has('text', P.OUT_OF_STOCK)} THEN false WHEN {has('text', P.IN_STOCK)} THEN true END AS in_stock"),
        "query_price": f"SELECT id, {_cents(_LEAST)} AS least_cents, {_cents(_MOST)} AS most_cents FROM {_Q} y",
        "query_facets": f"{FACETS} SELECT id, array_to_string(colors, '|') AS colors, {sizes} AS sizes, in_stock, comparison, CASE WHEN most IS NOT NULL OR len(colors) > 0 OR len(sizes) > 0 OR in_stock OR comparison THEN 'high' ELSE 'low' END AS confidence FROM c",
        "query_parse": f"{FACETS} SELECT id, NOT (most IS NOT NULL OR len(colors) > 0 OR len(sizes) > 0 OR in_stock OR comparison) AND {has('query', P.COMPLEX)} AS ask_model, {_clean} AS cleaned FROM c",
        "query_compare": f"SELECT id, {_compared} AS compared FROM {_Q} y",
        "query_clean": f"SELECT id, {_clean} AS cleaned FROM {_Q} y",
        "intent": f"SELECT id, intent, {_branch} AS branch FROM {INTENT} i",
        "guardrail": f"SELECT id, {' OR '.join(has('text', p) for p in P.GUARDRAILS)} AS guarded FROM {MESSAGES} m",
        "likely_english": f"SELECT id, {_english} AS english FROM {MESSAGES} m",
        "augment_query": f"SELECT id, {case([(f'intent = {L(a)}', f'text || {L(chr(32) + b)}') for a, b in P.AUGMENTATIONS], 'text')} AS augmented FROM {INTENT} i",
        "hyde_trigger": f"SELECT id, {_reason} AS reason FROM {INTENT} i",
        "expand_query": f"SELECT id, CASE WHEN ({_reason}) IS NULL AND {has('t', P.CATALOG)} THEN t || {L(' ' + P.CATALOG_SUFFIX)} ELSE t END AS expanded FROM {INTENT} i",
        "greeting_reply": f"SELECT id, {_reply} AS reply FROM {MESSAGES} m",
        "chat_route": f"SELECT id, intent, rag_path, rag_path <> 'gratitude' AS logged, CASE rag_path WHEN 'gratitude' THEN {_said(P.GRATITUDE_REPLY)} WHEN 'greeting' THEN {_reply} WHEN 'none' THEN {_said(P.GUARDED_REPLY)} END AS reply FROM (SELECT *, CASE WHEN intent IN ('gratitude', 'greeting') THEN intent WHEN {' OR '.join(has('text', p) for p in P.GUARDRAILS)} THEN 'none' WHEN intent = 'vague' THEN 'clarify' WHEN intent = 'product' THEN 'structured' ELSE 'semantic' END AS rag_path FROM {INTENT} i)",
        "history_window": "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN role = 'assistant' AND length(text) > 250 THEN substr(text, 1, 250) || '...' ELSE coalesce(text, '') END AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 4",
        "context_header": """SELECT doc_id, 'Document Title: ' || CASE doc_id % 4 WHEN 3 THEN 'About ' || src ELSE 'Page' END || ' | Page Type: ' || ['product page', 'faq page_type', 'document', 'document', 'about'][doc_id % 5 + 1] || CASE doc_id % 3 WHEN 0 THEN coalesce(' | URL: ' || nullif(source, ''), '') WHEN 1 THEN '' ELSE ' | URL: /d/' || src END
|| CASE WHEN doc_id % 2 = 0 THEN ' | Topics: ' || array_to_string(list_filter([src, '', coalesce(lang, ''), 'a', 'b'], lambda x: x <> ''), ' > ') ELSE '' END AS header FROM (SELECT *, coalesce(source, '') AS src FROM documents)""",
        "chunk_uuid": f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || CASE (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 WHEN 0 THEN '8' WHEN 1 THEN '9' WHEN 2 THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT doc_id, {_UUID} AS h FROM (SELECT doc_id, source AS url, '0_' || (doc_id % 7) AS ix, text FROM documents))",
        "knn_dense": f"SELECT * FROM {_dense()}",
        "filter_payload": f"SELECT * FROM {_dense('e.label > 0 AND e.label * 10 <= 30 AND e.label % 2 = 1')}",
        "dense_fallback": " UNION ALL ".join(_tiers(k, *rules) for k, rules in enumerate((("e.label >= 1", "e.label IN (1, 3)"), ("e.label > 100", "e.label IN (1, 3)"), ("e.label > 100", "e.label > 200")))),
        "knn_product": f"SELECT * FROM {_dense('true', '200000', 6)} WHERE query NOT IN (SELECT query FROM {_dense('e.label = 2', '300000', 6)}) UNION ALL SELECT * FROM {_dense('e.label = 2', '300000', 6)}",
        "bm25_stats": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS})) AS term FROM documents) GROUP BY term",
        "bm25_topk": f"SELECT * FROM {BM25}",
        "rrf_fuse": f"SELECT * FROM {RRF}",
        "compare_interleave": f"SELECT query, id, entity, row_number() OVER (PARTITION BY query ORDER BY rank, entity, id) AS rank FROM (SELECT query, id, rank, entity, row_number() OVER (PARTITION BY query, id ORDER BY rank, entity) AS f FROM (SELECT query // 2 AS query, query % 2 AS entity, rank, id FROM {_dense()})) WHERE f = 1",
        "diversity_cap": f"SELECT query, id, rank FROM {DIVERSE}",
        "calibrate_scores": f"SELECT provider, score, CAST(floor(CASE provider WHEN 'jina' THEN {_sig('score')} WHEN 'bge' THEN {_sig(f'(ln({_safe} / (1 - {_safe})) + 4.5) / 1.5')} ELSE score END * 1e4 + 0.5) AS BIGINT) AS calibrated FROM (SELECT * FROM {X.values(X.SCORES)} UNION ALL SELECT ['jina', 'bge', 'cohere'][id % 3 + 1], score / 1e8::DOUBLE FROM {BM25})",
        "rerank_none": f"SELECT query, id, rank, CAST(floor(greatest(0.85::DOUBLE - (rank - 1) * 0.02::DOUBLE, 0.70::DOUBLE) * 1e4 + 0.5) AS BIGINT) AS score FROM {DIVERSE}",
        "rerank_select": f"SELECT query, id, rank, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score FROM {SELECTED}",
        "abstention": f"SELECT query, CAST(floor(coalesce(top, 0) * 1e4 + 0.5) AS BIGINT) AS top, top IS NULL OR top < CASE WHEN {has('text', P.CATALOG_QUERY)} THEN 0.10 ELSE 0.05 END AS abstained FROM (SELECT * FROM {X.values(X.RANKED_QUERIES)} UNION ALL SELECT item_id + 1000, text FROM benchmark) LEFT JOIN (SELECT query, max(score) AS top FROM {SELECTED} GROUP BY query) USING (query)",
        "parent_resolve": f"SELECT query, id, rank, text FROM {PARENTS}",
        "context_text": f"SELECT query, CASE WHEN length(said) > 8000 THEN substr(said, 1, 8000) || chr(10) || '...[truncated]' ELSE said END AS context FROM (SELECT query, string_agg('RESULT ' || place || ':' || chr(10) || 'Title: Page' || chr(10) || coalesce('URL: ' || url || chr(10), '') || 'Type: general_page' || chr(10) || 'Emails: a@b.co' || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS said FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM {PARENTS}) GROUP BY query)",
        "usage_tokens": f"SELECT id, coalesce(prompt_tokens, input_tokens) AS input_tokens, coalesce(completion_tokens, output_tokens) AS output_tokens, coalesce(cached_tokens, other_cache, cache_tokens) AS cache_tokens FROM (SELECT * FROM {X.values(X.USAGE)} UNION ALL SELECT 'e' || event_id, input_tokens, output_tokens, cache_tokens, CASE WHEN event_id % 3 = 0 THEN input_tokens + 5 END, CASE WHEN event_id % 4 = 0 THEN output_tokens + 1 END, CASE WHEN event_id % 5 = 0 THEN cache_tokens + 2 END, CASE WHEN event_id % 7 = 0 THEN 3 END, bot, model FROM {USED})",
        "usage_cost": f"SELECT event_id, bot, model, input_tokens, output_tokens, cache_tokens, input_cost, output_cost, cache_cost, total_cost FROM {COSTED}",
        "usage_totals": f"SELECT bot, count(*) AS calls, {_SUMS} FROM {COSTED} GROUP BY bot",
        "feedback_latest": f"SELECT event_id AS log_id, event_type, thumbs AS feedback FROM events LEFT JOIN (SELECT log_id, thumbs FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY ts DESC, seq DESC) AS n FROM {X.values(X.VOTES)} WHERE thumbs IN ('up', 'down')) WHERE n = 1) ON event_id = log_id",
        "upsert_points": "SELECT user_id AS id, event_id AS version, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
        "eval_recall": None,
        "stream_usage": f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, bot, count(*) AS calls, CAST(sum(total_cost) AS BIGINT) AS total_cost FROM {COSTED} GROUP BY 1, 2",
        "scan_pages": "SELECT page_id, url, length(html) AS size FROM pages",
    }
    t = trim("text")
    out["md_headings"] = f"""SELECT id, CAST(place - 1 AS INTEGER) AS place, 'h' || length(regexp_extract(x, {S('^(#{1,6})' + chr(92) + 's+(.+)')}, 1)) AS level, {trim(f"regexp_extract(x, {S('^(#{1,6})' + chr(92) + 's+(.+)')}, 2)")} AS text FROM (SELECT id, unnest(l) AS x, generate_subscripts(l, 1) AS place FROM
(SELECT id, list_filter(string_split({t}, chr(10)), lambda y: regexp_matches(y, {S('^(#{1,6})' + chr(92) + 's+(.+)')})) AS l FROM {TEXTS} t))"""
    rest = ". Answer from the context alone, name only links found in it, and say so when it has no answer. See https://acme.example for anything else." + chr(10) * 2 + "BUSINESS:" + chr(10) + "Sells things."
    roles = [*chat.ROLES.values(), "a poet", chat.ROLES["general_assistant"]]
    made = f"CASE conv_id % {len(roles)} " + " ".join(f"WHEN {k} THEN {L('You are ' + said.replace('@', 'Acme') + rest)}" for k, said in enumerate(roles)) + " END"
    out["prompt_build"] = f"SELECT conv_id, turn, CASE WHEN role = 'system' AND length(trim(text)) > 20 THEN trim(text) ELSE {made} END || {L(chr(10) * 2 + 'CONTEXT:' + chr(10) + 'No context available.')} AS prompt FROM conversations"
    counts = [f"len(list_filter(string_split_regex(lower(coalesce(text, '')), {S(chr(92) + 's+')}), lambda w: w IN ({', '.join(map(L, known.split()))})))" for _, known in COMMON]
    names = [n for n, _ in COMMON]
    both = f"(SELECT id, text FROM {MESSAGES} m UNION ALL SELECT 'd' || doc_id, text FROM documents)"
    told = f"(SELECT id, text, {case([(f'c{k} = best AND best > 0', L(n)) for k, n in enumerate(names)], chr(39) + 'und' + chr(39))} AS top, CASE WHEN total > 0 THEN best / CAST(total AS DOUBLE) ELSE 0 END AS score FROM (SELECT *, greatest({', '.join(f'c{k}' for k in range(len(names)))}) AS best, {' + '.join(f'c{k}' for k in range(len(names)))} AS total FROM (SELECT id, text, {', '.join(f'{c} AS c{k}' for k, c in enumerate(counts))} FROM {both} b)))"
    sure = f"length({trim(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) >= 40 AND score >= 0.85 AND top NOT IN ('und', {', '.join(map(L, P.ENGLISH_CODES))})"
    out["lang_prepare"] = f"SELECT id, code, code <> 'eng' AS non_english, NOT (code = 'eng' AND (coalesce(length(text) >= 40, false) OR {_english})) AS ask_model FROM (SELECT id, text, CASE WHEN {sure} THEN top ELSE 'eng' END AS code FROM {told} t) m"
    out["analytics_log"] = f"SELECT 'bot_1' AS bot_id, r.id AS session_id, l.code AS detected_lang, l.non_english AS is_non_english, r.intent, r.rag_path, coalesce(m.text, '') AS query_text, '' AS translated_query, coalesce(r.reply, '') AS reply_text, CAST(0 AS BIGINT) AS chunks_retrieved, coalesce(g.guarded, false) AS guardrail_fired, CAST(NULL AS VARCHAR) AS feedback FROM ({out['chat_route']}) r JOIN ({out['guardrail']}) g USING (id) JOIN ({out['lang_prepare']}) l USING (id) JOIN {MESSAGES} m USING (id) WHERE r.rag_path IN ({', '.join(map(L, P.LOGGED_PATHS))})"
    spoken = "[" + ", ".join(map(L, Q.SAID)) + "]"
    number = lambda f: f"CASE WHEN json_type(j, '$.{f}') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract(j, '$.{f}') AS DOUBLE) END"
    array = lambda f: f"CASE WHEN json_type(j, '$.{f}') = 'ARRAY' THEN CAST(json_extract(j, '$.{f}') AS VARCHAR[]) END"
    flag = lambda f: f"coalesce(json_extract_string(j, '$.{f}') = 'true', false)"
    out["query_constraints"] = f"""WITH s AS (SELECT id, regexp_extract({spoken}[length(coalesce(query, '')) % {len(Q.SAID)} + 1], '(?s)\\{{.*\\}}') AS x FROM {QUERIES} q), p AS (SELECT * FROM s JOIN ({out['query_price']}) USING (id) JOIN ({out['query_facets']}) USING (id) JOIN ({out['query_compare']}) USING (id) JOIN (SELECT id, ask_model FROM ({out['query_parse']})) USING (id)),
j AS (SELECT *, CASE WHEN ask_model AND json_valid(x) THEN CAST(x AS JSON) END AS j FROM p)
SELECT id, coalesce({_cents(number('maxPrice'))}, most_cents) AS most_cents, coalesce({_cents(number('minPrice'))}, least_cents) AS least_cents, coalesce(array_to_string({array('colors')}, '|'), colors) AS colors, coalesce(array_to_string({array('sizes')}, '|'), sizes) AS sizes, coalesce(in_stock, false) OR {flag('inStockOnly')} AS in_stock, coalesce(comparison, false) OR {flag('isComparison')} AS comparison, coalesce(CASE WHEN len({array('comparisonEntities')}) >= 2 THEN array_to_string({array('comparisonEntities')}, '|') END, compared) AS compared FROM j"""
    place = "coalesce(try_cast(e ->> '$.index' AS INT), try_cast(e ->> '$.chunk' AS INT), try_cast(e ->> '$.item' AS INT))"
    out["model_scores"] = f"""WITH r AS (SELECT *, regexp_extract([{', '.join(map(L, Q.REPLIES))}][query % {len(Q.REPLIES)} + 1], '(?s)\\[.*\\]') AS x FROM {DIVERSE} d), l AS (SELECT *, CASE WHEN x <> '' THEN CAST(CAST(x AS JSON) AS JSON[]) END AS entries FROM r),
n AS (SELECT *, coalesce(list_filter(entries, lambda e: {place} IN (rank - 1, rank))[1], entries[rank]) AS entry FROM l),
v AS (SELECT query, id, rank AS before, CASE WHEN entries IS NULL THEN coalesce(score, 0.8::DOUBLE) ELSE floor(coalesce(try_cast(CAST(entry AS VARCHAR) AS DOUBLE), try_cast(entry ->> '$.score' AS DOUBLE), 0.8::DOUBLE) * 1e4 + 0.5) / 1e4 END AS score FROM n)
SELECT query, id, rank, CAST(floor(score * 1e4 + 0.5) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS LAST, before, id) AS rank FROM v) WHERE rank <= 10"""
    out["not_visited"] = f"SELECT DISTINCT link AS url FROM ({{links}}) WHERE link NOT IN (SELECT url FROM {URLS} u WHERE url IS NOT NULL)"
    out["usage_records"] = f"SELECT bot, row_number() OVER (PARTITION BY bot ORDER BY ts DESC, event_id DESC) AS place, event_id, model, total_cost FROM {COSTED} c"
    stored = "(SELECT 'bot_' || (doc_id % 4) AS bot_id, '/d' || doc_id AS url, doc_id AS no, n_chars, lang, source FROM documents)"
    out["bot_documents"] = f"SELECT bot_id, bot_name, url, n_chars FROM {stored} s JOIN (VALUES ('bot_1', 'One'), ('bot_3', 'Three'), ('bot_9', 'None')) AS b(bot_id, bot_name) USING (bot_id)"
    newer = f"(SELECT bot_id, CASE WHEN no % 2 = 0 THEN url ELSE url || '/new' END AS url, CASE WHEN no % 9 = 0 THEN n_chars + 1 END AS n_chars, no % 7 AS chunks FROM {stored} s WHERE no % 3 = 0)"
    out["documents_upsert"] = f"SELECT bot_id, url, coalesce(n.n_chars, o.n_chars) AS n_chars, o.lang, o.source, n.chunks FROM {stored} o FULL OUTER JOIN {newer} n USING (bot_id, url)"
    out["lang_detect"] = f"SELECT doc_id, {case([(f'c{k} = best AND best > 0', L(n)) for k, n in enumerate(names)], chr(39) + 'und' + chr(39))} AS code, CASE WHEN total > 0 THEN best / CAST(total AS DOUBLE) ELSE 0 END AS score FROM (SELECT *, greatest({', '.join(f'c{k}' for k in range(len(names)))}) AS best, {' + '.join(f'c{k}' for k in range(len(names)))} AS total FROM (SELECT doc_id, {', '.join(f'{c} AS c{k}' for k, c in enumerate(counts))} FROM documents))"
    out["search"] = f"""WITH near AS (SELECT f.query, f.id, f.rank, d.source, d.text, row_number() OVER (PARTITION BY f.query, d.source ORDER BY f.rank, f.id) AS own FROM {RRF} f JOIN documents d ON d.doc_id = f.id), pool AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, id) AS r FROM near WHERE own <= 2)
SELECT query, CAST(r AS INTEGER) AS rank, id, source AS url, CAST(floor(greatest(0.85::DOUBLE - (r - 1) * 0.02::DOUBLE, 0.70::DOUBLE) * 1e4 + 0.5) AS BIGINT) AS score, substr(text, 1, 80) AS excerpt FROM pool WHERE r <= 5"""
    child = "'https://gen.example/map' || k || '.xml'"
    tag = lambda x: f"'<url><loc>' || {x} || '</loc></url>'"
    own = f"{tag(chr(39) + 'https://gen.example/p/' + chr(39) + ' || page_id')} || {tag('replace(url, ' + chr(39) + '&' + chr(39) + ', ' + chr(39) + '&amp;' + chr(39) + ')')}"
    made = f"(SELECT 'https://gen.example/sitemap.xml' AS address, string_agg('<sitemap><loc>' || {child} || '</loc></sitemap>', '' ORDER BY k) AS xml FROM range(20) r(k) UNION ALL SELECT {child}, xml FROM (SELECT page_id % 20 AS k, string_agg({own}, '' ORDER BY page_id) AS xml FROM pages GROUP BY 1))"
    out["sitemap_locs"] = f"SELECT url, depth FROM ({_sitemap(X.values(X.SITEMAPS), 'https://e.com/sitemap.xml', 'e.com')}) UNION ALL SELECT url, depth FROM ({_sitemap(made, 'https://gen.example/sitemap.xml', 'gen.example')})"
    pages = f"(SELECT url, html FROM pages UNION ALL SELECT * FROM {X.values(X.PAGES)})"
    good = "html IS NOT NULL AND NOT contains(html, '>null</script>')"
    tags = lambda p: f"CAST(CASE WHEN {good} THEN len(regexp_extract_all(html, {S(p)})) WHEN html IS NULL THEN 0 END AS INTEGER)"
    out["html_tables"] = f"SELECT url, {tags('(?i)<table' + chr(92) + 'b')} AS tables, {tags('(?i)<(?:pre|code)' + chr(92) + 'b')} AS code FROM {pages}"
    body = "replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '&amp;', '&')"
    out["html_headings"] = f"""SELECT url, CAST(row_number() OVER (PARTITION BY url, html ORDER BY pos) - 1 AS INTEGER) AS place, level, text FROM (SELECT url, html, pos, lower(regexp_extract(h, '(?i)^<(h[1-6])', 1)) AS level, {trim(body)} AS text FROM
(SELECT url, html, unnest(l) AS h, generate_subscripts(l, 1) AS pos FROM (SELECT url, html, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS l FROM {pages} WHERE {good}))) WHERE text <> ''"""
    coded = "url_encode(x)"
    for code, char in (("%2F", "/"), ("%2C", ","), ("%21", "!"), ("%24", "$"), ("%25", "%"), ("%26", "&"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%2B", "+"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%5B", "["), ("%5D", "]"), ("%7C", "|")):
        coded = f"replace({coded}, '{code}', {L(char)})"
    hrefs = "list_transform(list_filter(regexp_extract_all(html, '(?is)<a[ ][^>]*?href=[\"'']([^\"'']*)[\"'']', 1), lambda x: starts_with(x, '/')), lambda x: regexp_replace(replace(x, '&amp;', '&'), '[?#].*$', ''))"
    kept = f"list_filter(list_transform({hrefs}, lambda x: {coded}), lambda x: NOT {has('lower(x)', P.FILE_EXTENSION)} AND NOT {has('lower(x)', P.ASSET_PATH)})"
    out["page_links"] = f"SELECT url, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place, {SCHEME} || '://' || {HOST_RAW} || unnest(l) AS link FROM (SELECT url, ({uniq('k')})[1:50] AS l FROM (SELECT url, {kept} AS k FROM {pages} WHERE url <> '' AND {good}))"
    bold = trim(f"regexp_replace(regexp_extract(m, {S(P.BOLD)}, 1), {S(P.BOLD_PREFIX)}, '')")
    link = trim(f"regexp_replace(regexp_extract(m, {S(P.LINK_TEXT)}, 1), {S(P.LINK_PREFIX)}, '')")
    is_bold, is_link = f"({has('m', P.BOLD)} AND NOT {has(bold, P.GENERIC_BOLD)})", has("m", P.LINK_TEXT)
    seen = f"list_transform(recent, lambda m: {{'done': {is_bold} OR ({is_link} AND length({link}) > 2 AND NOT {has(link, P.GENERIC_LINK)}), 'link': {is_link} AND NOT {is_bold}, 'name': CASE WHEN {is_bold} THEN {bold} WHEN {is_link} THEN {link} ELSE '' END}})"
    needed = f"(pronoun OR {has('t', P.IMPLICIT)} OR {has('t', P.OBJECTION)} OR short) AND NOT alone AND t <> ''"
    rest = trim(f"regexp_replace(t, {S(P.PRONOUNS)}, '', 'g')")
    joined = trim(f"name || CASE WHEN {has('t', P.SPEC_WORDS)} THEN {L(f' {P.SPEC_SUFFIX} ')} ELSE ' ' END || {rest}")
    turns = """(SELECT 'c_' || conv_id || '_' || turn AS id, text AS query, coalesce(list_reverse(recent), []) AS recent, role FROM (SELECT *, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS recent FROM conversations))"""
    runs = S(r"\s+")
    out["resolve_followup"] = f"""WITH a AS (SELECT id, query, recent FROM {turns} WHERE role = 'user' UNION ALL SELECT id, query, list_filter(string_split(recent, '~'), lambda m: m <> '') FROM {X.values(X.FOLLOW)}),
b AS (SELECT *, {trim("coalesce(query, '')")} AS t, {seen} AS seen FROM a), c AS (SELECT *, {has('t', P.PRONOUNS)} AS pronoun, {has('t', P.STANDALONE)} AND NOT {has('t', P.PRONOUNS)} AS alone, coalesce(list_filter(seen, lambda v: v.done)[1].name, list_filter(seen, lambda v: v.link)[-1].name, '') AS name FROM b),
d AS (SELECT *, len(string_split_regex(t, {runs})) <= 4 AND NOT alone AS short FROM c), e AS (SELECT id, t, CASE WHEN {needed} AND len(recent) > 0 AND name <> '' THEN CASE WHEN pronoun OR {has('t', P.IMPLICIT)} OR short THEN {joined} ELSE name || ' ' || t END END AS r FROM d)
SELECT id, coalesce(r, t) AS resolved, r IS NOT NULL AS was_resolved FROM e"""
    golden = f"(SELECT item_id AS query, text, item_id IN (SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(b.text)))) AS should_abstain FROM benchmark)"
    hits = f"(SELECT query, min(s.rank) AS rank FROM {BM25} s JOIN documents d ON d.doc_id = s.id JOIN {golden} g USING (query) WHERE contains(lower(d.text), lower(g.text)) GROUP BY query)"
    share = lambda x, n: f"CASE WHEN {n} > 0 THEN CAST(floor(coalesce({x}, 0) / {n} * 1e6 + 0.5) AS BIGINT) END"
    inside, outside = "sum(CAST(NOT should_abstain AS INT))", "sum(CAST(should_abstain AS INT))"
    out["eval_recall"] = f"""WITH top AS (SELECT query, max(score) AS top FROM {BM25} GROUP BY query), r AS (SELECT g.query, should_abstain, coalesce(top, 0) < 40000000 AS abstained, CASE WHEN NOT (coalesce(top, 0) < 40000000) AND NOT should_abstain THEN h.rank END AS rank FROM {golden} g LEFT JOIN top USING (query) LEFT JOIN {hits} h USING (query))
SELECT count(*) AS queries, {share('CAST(sum(CAST(rank = 1 AS INT)) AS DOUBLE)', inside)} AS recall_1, {share('CAST(sum(CAST(rank <= 5 AS INT)) AS DOUBLE)', inside)} AS recall_5, {share('sum(1.0::DOUBLE / rank)', inside)} AS mrr, {share('CAST(sum(CAST(should_abstain AND abstained AS INT)) AS DOUBLE)', outside)} AS abstention FROM r"""
    out["not_visited"] = out["not_visited"].replace("{links}", out["page_links"])
    # these are made of what this module has
    from corvane.plans import pages_sql, structure_sql

    return out | structure_sql.oracle_sql() | pages_sql.oracle_sql()
