"""DuckDB SQL for blocks, chunks and the Markdown of pages: window functions find
where blocks begin, and a recursion over pieces fills chunks."""

from __future__ import annotations

from corvane.functions import patterns as P
from corvane.operators import structure
from corvane.plans import fixtures as X

S, L = P.sql, P.literal
#: white space that Python strips
_BLANK = " || ".join(f"chr({c})" for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288])
LINE = "chr(10)"
SOURCE = f"(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT * FROM {X.values(X.BLOCKS)})"


def strip(x: str) -> str:
    return f"trim({x}, {_BLANK})"


def quarter(x: str) -> str:
    return f"CAST(ceil(length({x}) / 4) AS BIGINT)"


def blocks(source: str, key: str = "id") -> str:
    """WITH parts up to `blocks` (key, place, kind, content) of a relation (key, text)."""
    table, question = S(r"^\s*\|.*\|\s*$"), S(r"(?i)^(?:Q:|Question:|FAQ:|\d+\.\s+Q:)")
    upto = f"OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    now = f"OVER (PARTITION BY {key} ORDER BY i)"
    return f"""src AS MATERIALIZED (SELECT {key}, text FROM {source} s),
lines AS (SELECT {key}, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT {key}, string_split(text, {LINE}) AS l FROM src WHERE text IS NOT NULL) a),
marks AS (SELECT {key}, i, line, starts_with({strip('line')}, '```') AS fence, regexp_matches(line, {table}) AS tab, regexp_matches(line, {question}) AS ask FROM lines),
inside AS (SELECT *, coalesce(sum(CAST(fence AS INT)) {upto}, 0) % 2 = 1 AS fenced FROM marks),
plain AS (SELECT *, NOT fence AND NOT fenced AS plain FROM inside),
flags AS (SELECT *, coalesce(last_value(CASE WHEN plain THEN tab END IGNORE NULLS) {upto}, false) AS flag, coalesce(lag(fence AND fenced) {now}, false) AS closed FROM plain),
opens AS (SELECT *, CASE WHEN fence AND NOT fenced THEN 'code_block' WHEN plain AND tab AND NOT flag THEN 'table' WHEN plain AND NOT tab AND flag OR closed OR i = 1 THEN 'text' END AS opened FROM flags),
groups AS (SELECT *, count(opened) {now} AS g FROM opens),
asks AS (SELECT *, plain AND NOT tab AND ask AND coalesce(sum(CAST(plain AND NOT tab AND ask AS INT)) OVER (PARTITION BY {key}, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS first_ask FROM groups),
runs AS (SELECT *, CASE WHEN first_ask THEN 'qa_pair' ELSE opened END AS start FROM asks),
numbered AS (SELECT *, count(start) {now} AS b FROM runs),
joined AS (SELECT {key}, b, min_by(start, i) AS kind, {strip(f"string_agg(line, {LINE} ORDER BY i)")} AS content FROM numbered GROUP BY {key}, b),
blocks AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY b) - 1 AS INTEGER) AS place, kind, content FROM joined WHERE content <> '')"""


def chunks(name: str, source: str, key: str, most: int, overlap: int = structure.OVERLAP) -> str:
    """WITH parts up to `name` (key, no, chunk) of a relation (key, text)."""
    gap = f"chr(10) || {LINE}"
    n = {k: f"{name}_{k}" for k in ("src", "par", "unit", "all", "fill", "out")}
    size = lambda x: f"CASE WHEN {x} = '' THEN 0 ELSE {quarter(x)} END"
    held = lambda h: f"string_split({strip(h)}, {LINE})"
    sizes = lambda ls: f"list_transform(list_reverse({ls}), lambda x: {size('x')})"
    kept = lambda h: f"greatest(1, len(list_filter(range(1, len({held(h)}) + 1), lambda j: list_sum(list_slice({sizes(held(h))}, 1, j)) <= {overlap})))"
    tail = lambda h: f"(array_to_string(list_slice({held(h)}, len({held(h)}) - {kept(h)} + 1, len({held(h)})), {LINE}) || {LINE})"
    some = lambda h: f"{strip(h)} <> ''"
    return f"""{n['src']} AS MATERIALIZED (SELECT {key}, text FROM {source} s WHERE text IS NOT NULL AND {some('text')}),
{n['par']} AS (SELECT {key}, generate_subscripts(l, 1) AS p, unnest(l) AS par FROM (SELECT {key}, string_split_regex(text, {S(chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n')}) AS l FROM {n['src']} WHERE {quarter('text')} > {most}) a),
{n['unit']} AS (SELECT {key}, p, 1 AS k, par AS piece, {gap} AS gap, false AS long FROM {n['par']} WHERE {size('par')} <= {most}
  UNION ALL SELECT {key}, p, generate_subscripts(l, 1), unnest(l), {LINE}, generate_subscripts(l, 1) = 1 FROM (SELECT {key}, p, string_split(par, {LINE}) AS l FROM {n['par']} WHERE {size('par')} > {most}) a),
{n['all']} AS MATERIALIZED (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY p, k) AS i, piece, gap, long, {size('piece')} AS n FROM {n['unit']}),
{n['fill']} AS (SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS held, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS one, CAST(NULL AS VARCHAR) AS two FROM {n['all']}
  UNION ALL SELECT {key}, i, CASE WHEN over THEN {tail('held')} || piece || gap ELSE held || piece || gap END, CASE WHEN over THEN {quarter(f"({tail('held')} || piece || gap)")} ELSE used + n END, one, CASE WHEN over THEN {strip('held')} END
  FROM (SELECT {key}, i, piece, gap, n, held, used, one, used + n > {most} AND {some('held')} AS over
    FROM (SELECT {', '.join(f'u.{c}' for c in key.split(', '))}, u.i, u.piece, u.gap, u.n, CASE WHEN u.long AND {some('f.held')} THEN {tail('f.held')} ELSE f.held END AS held, CASE WHEN u.long AND {some('f.held')} THEN {quarter(tail('f.held'))} ELSE f.used END AS used, CASE WHEN u.long AND {some('f.held')} THEN {strip('f.held')} END AS one
      FROM {n['fill']} f JOIN {n['all']} u ON {' AND '.join(f'u.{c} = f.{c}' for c in key.split(', '))} AND u.i = f.i + 1) a) b),
{n['out']} AS (SELECT {key}, i, 1 AS k, one AS chunk FROM {n['fill']} UNION ALL SELECT {key}, i, 2, two FROM {n['fill']}
  UNION ALL SELECT {key}, i, 3, {strip('held')} FROM {n['fill']} WHERE ({key}, i) IN (SELECT ({key}, max(i)) FROM {n['all']} GROUP BY {key}) AND {some('held')}
  UNION ALL SELECT {key}, 0, 0, {strip('text')} FROM {n['src']} WHERE {quarter('text')} <= {most}),
{name} AS (SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY i, k) - 1 AS INTEGER) AS no, chunk FROM {n['out']} WHERE chunk IS NOT NULL)"""


def parents(source: str, key: str = "id") -> str:
    """WITH parts up to `parents` (key, no, chunk): chunks of the text of blocks,
    where tables and code stand apart, or of the text itself if it has none."""
    apart = f"CASE WHEN kind IN ('code_block', 'table') THEN {LINE} || {LINE} || content || {LINE} || {LINE} ELSE content END"
    said = f"(SELECT {key}, string_agg({apart}, {LINE} || {LINE} ORDER BY place) AS text FROM blocks GROUP BY {key})"
    return f"WITH RECURSIVE {blocks(source, key)},\n{chunks('parents', said, key, structure.PARENT)}"


def children(source: str, key: str = "id") -> str:
    """The same up to `children` (key, parent, no, chunk)."""
    own = f"(SELECT {key}, no AS parent, chunk AS text FROM parents)"
    return f"{parents(source, key)},\n{chunks('children', own, f'{key}, parent', structure.CHILD)}"


def oracle_sql() -> dict[str, str]:
    name = f"'parent_' || p.no || '_' || {quarter('p.chunk')}"
    return {
        "doc_blocks": f"WITH {blocks(SOURCE)}\nSELECT id, place, kind, content FROM blocks",
        "chunk_parent": f"{parents(SOURCE)}\nSELECT id, no AS parent_index, {name} AS parent_id, chunk AS text, {quarter('chunk')} AS tokens FROM parents p",
        "chunk_child": f"{children(SOURCE)}\nSELECT c.id, c.parent || '_' || c.no AS child_index, {name} AS parent_id, c.chunk AS chunk_text, {quarter('c.chunk')} AS tokens FROM children c JOIN parents p ON p.id = c.id AND p.no = c.parent",
    }
