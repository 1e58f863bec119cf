"""SQL of the rules on answers, written for a second engine: numbers, parts of an answer, verdicts, kinds of gold, units."""

from __future__ import annotations


def numbers_sql(name: str, source: str, key: str, text: str) -> str:
    """CTEs that end in ``name`` (key, place, value, decimals, percent, scale, dollar) of the numbers in ``text`` of ``source``. Every
    lexeme is a row; its neighbours come by lag and lead over the raw rows and over those that are not blank. A comma before four
    digits parts no groups and is written otherwise first."""
    near = ", ".join(f"lag({c}, {k}) OVER o AS p{k}{c}, lead({c}, {k}) OVER o AS n{k}{c}" for k in (1, 2) for c in ("x", "rp", "rn", "rn2", "rn3"))
    return rf"""{name}_lx AS (SELECT key, x, i, coalesce(lag(x) OVER w, '') AS rp, coalesce(lead(x) OVER w, '') AS rn, coalesce(lead(x, 2) OVER w, '') AS rn2, coalesce(lead(x, 3) OVER w, '') AS rn3
    FROM (SELECT key, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT {key} AS key,
      regexp_extract_all(regexp_replace({text}, ',([0-9]{{4}})', '~\1', 'g'), '(?s)[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?|[A-Za-z]+|\s+|.') AS l FROM {source})) WINDOW w AS (PARTITION BY key ORDER BY i)),
  {name}_nb AS (SELECT key, x, i, rp, rn, rn2, {near} FROM {name}_lx WHERE NOT regexp_matches(x, '^\s') WINDOW o AS (PARTITION BY key ORDER BY i)),
  {name}_a AS (SELECT *, coalesce(p1x = '$' AND NOT regexp_matches(p1rp, '[A-Za-z0-9]$'), false) AS dollar, coalesce(n1x = '%', false) AS percent FROM {name}_nb WHERE regexp_matches(x, '^[0-9]') AND NOT regexp_matches(rp, '[A-Za-z]$')),
  {name}_b AS (SELECT *, CASE WHEN dollar THEN p2x ELSE p1x END AS s, CASE WHEN dollar THEN p2rp ELSE p1rp END AS srp, coalesce(CASE WHEN percent THEN n2x ELSE n1x END, '') AS b,
    coalesce(CASE WHEN percent THEN n2rn ELSE n1rn END, '') AS brn, coalesce(CASE WHEN percent THEN n2rn2 ELSE n1rn2 END, '') AS brn2, coalesce(CASE WHEN percent THEN n2rn3 ELSE n1rn3 END, '') AS brn3 FROM {name}_a),
  {name}_c AS (SELECT *, CASE WHEN regexp_matches(brn, '^[0-9]') THEN '' ELSE regexp_replace(b, '[xX]$', '') END AS word, replace(x, ',', '') AS digits FROM {name}_b),
  {name}_d AS (SELECT *, CASE lower(word) WHEN 'trillion' THEN 1e12 WHEN 'billion' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'mm' THEN 1e6 WHEN 'm' THEN 1e6 WHEN 'thousand' THEN 1e3 WHEN 'k' THEN 1e3 END AS sc FROM {name}_c),
  {name}_e AS (SELECT *, CASE WHEN sc IS NOT NULL OR lower(b) = 'x' THEN brn ELSE b END AS e0, CASE WHEN sc IS NOT NULL OR lower(b) = 'x' THEN brn2 ELSE brn END AS e1,
    CASE WHEN sc IS NOT NULL OR lower(b) = 'x' THEN brn3 ELSE brn2 END AS e2 FROM {name}_d WHERE NOT (regexp_matches(rn, '^[A-Za-z]') AND sc IS NULL AND lower(b) <> 'x') AND NOT (word IN ('M', 'K') AND NOT dollar)),
  {name} AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY i) - 1)::INT AS place, digits::DOUBLE * CASE WHEN s IN ('-', '−') AND NOT regexp_matches(srp, '[\pL\pN_\n]$') THEN -1 ELSE 1 END AS value,
    length(regexp_replace(digits, '^[0-9]+\.?', ''))::INT AS decimals, percent, coalesce(sc, 1.0)::DOUBLE AS scale, dollar FROM {name}_e WHERE NOT (e0 = '-' AND lower(e1) IN ('k', 'q') AND NOT regexp_matches(e2, '^[0-9_]')))"""


def rounded_sql(x: str, decimals: str) -> str:
    exact = f"({x})::VARCHAR::DECIMAL(38, 12)"
    return f"CASE {decimals} " + " ".join(f"WHEN {k} THEN round({exact}, {k})::DOUBLE" for k in range(12)) + f" ELSE {x} END"


OK = """ok AS (SELECT * FROM cevaplar WHERE hata IS NULL AND yanit IS NOT NULL),
  latest AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY id, kosul, model, prompt_surum ORDER BY tarih DESC NULLS LAST, kayit_no DESC) = 1)"""


def parts_sql(source: str) -> str:
    """CTE ``pt``: all columns of ``source`` (with yanit) and body, sources and final answer."""
    return rf"""pt0 AS (SELECT *, regexp_replace(yanit, '[*`]+', '', 'g') AS p FROM {source}),
  pt1 AS (SELECT *, regexp_matches(p, '(?im)^\s*sources?\s*[:\-]') AS has, regexp_extract(p, '(?ims)\A(.*)^\s*sources?\s*[:\-](.*)\z', 1) AS head, regexp_extract(p, '(?ims)\A(.*)^\s*sources?\s*[:\-](.*)\z', 2) AS tail FROM pt0),
  pt2 AS (SELECT *, regexp_extract(tail, '(?is)final answer\s*[:\-].*\z') AS more FROM pt1),
  pt3 AS (SELECT *, CASE WHEN has THEN head || more ELSE p END AS body, left(tail, length(tail) - length(more)) AS src FROM pt2),
  pt AS (SELECT *, regexp_replace(regexp_replace(body, '(?is)\A.*final answer\s*[:\-]', ''), '\A\s+|\s+\z', '', 'g') AS final FROM pt3)"""


def verdict_sql(x: str) -> str:
    opening = rf"lower(regexp_extract({x}, '\A[^A-Za-z0-9_]*([A-Za-z0-9_]+)', 1))"
    early = rf"array_to_string(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')[1:12], ' ')"
    return rf"CASE WHEN {opening} IN ('yes', 'no') THEN {opening} ELSE nullif(lower(regexp_extract({early}, '(?i)(?:\A|[^a-z0-9_])(yes|no) ?(?:[,.;:!]|\z)', 1)), '') END"


GOLD_TYPE = r"""CASE WHEN answer IS NULL THEN NULL WHEN regexp_matches(trim(answer, ' '), '\A[(]?[-−]?[$]?\s*[0-9,]+([.][0-9]+)?\s*%?[)]?\z') THEN 'number'
  WHEN regexp_matches(trim(answer, ' '), '(?i)\A(yes|no)([^a-z0-9_]|\z)') THEN 'verdict' WHEN regexp_matches(answer, '[0-9]') THEN 'key_number' ELSE 'free' END"""
UNIT = r"nullif(lower(regexp_extract(question, '(?i)\bin\s+(?:(?:usd|u[.]s[.]\s+dollars)\s+)?(thousands|millions|billions)\b', 1)), '')"
