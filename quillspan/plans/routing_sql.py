"""SQL of the routing rules, written for a second engine: names by substring, years by rows of lexemes."""

from __future__ import annotations

_TOKENS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
MENTIONS = f"""cat AS (SELECT DISTINCT doc_name, doc_period AS period, nullif(array_to_string(list_filter({_TOKENS.format('company')}, lambda x: x NOT IN ('corporation', 'inc', 'company', 'co', 'corp')), ' '), '') AS company
    FROM belgeler WHERE doc_name IS NOT NULL), name AS (SELECT DISTINCT company FROM cat WHERE company IS NOT NULL),
  run AS (SELECT company, company AS run FROM name UNION SELECT company, left(company, length(company) - 1) FROM name WHERE company LIKE '%s' AND length(string_split(company, ' ')[-1]) > 3
    UNION SELECT company, a FROM name JOIN (VALUES ('jnj', 'johnson johnson'), ('j j', 'johnson johnson'), ('amex', 'american express')) AS al(a, c) ON c = company),
  said AS (SELECT qid, array_to_string({_TOKENS.format('question')}, ' ') AS said FROM q WHERE question IS NOT NULL),
  mention AS (SELECT qid, company FROM said, run WHERE strpos(' ' || said || ' ', ' ' || run || ' ') > 0
    UNION SELECT qid, company FROM said, name WHERE length(replace(company, ' ', '')) >= 6 AND strpos(replace(said, ' ', ''), replace(company, ' ', '')) > 0)"""
YEARS = r"""yl AS (SELECT qid, x, i, coalesce(lag(x) OVER w, '') AS rp, coalesce(lag(x, 2) OVER w, '') AS rp2, coalesce(lead(x) OVER w, '') AS rn, coalesce(lead(x, 2) OVER w, '') AS rn2
    FROM (SELECT qid, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT qid, regexp_extract_all(lower(question), '(?s)[0-9]+|[a-z]+|\s+|.') AS l FROM q)) WINDOW w AS (PARTITION BY qid ORDER BY i)),
  yb AS (SELECT *, lag(x) OVER o AS p, lag(rp) OVER o AS prp, lag(x, 2) OVER o AS p2, lag(rp, 2) OVER o AS p2rp, lag(rp2, 2) OVER o AS p2rp2, lag(rp2) OVER o AS prp2 FROM yl WHERE NOT regexp_matches(x, '^\s') WINDOW o AS (PARTITION BY qid ORDER BY i)),
  yf AS (SELECT qid, x, length(x) AS size, regexp_matches(rn, '^[a-z_]') AS open,
      coalesce((p = 'fy' AND NOT regexp_matches(prp, '[0-9_]$')) OR (p = chr(39) AND p2 = 'fy' AND NOT regexp_matches(p2rp, '[0-9_]$')), false) AS fy,
      coalesce((regexp_matches(p, '^[1-4]$') AND prp = 'q' AND NOT regexp_matches(prp2, '[0-9_]$')) OR (p = 'of' AND regexp_matches(p2, '^[1-4]$') AND p2rp = 'q' AND NOT regexp_matches(p2rp2, '[0-9_]$')), false) AS quarter,
      coalesce(p = 'year' AND p2 = 'fiscal' AND regexp_matches(rp, '^\s'), false) AS fiscal, rp = 'q' AND NOT regexp_matches(rp2, '[0-9_]$') AND regexp_matches(x, '^[1-4]20[12][0-9]') AS hanging,
      length(x) = 4 AND NOT regexp_matches(rp, '[0-9a-z_,.$]$') AND NOT regexp_matches(rn, '^[a-z_]') AND NOT (rn IN (',', '.') AND regexp_matches(rn2, '^[0-9]')) AS alone FROM yb WHERE regexp_matches(x, '^[0-9]')),
  yy AS (SELECT qid, CASE WHEN fy AND NOT open AND size = 2 THEN 2000 + x::INT WHEN (fy AND NOT open AND size = 4) OR quarter OR fiscal OR alone THEN TRY_CAST(left(x, 4) AS INT) WHEN hanging THEN x[2:5]::INT END AS year FROM yf),
  years AS (SELECT DISTINCT qid, year FROM yy WHERE year BETWEEN 2010 AND 2029)"""
ROUTE = (
    YEARS
    + """, found AS (SELECT DISTINCT m.qid, c.doc_name, c.period FROM mention m JOIN cat c USING (company)),
  fitting AS (SELECT DISTINCT f.qid, f.doc_name FROM found f JOIN years y ON f.qid = y.qid AND f.period BETWEEN y.year AND y.year + 1),
  routed AS (SELECT qid, doc_name, 'year' AS rule FROM fitting UNION ALL SELECT DISTINCT qid, doc_name, 'company' FROM found WHERE qid NOT IN (SELECT qid FROM fitting))"""
)
