"""SQL for the text queries that SQL can express over whole tables."""

from __future__ import annotations

_LETTERS = r"regexp_replace(lower(nfc_normalize(text)), '[^\p{L}\p{N}]', '', 'g')"

P2_FOUND = r"""
WITH h AS (SELECT DISTINCT global_id, domain, text FROM candidate WHERE content_kind = 'html' AND domain IS NOT NULL),
sizes AS (SELECT domain, count(DISTINCT global_id) AS docs FROM h GROUP BY domain),
split AS (SELECT domain, global_id, string_split(text, chr(10)) AS ls FROM h WHERE text IS NOT NULL),
lines AS (SELECT domain, global_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM split),
keyed AS (SELECT DISTINCT domain, global_id, line_no, regexp_replace(lower(nfc_normalize(line)), '[^\p{L}]', '', 'g') AS k FROM lines),
support AS (SELECT domain, k, count(DISTINCT global_id) AS n FROM keyed WHERE length(k) >= 2 GROUP BY domain, k)
SELECT DISTINCT global_id, CAST(line_no AS BIGINT) AS line_no
FROM keyed JOIN support USING (domain, k) JOIN sizes USING (domain)
WHERE n >= 4 AND n >= 0.05 * docs
"""

P5_FOUND = f"""
WITH t AS (SELECT DISTINCT global_id, {_LETTERS} AS s FROM candidate WHERE text IS NOT NULL),
g AS (SELECT DISTINCT global_id, substr(s, i, 5) AS w FROM (SELECT global_id, s, unnest(range(1, greatest(length(s) - 3, 2))) AS i FROM t WHERE length(s) > 0)),
n AS (SELECT global_id, count(*) AS n FROM g GROUP BY global_id),
c AS (SELECT a.global_id AS x, b.global_id AS y, count(*) AS m FROM g a JOIN g b ON a.w = b.w AND a.global_id < b.global_id GROUP BY 1, 2)
SELECT x AS global_id_a, y AS global_id_b FROM c JOIN n p ON p.global_id = x JOIN n q ON q.global_id = y
WHERE m >= 0.7 * (p.n + q.n - m) - 1e-9
"""

P9_FOUND = f"""
WITH i AS (SELECT DISTINCT item_id, CASE WHEN lang = 'zh' THEN 20 ELSE 80 END AS run, {_LETTERS} AS s FROM eval_item WHERE text IS NOT NULL),
w AS (SELECT DISTINCT item_id, run, substr(s, k, run) AS part FROM (SELECT item_id, run, s, unnest(range(1, length(s) - run + 2)) AS k FROM i WHERE length(s) >= run)),
d AS (SELECT DISTINCT doc_id, {_LETTERS} AS s FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, run, substr(s, k, run) AS part FROM (SELECT doc_id, run, s, unnest(range(1, length(s) - run + 2)) AS k FROM d, (VALUES (20), (80)) r(run) WHERE length(s) >= run))
SELECT DISTINCT doc_id, item_id FROM v JOIN w USING (run, part)
"""


P2_CLEAN = f"""
WITH found AS ({P2_FOUND.strip()}),
t AS (SELECT DISTINCT global_id, text FROM candidate WHERE content_kind = 'html'),
s AS (SELECT global_id, string_split(text, chr(10)) AS ls FROM t WHERE text IS NOT NULL),
l AS (SELECT global_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM s),
kept AS (SELECT global_id, string_agg(line, chr(10) ORDER BY n) AS text FROM l ANTI JOIN found f ON f.global_id = l.global_id AND f.line_no = l.n GROUP BY 1)
SELECT t.global_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text FROM t LEFT JOIN kept USING (global_id)
"""

P5_GROUPS = f"""
WITH RECURSIVE pr AS ({P5_FOUND.strip()}),
e AS (SELECT global_id_a AS x, global_id_b AS y FROM pr UNION SELECT global_id_b, global_id_a FROM pr),
tx AS (SELECT DISTINCT global_id, {_LETTERS} AS s FROM candidate WHERE text IS NOT NULL),
gr AS (SELECT DISTINCT global_id, CASE WHEN length(s) < 5 THEN s ELSE substr(s, i, 5) END AS w FROM (SELECT global_id, s, unnest(range(1, greatest(length(s) - 3, 2))) AS i FROM tx WHERE length(s) > 0)),
cl AS (SELECT global_id, list_sort(list(w)) AS ws FROM gr GROUP BY global_id),
cp AS (SELECT global_id, count(*) OVER (PARTITION BY ws) AS copies FROM cl),
r AS (SELECT global_id AS a, global_id AS b FROM cl UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.b)
SELECT global_id, group_id, copies FROM (SELECT a AS global_id, min(b) AS group_id FROM r GROUP BY a) JOIN cp USING (global_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_clean": P2_CLEAN, "p5_found": P5_FOUND, "p5_groups": P5_GROUPS, "p9_found": P9_FOUND}
