"""SQL of the core queries, written apart from the operators."""

from __future__ import annotations

from ..functions.text import BOILERPLATE, DROPPED_QUOTES, HAN, LATIN, SIMPLIFIED, SPACE, TRADITIONAL

_NL = "chr(10)"


def _drop(text: str, pattern: str, by: str = "", flags: str = "g") -> str:
    pattern, by = pattern.replace("'", "''"), by.replace("'", "''")
    return f"regexp_replace({text}, '{pattern}', '{by}', '{flags}')"


def _strip(text: str) -> str:
    return _drop(text, f"^[{SPACE}]+|[{SPACE}]+$")


def _count(text: str, chars: str) -> str:
    return f"length({_drop(f'coalesce({text}, {chr(39) * 2})', f'[^{chars}]')})"


def _share(a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN CAST({a} AS DOUBLE) / ({a} + {b}) ELSE 0.0 END"


def _clean(col: str, aggressive: bool = False) -> str:
    t = _drop(f"nfc_normalize(coalesce({col}, ''))", "[​‌‍﻿]")
    t = _drop(_drop(_drop(t, r"(?m)^\|\s*\d+\s*\|"), r"(?m)\|\s*$"), r"(?m)^[ \t]+|[ \t]+$")
    t = _drop(t, r"(?m)^[^\n]*[◄►][^\n]*$")
    t = _drop(t, r"(?i)\[(编辑|編輯|edit)\]")
    t = _drop(t, rf"(?mi)^[{SPACE}]*\|?[{SPACE}]*(维基百科条目|維基百科條目|Wikipedia article)[{SPACE}]*[:：][^\n]*$")
    t = _strip(f"array_to_string(list_filter(string_split({t}, {_NL}), lambda x: NOT regexp_matches(x, '(?i)^[{SPACE}]*(?:{BOILERPLATE})[{SPACE}]*$')), {_NL})")
    t = _drop(_drop(t, r"\[\d+\]|\(\d+\)"), r"〔[^\n]*?〕|【[^\n]*?】")
    if aggressive:
        t = _drop(t, r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}|〈[^\n]*?〉|《[^\n]*?》|（[^\n]*?）")
    t = _drop(t, "[〇「」『』]")
    t = _drop(_drop(t, r"[ \t]+", " "), r"[ \t]*\n[ \t]*", "\n")
    return _strip(_drop(t, r"\n{3,}", "\n\n"))


def _keyword_text(col: str) -> str:
    t = _drop(_drop(col, r"\[[^\]]*?\]", " "), r"\([^)]*?\)", " ")
    t = _drop(_drop(t, r"\r\n?", "\n"), r" *\n *", "\n")
    # A single line end after a closing mark becomes a blank; of several only the first, the others make a full stop.
    t = _drop(_drop(_drop(t, r"([.!?;:])\n(\n+)", r"\1" + "\x01. "), r"([.!?;:])\n", r"\1" + "\x01"), r"\n+", ". ")
    t = _drop(t, "\x01", " ")
    t = _drop(_drop(t, r"[ \t]+", " "), r"\s+([,;:.!?])", r"\1")
    t = _drop(_drop(t, r"([!?])\.", r"\1"), r"\.{2,}", ".")
    t = _drop(t, r"([,;:.!?])([^\s\"”’')\]])", r"\1 \2")
    return _strip(_drop(_drop(t, r"^[\s.,;:!?-]+"), r"[\s.,;:!?-]+$"))


def _signature(col: str, chars: str = HAN) -> str:
    t = _drop(_drop(col, r"\[[^\n]*?\]|\([^\n]*?\)|\{[^\n]*?\}|〈[^\n]*?〉|《[^\n]*?》|〔[^\n]*?〕|【[^\n]*?】|（[^\n]*?）"), f"[^{chars}]")
    return t if chars == HAN else f"lower({t})"


def _units() -> str:
    t = _drop(_drop(_drop("text", "^﻿+"), r"\r\n?", "\n"), f"[{DROPPED_QUOTES}]")
    t = _strip(_drop(t, r"[ \t]+", " "))
    han = f"string_split({_drop(t, rf'([。！？…])[）\]\}}]*[{SPACE}]*|' + chr(92) + 'n+', chr(92) + '1' + chr(1))}, chr(1))"
    latin = f"string_split({_drop(t, rf'([.!?…。！？])[{SPACE}]*|' + chr(92) + 'n+', chr(92) + '1' + chr(1))}, chr(1))"
    both = f"CASE WHEN {_count('text', HAN)} > {_count('text', LATIN)} THEN {han} ELSE {latin} END"
    return f"SELECT doc_id, list_filter({both}, lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]')) AS u FROM documents WHERE text IS NOT NULL"


def _windows(source: str, items: str, size: int, step: int) -> str:
    return (
        f"SELECT doc_id, CAST(i / {step} AS INTEGER) AS pos, array_to_string({items}[i + 1:i + {size}], ' ') AS \"window\" "
        f"FROM (SELECT doc_id, {items}, unnest(range(0, len({items}), {step})) AS i FROM ({source})) WHERE i = 0 OR i - {step} + {size} < len({items})"
    )


_LATEST = """latest AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY doc_id, page_id ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, fetched_at DESC NULLS LAST, loaded_at DESC NULLS LAST, url ASC NULLS LAST) = 1)"""
_ONE = "cand AS (SELECT * FROM candidate QUALIFY row_number() OVER (PARTITION BY global_id) = 1)"


def _runs(source: str, key: str, text: str) -> str:
    """CTEs ending in ``runs``: the line statistics of vertical text."""
    return f"""
ls AS (SELECT {key}, string_split({text}, {_NL}) AS a FROM {source}),
l0 AS (SELECT {key}, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM ls),
l1 AS (SELECT {key}, i, {_drop('x', f'[{SPACE}]+')} AS x FROM l0),
l2 AS (SELECT {key}, length(x) AS n, {_count('x', HAN)} AS h, row_number() OVER (PARTITION BY {key} ORDER BY i) AS r FROM l1 WHERE x <> ''),
l3 AS (SELECT *, h = 1 AND n <= 2 AS one, h BETWEEN 1 AND 2 AND n <= 3 AS short FROM l2),
r1 AS (SELECT {key}, max(c) AS m FROM (SELECT {key}, count(*) AS c FROM (SELECT {key}, r - row_number() OVER (PARTITION BY {key} ORDER BY r) AS g FROM l3 WHERE one) GROUP BY {key}, g) GROUP BY {key}),
r2 AS (SELECT {key}, max(c) AS m FROM (SELECT {key}, count(*) AS c FROM (SELECT {key}, r - row_number() OVER (PARTITION BY {key} ORDER BY r) AS g FROM l3 WHERE short) GROUP BY {key}, g) GROUP BY {key}),
agg AS (SELECT {key}, count(*) AS n_lines, count_if(one) AS one_lines, count_if(short) AS short_lines, CAST(sum(n) AS BIGINT) AS letters FROM l3 GROUP BY {key}),
runs AS (SELECT s.{key}, coalesce(n_lines, 0) AS n_lines, coalesce(one_lines, 0) AS one_lines, coalesce(short_lines, 0) AS short_lines, coalesce(letters, 0) AS letters, coalesce(r1.m, 0) AS run_one, coalesce(r2.m, 0) AS run_short
  FROM {source} s LEFT JOIN agg USING ({key}) LEFT JOIN r1 USING ({key}) LEFT JOIN r2 USING ({key}))"""


def _gate() -> str:
    return f"""{_LATEST},
cl AS (SELECT doc_id, page_id, doc_id || '/' || page_id AS k, status, needs_ocr, text AS raw, {_clean('text')} AS clean FROM latest),
{_runs('cl', 'k', 'clean').strip()},
st AS (SELECT cl.*, runs.*, {_count('clean', HAN)} AS han, {_count('clean', LATIN)} AS latin, {_signature('clean')} AS sig FROM cl JOIN runs USING (k)),
gated AS (SELECT doc_id, page_id, clean, han, sig, CASE
  WHEN coalesce(status, '') <> 'ok' THEN 'status_not_ok' WHEN coalesce(needs_ocr, false) THEN 'needs_ocr' WHEN {_strip("coalesce(raw, '')")} = '' THEN 'empty_text'
  WHEN n_lines >= 30 AND (((one_lines >= 0.6 * n_lines OR short_lines >= 0.6 * n_lines) AND letters <= 3.0 * n_lines) OR run_one >= 30 OR run_short >= 30) THEN 'vertical_ocr_text'
  WHEN length(clean) < 150 THEN 'text_too_short' WHEN han < 100 THEN 'too_few_han_chars' WHEN {_share('han', 'latin')} < 0.6 THEN 'low_han_ratio' WHEN sig = '' THEN 'empty_han_signature' END AS reason FROM st)"""


def _exact(scope: str) -> str:
    return f"WITH {_ONE} SELECT global_id, CASE WHEN content_hash IS NULL THEN global_id ELSE first_value(global_id) OVER (PARTITION BY {scope} ORDER BY traditional_score DESC, han_ratio DESC, han_chars DESC, text_len DESC, global_id) END AS kept FROM cand"


def _grams() -> str:
    return f"""{_ONE}, sg AS (SELECT global_id, {_signature('text')} AS s FROM cand WHERE text IS NOT NULL),
g AS (SELECT DISTINCT global_id, CASE WHEN length(s) < 3 THEN s ELSE substr(s, i, 3) END AS w FROM (SELECT global_id, s, unnest(range(1, greatest(length(s) - 1, 2))) AS i FROM sg WHERE s <> '')),
n AS (SELECT global_id, count(*) AS n FROM g GROUP BY global_id),
c AS (SELECT a.global_id AS a, b.global_id AS b, CAST(count(*) AS DOUBLE) AS m FROM g a JOIN g b ON a.w = b.w AND a.global_id < b.global_id GROUP BY 1, 2),
p AS (SELECT a, b, m, x.n AS na, y.n AS nb FROM c JOIN n x ON x.global_id = a JOIN n y ON y.global_id = b)"""


_RANKED = "rk AS (SELECT global_id, row_number() OVER (ORDER BY traditional_score DESC NULLS LAST, text_len DESC NULLS LAST, han_chars DESC NULLS LAST, han_ratio DESC NULLS LAST, global_id) AS r FROM cand)"


def _near(similar: str, score: str) -> str:
    """The greedy choice as a recursion over ranks: a row is dropped if a better row similar to it is not.

    ``nw`` and ``nbt`` are the set sizes of the worse and the better row.
    """
    return f"""WITH RECURSIVE {_grams()}, {_RANKED},
o AS (SELECT least(x.r, y.r) AS better, greatest(x.r, y.r) AS worse, m, na, nb, CASE WHEN x.r < y.r THEN nb ELSE na END AS nw, CASE WHEN x.r < y.r THEN na ELSE nb END AS nbt FROM p JOIN rk x ON x.global_id = a JOIN rk y ON y.global_id = b),
lk AS (SELECT better, worse, {score} AS score FROM o WHERE {similar}),
above AS (SELECT worse, list(better) AS bs FROM lk GROUP BY worse),
nxt AS (SELECT worse, bs, coalesce(lag(worse) OVER (ORDER BY worse), 0) AS prev FROM above),
step AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS dropped
  UNION ALL SELECT n.worse, CASE WHEN len(list_filter(n.bs, lambda x: NOT list_contains(s.dropped, x))) > 0 THEN list_append(s.dropped, n.worse) ELSE s.dropped END FROM step s JOIN nxt n ON n.prev = s.r),
dropped AS (SELECT unnest(dropped) AS r FROM (SELECT dropped FROM step ORDER BY r DESC LIMIT 1)),
by_ AS (SELECT worse AS r, min(better) AS b FROM lk WHERE worse IN (SELECT r FROM dropped) AND better NOT IN (SELECT r FROM dropped) GROUP BY worse)
SELECT c.global_id, coalesce(k.global_id, -1) AS keeper, coalesce(round(lk.score, 6), 0.0) AS score FROM cand c JOIN rk USING (global_id) LEFT JOIN by_ ON by_.r = rk.r LEFT JOIN rk k ON k.r = by_.b LEFT JOIN lk ON lk.better = by_.b AND lk.worse = by_.r WHERE c.text IS NOT NULL"""


_CANONICAL_PARTS = r"""
u0 AS (SELECT DISTINCT url, trim(url) AS u FROM pages),
u1 AS (SELECT url, u, string_split(u, '#')[1] AS f FROM u0),
u2 AS (SELECT url, u, lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)) AS scheme, regexp_replace(f, '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS rest FROM u1),
u3 AS (SELECT *, string_split(rest, '?')[1] AS place, regexp_extract(rest, '\?(.*)$', 1) AS q FROM u2),
u4 AS (SELECT url, u, scheme, lower(regexp_extract(place, '^([^/]*)', 1)) AS host, regexp_replace(url_decode(regexp_extract(place, '^[^/]*(/.*)?$', 1)), '/+$', '') AS path,
  list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(string_split(x, '=')[1]), '^(?:utm_.*|fbclid|gclid|yclid)$')), lambda x: [string_split(x, '=')[1], regexp_extract(x, '=(.*)$', 1)]) AS ps FROM u3),
canon AS (SELECT url, CASE WHEN u = '' THEN '' ELSE (CASE WHEN scheme = '' THEN 'https' ELSE scheme END) || '://' || host || replace(replace(replace(url_encode(path), '%2F', '/'), '%3A', ':'), '%25', '%')
  || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(list_transform(ps, lambda x: replace(url_encode(url_decode(replace(x[1], '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(x[2], '+', ' '))), '%20', '+')), '&') ELSE '' END END AS canonical FROM u4)"""

_KEYWORDS = r"""
l AS (SELECT file_name, string_split(text, chr(10)) AS a FROM source_text),
ln AS (SELECT file_name, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS i FROM l),
w AS (SELECT file_name, CAST(floor(i / 4) AS BIGINT) AS chunk, regexp_extract_all(lower(line), '[\p{L}\p{M}]+|[^\p{L}\p{M}\s]') AS w FROM ln),
g AS (SELECT file_name, chunk, w[j:j + n - 1] AS gram FROM (SELECT file_name, chunk, w, n, unnest(range(1, len(w) - n + 2)) AS j FROM w, (VALUES (1), (2)) v(n))),
cand AS (SELECT file_name, chunk, array_to_string(gram, ' ') AS word, count(*) AS tf FROM g WHERE len(list_filter(gram, lambda x: length(x) < 2 OR NOT regexp_matches(x, '^\p{L}'))) = 0 GROUP BY 1, 2, 3),
chunks AS (SELECT file_name, count(DISTINCT chunk) AS chunks FROM w GROUP BY 1),
sc AS (SELECT *, tf + length(word) / 100.0 AS score FROM cand),
pl AS (SELECT *, min(score) OVER k AS lo, max(score) OVER k AS hi, count(*) OVER k AS n, row_number() OVER (PARTITION BY file_name, chunk ORDER BY score DESC, word) - 1 AS r FROM sc WINDOW k AS (PARTITION BY file_name, chunk)),
s AS (SELECT file_name, word, (score - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END + 0.1 * (1 - CAST(r AS DOUBLE) / greatest(n - 1, 1)) AS s FROM pl),
q AS (SELECT file_name, word, 0.7 * max(s) + 0.3 * avg(s) AS quality, ln(CAST(max(chunks) AS DOUBLE) / count(*)) AS idf FROM s JOIN chunks USING (file_name) GROUP BY 1, 2),
un AS (SELECT *, CASE WHEN max(quality) OVER f - min(quality) OVER f < 1e-9 THEN 1.0 ELSE (quality - min(quality) OVER f) / (max(quality) OVER f - min(quality) OVER f) END AS uq,
  CASE WHEN max(idf) OVER f - min(idf) OVER f < 1e-9 THEN 1.0 ELSE (idf - min(idf) OVER f) / (max(idf) OVER f - min(idf) OVER f) END AS ui FROM q WINDOW f AS (PARTITION BY file_name)),
fin AS (SELECT file_name, word, round(0.8 * uq + 0.2 * uq * ui, 6) AS score FROM un),
kw AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY score DESC, word) AS rank FROM fin QUALIFY rank <= 15)"""

_HITS = """
tm AS (SELECT file_name, word AS term, score FROM kw WHERE rank <= 8),
cp AS (SELECT DISTINCT file_name AS d, word AS term FROM cand),
held AS (SELECT tm.file_name, tm.term, d FROM tm JOIN cp USING (term)),
hit AS (SELECT x.file_name, x.term AS a, y.term AS b, count(DISTINCT x.d) AS hits FROM held x JOIN held y ON x.file_name = y.file_name AND x.d = y.d AND x.term < y.term GROUP BY 1, 2, 3),
ph AS (SELECT x.file_name, x.term AS a, y.term AS b, coalesce(hits, 0) AS hits FROM tm x JOIN tm y ON x.file_name = y.file_name AND x.term < y.term LEFT JOIN hit ON hit.file_name = x.file_name AND hit.a = x.term AND hit.b = y.term)"""

_TABLE = "tb AS (SELECT src_norm, min(tgt) AS tgt FROM translation_cache GROUP BY 1)"

_POOL = f"""
{_TABLE},
pool AS (SELECT file_name, term, score, tgt AS han, length(trim(tgt)) >= 2 AS eligible FROM tm JOIN tb ON src_norm = term WHERE trim(tgt) <> ''),
rkd AS (SELECT *, eligible AND count_if(eligible) OVER (PARTITION BY file_name) >= 2 AS ranked FROM pool),
pe AS (SELECT ph.* FROM ph SEMI JOIN (SELECT * FROM rkd WHERE ranked) x ON x.file_name = ph.file_name AND x.term = ph.a SEMI JOIN (SELECT * FROM rkd WHERE ranked) y ON y.file_name = ph.file_name AND y.term = ph.b),
bt AS (SELECT file_name, a AS term, hits FROM pe UNION ALL SELECT file_name, b, hits FROM pe),
su AS (SELECT file_name, term, count_if(hits >= 1) AS support, sum(CASE WHEN hits <= 0 THEN 0.0 WHEN hits <= 3 THEN 1.0 WHEN hits <= 10 THEN 0.8 WHEN hits <= 30 THEN 0.5 WHEN hits <= 100 THEN 0.25 ELSE 0.1 END::DOUBLE) AS quality FROM bt GROUP BY 1, 2),
af AS (SELECT rkd.file_name, rkd.term, score, coalesce(support, 0) AS support, coalesce(quality, 0.0) AS quality FROM rkd LEFT JOIN su USING (file_name, term)),
aa AS (SELECT *, round(0.10 * score / CASE WHEN max(score) OVER f > 0 THEN max(score) OVER f ELSE 1 END + 0.60 * (CAST(support AS DOUBLE) / CASE WHEN max(support) OVER f > 0 THEN max(support) OVER f ELSE 1 END) + 0.30 * (quality / CASE WHEN max(quality) OVER f > 0 THEN max(quality) OVER f ELSE 1 END), 4) AS anchor FROM af WINDOW f AS (PARTITION BY file_name)),
ta AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY anchor DESC, score DESC, term) AS place FROM aa QUALIFY place <= 6),
an AS (SELECT *, max(support > 0) OVER (PARTITION BY file_name) AS any_ FROM ta)"""

_ALIGN = """
v AS (SELECT vec_id AS chunk, label AS doc, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sim AS MATERIALIZED (SELECT a.doc AS src, a.chunk AS sc, b.doc AS dst, b.chunk AS dc, list_inner_product(a.vec, b.vec) AS sim FROM v a, v b WHERE a.chunk % 2 = 0 AND b.chunk % 2 = 1),
k1 AS (SELECT *, row_number() OVER (PARTITION BY src, sc ORDER BY sim DESC, dst, dc) AS near FROM sim QUALIFY near <= 5),
k2 AS (SELECT *, row_number() OVER (PARTITION BY dst, dc ORDER BY sim DESC, src, sc) AS near FROM sim QUALIFY near <= 5),
v1 AS (SELECT src, dst, count(*) AS votes, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, min(sc * 100 + near), dst) AS rank FROM k1 GROUP BY src, dst QUALIFY rank <= 10),
v2 AS (SELECT src, dst, count(*) AS votes, row_number() OVER (PARTITION BY dst ORDER BY count(*) DESC, min(dc * 100 + near), src) AS rank FROM k2 GROUP BY src, dst QUALIFY rank <= 10),
fb AS (SELECT src, dst, avg(m) AS f FROM (SELECT src, dst, sc, max(sim) AS m, row_number() OVER (PARTITION BY src, dst ORDER BY max(sim) DESC, sc) AS r, count(*) OVER (PARTITION BY src, dst) AS n FROM sim GROUP BY src, dst, sc) WHERE r <= greatest(1, floor(n * 0.7 + 1e-9)) GROUP BY src, dst),
bb AS (SELECT src, dst, avg(m) AS b FROM (SELECT src, dst, dc, max(sim) AS m, row_number() OVER (PARTITION BY src, dst ORDER BY max(sim) DESC, dc) AS r, count(*) OVER (PARTITION BY src, dst) AS n FROM sim GROUP BY src, dst, dc) WHERE r <= greatest(1, floor(n * 0.7 + 1e-9)) GROUP BY src, dst),
bm AS (SELECT src, dst, (f + b) / 2 AS s_avg, greatest(f, b) AS s_max, least(f, b) AS s_min FROM fb JOIN bb USING (src, dst))"""


def _margins(score: str) -> str:
    return f"""{_ALIGN},
e1 AS (SELECT src, dst, {score} AS s FROM bm SEMI JOIN v1 USING (src, dst)), e2 AS (SELECT src, dst, {score} AS s FROM bm SEMI JOIN v2 USING (src, dst)),
ra AS (SELECT src, avg(s) AS r FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS k FROM e1) WHERE k <= 10 GROUP BY src),
rb AS (SELECT dst, avg(s) AS r FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY s DESC, src) AS k FROM e2) WHERE k <= 10 GROUP BY dst),
un AS (SELECT src, dst, s FROM e1 UNION ALL SELECT src, dst, s FROM e2 ANTI JOIN e1 USING (src, dst)),
mg AS (SELECT src, dst, 2 * s - coalesce(ra.r, 0) - coalesce(rb.r, 0) AS margin, row_number() OVER (PARTITION BY src ORDER BY 2 * s - coalesce(ra.r, 0) - coalesce(rb.r, 0) DESC, dst) AS rank FROM un LEFT JOIN ra USING (src) LEFT JOIN rb USING (dst) QUALIFY rank <= 10)"""


def oracle_sql() -> dict[str, str]:
    han, latin = _count("text", HAN), _count("text", LATIN)
    old, new = _count("text", TRADITIONAL), _count("text", SIMPLIFIED)
    return {
        "text_stats": f"SELECT doc_id, coalesce(length(text), 0) AS chars, {han} AS han, {latin} AS latin, round({_share(han, latin)}, 6) AS han_ratio, round({_share(latin, han)}, 6) AS latin_ratio, round(CASE WHEN {old} + {new} > 0 THEN CAST({old} AS DOUBLE) / ({old} + {new}) ELSE 0.5 END, 6) AS traditional_score FROM documents",
        "clean_text_export": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
        "clean_text_aggressive": f"SELECT doc_id, {_clean('text', True)} AS text FROM documents",
        "clean_text_keyword": f"SELECT doc_id, {_keyword_text('text')} AS text FROM documents WHERE text IS NOT NULL",
        "sentence_split": f"SELECT doc_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS pos, unnest(u) AS sentence FROM ({_units()})",
        "sentence_windows": _windows(_units(), "u", 8, 6),
        "token_windows": _windows(f"SELECT doc_id, list_filter(string_split({_drop('coalesce(text, ' + chr(39) * 2 + ')', f'[{SPACE}]+', chr(1))}, chr(1)), lambda x: x <> '') AS u FROM documents", "u", 100, 50),
        "signatures": f"WITH {_ONE} SELECT global_id, sha1({_signature('text')}) AS han_hash, sha1({_signature('text', LATIN)}) AS latin_hash FROM cand WHERE text IS NOT NULL",
        "pages_latest": f"WITH {_LATEST} SELECT doc_id, page_id, status, coalesce(length(text), 0) AS chars FROM latest",
        "line_run_stats": f"WITH {_ONE}, src AS (SELECT global_id, text FROM cand WHERE text IS NOT NULL), {_runs('src', 'global_id', 'text').strip()} SELECT * FROM runs",
        "page_gate": f"WITH {_gate()} SELECT doc_id, page_id, coalesce(reason, 'candidate') AS reason, length(clean) AS chars, han FROM gated",
        "funnel_summary": f"WITH {_gate()} SELECT count(*) AS pages, count_if(reason IS NULL) AS candidates, count(DISTINCT CASE WHEN reason IS NULL THEN sig END) AS distinct_texts FROM gated",
        "page_rollup": f"WITH {_LATEST} SELECT doc_id, count(*) AS num_pages, count_if(coalesce(status = 'ok', false)) AS num_ok, count_if(coalesce(status, '') <> 'ok') AS num_error, count_if(coalesce(needs_ocr, false)) AS num_needs_ocr, CAST(sum(coalesce(len(assets), 0)) AS BIGINT) AS num_assets FROM latest GROUP BY doc_id",
        "rejection_reasons": "SELECT reason, count(*) AS n FROM (SELECT DISTINCT doc_id, page_id, reason FROM rejection) GROUP BY reason",
        "url_canonical": f"WITH {_CANONICAL_PARTS} SELECT url, canonical, regexp_replace(string_split(trim(url), '#')[1], '/+$', '') AS stop_key FROM canon",
        "url_group": f"WITH {_CANONICAL_PARTS} SELECT doc_id, canonical, min(page_id) AS first, count(*) AS n FROM (SELECT DISTINCT doc_id, page_id, url FROM pages WHERE url IS NOT NULL) JOIN canon USING (url) GROUP BY doc_id, canonical",
        "url_early_stop": "WITH h AS (SELECT DISTINCT doc_id, q.query_id AS query_no, q.rank AS rank, url FROM (SELECT doc_id, url, unnest(source_queries) AS q FROM pages)), k AS (SELECT *, regexp_replace(string_split(trim(url), '#')[1], '/+$', '') AS key FROM h), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key ORDER BY query_no, rank ROWS UNBOUNDED PRECEDING) AS seen FROM k), cut AS (SELECT doc_id, min(query_no) AS cut FROM c WHERE seen >= 3 GROUP BY doc_id) SELECT k.doc_id, query_no, rank, url FROM k LEFT JOIN cut USING (doc_id) WHERE cut IS NULL OR query_no <= cut",
        "content_kinds": "SELECT DISTINCT url, content_type, CASE WHEN lower(coalesce(content_type, '')) LIKE '%application/pdf%' OR lower(coalesce(url, '')) LIKE '%.pdf' THEN 'pdf' WHEN lower(coalesce(content_type, '')) LIKE '%text/plain%' OR lower(coalesce(url, '')) LIKE '%.txt' THEN 'text' WHEN lower(coalesce(content_type, '')) LIKE '%text/html%' THEN 'html' ELSE 'unknown' END AS kind, CASE WHEN coalesce(regexp_extract(content_type, '(?i)charset=[\"'']?([^\\s;\"'']+)', 1), '') = '' THEN 'utf-8' ELSE regexp_extract(content_type, '(?i)charset=[\"'']?([^\\s;\"'']+)', 1) END AS charset FROM pages",
        "exact_dedup": _exact("content_hash"),
        "exact_dedup_scoped": _exact("content_hash, doc_id"),
        "ngram_jaccard_pairs": f"WITH {_grams()} SELECT a, b, round(m / (na + nb - m), 6) AS score FROM p WHERE m / (na + nb - m) >= 0.85 - 1e-9",
        "containment_pairs": f"WITH {_grams()} SELECT a, b, round(m / least(na, nb), 6) AS score FROM p WHERE m / least(na, nb) >= 0.9 - 1e-9",
        "containment_asym_pairs": f"WITH {_grams()}, {_RANKED}, o AS (SELECT CASE WHEN x.r < y.r THEN a ELSE b END AS a, CASE WHEN x.r < y.r THEN b ELSE a END AS b, m, CASE WHEN x.r < y.r THEN na ELSE nb END AS na, CASE WHEN x.r < y.r THEN nb ELSE na END AS nb FROM p JOIN rk x ON x.global_id = a JOIN rk y ON y.global_id = b) SELECT a, b, round(m / nb, 6) AS b_in_a, round(m / na, 6) AS a_in_b FROM o WHERE m / nb >= 0.95 - 1e-9 OR least(m / nb, m / na) >= 0.9 * 0.95 - 1e-9",
        "similarity_metrics": f"WITH {_grams()} SELECT a, b, round(m / (na + nb - m), 6) AS jaccard, round(m / least(na, nb), 6) AS containment, round(m / nb, 6) AS b_in_a, round(m / na, 6) AS a_in_b FROM p WHERE m / least(na, nb) >= 0.9 - 1e-9",
        "doc_scope_pairs": f"WITH {_grams()} SELECT a, b, round(m / (na + nb - m), 6) AS score FROM p JOIN cand x ON x.global_id = a JOIN cand y ON y.global_id = b WHERE x.doc_id = y.doc_id AND m / (na + nb - m) >= 0.5 - 1e-9",
        "near_dedup": _near("m / (na + nb - m) >= 0.85 - 1e-9", "m / (na + nb - m)"),
        "near_dedup_contained": _near("m / nw >= 0.95 - 1e-9 OR least(m / nw, m / nbt) >= 0.9 * 0.95 - 1e-9", "CASE WHEN m / nw >= 0.95 - 1e-9 THEN m / nw ELSE least(m / nw, m / nbt) END"),
        "export_manifest": f"WITH {_ONE}, x AS (SELECT *, first_value(global_id) OVER (PARTITION BY content_hash ORDER BY traditional_score DESC, han_ratio DESC, han_chars DESC, text_len DESC, global_id) AS kept FROM cand) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_id, domain, content_hash, global_id) AS local_no, global_id FROM x WHERE kept = global_id",
        "keyword_candidates": f"WITH {_KEYWORDS} SELECT file_name, chunk, word, tf FROM cand",
        "keyword_aggregate": f"WITH {_KEYWORDS} SELECT file_name, word, score, rank FROM kw",
        "cooccurrence_hits": f"WITH {_KEYWORDS}, {_HITS.strip()} SELECT file_name, a, b, hits FROM ph",
        "anchor_score": f"WITH {_KEYWORDS}, {_HITS.strip()}, both_ AS (SELECT file_name, a AS term, hits FROM ph UNION ALL SELECT file_name, b, hits FROM ph), sp AS (SELECT file_name, term, count_if(hits >= 1) AS support, CAST(sum(hits) AS BIGINT) AS hits, sum(CASE WHEN hits <= 0 THEN 0.0 WHEN hits <= 3 THEN 1.0 WHEN hits <= 10 THEN 0.8 WHEN hits <= 30 THEN 0.5 WHEN hits <= 100 THEN 0.25 ELSE 0.1 END::DOUBLE) AS quality FROM both_ GROUP BY 1, 2), fl AS (SELECT tm.*, coalesce(support, 0) AS support, coalesce(hits, 0) AS hits, coalesce(quality, 0.0) AS quality FROM tm LEFT JOIN sp USING (file_name, term)) SELECT file_name, term, support, hits, round(quality, 6) AS quality, round(0.10 * score / CASE WHEN max(score) OVER f > 0 THEN max(score) OVER f ELSE 1 END + 0.60 * (CAST(support AS DOUBLE) / CASE WHEN max(support) OVER f > 0 THEN max(support) OVER f ELSE 1 END) + 0.30 * (quality / CASE WHEN max(quality) OVER f > 0 THEN max(quality) OVER f ELSE 1 END), 4) AS anchor FROM fl WINDOW f AS (PARTITION BY file_name)",
        "query_variants": f"WITH {_KEYWORDS}, n AS (SELECT *, count(*) OVER (PARTITION BY file_name) AS n FROM kw), x AS (SELECT file_name, variant, ((rank - 1) - (variant * 4) % n + n) % n AS place, word FROM n, (VALUES (1), (2), (3)) v(variant)) SELECT file_name, variant, place, word FROM x WHERE place < 4",
        "translate_lookup": f"WITH {_KEYWORDS}, {_TABLE} SELECT term, coalesce(tgt, '') AS trans, src_norm IS NOT NULL AS found FROM (SELECT DISTINCT word AS term FROM kw WHERE rank <= 8) LEFT JOIN tb ON src_norm = term",
        "query_compose": f"WITH {_KEYWORDS}, {_TABLE} SELECT file_name, string_agg(CASE WHEN rank <= 3 THEN '\"' || tgt || '\"' ELSE tgt END, ' ' ORDER BY rank) || ' (site:a.example OR site:b.example)' AS query FROM kw JOIN tb ON src_norm = word WHERE rank <= 6 AND tgt <> '' GROUP BY file_name",
        "rerank_candidates": f"WITH {_KEYWORDS}, {_HITS.strip()}, {_POOL} SELECT file_name, term, han, eligible FROM pool",
        "anchor_top": f"WITH {_KEYWORDS}, {_HITS.strip()}, {_POOL} SELECT file_name, term, support, anchor, place FROM ta",
        "anchor_connections": f"WITH {_KEYWORDS}, {_HITS.strip()}, cb AS (SELECT file_name, a AS term, b AS other, hits FROM ph UNION ALL SELECT file_name, b, a, hits FROM ph), cq AS (SELECT *, CASE WHEN hits <= 0 THEN 0.0 WHEN hits <= 3 THEN 1.0 WHEN hits <= 10 THEN 0.8 WHEN hits <= 30 THEN 0.5 WHEN hits <= 100 THEN 0.25 ELSE 0.1 END AS ql FROM cb) SELECT file_name, term, max(hits) AS max_hits, coalesce(string_agg(other, '|' ORDER BY ql DESC, hits DESC, other) FILTER (WHERE hits >= 1), '') AS connected FROM cq GROUP BY 1, 2",
        "query_terms": f"WITH {_KEYWORDS}, {_HITS.strip()}, {_POOL} SELECT file_name, term, row_number() OVER (PARTITION BY file_name ORDER BY place) AS place FROM an WHERE NOT any_ OR support > 0 QUALIFY row_number() OVER (PARTITION BY file_name ORDER BY place) <= 4",
        "query_exact_loose": f"WITH {_KEYWORDS}, {_HITS.strip()}, {_POOL}, ch AS (SELECT file_name, term, support, row_number() OVER (PARTITION BY file_name ORDER BY CASE WHEN any_ AND support = 0 THEN 1 ELSE 0 END, place) AS place FROM an QUALIFY place <= 5), ex AS (SELECT file_name, term, row_number() OVER (PARTITION BY file_name ORDER BY CASE WHEN support > 0 AND contains(term, ' ') THEN 0 WHEN support > 0 THEN 1 ELSE 2 END, place) AS place FROM ch) SELECT file_name, term, place <= 2 AS is_exact, place FROM ex",
        "query_local_ranges": f"WITH {_KEYWORDS}, k AS (SELECT file_name, chunks, greatest(1, CAST(ceil(sqrt(chunks)) AS BIGINT)) AS k FROM chunks), pt AS (SELECT file_name, chunks, k, unnest(range(0, k)) AS part FROM k) SELECT file_name, part, part * chunks // k AS first_chunk, (part + 1) * chunks // k - 1 AS last_chunk FROM pt WHERE part * chunks // k <= (part + 1) * chunks // k - 1",
        "translation_hit_counts": f"WITH {_KEYWORDS}, {_TABLE} SELECT file_name, count(*) AS terms, count_if(coalesce(tgt, '') <> '') AS hits FROM kw LEFT JOIN tb ON src_norm = word WHERE rank <= 8 GROUP BY file_name",
        "terms_first_seen": f"WITH {_KEYWORDS} SELECT word AS term, min(file_name) AS first FROM kw WHERE rank <= 8 GROUP BY word",
        "url_group_traces": f"WITH {_CANONICAL_PARTS}, pg AS (SELECT DISTINCT ON (doc_id, page_id, url) doc_id, page_id, url, source_queries FROM pages WHERE url IS NOT NULL) SELECT doc_id, canonical, arg_min(url, [page_id, url]) AS url, min(page_id) AS first, CAST(coalesce(sum(len(source_queries)), 0) AS BIGINT) AS traces FROM pg JOIN canon USING (url) WHERE canonical <> '' GROUP BY doc_id, canonical",
        "corpus_index": "SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS doc_idx FROM (SELECT DISTINCT file_name FROM source_text)",
        "pair_metadata": "WITH i AS (SELECT file_name, row_number() OVER (ORDER BY file_name) - 1 AS doc_idx FROM (SELECT DISTINCT file_name FROM source_text)) SELECT DISTINCT doc_idx AS src_idx, src, tgt FROM gold_pair JOIN i ON src = file_name WHERE tgt IS NOT NULL AND src <> '' AND tgt <> ''",
        "title_names": f"WITH {_ONE}, t AS (SELECT global_id, coalesce(nullif(html_title, ''), nullif(title, ''), doc_id) AS t FROM cand) SELECT global_id, {_drop(_strip('t'), '(?i)' + chr(92) + 's*[-_｜|]' + chr(92) + 's*(?:Wikisource|Chinese Text Project|中國哲學書電子化計劃).*$')} AS title, {_drop(_strip('t'), f'[{SPACE}]+', '_')} AS unit FROM t",
        "translation_table": "SELECT src_norm, coalesce(tgt, '') AS tgt, length(tgt) > 0 AS filled FROM translation_cache",
        "knn_chunks": f"WITH {_ALIGN} SELECT src, sc AS src_chunk, dst, dc AS dst_chunk, round(sim, 6) AS sim, near AS rank FROM k1",
        "vote_docs": f"WITH {_ALIGN} SELECT src, dst, votes, rank FROM v1",
        "bimax_avg": f"WITH {_ALIGN} SELECT src, dst, round(s_avg, 6) AS score FROM bm SEMI JOIN v1 USING (src, dst)",
        "bimax_max": f"WITH {_ALIGN} SELECT src, dst, round(s_max, 6) AS score FROM bm SEMI JOIN v1 USING (src, dst)",
        "bimax_min": f"WITH {_ALIGN} SELECT src, dst, round(s_min, 6) AS score FROM bm SEMI JOIN v1 USING (src, dst)",
        "csls_edges": f"WITH {_margins('s_max')} SELECT src, dst, round(margin, 6) AS margin, rank FROM mg",
        "align_mm": f"WITH {_margins('s_max')} SELECT src, dst, round(margin, 6) AS margin FROM mg WHERE margin >= 0.0",
        "align_one_to_one": f"WITH RECURSIVE {_margins('s_avg')}, eg AS (SELECT src, dst, margin, row_number() OVER (ORDER BY margin DESC, src, dst) AS r FROM mg WHERE margin >= -1.0), gr AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS ud UNION ALL SELECT eg.r, CASE WHEN list_contains(us, src) OR list_contains(ud, dst) THEN us ELSE list_append(us, src) END, CASE WHEN list_contains(us, src) OR list_contains(ud, dst) THEN ud ELSE list_append(ud, dst) END FROM gr JOIN eg ON eg.r = gr.r + 1), tk AS (SELECT unnest(us) AS src, unnest(ud) AS dst FROM (SELECT * FROM gr ORDER BY r DESC LIMIT 1)) SELECT src, dst, round(margin, 6) AS margin FROM tk JOIN eg USING (src, dst)",
        "align_eval": f"WITH {_margins('s_max')}, f AS (SELECT DISTINCT src, dst FROM mg WHERE margin >= 0.0), g AS (SELECT DISTINCT label AS src, label AS dst FROM embeddings), c AS (SELECT (SELECT count(*) FROM f SEMI JOIN g USING (src, dst)) AS tp, (SELECT count(*) FROM f ANTI JOIN g USING (src, dst)) AS fp, (SELECT count(*) FROM g ANTI JOIN f USING (src, dst)) AS fn), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS q FROM c) SELECT tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0.0 END, 6) AS f1 FROM r",
        "gold_pairs": "SELECT DISTINCT src, tgt FROM gold_pair WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> '' AND tgt <> ''",
        "target_link": "WITH k AS (SELECT regexp_extract(txt_path, '([^/]*)$', 1) AS tgt, min(coalesce(final_url, canonical_url, url, '')) AS link FROM candidate WHERE txt_path IS NOT NULL GROUP BY 1) SELECT src, tgt, coalesce(link, '') AS link FROM (SELECT DISTINCT src, tgt FROM gold_pair WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> '' AND tgt <> '') LEFT JOIN k USING (tgt)",
    }
