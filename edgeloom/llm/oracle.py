"""The registered queries as SQL over whole tables, where SQL can express them."""

from __future__ import annotations

from .decontaminate import LOWER, UPPER
from .license_scan import TEMPLATES
from .unit_dedup import SENTENCE_END, STRETCH
from .url_filter import RULES, blocked_globs

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


def _fold(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


_LINES = rf"""
d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l0 AS (SELECT rid, doc_id, source, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
l AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS words, trim(regexp_replace({_fold("line")}, '{_SPACE}', ' ', 'g'), ' ') AS norm FROM l0)
"""

OP1 = rf"""
WITH {_LINES},
w0 AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM d),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w0),
t AS (SELECT rid, p, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
c AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w1, w2) AS times FROM t WHERE w2 IS NOT NULL),
hit AS (SELECT DISTINCT rid, p + k AS p FROM (SELECT rid, p, unnest(range(3)) AS k FROM c WHERE times > 1)),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM l WHERE words > 0 GROUP BY rid, line) GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, d.source, d.text, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN w0 USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
bad AS (SELECT source, norm FROM l WHERE words > 0 GROUP BY source, norm HAVING count(DISTINCT rid) > 20),
lost AS (SELECT l.rid, sum(words) AS n FROM l JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.norm = bad.norm WHERE words > 0 GROUP BY l.rid),
f AS (SELECT *, coalesce(lost.n, 0) AS gone, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM base LEFT JOIN lost USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, gone::BIGINT AS n_removed_words, failed AS base_failed, NOT failed AND gone <= 0.5 * n_words AS kept FROM f
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{_quoted(v)}')" for k, v in TEMPLATES.items())}) AS v(name, text)),
units AS (SELECT rid, unnest(string_split(text, chr(10))) AS u, true AS is_line FROM d UNION ALL SELECT rid, text, false FROM d),
uw AS (SELECT rid, is_line, regexp_extract_all({_fold("u")}, '{_ITEM_WORD}') AS w FROM units),
ub AS (SELECT rid, is_line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM uw WHERE len(w) > 1),
nw AS (SELECT name, regexp_extract_all({_fold("text")}, '{_ITEM_WORD}') AS w FROM n),
nb AS (SELECT name, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM nw),
s AS (SELECT rid, is_line, name, 2 * len(list_intersect(ub.b, nb.b)) / (len(ub.b) + len(nb.b))::DOUBLE AS dice
  FROM ub JOIN nb ON len(nb.b) BETWEEN len(ub.b) * 0.8::DOUBLE / 1.2 - 1e-9 AND len(ub.b) * 1.2::DOUBLE / 0.8 + 1e-9),
m AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, name) AS rank FROM s WHERE dice >= 0.8),
ln AS (SELECT rid, count(*) AS n FROM (
  SELECT rid FROM (SELECT row_number() OVER () AS k, rid, b FROM ub WHERE is_line) q
  WHERE EXISTS (SELECT 1 FROM nb WHERE 2 * len(list_intersect(q.b, nb.b)) / (len(q.b) + len(nb.b))::DOUBLE >= 0.8)) GROUP BY rid)
SELECT doc_id, name AS license, coalesce(round(dice, 6), 0) AS dice, coalesce(ln.n, 0)::BIGINT AS n_matches
FROM d LEFT JOIN (SELECT * FROM m WHERE rank = 1) USING (rid) LEFT JOIN ln USING (rid)
"""

OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT rid, regexp_extract_all(text, '{_SPACE}|{_WORD}') AS t FROM d),
k0 AS (SELECT rid, unnest(t) AS x, generate_subscripts(t, 1) AS k FROM x),
k1 AS (SELECT *, sum(length(x)) OVER o AS e, sum((x LIKE '%' || chr(10) || '%')::INT) OVER o AS line, sum((x LIKE '%' || chr(10) || '%' || chr(10) || '%')::INT) OVER o AS para
  FROM k0 WINDOW o AS (PARTITION BY rid ORDER BY k)),
w AS (SELECT rid, {_fold("x")} AS w, e - length(x) AS s, e, line, para, row_number() OVER (PARTITION BY rid ORDER BY k) AS p, count(*) OVER (PARTITION BY rid) AS n
  FROM k1 WHERE NOT regexp_matches(x, '^{_SPACE}')),
m AS (SELECT *, p = n OR regexp_matches(w, '{_quoted(SENTENCE_END)}') AS fin FROM w),
y AS (SELECT *, coalesce(sum(fin::INT) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM m),
c AS (SELECT *, fin OR (count(*) OVER (PARTITION BY rid, sentence) > {STRETCH} AND substr(md5(w), 2, 1) IN ('0', '8')) AS cut FROM y),
q AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM c),
a AS (SELECT rid, part, min(p) AS lo, max(p) AS hi, any_value(n) AS n FROM q GROUP BY rid, part),
r AS (
  SELECT l.rid, l.lo, min(h.hi) AS hi FROM a l JOIN a h ON l.rid = h.rid AND h.hi - l.lo >= 19 AND h.part BETWEEN l.part AND l.part + 20 GROUP BY l.rid, l.lo
  UNION SELECT rid, max(lo), n FROM a WHERE n - lo >= 19 GROUP BY rid, n
  UNION SELECT rid, 1, n FROM a WHERE n < 20
  UNION SELECT rid, min(p), max(p) FROM w GROUP BY rid, line HAVING count(*) >= 10
  UNION SELECT rid, min(p), max(p) FROM w GROUP BY rid, para HAVING count(*) >= 10),
t AS (SELECT rid, list(w ORDER BY p) AS ws, list(s ORDER BY p) AS ss, list(e ORDER BY p) AS es FROM w GROUP BY rid),
u AS (SELECT rid, doc_id, array_to_string(ws[lo:hi], ' ') AS words, ss[lo] AS s, es[hi] AS e FROM r JOIN t USING (rid) JOIN d USING (rid)),
k AS (SELECT *, count(*) OVER b AS times, min(rid) OVER b < max(rid) OVER b AS shared, first_value(rid) OVER o AS kr, first_value(s) OVER o AS ks, first_value(e) OVER o AS ke, first_value(doc_id) OVER o AS ki
  FROM u WINDOW b AS (PARTITION BY words), o AS (PARTITION BY words ORDER BY doc_id NULLS LAST, rid, s, e)),
z AS (SELECT *, kr <> rid OR ks <> s AS again, CASE WHEN kr = rid THEN greatest(s, ke) ELSE s END AS s2 FROM k WHERE times > 1),
g0 AS (SELECT rid, s2, e, max(e) OVER (PARTITION BY rid ORDER BY s2, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM z WHERE again AND s2 < e),
g1 AS (SELECT *, sum((reach IS NULL OR s2 > reach)::INT) OVER (PARTITION BY rid ORDER BY s2, e ROWS UNBOUNDED PRECEDING) AS span FROM g0),
g AS (SELECT rid, string_agg(s::BIGINT || '-' || e::BIGINT, ',' ORDER BY s) AS spans FROM (SELECT rid, min(s2) AS s, max(e) AS e FROM g1 GROUP BY rid, span) GROUP BY rid),
n AS (SELECT rid, count(*) AS n FROM r GROUP BY rid),
h AS (SELECT rid, sum(shared::INT) AS n_repeated, sum(again::INT) AS n_removed FROM z GROUP BY rid),
i AS (SELECT rid, string_agg(ki::VARCHAR, ',' ORDER BY ki) AS kept_in FROM (SELECT DISTINCT rid, ki FROM z WHERE kr <> rid AND ki IS NOT NULL) GROUP BY rid)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_units, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS removed_spans,
  coalesce(kept_in, '') AS kept_in FROM d LEFT JOIN n USING (rid) LEFT JOIN h USING (rid) LEFT JOIN g USING (rid) LEFT JOIN i USING (rid)
"""

OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p + 1:p + n], ' ') AS s FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT rid, n, w, unnest(range(greatest(len(w) - n + 1, 0))) AS p FROM d, sizes),
spots AS (SELECT rid, n, p, array_to_string(w[p + 1:p + n], ' ') AS s FROM dw),
hit AS (SELECT rid, p, spots.n, item_id FROM spots JOIN win ON spots.n = win.n AND spots.s = win.s),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS i FROM (SELECT DISTINCT rid, item_id::VARCHAR AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(i, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (rid) LEFT JOIN items USING (rid)
"""


OP8 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, array_to_string(regexp_extract_all({_fold("coalesce(text, '')")}, '{_WORD}'), ' ') AS t FROM documents),
c AS (SELECT t, min(rid) AS cid, count(*) AS n_copies, string_split(t, ' ') AS w FROM d GROUP BY t),
p AS (SELECT cid, w, unnest(range(greatest(len(w) - 4, 1))) AS p FROM c WHERE t <> ''),
s AS (SELECT DISTINCT cid, array_to_string(w[p + 1:p + 5], ' ') AS sh FROM p),
n AS (SELECT cid, count(*) AS n FROM s GROUP BY cid),
j AS (SELECT a.cid AS a, b.cid AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.cid <> b.cid GROUP BY 1, 2),
l AS (SELECT a, b FROM j JOIN n x ON a = x.cid JOIN n y ON b = y.cid WHERE k >= 0.8::DOUBLE * (x.n + y.n - k) - 1e-9),
r AS (SELECT cid, cid AS o FROM c UNION SELECT r.cid, l.b FROM r JOIN l ON r.o = l.a),
m AS (SELECT cid, min(o) AS root FROM r GROUP BY cid),
g AS (SELECT root, min(doc_id) AS class_id FROM d JOIN c USING (t) JOIN m USING (cid) GROUP BY root),
k AS (SELECT a AS cid, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, n_copies::BIGINT AS n_copies
FROM d JOIN c USING (t) JOIN m USING (cid) JOIN g USING (root) LEFT JOIN k USING (cid)
"""


def _rule(rule: str) -> str:
    host, path = rule[: rule.index("/")], rule[rule.index("/") :]
    return f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}') THEN"


def _like(glob: str) -> str:
    return glob.replace("*", "%").replace("?", "_")


_LONGEST = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
OP9 = rf"""
WITH p AS (SELECT page_id, {_fold("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"{_rule(r)} '{r}'" for r, _ in _LONGEST)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in _LONGEST)}
  WHEN {" OR ".join(f"host || path LIKE '{_like(g)}'" for g in blocked_globs())} THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP10 = rf"""
WITH {_LINES},
bad AS (SELECT norm FROM l WHERE words > 0 GROUP BY norm HAVING count(DISTINCT coalesce(source, chr(0))) > 10),
h AS (SELECT l.*, words > 0 AND norm IN (SELECT norm FROM bad) AS hit FROM l),
g AS (SELECT rid, any_value(text) AS text, sum(hit::INT) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '') AS rest FROM h GROUP BY rid),
o AS (SELECT rid, n, coalesce(text, '') AS text, CASE WHEN n > 0 THEN rest ELSE coalesce(text, '') END AS t FROM g)
SELECT doc_id, n::BIGINT AS n_removed_lines, (length(o.text) - length(t))::BIGINT AS n_removed_chars, sha256(t) AS text_sha256 FROM d JOIN o USING (rid)
"""

_BITS = 4294967295
OP12 = rf"""
WITH RECURSIVE table_steps AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM table_steps WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY i) AS steps FROM table_steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '{_ITEM_WORD}') AS w FROM documents),
f AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
b AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_fold("coalesce(text, '')")}, '{_ITEM_WORD}')) AS word FROM benchmark) GROUP BY ALL),
h AS (SELECT word, hex(word) AS digits FROM (SELECT word FROM f UNION SELECT word FROM b)),
p AS (
  SELECT word, xor({_BITS}, list_reduce(list_prepend({_BITS}::BIGINT, list_transform(range(len(digits) // 2), lambda i: ('0x' || substr(digits, i * 2 + 1, 2))::BIGINT)),
    lambda c, x: xor(c // 256, steps[(xor(c, x) % 256) + 1]))) % 10000 AS bucket
  FROM h, crc_table
),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN p USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM b JOIN p USING (word) GROUP BY bucket),
g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
w AS (SELECT rid, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN p USING (word) JOIN g USING (bucket) GROUP BY rid),
c AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN w USING (rid)
),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS rank FROM c WHERE n_words >= 20)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END::BIGINT AS rank FROM c LEFT JOIN r USING (rid)
"""
