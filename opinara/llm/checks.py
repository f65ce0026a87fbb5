"""SQL that checks registered queries, where SQL can say what they return."""

from __future__ import annotations

LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
SPACED = rf"regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {SPACED} AS ws FROM documents),
s AS (
  SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) END AS g
  FROM w),
c AS (SELECT g, min(doc_id) AS doc_id, row_number() OVER () AS c FROM (SELECT list_sort(g) AS g, doc_id FROM s) GROUP BY g),
e AS (SELECT c, unnest(g) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b, count(*) AS n FROM e AS a JOIN e AS b USING (x) WHERE a.c <> b.c GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN c AS x ON x.c = p.a JOIN c AS y ON y.c = p.b
  WHERE 100 * n >= 85 * (len(x.g) + len(y.g) - n)),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
m AS (SELECT c.g, least(c.doc_id, min(d.doc_id)) AS k FROM c LEFT JOIN reach ON reach.a = c.c
  LEFT JOIN c AS d ON d.c = reach.b GROUP BY c.g, c.doc_id),
o AS (SELECT s.doc_id, len(s.g) AS n, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE m.k END AS k
  FROM s LEFT JOIN m ON m.g = list_sort(s.g))
SELECT doc_id, n::BIGINT AS n_shingles, k AS component_id, coalesce(doc_id = k, false) AS kept FROM o
"""

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS ws FROM documents),
i AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, ws[k : k + least(10, len(ws)) - 1] AS win, least(10, len(ws)) AS n
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
places AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT p.r, p.k, p.n, w.item_id FROM places AS p JOIN w ON w.n = p.n AND w.win = p.ws[p.k : p.k + p.n - 1]),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

URL_LOWER = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
REST = "CASE WHEN instr({0}, '://') > 0 THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"

URL_FILTER = rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, {URL_LOWER} AS low, {REST.format("coalesce(url, '')")} AS rest FROM pages),
q AS (SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, low, {REST.format("low")} AS lrest FROM p),
t AS (SELECT r, page_id, host, path, CASE WHEN instr(low, '://') = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(
  ['scheme=' || split_part(low, '://', 1)]
  || ['host=' || x FOR x IN string_split(regexp_extract(lrest, '^([^/?#]*)', 1), '.')]
  || ['path=' || regexp_replace(x, '[0-9]+', 'N', 'g') FOR x IN string_split(regexp_extract(lrest, '^[^/?#]*([^?#]*)', 1), '/') IF x <> '']
  || ['query=' || split_part(x, '=', 1) FOR x IN string_split(regexp_extract(lrest, '^[^?#]*\?([^#]*)', 1), '&') IF x <> ''])) END AS ts,
  try_cast(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id FROM q),
l AS (SELECT t.r, ts, coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS bad FROM t JOIN labels USING (doc_id)
  WHERE quality = 0 OR toxic = 1 OR (quality IS NOT NULL AND toxic IS NOT NULL)),
n AS (SELECT greatest(10, ceil(0.002 * count(*))) AS least FROM l),
u AS (SELECT row_number() OVER () AS k, ts, bad FROM l),
e AS (SELECT k, bad, unnest(ts) AS x FROM u),
c AS (
  SELECT [a.x] AS c, a.bad FROM e AS a
  UNION ALL SELECT [a.x, b.x], a.bad FROM e AS a JOIN e AS b ON a.k = b.k AND a.x < b.x
  UNION ALL SELECT [a.x, b.x, d.x], a.bad FROM e AS a JOIN e AS b ON a.k = b.k AND a.x < b.x JOIN e AS d ON b.k = d.k AND b.x < d.x),
rules AS (SELECT c, count(*) FILTER (bad) / count(*) AS confidence FROM c GROUP BY c
  HAVING count(*) FILTER (bad) >= (SELECT least FROM n) AND count(*) FILTER (bad) / count(*) >= 0.5),
m AS (SELECT t.r, max(confidence) AS confidence FROM t JOIN rules ON list_has_all(t.ts, rules.c) GROUP BY t.r),
v AS (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM t LEFT JOIN m USING (r))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN confidence IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, confidence FROM v
"""

# CRC-32 of the bytes ``bs`` of a text, by a table that the common rule fills.
CRC_TABLE = """t AS (SELECT list(list_reduce(list_prepend(i, range(8)),
  lambda c, _ : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i))"""


def crc(value: str) -> str:
    digits = f"hex(encode({value}))"
    number = f"[('0x' || {digits}[2 * k - 1 : 2 * k])::BIGINT FOR k IN range(1, strlen({value}) + 1)]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {number}), lambda c, b : xor(c >> 8, t.t[(xor(c, b) & 255) + 1])))"


RESAMPLING = f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS ws FROM documents),
b AS (SELECT {ALNUM} AS ws FROM benchmark),
fd AS (SELECT r, unnest(ws) AS f FROM d UNION ALL SELECT r, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM d
  UNION ALL SELECT r, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) FROM d),
fb AS (SELECT unnest(ws) AS f FROM b UNION ALL SELECT unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM b
  UNION ALL SELECT unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) FROM b),
x AS (SELECT f, {crc("f")} % 10000 AS bucket FROM (SELECT f FROM fd UNION SELECT f FROM fb), t),
cd AS (SELECT bucket, count(*) AS s FROM fd JOIN x USING (f) GROUP BY bucket),
cb AS (SELECT bucket, count(*) AS t FROM fb JOIN x USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM fd) + 10000 AS s, (SELECT count(*) FROM fb) + 10000 AS t),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(cb.t, 0) + 1)::DOUBLE * n.s::DOUBLE / ((coalesce(cd.s, 0) + 1)::DOUBLE * n.t::DOUBLE)))::BIGINT AS gain
  FROM n, range(10000) AS q(i) LEFT JOIN cd ON cd.bucket = i LEFT JOIN cb ON cb.bucket = i),
w AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS weight FROM fd JOIN x USING (f) JOIN g USING (bucket) GROUP BY r),
s AS (SELECT r, doc_id, len(ws) AS words, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM s WHERE words >= 20)
SELECT doc_id, n::BIGINT AS n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM k) * 5 // 100 THEN place END AS rank FROM s LEFT JOIN k USING (r)
"""

RUN_LOWER = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
l AS (SELECT id, {RUN_LOWER} AS w, count(*) AS n FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT w, n, {crc("concat(id, ':', w)")} AS h FROM l, t),
x AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS (SELECT w, sum(n)::BIGINT AS n FROM x WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
d AS (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS rest FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
p AS (SELECT a.w AS a, b.w AS b FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.w <> b.w
  UNION SELECT d.w, v.w FROM d JOIN v ON d.rest = v.w UNION SELECT v.w, d.w FROM d JOIN v ON d.rest = v.w),
m AS (SELECT a, count(*) AS n_near, max(n) AS n FROM p JOIN v ON v.w = b GROUP BY a),
f AS (SELECT m.a AS w, min(b) AS form, any_value(m.n) AS form_n FROM m JOIN p USING (a) JOIN v ON v.w = p.b AND v.n = m.n JOIN v AS o ON o.w = m.a
  WHERE m.n >= 5 * o.n GROUP BY m.a),
c AS (SELECT w, form AS root, 1 AS k FROM f UNION ALL SELECT c.w, f.form, k + 1 FROM c JOIN f ON f.w = c.root),
e AS (SELECT w, arg_max(root, k) AS root FROM c GROUP BY w)
SELECT v.w AS word, form, coalesce(root, v.w) AS root, v.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n
FROM v LEFT JOIN m ON m.a = v.w LEFT JOIN f ON f.w = v.w LEFT JOIN e ON e.w = v.w
"""
