"""SQL, for DuckDB, of operators whose plain definition SQL can state. It is quadratic or writes every window, and so for small tables only."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP10_SQL = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, p, n, item_id FROM dw JOIN bw USING (n, k)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
OP9_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y USING (k) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS k FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS p FROM d WHERE len(x) >= 200)),
g AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
i AS (SELECT doc_id, p, coalesce(p - lag(p) OVER v > 100, true) AS new FROM g WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
j AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS span FROM i),
r AS (SELECT doc_id, span, min(p) AS s, max(p) + 100 AS e FROM j GROUP BY doc_id, span),
f AS (SELECT doc_id, span, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY span) AS before FROM r),
m AS (
  SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(substr(x, 2 * before + 1, 2 * (s - before)), '' ORDER BY span) AS kept
  FROM f JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id)
"""
#: crc32 of a decimal id, a byte at a time: ``t`` is the table of the 256 remainders.
OP12_SQL = r"""
WITH t AS (
  SELECT list(list_reduce([CAST(b AS BIGINT)] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) AS r(b)),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) AS h
  FROM d, t),
g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
e AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
o AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE w END AS w FROM e),
x AS (SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS k FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM o WHERE n >= 6)),
q AS (SELECT doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r USING (doc_id, k) WHERE r.i > l.i AND 4 * (r.i - l.i) <= l.n),
s AS (SELECT doc_id, q, min(i) AS s, max(i) + 3 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS j FROM q) GROUP BY doc_id, q, j),
l AS (SELECT * FROM s WHERE e - s >= greatest(6, 4 * q)),
r AS (SELECT * FROM l WHERE NOT EXISTS (FROM l AS m WHERE m.doc_id = l.doc_id AND m.q < l.q AND m.s <= l.s AND m.e >= l.e)),
c AS (
  SELECT doc_id, coalesce(string_agg(w[i + 1], ' ' ORDER BY i), '') AS kept
  FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM o) b WHERE NOT EXISTS (FROM r WHERE r.doc_id = b.doc_id AND b.i >= r.s + r.q AND b.i < r.e) GROUP BY doc_id),
f AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS runs, first({'s': s, 'l': e - s, 'q': q} ORDER BY e - s DESC, s, q) AS b
  FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s AS start, b.l AS length, b.q AS period, 1000 * b.l // b.q AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (doc_id) LEFT JOIN c USING (doc_id)
"""
