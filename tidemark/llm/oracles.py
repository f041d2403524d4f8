"""The same results as SQL for DuckDB, written from the definitions."""

from __future__ import annotations

_VECTOR = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(x[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, x, unnest(range(1, CASE WHEN len(x) = 0 THEN 1 ELSE greatest(len(x) - 3, 2) END)) AS i FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

_CONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS x
  FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(13, len(x)) AS m, array_to_string(x[i:i + least(13, len(x)) - 1], ' ') AS w
  FROM (SELECT item_id, x, unnest(range(1, len(x) - least(13, len(x)) + 2)) AS i FROM iw WHERE len(x) > 0)
), sizes AS (SELECT DISTINCT m FROM win),
run AS (
  SELECT doc_id, m, i, array_to_string(x[i:i + m - 1], ' ') AS w
  FROM (SELECT doc_id, x, m, unnest(range(1, len(x) - m + 2)) AS i FROM dw, sizes WHERE len(x) >= m)
), hit AS (SELECT r.doc_id, r.i, r.m, win.item_id FROM run r JOIN win ON r.m = win.m AND r.w = win.w),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
held AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(x) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""

_ASSIGN = (
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _found(kind: str, rank: int, pattern: str, least: int) -> str:
    """Matches with their places: texts between matches and matches, added up."""
    return rf"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, v[i] AS value, a.start, a.start + length(f[i]) AS stop FROM (
    SELECT doc_id, f, v, i, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS start
    FROM (
      SELECT doc_id, f, v, gap, unnest(range(1, len(f) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}', 0) AS f, regexp_extract_all(text, '{pattern}', 1) AS v, string_split_regex(text, '{pattern}') AS gap
        FROM d WHERE regexp_matches(text, '{pattern}')))) a
  WHERE length(v[i]) >= {least}"""


_SECRETS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
base AS MATERIALIZED ({_found('assign', 0, _ASSIGN, 8)}
  UNION ALL {_found('access', 1, '(AKIA[A-Z0-9]+)', 16)}
  UNION ALL {_found('hex', 2, '([0-9a-f]+)', 32)}),
vals AS (
  SELECT value, CASE WHEN count(DISTINCT coalesce(source, chr(0))) >= 3 THEN 'copied'
    WHEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= 6 THEN 'live'
    ELSE 'plain' END AS state
  FROM base JOIN d USING (doc_id) GROUP BY value
), runs AS MATERIALIZED ({_found('reuse', 3, '([A-Za-z0-9+/_.=-]{16,})', 16)}),
again AS (
  SELECT r.*, state FROM runs r JOIN vals USING (value)
  WHERE state = 'live' AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND r.start < b.stop)
), every_span AS (SELECT b.*, state FROM base b JOIN vals USING (value) UNION ALL SELECT * FROM again),
per_base AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS listed FROM base GROUP BY doc_id
), per_span AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans,
    count(*) FILTER (state = 'live') AS n_live, count(*) FILTER (state = 'copied') AS n_copied FROM every_span GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans,
  CAST(coalesce(n_live, 0) AS BIGINT) AS n_live, CAST(coalesce(n_copied, 0) AS BIGINT) AS n_copied
FROM d LEFT JOIN per_base USING (doc_id) LEFT JOIN per_span USING (doc_id)
"""

_URL_LISTS = r"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host,
    coalesce(nullif(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/') AS path
  FROM pages
), entry AS (
  SELECT 'hosts' AS list, 'domain' AS kind, 'block' AS verdict, host AS pattern, 8 AS upto FROM p WHERE host <> ''
  UNION SELECT 'domains', 'domain', 'block', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 12 FROM p WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT 'folders', 'prefix', 'allow', lower(host || '/' || split_part(path, '/', 2) || '/'), 8 FROM p WHERE host <> '' AND path LIKE '/%/%'
), dated AS (
  SELECT list, kind, verdict, pattern,
    DATE '2024-01-01' + CAST(('0x' || substr(md5(pattern), 2, 2)) AS INTEGER) AS a, DATE '2024-01-01' + CAST(('0x' || substr(md5(pattern), 4, 2)) AS INTEGER) AS r,
    DATE '2024-01-01' + CAST(('0x' || substr(md5(pattern), 6, 2)) AS INTEGER) AS b
  FROM entry WHERE CAST(('0x' || substr(md5(pattern), 1, 1)) AS INTEGER) < upto
), active AS (
  -- added twice and removed once: open from each addition up to a removal that is not before it
  SELECT page_id, list, kind, verdict, pattern
  FROM p JOIN dated ON CASE kind WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern) ELSE starts_with(lower(host || path), pattern) END
  WHERE host <> '' AND ((fetched >= a AND NOT (r >= a AND fetched >= r)) OR (fetched >= b AND NOT (r >= b AND fetched >= r)))
), best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
    row_number() OVER (PARTITION BY page_id ORDER BY kind = 'prefix' DESC, length(pattern) DESC, verdict = 'allow' DESC, list) AS nth
  FROM active
)
SELECT p.page_id, p.url, p.fetched, coalesce(b.verdict, 'allow') AS verdict, b.list, b.kind, b.pattern, CAST(coalesce(b.n, 0) AS BIGINT) AS n_active
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND b.nth = 1
"""

_RATIO = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, unnest(x) AS word, unnest(range(1, len(x) + 1)) AS i, len(x) AS n
  FROM (SELECT r, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS x FROM d)
), ids AS MATERIALIZED (
  SELECT r, doc_id, i, n, word, CAST(('0x' || substr(md5(word), 1, 7)) AS BIGINT) AS id FROM w
), win AS MATERIALIZED (
  SELECT r, i, lead(word, 4) OVER o IS NOT NULL AS whole, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five
  FROM ids WINDOW o AS (PARTITION BY r ORDER BY i)
), again AS (
  SELECT DISTINCT r, unnest(range(i, i + 5)) AS at
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, five) AS times FROM win WHERE whole) WHERE times > 1
), line AS (
  SELECT r, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth
  FROM (SELECT r, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS x FROM d))
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), base AS MATERIALIZED (
  SELECT d.r, d.doc_id, coalesce(a.n_words, 0) AS n_words, coalesce(a.word_chars, 0) AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(g.n, 0) AS n_repeat_words
  FROM d LEFT JOIN (SELECT r, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM ids GROUP BY r) a USING (r)
  LEFT JOIN (SELECT r, count(*) AS n FROM line WHERE nth > 1 GROUP BY r) l USING (r)
  LEFT JOIN (SELECT r, count(*) AS n FROM again GROUP BY r) g USING (r)
), good AS (
  SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM labels WHERE doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)
  GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0 AND count(*) FILTER (quality IS NULL OR toxic IS NULL) = 0 ORDER BY h, doc_id LIMIT 20000
), fold AS (SELECT doc_id, substr(h, 32, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') AS fit FROM good),
gram AS MATERIALIZED (
  SELECT r, doc_id, id % 262144 AS bucket FROM ids
  UNION ALL SELECT r, doc_id, (31 * id + after + 1) % 262144 FROM (SELECT r, doc_id, id, lead(id) OVER (PARTITION BY r ORDER BY i) AS after FROM ids) WHERE after IS NOT NULL
), counted AS (
  SELECT bucket, CAST(count(*) AS DOUBLE) AS raw, CAST(count(*) FILTER (fit) AS DOUBLE) AS target FROM gram LEFT JOIN fold USING (doc_id) GROUP BY bucket
), total AS (SELECT sum(raw) AS raws, sum(target) AS targets FROM counted),
weight AS (
  SELECT bucket, CASE WHEN targets = 0 THEN 0 ELSE CAST(round(65536 * ln((target + 1) / (raw * targets / raws + 1))) AS BIGINT) END AS worth FROM counted, total
), score AS (
  SELECT r, count(*) AS n_grams, CAST(floor(CAST(sum(worth) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM gram JOIN weight USING (bucket) GROUP BY r
), judged AS MATERIALIZED (
  SELECT b.*, b.n_words < 10 OR 100 * b.n_repeat_words > 20 * b.n_words AS base_failed, coalesce(s.n_grams, 0) AS n_grams, coalesce(s.score, 0) AS score
  FROM base b LEFT JOIN score s USING (r)
), held AS (SELECT score, row_number() OVER (ORDER BY score) AS k, count(*) OVER () AS n FROM judged JOIN fold USING (doc_id) WHERE NOT fit AND NOT base_failed),
mark AS (SELECT max(score) AS threshold FROM held WHERE k = CAST(floor(CAST(0.002 AS DOUBLE) * n) AS BIGINT) + 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_grams, score, threshold,
  NOT base_failed AND coalesce(score >= threshold, true) AS kept
FROM judged, mark
"""

_VARIANTS = r"""
WITH RECURSIVE run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS lead, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), key AS MATERIALIZED (
  SELECT run, hex(encode(lead || run)) AS hex, count(*) AS n FROM run GROUP BY ALL
), bit(k, b, v) AS (
  SELECT 0, b, CAST(b AS BIGINT) FROM range(256) t(b)
  UNION ALL SELECT k + 1, b, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bit WHERE k < 8
), tab AS MATERIALIZED (SELECT b, v FROM bit WHERE k = 8),
longest AS MATERIALIZED (SELECT max(len(hex)) // 2 AS n FROM key),
-- crc32 is linear: what a byte adds depends on the byte and on how many follow it
adds(d, b, v) AS (
  SELECT 0, b, v FROM tab
  UNION ALL SELECT a.d + 1, a.b, xor(a.v // 256, t.v) FROM adds a JOIN tab t ON t.b = a.v % 256 WHERE a.d + 1 < (SELECT n FROM longest)
), begins(n, v) AS (
  SELECT 0, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT s.n + 1, xor(s.v // 256, t.v) FROM begins s JOIN tab t ON t.b = s.v % 256 WHERE s.n < (SELECT n FROM longest)
), part AS (
  SELECT hex, len(hex) // 2 AS size, i, CAST(('0x' || substr(hex, 2 * i + 1, 2)) AS BIGINT) AS b FROM (SELECT hex, unnest(range(len(hex) // 2)) AS i FROM key)
), crc AS (
  SELECT p.hex, xor(xor(bit_xor(a.v), any_value(z.v)), 4294967295) AS h
  FROM part p JOIN adds a ON a.d = p.size - 1 - p.i AND a.b = p.b JOIN begins z ON z.n = p.size GROUP BY p.hex
), seen AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n
  FROM key JOIN crc USING (hex)
), word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), gap AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gap a JOIN gap b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gap a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gap a JOIN word b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS most FROM near GROUP BY word
), form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 2 * w.n THEN (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.near_n = b.most) END AS form,
    CASE WHEN b.most >= 2 * w.n THEN b.most END AS form_n
  FROM word w LEFT JOIN best b USING (word)
), chain(word, here) AS (
  SELECT word, word FROM form
  UNION ALL SELECT c.word, f.form FROM chain c JOIN form f ON f.word = c.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.here AS root FROM form f JOIN chain c ON c.word = f.word JOIN form e ON e.word = c.here AND e.form IS NULL
"""

ORACLES = {
    "op1_vector_file": _VECTOR,
    "op4_secrets": _SECRETS,
    "op5_jaccard": _JACCARD,
    "op6_decontamination": _CONTAMINATION,
    "op7_url_lists": _URL_LISTS,
    "op11_variants": _VARIANTS,
    "op13_ratio": _RATIO,
}
