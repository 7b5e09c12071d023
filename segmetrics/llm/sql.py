"""DuckDB statements of the queries that SQL can express. They restate the
results from the texts, without hashes, salts, slices or doubling."""

# op1: of the lines with a word, every window of 1 to 5 lines that holds 5
# words; one that also starts earlier covers lines to delete. Five lines are
# enough: of a longer run each line lies in such a window of the run.
_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d),
ex AS (SELECT doc_id, unnest(generate_series(1, len(ls))) AS i, unnest(ls) AS ln FROM raw),
w AS (SELECT doc_id, i, ln, len(regexp_extract_all(ln, '[^\x20\x09-\x0D]+')) AS n FROM ex),
s AS (SELECT doc_id, i, ln, n, row_number() OVER (ORDER BY doc_id, i) AS pos,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM w WHERE n > 0),
a AS (SELECT *, list(ln) OVER f AS lns, list(n) OVER f AS ns FROM s
      WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
m AS (SELECT * FROM (SELECT doc_id, pos, lns, ns, unnest(generate_series(1, len(ns))) AS depth FROM a) WHERE list_sum(ns[1:depth]) >= 5),
r AS (SELECT pos, depth, min(pos) OVER (PARTITION BY lns[1:depth]) AS first FROM m),
g AS (SELECT DISTINCT unnest(generate_series(pos, pos + depth - 1)) AS pos FROM r WHERE pos > first),
gone AS (SELECT s.doc_id, s.i, s.pos - lag(s.pos) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS gap FROM s JOIN g USING (pos)),
per AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE gap IS NULL OR gap > 1) AS n_runs FROM gone GROUP BY 1),
kept AS (SELECT ex.doc_id, string_agg(ex.ln, chr(10) ORDER BY ex.i) AS t FROM ex ANTI JOIN gone ON ex.doc_id = gone.doc_id AND ex.i = gone.i GROUP BY 1),
nl AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(nl.n, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN nl USING (doc_id)
"""

# op4: dated entries by host, intervals by the next entry, and a plain range
# join over every pattern that covers a URL
_OP4 = r"""
WITH c AS (SELECT page_id, url, (DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER)) AS fetch_day,
    regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(coalesce(url, ''),
      '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)', 1), '^.*@', '')), ':[0-9]*$', ''), '\.$', '') AS host,
    string_split(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*/([^?#]*)', 1), '/') AS path
  FROM pages),
h AS (SELECT DISTINCT host FROM c WHERE host <> ''),
x AS (SELECT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS k FROM h),
e AS (
  SELECT 'gambling' AS list_name, host AS pattern, DATE '2024-01-01' AS day, true AS added FROM x WHERE regexp_matches(host, 'casino|bets|poker')
  UNION ALL SELECT 'spam', host, DATE '2024-01-01' + CAST(k % 97 AS INTEGER), true FROM x WHERE k % 3 = 0
  UNION ALL SELECT 'spam', host, DATE '2024-01-01' + CAST(k % 97 + 60 AS INTEGER), false FROM x WHERE k % 3 = 0
  UNION ALL SELECT 'spam', host, DATE '2024-01-01' + CAST(k % 97 + 150 AS INTEGER), true FROM x WHERE k % 3 = 0
  UNION ALL SELECT 'policy', host || '/de/', DATE '2024-01-01' + CAST(k % 200 AS INTEGER), true FROM x WHERE k % 5 = 0
  UNION ALL SELECT 'policy', host || '/de/', DATE '2024-01-01' + CAST(k % 200 + 45 AS INTEGER), false FROM x WHERE k % 5 = 0),
v AS (SELECT list_name, pattern, day AS valid_from, added, lead(day) OVER (PARTITION BY list_name, pattern ORDER BY day) AS valid_to FROM e),
lab AS (SELECT *, string_split(host, '.') AS ls FROM c),
ks AS (
  SELECT page_id, url, fetch_day, unnest(CASE WHEN regexp_matches(host, '^[0-9.]+$|^\[') THEN [host]
         ELSE [array_to_string(ls[i:], '.') FOR i IN generate_series(1, len(ls) - 1)] END) AS key FROM lab WHERE host <> ''
  UNION SELECT page_id, url, fetch_day, unnest([host || '/' || array_to_string(path[1:i], '/') || '/' FOR i IN generate_series(1, len(path) - 1)]) FROM lab WHERE host <> ''),
hit AS (SELECT ks.page_id, list_name FROM ks JOIN v ON key = pattern AND added AND valid_from <= fetch_day AND (valid_to IS NULL OR fetch_day < valid_to)),
m AS (SELECT page_id, string_agg(DISTINCT list_name, ',' ORDER BY list_name) AS lists, count(*) AS n FROM hit GROUP BY 1)
SELECT c.page_id, c.url, c.fetch_day, c.host, coalesce(m.lists, '') AS lists, coalesce(m.n, 0) AS n_matches, m.lists IS NOT NULL AS blocked
FROM c LEFT JOIN m USING (page_id)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        [l FOR l IN string_split(text, chr(10)) IF len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) > 0] AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY 1),
ex AS (SELECT doc_id, source, text, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT doc_id, source, text, unnest(ls) AS l FROM w)),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1),
common AS (SELECT ex.source, line FROM ex JOIN hosts ON ex.source IS NOT DISTINCT FROM hosts.source
           GROUP BY ex.source, line, docs HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > docs * 0.002),
lost AS (SELECT doc_id, count(*) AS n, sum(ex.n)::BIGINT AS words FROM ex
         JOIN common ON ex.line = common.line AND ex.source IS NOT DISTINCT FROM common.source GROUP BY 1),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words,
        coalesce(lost.n, 0) AS removed_lines, coalesce(lost.words, 0) AS removed_words
      FROM w LEFT JOIN rw USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, removed_lines, removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM f
"""

_OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source),
w AS (SELECT source, source_size, (k - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
-- share by weight, close what reaches its cap, share the rest again
step(n, closed, rest, shares) AS (
  SELECT 0, []::VARCHAR[], (SELECT sum(source_size)::BIGINT FROM w), (SELECT sum(weight)::BIGINT FROM w)
  UNION ALL
  SELECT n + 1, c.closed, (SELECT sum(source_size)::BIGINT FROM w) - c.caps, (SELECT sum(weight)::BIGINT FROM w) - c.weights
  FROM step, LATERAL (SELECT list('s' || coalesce(source, '') || '/' || (source IS NULL)) AS closed,
      coalesce(sum(cap), 0)::BIGINT AS caps, coalesce(sum(weight), 0)::BIGINT AS weights
    FROM w WHERE rest * weight > cap * shares OR list_contains(step.closed, 's' || coalesce(source, '') || '/' || (source IS NULL))) c
  WHERE len(c.closed) > len(step.closed)),
fin AS (SELECT * FROM step ORDER BY n DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN list_contains(closed, 's' || coalesce(source, '') || '/' || (source IS NULL))
        THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / nullif(shares, 0)::DOUBLE END AS target,
        ('0x' || substr(md5('9:' || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u FROM w, fin),
n AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.target / nullif(t.source_size, 0) AS rate, u,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024, d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(floor(k::DOUBLE * rate + u) - floor((k - 1)::DOUBLE * rate + u), 0)::BIGINT AS copies FROM n)
SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size AS taken, copies, source FROM c
"""

# op11: checksums byte by byte over a table that its rule gives; a plain
# sort of all scores
_OP11 = r"""
WITH t AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab
           FROM range(256) AS r(b)),
w AS (SELECT 1 AS d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
      UNION ALL SELECT 0, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT DISTINCT word FROM w),
x AS (SELECT word, xor(list_reduce([('0x' || substr(hex(word), 2 * i - 1, 2))::BIGINT FOR i IN range(1, strlen(word) + 1)],
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM v, t),
c AS (SELECT doc_id, bucket, d FROM w JOIN x USING (word)),
sums AS (SELECT bucket, sum(d)::DOUBLE AS s, sum(1 - d)::DOUBLE AS t FROM c GROUP BY 1),
total AS (SELECT sum(s) AS s, sum(t) AS t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((sums.t + 1) * (total.s + 10000) / ((sums.s + 1) * (total.t + 10000))))::BIGINT AS gain FROM sums, total),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM c JOIN gain USING (bucket) WHERE d = 1 GROUP BY 1),
o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
        (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank, n_features AS n_words
FROM o LEFT JOIN r ON o.doc_id = r.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1, "op4_url_filters": _OP4, "op6_quality_rules": _OP6,
                              "op9_mixing": _OP9, "op11_importance_resampling": _OP11}
