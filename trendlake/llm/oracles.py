"""DuckDB SQL for the queries, or the part of a query, that SQL can express.

Where only some columns have a SQL form (the learned verdict of ``op1``, the drawn documents of
``op2``, the added spans of ``op10``), a companion query without the others has the oracle.
"""

from __future__ import annotations

SPACES = r"[^\x20\x09-\x0D]"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

BASE_COUNTS = f"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{SPACES}+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS win
            FROM w, unnest(range(1, len(words) - 1)) t(i)),
often AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n
            FROM windows JOIN often USING (doc_id, win), (VALUES (0), (1), (2)) v(j) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words,
       CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols,
       len(lines) - len(list_distinct(lines)) AS n_dup_lines,
       coalesce(n, 0) AS n_repeat_words,
       len(words) < 50 OR 100 * coalesce(n, 0) > 50 * len(words) AS base_failed
FROM (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACES}')) AS lines FROM w)
LEFT JOIN covered USING (doc_id)"""

# Each source's share rises with its weight until it meets three times its size: the common
# level is the one at which the shares, so capped, add up to all words.
MIX_TARGETS = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACES}+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3.0 * source_size / weight AS level FROM s),
k AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
      row_number() OVER (ORDER BY level, source) AS nth FROM r),
l AS (SELECT arg_min(rest, nth) FILTER (WHERE rest <= level) AS common FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size,
       CAST(round(least(3.0 * source_size, common * weight), 3) AS DOUBLE) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i:i + 199]) AS h FROM d, unnest(range(1, n - 198)) t(i)),
hits AS (SELECT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
marks AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS z
          FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marks) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS lo, a - 1 AS hi FROM spans
         UNION ALL SELECT s.doc_id, max(z) + 1, max(n) FROM spans s JOIN d USING (doc_id) GROUP BY s.doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN hi < lo THEN '' ELSE hex(b[lo:hi]) END, '' ORDER BY lo) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_spans, sum(z - a + 1) AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
FROM r"""

DECONTAMINATE = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, words, least(13, len(words)) AS k
           FROM (SELECT item_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM benchmark) WHERE len(words) > 0),
iw AS (SELECT DISTINCT k, item, array_to_string(words[a:a + k - 1], ' ') AS win FROM i, unnest(range(1, len(words) - k + 2)) t(a)),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents),
dw AS (SELECT doc_id, a, k, array_to_string(words[a:a + k - 1], ' ') AS win
       FROM d, (SELECT DISTINCT k FROM iw) ks, unnest(range(1, len(words) - k + 2)) t(a)),
hits AS (SELECT doc_id, a, k, item FROM dw JOIN iw USING (k, win)),
places AS (SELECT doc_id, count(DISTINCT a + j) AS n_hit FROM hits, unnest(range(0, k)) t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """The matches of a pattern with their code points, from the pieces between them."""
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(m) AS stop
FROM (SELECT doc_id, found[i] AS m, groups[i] AS g, CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '({pattern})', {2 if kind == 'assign' else 1}) AS groups, string_split_regex(t, '{pattern}') AS pieces FROM d),
           unnest(range(1, len(found) + 1)) u(i))
WHERE {keep}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({_spans('assign', 0, ASSIGN, 'length(g) >= 8')}
UNION ALL {_spans('access', 1, 'AKIA[A-Z0-9]+', 'length(m) >= 16')}
UNION ALL {_spans('hex', 2, '[0-9a-f]+', 'length(m) >= 32')}),
sums AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS ids FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(ids, '')) AS base_sha256
FROM d LEFT JOIN sums USING (doc_id)"""

# CRC-32 byte by byte: the table of the reflected polynomial (a fixed value), then one step for each byte.
IMPORTANCE = f"""
WITH tbl AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) r(n)),
w AS (SELECT 0 AS side, doc_id AS id, regexp_extract_all({LOWER}, '{ALNUM}') AS words FROM documents
      UNION ALL SELECT 1, item_id, regexp_extract_all({LOWER}, '{ALNUM}') FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS x FROM w),
c AS (SELECT side, id, x, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT x, xor(list_reduce(list_transform(range(1, strlen(x) + 1), lambda i: CAST('0x' || substr(hex(x), CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT)),
               lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT x FROM c), tbl),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t FROM c JOIN b USING (x) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * ((SELECT CAST(sum(s) AS DOUBLE) FROM sums) + 10000) / ((CAST(s AS DOUBLE) + 1) * ((SELECT CAST(sum(t) AS DOUBLE) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
m AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM c JOIN b USING (x) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
             coalesce(CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT), 0) AS weight,
             CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise
           FROM w LEFT JOIN m USING (id) WHERE side = 0),
ranked AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY weight + noise DESC, doc_id) AS nth,
             (SELECT count(*) FROM scored WHERE n_words >= 20) AS open FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= 25 * open // 100 THEN nth END AS rank FROM ranked"""

ORACLE_SQL = {
    "quality_base_counts": BASE_COUNTS,
    "mixing_targets": MIX_TARGETS,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op6_warc": WARC,
    "op9_decontaminate": DECONTAMINATE,
    "secret_base_spans": SECRETS,
    "op13_importance": IMPORTANCE,
}
