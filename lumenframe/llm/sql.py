"""DuckDB SQL for the queries of this subpackage, where SQL can express them."""

EXACT_DEDUP = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS c,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM (SELECT doc_id, h,
             first_value(doc_id) OVER (PARTITION BY h ORDER BY c DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size
      FROM n)
"""

URL_FILTER = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
judged AS (
  SELECT page_id, host, path,
         CASE WHEN host = '' THEN ''
              ELSE regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '/+$', '') END AS canonical,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
              WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts),
listed AS (
  SELECT DISTINCT canonical FROM judged WHERE page_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN canonical <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block'
            ELSE 'allow' END AS verdict
FROM judged
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) - 1 AS pos
  FROM conversations),
p AS (
  SELECT conv_id, pos + 1 AS length,
         string_agg(length(role) || ':' || role || ':' || length(text) || ':' || text, '|') OVER
           (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM t),
whole AS (SELECT conv_id, n_turns, prefix FROM p WHERE length = n_turns),
kept AS (
  SELECT min(w.conv_id) AS conv_id, w.n_turns
  FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.prefix = w.prefix AND p.n_turns > w.n_turns)
  GROUP BY w.prefix, w.n_turns)
SELECT k.conv_id, CAST(floor(t.pos / 1024) AS INTEGER) AS part, k.n_turns,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.pos) AS text
FROM kept k JOIN t ON t.conv_id = k.conv_id
GROUP BY k.conv_id, part, k.n_turns
"""

def _urn(key: str) -> str:
    h = f"md5({key})"
    parts = [f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return "'<urn:uuid:' || " + " || '-' || ".join(parts) + " || '>'"


_BLOCK_TAG = r"(?i)<(?:/?(?:p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title)|br)(?:[ \t\r\n/][^>]*)?>"
_UNSEEN = "script style noscript template textarea select iframe object svg math canvas audio video".split()
_UNSEEN_PART = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}(?:[\s/][^>]*)?>.*?(?:</{t}\s*>|\z)" for t in _UNSEEN)
_CRLF = "chr(13) || chr(10)"

WARC = rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
         {_urn("coalesce(page_id::VARCHAR, '') || ' ' || coalesce(url, '')")} AS refers_to FROM pages),
a AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(payload,
      '{_UNSEEN_PART}', ' ', 'g'),
      '{_BLOCK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM r),
b AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
      '&quot;', chr(34)), '&#39;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&'), chr(160), ' ') AS u FROM a),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(u, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'),
      '^[ \n]+|[ \n]+$', '', 'g') AS text,
    'sha256:' || sha256(payload) AS source_payload_digest,
    'sha256:' || sha256('HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF}
      || 'Content-Length: ' || strlen(payload) || {_CRLF} || {_CRLF} || payload) AS source_block_digest,
    {_urn("'conversion ' || refers_to")} AS conversion_id,
    {_urn("'metadata ' || refers_to")} AS metadata_id FROM b),
d AS (
  SELECT *, 'source-status: 200' || {_CRLF} || 'source-http-Content-Type: text/html; charset=utf-8' || {_CRLF}
    || 'source-http-Content-Length: ' || strlen(payload) || {_CRLF}
    || 'source-payload-length: ' || strlen(payload) || {_CRLF}
    || 'source-payload-digest: ' || source_payload_digest || {_CRLF}
    || 'source-block-digest: ' || source_block_digest || {_CRLF}
    || 'conversion-record-id: ' || conversion_id || {_CRLF}
    || 'conversion-digest: sha256:' || sha256(text) || {_CRLF} AS fields FROM c),
e AS (
  SELECT page_id, 'conversion' AS warc_type, conversion_id AS record_id, refers_to, target_uri,
         'text/plain; charset=utf-8' AS content_type, source_payload_digest, source_block_digest, text AS block FROM d
  UNION ALL
  SELECT page_id, 'metadata', metadata_id, refers_to, target_uri, 'application/warc-fields',
         source_payload_digest, source_block_digest, fields FROM d)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '2024-01-01T00:00:00Z' AS warc_date, content_type,
       'sha256:' || sha256(block) AS block_digest, source_payload_digest, source_block_digest,
       CAST(strlen(block) AS BIGINT) AS content_length, block FROM e
"""


NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                               ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

#: Every diagonal of a document and an item with enough equal tokens, and its best segment: 1 for an equal token, -2 for another.
DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS p FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents)),
b AS (SELECT item_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS p FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM benchmark)),
c AS (SELECT doc_id, item_id, any_value(b.n) AS n, d.p - b.p AS g FROM d JOIN b ON d.w = b.w GROUP BY doc_id, item_id, d.p - b.p HAVING count(*) >= least(13, 0.8 * any_value(b.n))),
a AS (
  SELECT c.doc_id, c.item_id, c.n, c.g, d.p, CASE WHEN d.w = b.w THEN 1 ELSE -2 END AS gain
  FROM c JOIN b ON b.item_id = c.item_id JOIN d ON d.doc_id = c.doc_id AND d.p = b.p + c.g),
q AS (SELECT *, sum(gain) OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS s, row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY p) AS k FROM a),
z AS (SELECT doc_id, item_id, n, g, min(p) AS first FROM q GROUP BY ALL),
f AS (SELECT doc_id, item_id, n, g, k, s, p FROM q UNION ALL SELECT doc_id, item_id, n, g, 0, 0, first - 1 FROM z),
o AS (SELECT *, min(s) OVER (PARTITION BY doc_id, item_id, g ORDER BY k) AS low FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, g ORDER BY s - low DESC, k) AS r FROM o),
u AS (
  SELECT t.doc_id, t.item_id, t.n, t.g, t.k AS last, t.s - t.low AS best, max(o.k) AS begin
  FROM t JOIN o ON o.doc_id = t.doc_id AND o.item_id = t.item_id AND o.g = t.g AND o.k <= t.k AND o.s = t.low WHERE t.r = 1 GROUP BY ALL),
v AS (
  SELECT u.doc_id, u.item_id, u.n, last - begin AS n_span, (best + 2 * (last - begin)) / 3 AS n_equal, z.first + begin AS doc_start
  FROM u JOIN z USING (doc_id, item_id, g))
SELECT doc_id, item_id, CAST(n_equal AS BIGINT) AS n_equal, CAST(n_span AS BIGINT) AS n_span, CAST(doc_start AS BIGINT) AS doc_start
FROM v WHERE n_equal >= least(13, 0.8 * n)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, n_span, doc_start) = 1
"""


ORACLES = {
    "op4_minhash_near_dedup": NEAR_DEDUP,
    "op7_spaced_seed_decontamination": DECONTAMINATION,
    "op1_warc_derivatives": WARC,
    "op5_url_filter": URL_FILTER,
    "op6_chat_snapshot_collapse": CHAT,
    "op3_exact_dedup": EXACT_DEDUP,
}
