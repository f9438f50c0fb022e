"""Oracle SQL (DuckDB) for the queries whose whole result SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') AS phrase FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT row_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase FROM (SELECT row_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
met AS (SELECT row_id, p.n, s, item_id FROM places p JOIN win USING (phrase)),
hit AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY row_id),
ids AS (SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_id, item_id::VARCHAR AS item FROM met) GROUP BY row_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (row_id) LEFT JOIN ids USING (row_id)
"""

OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM p
"""

OP10 = rf"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM dw WHERE len(w) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
lk AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN sz s1 ON s1.doc_id = a JOIN sz s2 ON s2.doc_id = b WHERE 100 * k >= 90 * (s1.n + s2.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM dw UNION SELECT r.a, l.b FROM reach r JOIN lk l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id FROM dw LEFT JOIN sz USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""

OP12 = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT row_id, doc_id, len(w)::BIGINT AS n FROM dw WHERE len(w) > 0),
corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
asked AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS q, item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
posted AS (SELECT row_id, term, count(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS wt FROM posted, corpus GROUP BY term, nn),
parts AS (SELECT row_id, term, wt * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))) AS part FROM posted JOIN weights USING (term) JOIN sizes USING (row_id), corpus),
scored AS (SELECT q, item_id, row_id, sum(times * part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN sizes USING (row_id) WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10
"""

OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r0 AS (SELECT c.conv_id, 0 AS part, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, length(text)::BIGINT AS size, sha256(length(role)::VARCHAR || ':' || role || text) AS g FROM r0),
p AS (SELECT conv_id, d, size, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT k, any_value(d)::BIGINT AS depth, any_value(size) AS size, count(*) AS n_convs, min(conv_id) AS conv_id FROM p GROUP BY k),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY k),
up AS (SELECT k, CASE WHEN k <> '' THEN left(k, length(k) - 64) END AS pk FROM nodes),
kids AS (SELECT pk AS k, count(*) AS n FROM up WHERE pk IS NOT NULL GROUP BY pk),
below AS (SELECT left(n.k, (64 * a.d)::BIGINT) AS k, sum((n.n_convs - 1) * n.size)::BIGINT AS saved, count(*) FILTER (q.n IS NULL) AS leaves FROM nodes n LEFT JOIN kids q ON q.k = n.k, LATERAL (SELECT unnest(range(0, n.depth + 1)) AS d) a GROUP BY 1)
SELECT m.conv_id, m.depth, pa.conv_id AS parent_conv_id, m.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes m JOIN up USING (k) LEFT JOIN nodes pa ON pa.k = up.pk LEFT JOIN kids ON kids.k = m.k LEFT JOIN ends ON ends.k = m.k JOIN below ON below.k = m.k
"""
