"""Checking SQL (DuckDB) of the operators that SQL can express."""

LINE_DEDUP = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE text <> ''
), line AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS core,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w
  FROM raw
), own AS (
  SELECT doc_id, n, core, w, row_number() OVER d AS i, sum(w) OVER d AS upto
  FROM line WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY n)
), spans AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e
  FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 2
  UNION
  SELECT b.doc_id, max(a.i), b.i
  FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY 1, 3
), content AS (
  SELECT x.doc_id, s, e, string_agg(core, chr(10) ORDER BY o.i) AS t
  FROM spans x JOIN own o ON o.doc_id = x.doc_id AND o.i BETWEEN s AND e GROUP BY 1, 2, 3
), later AS (
  SELECT doc_id, s, e FROM (
    SELECT *, first_value(doc_id) OVER w AS fd, first_value(e) OVER w AS fe FROM content
    WINDOW w AS (PARTITION BY t ORDER BY doc_id, s))
  WHERE doc_id <> fd OR s > fe
), gone AS (
  SELECT DISTINCT r.doc_id, r.n
  FROM later x JOIN own a ON a.doc_id = x.doc_id AND a.i = x.s JOIN own b ON b.doc_id = x.doc_id AND b.i = x.e
  JOIN raw r ON r.doc_id = x.doc_id AND r.n BETWEEN a.n AND b.n
), result AS (
  SELECT r.doc_id, count(*) AS n_lines, count(g.n) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY r.n) FILTER (WHERE g.n IS NULL), '') AS t
  FROM raw r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.n = r.n GROUP BY 1
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, d.text)) AS text_sha256
FROM documents d LEFT JOIN result r ON r.doc_id = d.doc_id
"""

WARC = r"""
WITH page AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), front AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM page
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM front
"""

MIXING = r"""
WITH doc AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM doc GROUP BY source
), ordered AS (
  SELECT *, row_number() OVER r AS k, sum(source_size) OVER () AS total,
         coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS uncapped
  FROM src WINDOW r AS (ORDER BY source_size / w, source NULLS LAST)
), water AS (
  SELECT arg_min(height, k) AS water_level
  FROM (SELECT *, CAST(1.5 * total - 2.0 * capped AS DOUBLE) / uncapped AS height FROM ordered) WHERE height * w <= 2 * source_size
), target AS (
  SELECT source, source_size, least(2.0 * source_size, w * water_level)::DOUBLE AS target FROM src, water
), place AS (
  SELECT doc_id, size, d.source, source_size, target, floor(target)::BIGINT AS wanted,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(doc_id::VARCHAR), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM doc d JOIN target t ON d.source IS NOT DISTINCT FROM t.source
)
, fact AS (
  SELECT source, source_size, floor(target)::BIGINT AS wanted, (source_size + 1023) // 1024 AS per_epoch,
         floor(target)::BIGINT // source_size * ((source_size + 1023) // 1024) + (floor(target)::BIGINT % source_size + 1023) // 1024 AS need
  FROM target WHERE source_size > 0
), share AS (
  SELECT *, sum(need) OVER (ORDER BY source NULLS LAST)::BIGINT - need AS before, sum(need) OVER ()::BIGINT AS n FROM fact
), dealt AS (
  SELECT i AS slot, s.source, row_number() OVER (PARTITION BY s.source ORDER BY i) - 1 AS rank
  FROM (SELECT unnest(range((SELECT max(n) FROM share))) AS i)
  JOIN share s ON (i % 2147483648) * 1327217885 % 2147483648 >= floor(before * (2147483648.0::DOUBLE / n))
    AND (before + need = n OR (i % 2147483648) * 1327217885 % 2147483648 < floor((before + need) * (2147483648.0::DOUBLE / n)))
), tail AS (
  SELECT source, unnest(range(coalesce(got, 0), need)) AS rank, n
  FROM share LEFT JOIN (SELECT source AS src, count(*) AS got FROM dealt GROUP BY source) ON source IS NOT DISTINCT FROM src
), slots AS (
  SELECT source AS slot_source, slot, rank // per_epoch AS epoch, rank % per_epoch AS block,
         least(1024, source_size - rank % per_epoch * 1024, wanted - (rank // per_epoch * source_size + rank % per_epoch * 1024)) AS words
  FROM (SELECT slot, source, rank FROM dealt UNION ALL SELECT rank + n, source, rank FROM tail) t
  JOIN (SELECT source AS own, source_size, wanted, per_epoch, need FROM fact) ON source IS NOT DISTINCT FROM own
  WHERE rank < need
), piece AS (
  SELECT p.doc_id, p.source, min(slot) AS first_slot, count(*) AS n_pieces
  FROM (SELECT *, unnest(range(start::BIGINT // 1024, (start::BIGINT + size - 1) // 1024 + 1)) AS b FROM place WHERE size > 0) p
  JOIN slots ON p.source IS NOT DISTINCT FROM slot_source AND b = block
  WHERE least(start + size, b * 1024 + words) > greatest(start, b * 1024)
  GROUP BY p.doc_id, p.source
)
SELECT p.doc_id, size::BIGINT AS size, source_size, target, p.source,
       CASE WHEN size = 0 THEN 0
            ELSE (wanted // source_size * size + greatest(0, least(size, wanted % source_size - start)))::BIGINT END AS taken,
       first_slot::BIGINT AS first_slot, coalesce(n_pieces, 0)::BIGINT AS n_pieces
FROM place p LEFT JOIN piece q ON p.doc_id = q.doc_id AND p.source IS NOT DISTINCT FROM q.source
"""

TOP_PRODUCTS = r"""
WITH part AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vec AS (
  SELECT vec_id, list(x ORDER BY i) AS v FROM part GROUP BY vec_id
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vec q JOIN vec c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

FINGERPRINTS = r"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), near AS (
  SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS next FROM doc WINDOW o AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), paired AS (
  SELECT doc_id, n, text, substring(text, 1, n - n // 2) || substring(next, 1, n // 2) AS edited, lead(doc_id) OVER (ORDER BY doc_id) AS next_id FROM near
), word AS (
  SELECT doc_id, kind, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM (SELECT doc_id, 0 AS kind, text AS t FROM paired UNION ALL SELECT doc_id, 1, edited FROM paired)
), shingle AS (
  SELECT DISTINCT doc_id, kind, md5(array_to_string(w[i + 1:i + 5], ' ')) AS h
  FROM (SELECT *, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM word)
), smallest AS (
  SELECT doc_id, kind, list(h[1:16] ORDER BY h) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY h) AS r FROM shingle) WHERE r <= 128 GROUP BY 1, 2
), sketch AS (
  SELECT b.doc_id, n, edited, coalesce(a.s, []) AS a, coalesce(e.s, []) AS e, coalesce(x.s, []) AS x
  FROM paired b LEFT JOIN smallest a ON a.doc_id = b.doc_id AND a.kind = 0 LEFT JOIN smallest e ON e.doc_id = b.doc_id AND e.kind = 1
  LEFT JOIN smallest x ON x.doc_id = coalesce(b.next_id, (SELECT min(doc_id) FROM doc)) AND x.kind = 0
), merged AS (
  SELECT *, list_sort(list_distinct(a || e))[1:128] AS ae, list_sort(list_distinct(a || x))[1:128] AS ax FROM sketch
), measured AS (
  SELECT *, CASE WHEN len(ae) = 0 THEN 1.0 ELSE len(list_filter(ae, lambda h: list_contains(a, h) AND list_contains(e, h)))::DOUBLE / len(ae) END AS near_edited,
         CASE WHEN len(ax) = 0 THEN 1.0 ELSE len(list_filter(ax, lambda h: list_contains(a, h) AND list_contains(x, h)))::DOUBLE / len(ax) END AS near_next,
         CASE WHEN len(a) < 128 THEN len(a)::DOUBLE ELSE 127.0::DOUBLE / (('0x' || a[128][1:15])::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE) END AS n_shingles,
         CASE WHEN len(ae) < 128 THEN len(ae)::DOUBLE ELSE 127.0::DOUBLE / (('0x' || ae[128][1:15])::BIGINT::DOUBLE / 1152921504606846976.0::DOUBLE) END AS n_merged
  FROM merged
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(e, '') AS edited_fingerprint,
       near_edited, near_next, round(n_shingles, 6) AS n_shingles,
       round(CASE WHEN len(a) = 0 THEN 1.0 ELSE least(1.0, near_edited * n_merged / n_shingles) END, 9) AS kept_edited
FROM measured
"""

PREFIX_TRIE = r"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
         lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, p, r, t FROM conv c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20 AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, r, t FROM conv c JOIN own USING (conv_id) WHERE p > h
), seq AS (
  SELECT c.conv_id, coalesce(s, []) AS s
  FROM conv c LEFT JOIN (SELECT conv_id, list({'r': r, 't': t} ORDER BY part, p) AS s FROM rebuilt GROUP BY 1) USING (conv_id)
), prefix AS (
  SELECT conv_id, len(s) AS l, d, s[1:d] AS pre FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seq)
), node AS (
  SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE l = d), '') AS ends,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(pre[d].t, '[^\x20\x09-\x0D]+')) END AS w
  FROM prefix GROUP BY d, pre
), child AS (
  SELECT u.d, u.pre, p.conv_id AS parent_conv_id FROM node u LEFT JOIN node p ON p.d = u.d - 1 AND p.pre = u.pre[1:u.d - 1]
), fan AS (
  SELECT d - 1 AS d, pre[1:d - 1] AS pre, count(*) AS c FROM node WHERE d > 0 GROUP BY 1, 2
), full_node AS (
  SELECT n.*, parent_conv_id, coalesce(c, 0) AS c FROM node n JOIN child x ON x.d = n.d AND x.pre = n.pre LEFT JOIN fan f ON f.d = n.d AND f.pre = n.pre
), subtree AS (
  SELECT v.d, v.pre, sum((u.n - 1) * u.w) AS saved, count(*) FILTER (WHERE u.c = 0) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS e FROM full_node) u JOIN node v ON v.d = u.e AND v.pre = u.pre[1:u.e] GROUP BY 1, 2
)
SELECT conv_id, f.d::BIGINT AS depth, parent_conv_id, n AS n_convs, c AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_node f JOIN subtree s ON s.d = f.d AND s.pre = f.pre
"""

HARD_NEGATIVES = r"""
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         generate_subscripts(embedding, 1) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vec AS (
  SELECT vec_id, label, list(x ORDER BY i) AS v FROM part GROUP BY vec_id, label
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vec a JOIN vec c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM scored WHERE same) WHERE r <= 5
), negative AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 5
"""
