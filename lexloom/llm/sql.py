"""DuckDB counterparts of the queries that SQL can express."""

OP1 = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rows_ AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
named AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS n FROM (SELECT DISTINCT host FROM rows_)),
cut AS (SELECT host, n, string_split(n, '.') AS l, len(string_split(n, '.')) AS c FROM named),
parted AS (SELECT host, CASE WHEN c = 1 OR regexp_matches(n, '^[0-9.]+$') THEN n WHEN w THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix,
  CASE WHEN c = 1 OR regexp_matches(n, '^[0-9.]+$') THEN n WHEN w THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT *, array_to_string(l[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'gov.uk', 'com.au', 'net.au', 'org.au', 'co.jp', 'or.jp',
    'co.nz', 'com.br', 'co.za') AS w FROM cut)),
outcomes AS (SELECT host, quality AS good FROM rows_ JOIN labels
  ON labels.doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]+/([0-9]{1,18})', 1), '') AS BIGINT) WHERE quality IS NOT NULL),
h0 AS (SELECT host, domain, suffix, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM parted
  LEFT JOIN (SELECT host, count(*) AS n, sum(good) AS k FROM outcomes GROUP BY host) USING (host)),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h0 GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM d0) AS p FROM d0 GROUP BY suffix),
s1 AS (SELECT suffix, (k + m * p) / (n + m) AS p FROM s0, (SELECT 1 / greatest(0.001::double, least(0.999::double, coalesce(
  sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0), 0.001::double))) - 1 AS m FROM s0)),
d1 AS (SELECT d0.*, p FROM d0 JOIN s1 USING (suffix)),
d2 AS (SELECT domain, suffix, (k + m * p) / (n + m) AS p FROM d1, (SELECT 1 / greatest(0.001::double, least(0.999::double, coalesce(
  sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0), 0.001::double))) - 1 AS m FROM d1)),
h1 AS (SELECT h0.*, p FROM h0 JOIN d2 USING (domain, suffix)),
h2 AS (SELECT host, domain, k + m * p AS a, n - k + m * (1 - p) AS b FROM h1, (SELECT 1 / greatest(0.001::double, least(0.999::double, coalesce(
  sum((k - n * p) * (k - n * p) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * (p * (1 - p))), 0), 0.001::double))) - 1 AS m FROM h1)),
known AS (SELECT host, domain, round(a / (a + b), 6) AS mean,
  round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS bound FROM h2),
ruled AS (SELECT page_id, max({'size': length(h || p), 'rule': h || p, 'verdict': v}) AS r FROM rows_ JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN bound >= 0.75 THEN 'allow' ELSE 'block' END) AS verdict,
  domain, mean, bound FROM rows_ JOIN known USING (host) LEFT JOIN ruled USING (page_id)
"""

OP4 = r"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  md5(doc_id::VARCHAR || ':mix') AS place FROM documents),
sized AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST)::INT - 1 AS rank FROM sized),
capped AS (SELECT *, 3.0::double * source_size AS cap, ([5.0::double, 2.0::double, 1.0::double])[rank % 3 + 1] AS w FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0)) AS left_
  FROM capped WINDOW earlier AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aimed AS (SELECT *, least(cap, coalesce((SELECT max(left_) FROM levels WHERE left_ * w <= cap) * w, cap)) AS target FROM levels),
queued AS (SELECT doc_id, size, place, rank, source_size, target,
  sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM base JOIN aimed ON base.source IS NOT DISTINCT FROM aimed.source),
copies AS (SELECT *, (pass * source_size + upto) / target AS finish FROM queued, (VALUES (0), (1), (2)) t(pass) WHERE size > 0 AND target > 0),
kept AS (SELECT doc_id, size FROM (SELECT *, sum(size) OVER (ORDER BY finish, rank, pass, place, doc_id ROWS UNBOUNDED PRECEDING) AS so_far
  FROM copies) WHERE so_far <= (SELECT sum(source_size) FROM sized))
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queued
LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM kept GROUP BY doc_id) USING (doc_id)
"""

OP2 = r"""
WITH crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crcs),
t AS (SELECT doc_id, coalesce(text, '') AS t, (strlen(coalesce(text, '')) + 16)::BIGINT AS size FROM documents),
b AS (SELECT doc_id, size, ('0x' || md5(t)[1:15])::BIGINT AS h, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM t),
c AS (SELECT doc_id, size, h, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255)::INT + 1])),
  4294967295::UBIGINT)::BIGINT AS text_crc32 FROM b, crcs),
placed AS (SELECT doc_id, size, text_crc32, h, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS whole FROM c),
dealt AS (SELECT *, least(39, floor((2 * upto - size)::DOUBLE / whole::DOUBLE * 20))::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM dealt
"""

OP3 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS first_ FROM g GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE first_ < doc_id),
kept AS (SELECT doc_id, string_agg(w[p], ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)
  ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS k FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
ways AS (SELECT a AS f, b AS t FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, ways.t FROM reach r JOIN ways ON ways.f = r.t)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(t) AS component_id, r.doc_id = min(t) AS kept FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP11 = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM words GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY t),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l))))::BIGINT AS score
  FROM i JOIN w USING (t) JOIN tf USING (t) JOIN n USING (doc_id), total GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, p, array_to_string(w[p : p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, p, k FROM dw JOIN iw USING (k, s)),
places AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP13 = r"""
WITH crcs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crcs),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
runs AS (SELECT doc_id, true AS ours, array_to_string(w[p : p + k - 1], ' ') AS f
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
  UNION ALL SELECT NULL, false, array_to_string(w[p : p + k - 1], ' ')
    FROM (SELECT w, k, unnest(range(1, len(w) - k + 2)) AS p FROM b, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)),
named AS (SELECT f, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(hex(f)) + 1, 2),
    lambda i: ('0x' || hex(f)[i : i + 1])::UBIGINT)), lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255)::INT + 1])), 4294967295::UBIGINT) % 10000)::INT AS bucket
  FROM (SELECT DISTINCT f FROM runs), crcs),
counts AS (SELECT bucket, count(*) FILTER (ours) AS s, count(*) FILTER (NOT ours) AS t FROM runs JOIN named USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM runs JOIN named USING (f) JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS words, (len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id::VARCHAR)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM ranked) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""

ORACLES = {
    "op1_url_reputation": OP1, "op2_byte_shards": OP2, "op3_pivot_search": OP3, "op4_fair_mix": OP4, "op6_recompressed_repeats": OP6, "op7_bbit_near_duplicates": OP7,
    "op11_dual_tree_search": OP11, "op12_winnowed_decontamination": OP12, "op13_batch_resampling": OP13}
