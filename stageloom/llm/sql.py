"""DuckDB SQL of the corpus queries that SQL can express."""

URL_SQL = r"""
WITH parsed AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parsed
), outcomes AS (
  SELECT s.host, count(*)::DOUBLE AS n, sum(l.quality)::DOUBLE AS good
  FROM (SELECT *, try_cast(nullif(regexp_extract(path, '/(\d{1,18})', 1), '') AS BIGINT) AS doc_id FROM split) s
  JOIN labels l USING (doc_id)
  WHERE l.quality IS NOT NULL
  GROUP BY s.host
), hosts AS (
  SELECT host,
    CASE WHEN regexp_matches(host, '[^.]+\.[^.]+$') THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) ELSE host END AS domain,
    regexp_extract(host, '([^.]+)$', 1) AS suffix,
    coalesce(n, 0) AS n, coalesce(good, 0) AS good
  FROM (SELECT DISTINCT host FROM split) h LEFT JOIN outcomes USING (host)
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL
), levels AS (
  SELECT 'host' AS level, n, good FROM hosts UNION ALL
  SELECT 'domain', n, good FROM domains UNION ALL
  SELECT 'suffix', n, good FROM suffixes
), moments AS (
  SELECT level, sum(n) AS total, count(*) FILTER (n > 0) - 1 AS k1, sum(good) / nullif(sum(n), 0) AS p,
    sum(good * good / n) FILTER (n > 0) AS squares, sum(n * n) AS nn
  FROM levels GROUP BY level
), rhos AS (
  SELECT level,
    (squares - total * p * p - p * (1 - p) * k1) / nullif(p * (1 - p) * (total - nn / total - k1), 0) AS rho
  FROM moments
), strengths AS (
  SELECT level, least(greatest(CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 1000 END, 1), 1000) AS s FROM rhos
), suffix_means AS (
  SELECT suffix, (s * overall + good) / (s + n) AS mean
  FROM suffixes, (SELECT s FROM strengths WHERE level = 'suffix'), (SELECT (sum(good) + 1) / (sum(n) + 2) AS overall FROM hosts)
), domain_means AS (
  SELECT domain, (s * m.mean + good) / (s + n) AS mean
  FROM domains d JOIN suffix_means m USING (suffix), (SELECT s FROM strengths WHERE level = 'domain')
), posterior AS (
  SELECT host, n, good, s * m.mean + good AS a, s * (1 - m.mean) + n - good AS b
  FROM hosts h JOIN domain_means m USING (domain), (SELECT s FROM strengths WHERE level = 'host')
), judged AS (
  SELECT host, n, good, a / (a + b) AS mean, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper
  FROM posterior
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN upper < 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  n::BIGINT AS n_labelled, good::BIGINT AS n_good, round(mean, 6) AS mean, round(upper, 6) AS upper
FROM ruled JOIN judged USING (host)
"""

# Words as lists; [\x20\x09-\x0D]+ separates them.
NEAR_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM docs WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

REPEAT_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM docs WHERE len(ws) >= 50)
), hits AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM windows) WHERE least < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM hits, (SELECT unnest(generate_series(0, 49)) AS k)
), kept AS (
  SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM docs) w
  ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i
  GROUP BY w.doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

NEGATIVE_SQL = r"""
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE own = label AND id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE own <> label AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""

# Bytes as pairs of hexadecimal digits.
BYTE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS s
  FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200)) AS i FROM docs WHERE len(h) >= 400)
), hits AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM windows) WHERE n > 1
), runs AS (
  SELECT r, min(i) AS start, max(i) + 200 AS stop
  FROM (SELECT r, i, sum(edge) OVER (PARTITION BY r ORDER BY i) AS run
    FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS edge FROM hits))
  GROUP BY r, run
), cut AS (
  SELECT r, h, doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) AS before
  FROM docs LEFT JOIN runs USING (r)
), kept AS (
  SELECT r, any_value(doc_id) AS doc_id, any_value(h) AS h, coalesce(sum(stop - start), 0) AS n, count(start) AS spans, coalesce(max(stop), 0) AS last,
    coalesce(string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY start), '') AS head
  FROM cut GROUP BY r
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, n::BIGINT AS n_removed, spans::BIGINT AS n_spans,
  sha256(unhex(head || substr(h, 2 * last + 1))) AS kept_sha256
FROM kept
"""
