"""DuckDB statements of the queries that SQL can express, spelled out on their own.

op4, op7, op9, op10, op12 and op13 are whole; the others need tokenizer files, learned models,
hash functions DuckDB lacks, or checks it has no functions for, and are tested
against brute-force versions instead."""

OP4 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('0' || source, '1') AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), 'null'), md5(coalesce(text, '')),
            CAST(row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS VARCHAR))), 1, 12)) AS BIGINT)
          + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS u
  FROM documents),
s AS (
  SELECT src, CAST(sum(size) AS BIGINT) AS words,
         CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS DOUBLE) AS weight
  FROM d GROUP BY src),
o AS (
  SELECT *, 2.0::DOUBLE * words AS room,
         1.5::DOUBLE * sum(words) OVER () AS total,
         coalesce(sum(2.0::DOUBLE * words) OVER (ORDER BY 2.0::DOUBLE * words / weight, src
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS capped,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * words / weight, src
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM s),
l AS (
  SELECT (total - capped) / open AS level FROM o
  WHERE (total - capped) / open * weight <= room ORDER BY room / weight, src LIMIT 1),
t AS (
  SELECT o.src, o.words, coalesce(least(o.room, (SELECT level FROM l) * o.weight), o.room) AS target FROM o),
g AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(log2(size)) AS INTEGER) ELSE 0 END AS cls FROM d),
k AS (
  SELECT g.src, g.cls, CAST(sum(size) AS BIGINT) AS words_cls, max(t.target) AS target, max(t.words) AS words,
         floor(max(t.target) / max(t.words)) AS copies
  FROM g JOIN t USING (src) WHERE size > 0 GROUP BY g.src, g.cls),
k2 AS (
  SELECT *, target - copies * words AS remain,
         coalesce(sum(words_cls) OVER (PARTITION BY src ORDER BY cls DESC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
         sum(words_cls * (cls + 1)) OVER (PARTITION BY src ORDER BY cls DESC
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pull
  FROM k),
k3 AS (
  SELECT *, arg_max((remain - sure) / pull, cls) FILTER (WHERE (remain - sure) / pull * (cls + 1) <= 1)
            OVER (PARTITION BY src) AS c FROM k2),
k4 AS (
  SELECT src, cls, copies, remain, words_cls,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(c * (cls + 1), 1.0::DOUBLE))) AS p FROM k3),
r AS (
  SELECT g.*, k4.copies, k4.p,
         CASE WHEN p > 0 AND p < 1 THEN CAST(least(floor(q / (1 + q) * CAST(1099511627776 AS DOUBLE)),
              CAST(1099511627775 AS DOUBLE)) AS BIGINT) END AS rank
  FROM (SELECT g.*, (u / (1 - u)) * ((1 - k4.p) / nullif(k4.p, 0)) AS q FROM g LEFT JOIN k4 USING (src, cls)) g
  LEFT JOIN k4 USING (src, cls)),
want AS (
  SELECT src, max(remain) - sum(CASE WHEN p >= 1 THEN words_cls ELSE 0 END) AS want
  FROM k4 WHERE p > 0 GROUP BY src),
steps AS (
  SELECT src, rank, CAST(sum(size) AS BIGINT) AS n FROM r WHERE rank IS NOT NULL GROUP BY src, rank),
run AS (
  SELECT src, rank, n, sum(n) OVER (PARTITION BY src ORDER BY rank) AS upto FROM steps),
hit AS (
  SELECT run.src, min(rank) FILTER (WHERE upto >= want) AS first_hit, max(rank) AS last_rank
  FROM run JOIN want USING (src) GROUP BY run.src),
cut AS (
  SELECT hit.src, CASE WHEN upto - want <= want - (upto - n) THEN rank ELSE rank - 1 END AS last
  FROM hit JOIN run ON run.src = hit.src AND run.rank = coalesce(first_hit, last_rank) JOIN want ON want.src = hit.src)
SELECT r.doc_id, r.size, t.words AS source_size, t.target,
       CAST(r.size * (coalesce(r.copies, floor(t.target / t.words), 0)
            + CASE WHEN r.size = 0 OR r.p IS NULL OR r.p <= 0 THEN 0 WHEN r.p >= 1 THEN 1
                   WHEN r.rank <= coalesce(cut.last, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN t USING (src) LEFT JOIN cut USING (src)
"""

OP7 = r"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
texts AS (
  SELECT DISTINCT text, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
           lambda b: CAST(('0x' || b) AS BIGINT)) AS bytes FROM documents),
sums AS (
  SELECT text, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(4294967295, list_reduce(bytes, lambda c, b:
           xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295)) AS text_crc32 FROM texts, crc),
d AS (
  SELECT doc_id, size, text_crc32, list_transform(
           ['r0', 'r1', 'r2', 'r0.k0', 'r0.k1', 'r1.k0', 'r1.k1', '0', '1', '2', '3', '4', '5', '6', '7'],
           lambda name: -ln((CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || name), 1, 12)) AS BIGINT)
             + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE))) AS e
  FROM documents JOIN sums ON documents.text IS NOT DISTINCT FROM sums.text),
regions AS (SELECT *, CASE WHEN e[1] / 4 <= e[2] / 4 THEN 0 ELSE 1 END AS r FROM d),
racks AS (SELECT *, CASE WHEN e[4 + 2 * r] / 2 <= e[5 + 2 * r] / 2 THEN 0 ELSE 1 END AS k FROM regions),
shards AS (
  SELECT *, CAST(4 * r + 2 * k + CASE WHEN e[8 + 4 * r + 2 * k] <= e[9 + 4 * r + 2 * k] THEN 0 ELSE 1 END AS INTEGER) AS shard
  FROM racks)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(CASE WHEN e[3] < least(e[1] / 4, e[2] / 4) THEN 8 ELSE shard END AS INTEGER) AS grown_shard,
       'r' || r AS region, 'r' || r || '.k' || k AS rack
FROM shards
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
         WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS g
  FROM w),
sets AS (SELECT doc_id, g, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(list_sort(g), chr(10))) AS sid FROM s),
reps AS (SELECT sid, min(doc_id) AS rep, max(n) AS n, any_value(g) AS g FROM sets WHERE n > 0 GROUP BY sid),
x AS (SELECT rep, n, unnest(g) AS shingle FROM reps),
rare AS (SELECT shingle, count(*) AS df FROM x GROUP BY shingle),
ranked AS (
  SELECT x.rep, x.n, x.shingle, row_number() OVER (PARTITION BY x.rep ORDER BY df, x.shingle) AS place
  FROM x JOIN rare USING (shingle)),
prefix AS (SELECT * FROM ranked WHERE place <= n - CAST(ceil(85 * n / 100.0) AS BIGINT) + 1),
cand AS (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM prefix a JOIN prefix b ON a.shingle = b.shingle AND a.rep < b.rep
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
overlap AS (
  SELECT c.a, c.b, p.n AS na, q.n AS nb, len(list_intersect(p.g, q.g)) AS k
  FROM cand c JOIN reps p ON p.rep = c.a JOIN reps q ON q.rep = c.b),
link AS (SELECT a, b FROM overlap WHERE 100 * k >= 85 * (na + nb - k)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen),
comp AS (SELECT node, min(seen) AS least FROM reach GROUP BY node)
SELECT sets.doc_id, sets.n AS n_shingles,
       CASE WHEN sets.n = 0 THEN sets.doc_id ELSE coalesce(comp.least, reps.rep) END AS component_id
FROM sets LEFT JOIN reps ON reps.sid = sets.sid AND sets.n > 0 LEFT JOIN comp ON comp.node = reps.rep
"""

OP10 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
           CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
met AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM met),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(range(1, len(x), 2), lambda c, i:
           xor(c >> 8, t[1 + (xor(c, CAST(('0x' || substr(x, i, 2)) AS BIGINT)) & 255)]), 4294967295)) AS h
  FROM bytes, crc),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
near AS (
  SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON g.rest = w.word
  UNION SELECT w.word, g.word FROM gaps g JOIN words w ON g.rest = w.word),
ranked AS (
  SELECT near.word, near.near, x.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
         row_number() OVER (PARTITION BY near.word ORDER BY x.n DESC, near.near) AS place
  FROM near JOIN words x ON x.word = near.near),
forms AS (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near,
         CASE WHEN r.near_n >= 10 * w.n THEN r.near END AS form,
         CASE WHEN r.near_n >= 10 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS spot, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chain c JOIN forms f ON f.word = c.spot WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT word, arg_max(spot, steps) AS root FROM chain GROUP BY word) c USING (word)
"""

OP13 = r"""
WITH e AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS other_id,
         coalesce(CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT), 0) AS score
  FROM e a JOIN e c ON c.vec_id <> a.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
pos AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS place
  FROM p WHERE same),
neg AS (
  SELECT pos.anchor_id, positive_id, p.other_id AS negative_id, positive_score, p.score AS negative_score,
         row_number() OVER (PARTITION BY pos.anchor_id, pos.place ORDER BY p.score DESC, p.other_id) AS rank
  FROM pos JOIN p ON p.anchor_id = pos.anchor_id AND NOT p.same
   AND 80 * positive_score <= 100 * p.score AND p.score <= positive_score
  WHERE pos.place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM neg WHERE rank <= 5
"""

SQL = {"op4_mixing": OP4, "op7_sharding": OP7, "op9_jaccard": OP9, "op10_topk": OP10, "op12_spelling": OP12, "op13_hard_negatives": OP13}
