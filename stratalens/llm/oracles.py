"""DuckDB SQL for the queries that SQL can express on small tables.

A sharding curve, fitted scores, fingerprints, posteriors, tokens and packing are
beyond it; tests compare those with brute force.
"""

from __future__ import annotations

LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "\\x20\\x09-\\x0D"
MARK = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW.format('text')}, '[^{BLANK}]+') AS w FROM documents),
shingles AS (SELECT DISTINCT rid, hash(s) AS s FROM (SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY 1),
often AS (SELECT * FROM shingles WHERE s IN (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1)),
shared AS (SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM often a JOIN often b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
reach(rid, other) AS (SELECT rid, rid FROM words UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT w.doc_id, coalesce(min(n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM words w LEFT JOIN sizes USING (rid) JOIN reach r ON r.rid = w.rid JOIN words o ON o.rid = r.other GROUP BY w.rid, w.doc_id"""

# Ranges (of bytes, from 0) are counted by what they hold; those that occur twice cover their bytes.
SUFFIX_REPEATS = f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n, coalesce(text, '') AS t FROM documents),
tokens AS (SELECT rid, unnest(regexp_extract_all(t, '[^{BLANK}]+|[{BLANK}]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^{BLANK}]+|[{BLANK}]+'), 1) AS k FROM texts),
placed AS (SELECT rid, k, w, sum(octet_length(encode(w))) OVER (PARTITION BY rid ORDER BY k) AS past FROM tokens),
words AS (SELECT rid, past - octet_length(encode(w)) AS first, past, row_number() OVER (PARTITION BY rid ORDER BY k) AS i FROM placed WHERE NOT regexp_matches(w, '^[{BLANK}]')),
strings AS (SELECT rid, unnest(range(0, n - 399)) AS first FROM texts WHERE n >= 400),
spans AS (
  SELECT rid, first, first + 400 AS past, true AS long FROM strings
  UNION ALL SELECT a.rid, a.first, z.past, false FROM words a JOIN words z ON z.rid = a.rid AND z.i = a.i + 50
  UNION ALL SELECT rid, 0, n, false FROM texts WHERE rid IN (SELECT rid FROM words WHERE i = 51)),
held AS (SELECT s.*, hash(b[(first + 1)::BIGINT:past::BIGINT]) AS h, past - first AS size FROM spans s JOIN texts USING (rid)),
often AS (SELECT h, size FROM (SELECT DISTINCT rid, first, past, h, size FROM held) GROUP BY ALL HAVING count(*) > 1),
hits AS (SELECT DISTINCT rid, first, past, long FROM held JOIN often USING (h, size)),
joined AS (SELECT *, max(past) OVER (PARTITION BY rid, every ORDER BY first, past ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM (SELECT *, true AS every FROM hits UNION ALL SELECT *, false FROM hits WHERE long)),
numbered AS (SELECT *, sum((before IS NULL OR first > before)::INT) OVER (PARTITION BY rid, every ORDER BY first, past) AS run FROM joined),
runs AS (SELECT rid, every, run, min(first) AS first, max(past) AS past FROM numbered GROUP BY ALL),
gone AS (SELECT rid, count(*) FILTER (NOT every) AS n_spans, coalesce(sum(past - first) FILTER (NOT every), 0) AS n_removed, count(*) FILTER (every) AS n_passages, sum(past - first) FILTER (every) AS n_repeated FROM runs GROUP BY 1),
kept AS (SELECT rid, lag(past, 1, 0) OVER (PARTITION BY rid ORDER BY first) AS x, first AS y FROM runs WHERE NOT every
  UNION ALL SELECT rid, max(past), any_value(n) FROM runs JOIN texts USING (rid) WHERE NOT every GROUP BY rid),
pieces AS (SELECT rid, list_reduce(list(b[(x + 1)::BIGINT:y::BIGINT] ORDER BY x), lambda p, q: p || q) AS rest FROM kept JOIN texts USING (rid) GROUP BY rid)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(rest, b)) AS kept_sha256,
  coalesce(n_passages, 0)::BIGINT AS n_passages, coalesce(n_repeated, 0)::BIGINT AS n_repeated
FROM texts LEFT JOIN gone USING (rid) LEFT JOIN pieces USING (rid)"""

PHRASE_INDEX = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW.format('text')}, '[^{MARK}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({LOW.format('text')}, '[^{MARK}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
wanted AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS s FROM items WHERE len(w) > 0),
found AS (SELECT rid, p, k, s FROM (SELECT rid, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM docs, (SELECT DISTINCT k FROM wanted) WHERE len(w) >= k), LATERAL (SELECT array_to_string(w[p:p+k-1], ' ') AS s) WHERE s IN (SELECT s FROM wanted)),
hit AS (SELECT rid, count(DISTINCT spot) AS n FROM (SELECT rid, unnest(range(p, p + k)) AS spot FROM found) GROUP BY 1),
named AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found JOIN wanted USING (s, k) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""

ZIP_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id < kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < kept THEN kept END AS refers_to FROM q"""

# The usual CRC-32 of a list of bytes, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
BYTES = "flatten(list_transform(string_split({0}, ''), lambda k: CASE WHEN unicode(k) < 128 THEN [unicode(k)::BIGINT] ELSE [(192 + (unicode(k) >> 6))::BIGINT, (128 + (unicode(k) & 63))::BIGINT] END))"
FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0} END"
_FIXED = " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_LOW_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIDES = "coalesce(string_agg(n.d, '' ORDER BY n.idx) FILTER (n.idx < (x.idx >> (4 * n.level))), '') AS b, coalesce(string_agg(n.d, '' ORDER BY n.idx) FILTER (n.idx > (x.idx >> (4 * n.level))), '') AS a"

MERKLE = f"""
WITH RECURSIVE made AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({_FIXED} || {FIELD.format('text')}) AS leaf,
    CASE WHEN {CRC.format(BYTES.format('doc_id::VARCHAR'))} % 5 = 0 THEN sha256({_FIXED} || {FIELD.format(_LOW_TEXT)}) END AS changed FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM made),
nodes AS (SELECT tree, 0 AS level, idx, size, leaf AS d FROM leaves
  UNION ALL SELECT tree, level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE size > 1 GROUP BY tree, level, idx // 16, size),
subs AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (SELECT 0 AS level, idx, size, subroot AS d FROM subs
  UNION ALL SELECT level + 1, idx // 16, (size + 15) // 16, sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE size > 1 GROUP BY level, idx // 16, size),
top AS (SELECT d AS root FROM tops WHERE size = 1),
lower_steps AS (SELECT x.tree, x.idx, n.level, {_SIDES} FROM leaves x JOIN nodes n ON n.tree = x.tree AND n.size > 1 AND (n.idx >> 4) = (x.idx >> (4 * n.level + 4)) GROUP BY x.tree, x.idx, n.level),
upper_steps AS (SELECT x.tree, n.level + 100 AS level, {_SIDES} FROM subs x JOIN tops n ON n.size > 1 AND (n.idx >> 4) = (x.idx >> (4 * n.level + 4)) GROUP BY x.tree, x.idx, n.level),
steps AS (SELECT tree, idx, level, b, a FROM lower_steps UNION ALL SELECT l.tree, l.idx, u.level, b, a FROM leaves l JOIN upper_steps u ON u.tree = l.tree),
held AS (SELECT tree, idx, sha256(string_agg(b || a, '' ORDER BY level)) AS proof_sha256, list(b ORDER BY level) AS bs, list(a ORDER BY level) AS afters FROM steps GROUP BY tree, idx),
fold AS (SELECT l.tree, l.idx, 0 AS k, coalesce(changed, leaf) AS d FROM leaves l
  UNION ALL SELECT f.tree, f.idx, k + 1, sha256(bs[k + 1] || d || afters[k + 1]) FROM fold f JOIN held h ON h.tree = f.tree AND h.idx = f.idx WHERE k < len(bs)),
ends AS (SELECT tree, idx, arg_max(d, k) AS folded_root FROM fold GROUP BY tree, idx)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subs s ON s.tree = l.tree JOIN ends e ON e.tree = l.tree AND e.idx = l.idx LEFT JOIN held h ON h.tree = l.tree AND h.idx = l.idx, top"""

SPELLING = f"""
WITH RECURSIVE runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({LOW.format('text')}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT *, {CRC.format(BYTES.format("coalesce(doc_id::VARCHAR, '') || ':' || w"))} AS h FROM runs),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
gaps AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gaps g JOIN words w ON w.word = g.rest UNION SELECT w.word, g.word FROM gaps g JOIN words w ON w.word = g.rest),
best AS (SELECT r.word, r.other, o.n AS other_n, count(*) OVER (PARTITION BY r.word) AS n_near, row_number() OVER (PARTITION BY r.word ORDER BY o.n DESC, r.other) AS k FROM near r JOIN words o ON o.word = r.other),
rows AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.word = w.word),
reach AS (SELECT word, word AS root, 0 AS k FROM rows UNION ALL SELECT c.word, r.form, k + 1 FROM reach c JOIN rows r ON r.word = c.root WHERE r.form IS NOT NULL)
SELECT r.word, form, root, n, n_near, form_n FROM rows r JOIN (SELECT word, arg_max(root, k) AS root FROM reach GROUP BY 1) e ON e.word = r.word"""

ORACLES = {"op2_ngram_join": NGRAM_JOIN, "op7_suffix_repeats": SUFFIX_REPEATS, "op8_phrase_index": PHRASE_INDEX, "op9_zip_warc": ZIP_WARC, "op12_merkle_manifest": MERKLE, "op13_spelling_variants": SPELLING}
