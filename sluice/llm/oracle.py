"""SQL of the corpus operators that SQL can express, by brute force."""

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS s FROM words, unnest(range(greatest(len(ws) - 4, 1))) AS t(i) WHERE len(ws) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), reach(node, other) AS (
  SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT node, b FROM reach JOIN links ON other = a
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = d.doc_id
"""

VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len([x FOR x IN embedding IF NOT isfinite(x)]) = 0
), sized AS (
  SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM usable
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT node, b FROM reach JOIN links ON other = a
)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) ON node = v.vec_id
"""

SUBSTRINGS = rf"""
WITH words AS (
  SELECT doc_id, {WORDS.format("text")} AS ws FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(ws[i + 1:i + 13], ' ') AS w FROM words, unnest(range(greatest(len(ws) - 12, 0))) AS t(i)
), first AS (
  SELECT w, min(doc_id) AS lo FROM windows GROUP BY w
), gone AS (
  SELECT DISTINCT doc_id, start + j AS place FROM windows JOIN first USING (w), unnest(range(13)) AS t(j) WHERE lo < doc_id
), each AS (
  SELECT doc_id, i AS place, ws[i + 1] AS word FROM words, unnest(range(len(ws))) AS t(i)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM each ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

SUFFIXES = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), chunks AS (  -- short texts, as a slice far into a long one is slow
  SELECT r, j, array_slice(h, 2000 * j + 1, 2000 * j + 2798) AS s FROM docs, unnest(range((greatest(length(h) // 2 - 399, 0) + 999) // 1000)) AS t(j)
), windows AS (
  SELECT r, 1000 * j + x AS i, md5(array_slice(s, 2 * x + 1, 2 * x + 800)) AS k FROM chunks, unnest(range(length(s) // 2 - 399)) AS t(x)
), hits AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS begins FROM windows SEMI JOIN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1) USING (k)
), spans AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS s FROM hits) GROUP BY r, s
), gaps AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, coalesce(max(b), 0), any_value(length(h)) // 2 FROM docs LEFT JOIN spans USING (r) GROUP BY r
), kept AS (
  SELECT r, string_agg(array_slice(h, 2 * a + 1, 2 * b), '' ORDER BY a) FILTER (WHERE a < b) AS h FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST((length(d.h) - length(coalesce(k.h, ''))) // 2 AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d JOIN kept k USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM spans GROUP BY r) USING (r)
"""

#: Edits are tried turn by turn; of those that reach one state the cheapest stay, ties by letters.
REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
), keyed AS (
  SELECT c.*, list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM conversations c
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) WHERE kind <> 0
), ids AS (
  SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT g, turn, role, text, regexp_extract(role, '^[\s\S]', 0) AS r, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail FROM damaged JOIN ids ON damaged.conv_id IS NOT DISTINCT FROM ids.conv_id
), turns AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed
), inserts(q, p, fee, letters, added) AS (
  VALUES (0, 0, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 3, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 3, 'I', ['user:'])
), moves(p, letter, initial, to_, price, given) AS (
  VALUES (0, 'D', NULL, 0, 4, NULL), (1, 'D', NULL, 1, 4, NULL), (2, 'D', NULL, 2, 4, NULL), (3, 'D', NULL, 3, 4, NULL), (0, 'K', 's', 1, 0, NULL), (0, 'K', 'u', 2, 0, NULL), (1, 'K', 'u', 2, 0, NULL), (2, 'K', 'a', 3, 0, NULL), (3, 'K', 'u', 2, 0, NULL), (0, 'R', NULL, 2, 3, 'user'), (1, 'R', NULL, 2, 3, 'user'), (2, 'R', NULL, 3, 3, 'assistant'), (3, 'R', NULL, 2, 3, 'user')
), best(g, i, q, c, a, t) AS (
  SELECT g, 0, 0, 0, '', CAST([] AS VARCHAR[]) FROM ids
  UNION ALL
  SELECT g, i, q, min(o).c, min(o).a, min(o).t FROM (
    SELECT b.g, b.i + 1 AS i, m.to_ AS q, {'c': b.c + n.fee + m.price + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END, 'a': b.a || n.letters || letter,
      't': list_concat(list_concat(b.t, n.added), CASE letter WHEN 'D' THEN [] ELSE [concat(coalesce(given, x.role), ':', x.text)] END)} AS o
    FROM best b JOIN turns x ON x.g = b.g AND x.pos = b.i JOIN inserts n ON n.q = b.q JOIN moves m ON m.p = n.p AND (m.initial IS NULL OR m.initial = x.r) AND (letter = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate'))
  ) GROUP BY g, i, q
), ends AS (
  SELECT b.g, min({'c': b.c + n.fee, 'a': b.a || n.letters, 't': list_concat(b.t, n.added)}) AS o FROM best b JOIN (SELECT g, count(pos) AS n FROM ids LEFT JOIN turns USING (g) GROUP BY g) s ON s.g = b.g AND s.n = b.i JOIN inserts n ON n.q = b.q WHERE n.p IN (0, 3) GROUP BY b.g
), pairs AS (
  SELECT g, concat(r, lead(r) OVER (PARTITION BY g ORDER BY pos)) AS two, lead(pos) OVER (PARTITION BY g ORDER BY pos) IS NOT NULL AS next FROM turns
), counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM turns GROUP BY g
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, (SELECT count(*) FROM pairs WHERE pairs.g = ids.g AND next AND two NOT IN ('su', 'ua', 'au')) AS illegal,
  CAST(o.c AS BIGINT) AS cost, o.a AS audit, sha256(array_to_string(o.t, chr(10))) AS repaired_sha256
FROM ids LEFT JOIN counts USING (g) JOIN ends USING (g)
"""
