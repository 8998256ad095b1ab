"""DuckDB statements that give the rows of the queries which SQL can express."""

from __future__ import annotations

CHAT = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role, text,
         regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|/?<SYS>>|</SYS>>|<SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS esc,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS cost
  FROM rows),
written AS (
  SELECT *, length('<s>') + length(role) + 1 + length(esc) + length('</s>')
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 15 ELSE 0 END AS chars FROM escaped),
conv AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
         coalesce(max(cost) FILTER (k = 1 AND role = 'system'), 0) AS system_cost,
         coalesce(max(chars) FILTER (k = 1 AND role = 'system'), 0) AS system_chars,
         list_concat([0], coalesce(list(cost ORDER BY k) FILTER (NOT (k = 1 AND role = 'system')), [])) AS costs,
         list_concat([0], coalesce(list(chars ORDER BY k) FILTER (NOT (k = 1 AND role = 'system')), [])) AS lengths
  FROM written GROUP BY conv_id),
summed AS (
  SELECT *, len(costs) - 1 AS n, list_transform(costs, lambda x, i: list_sum(costs[1:i])) AS p,
         list_transform(lengths, lambda x, i: list_sum(lengths[1:i])) AS c FROM conv),
spans AS (
  SELECT conv_id, 0::BIGINT AS fresh, 0::BIGINT AS repeated FROM summed
  UNION ALL
  SELECT conv_id, nxt, list_filter(range(greatest(nxt - 2, 0), nxt + 1), lambda x: p[nxt + 1] - p[x + 1] <= 128)[1]
  FROM (SELECT s.conv_id, u.p, u.n,
               list_filter(range(s.fresh + 1, u.n), lambda j: u.system_cost + u.p[j + 2] - u.p[s.repeated + 1] > 512)[1] AS nxt
        FROM spans s JOIN summed u USING (conv_id))
  WHERE nxt IS NOT NULL),
until AS (SELECT *, lead(fresh) OVER (PARTITION BY conv_id ORDER BY fresh) AS upto FROM spans),
sizes AS (
  SELECT conv_id, sum(u.system_chars + u.c[coalesce(t.upto, u.n) + 1] - u.c[t.repeated + 1])::BIGINT AS formatted_chars, count(*) AS n_windows
  FROM until t JOIN summed u USING (conv_id) GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, formatted_chars, n_windows
FROM conv JOIN sizes USING (conv_id)
"""

#: Counts of every document, as a statement that defines ``measured``.
MEASURED = r"""
texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, k, words[k:k+2] AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS k FROM texts)),
twice AS (SELECT doc_id, unnest([k, k + 1, k + 2]) AS k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT k) AS n FROM twice GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
lines AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
measured AS (
  SELECT t.doc_id, lang, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM texts t LEFT JOIN repeats r USING (doc_id) LEFT JOIN lines l USING (doc_id))
"""

_JUDGED = r"""
parts AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         unnest(['symbol_rate', 'upper_rate', 'dup_line_rate', 'repeat_rate', 'word_length']) AS measure,
         unnest([1000 * n_symbols, 1000 * n_upper, 1000 * n_dup_lines, 1000 * n_repeat_words, 100 * word_chars]) AS part,
         greatest(1, unnest([n_words, word_chars, n_lines, n_words, n_words])) AS whole,
         unnest([1000, 1000, 1000, 1000, 5000]) AS top, unnest([5000, 10000, 2000, 20000, 0]) AS granted
  FROM measured),
good AS MATERIALIZED (SELECT lang, source, measure, least(top, part // whole) AS cell, count(*) AS n FROM parts WHERE NOT base_failed GROUP BY 1, 2, 3, 4),
whole_corpus AS (SELECT measure, cell, sum(n)::BIGINT AS n FROM good GROUP BY 1, 2),
corpus_size AS (SELECT measure, sum(n)::BIGINT AS total FROM whole_corpus GROUP BY 1),
lang_size AS (SELECT lang, measure, sum(n)::BIGINT AS total FROM good GROUP BY 1, 2),
lang_rows AS (
  SELECT lang, measure, cell, 1000000 * n AS w FROM good
  UNION ALL SELECT lang, measure, cell, 100 * 1000000 * n // corpus_size.total FROM lang_size JOIN whole_corpus USING (measure) JOIN corpus_size USING (measure)),
lang_weights AS MATERIALIZED (SELECT lang, measure, cell, sum(w)::BIGINT AS w FROM lang_rows GROUP BY 1, 2, 3),
group_rows AS (
  SELECT lang, source, measure, cell, 1000000 * n AS w FROM good
  UNION ALL SELECT g.lang, g.source, g.measure, l.cell, 100 * l.w // (s.total + 100)
  FROM (SELECT DISTINCT lang, source, measure FROM good) g
  JOIN lang_weights l ON l.lang IS NOT DISTINCT FROM g.lang AND l.measure = g.measure
  JOIN lang_size s ON s.lang IS NOT DISTINCT FROM g.lang AND s.measure = g.measure),
group_weights AS (SELECT lang, source, measure, cell, sum(w)::BIGINT AS w FROM group_rows GROUP BY 1, 2, 3, 4),
ranked AS (
  SELECT *, sum(w) OVER (PARTITION BY lang, source, measure ORDER BY cell) AS below, sum(w) OVER (PARTITION BY lang, source, measure) AS total FROM group_weights),
tails AS MATERIALIZED (
  SELECT lang, source, measure, min(cell) FILTER (100 * below >= 15 * total) AS low, min(cell) FILTER (100 * below >= 50 * total) AS middle,
         min(cell) FILTER (100 * below >= 85 * total) AS high FROM ranked GROUP BY 1, 2, 3),
outside AS (
  SELECT p.doc_id
  FROM parts p
  JOIN tails t ON t.lang IS NOT DISTINCT FROM p.lang AND t.source IS NOT DISTINCT FROM p.source AND t.measure = p.measure
  WHERE least(part, top * whole) > (high + 6 * greatest(high - middle, 5)) * whole + granted
     OR p.measure = 'word_length' AND least(part, top * whole) < (low - 6 * greatest(middle - low, 5)) * whole)
"""

QUALITY = f"""
WITH {MEASURED}, {_JUDGED}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM outside) AS kept
FROM parts WHERE measure = 'word_length'
"""

_REACHED = """reached(id, c) AS (SELECT id, id FROM nodes UNION SELECT b, c FROM reached JOIN pairs ON a = reached.id),
named AS (SELECT id, min(c) AS component_id FROM reached GROUP BY 1)"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common.n >= 80 * (x.n + y.n - common.n)),
pairs AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS id FROM docs), {_REACHED}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM docs LEFT JOIN sizes USING (doc_id) JOIN named ON id = doc_id
"""

CAP_FILTERS = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN named ON id = vec_id LEFT JOIN counts ON a = vec_id
"""

SUBSTRINGS = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, k, array_to_string(w[k:k+34], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 33)) AS k FROM docs)),
again AS (SELECT s FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 35)) AS k FROM windows JOIN again USING (s)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)
"""

#: Counts with the checksum bit by bit, near words by cutting one code point out, forms followed to their end.
SPELLING = r"""
WITH RECURSIVE bits(k, c, r) AS (
  SELECT k, k, 0 FROM range(256) t(k)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM bits WHERE r < 8),
steps AS (SELECT list(c ORDER BY k) AS s FROM bits WHERE r = 8),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zA-Z\x{C0}-\x{FF}]+')) AS run
  FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, run, count(*) AS n, list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x: ord(x)) AS codes FROM found GROUP BY doc_id, run),
checked AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295,
           flatten(list_transform(codes, lambda x: CASE WHEN x < 128 THEN [x::BIGINT] ELSE [192 + (x >> 6)::BIGINT, 128 + (x & 63)::BIGINT] END))),
           lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1]))) AS h
  FROM runs, steps),
garbled AS (
  SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM checked),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM garbled WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS MATERIALIZED (
  SELECT word, k, substr(word, 1, k - 1) AS head, substr(word, k + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.k = b.k AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT word, head || tail FROM cuts WHERE head || tail IN (SELECT word FROM words)
  UNION SELECT head || tail, word FROM cuts WHERE head || tail IN (SELECT word FROM words)),
near AS (
  SELECT a, count(*) AS n_near, first(b ORDER BY m.n DESC, b) AS best, max(m.n) AS best_n FROM pairs JOIN words m ON b = m.word GROUP BY a),
formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
  FROM words LEFT JOIN near ON a = word),
path(word, reached, nth) AS (
  SELECT word, word, 0 FROM formed UNION ALL SELECT p.word, f.form, nth + 1 FROM path p JOIN formed f ON f.word = p.reached WHERE f.form IS NOT NULL),
lasts AS (SELECT word, last(reached ORDER BY nth) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN lasts USING (word)
"""

WARC = r"""
WITH digested AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
based AS (
  SELECT page_id, payload_bytes, array_to_string(flatten(list_transform(range(0, 8), lambda g: list_transform([15, 10, 5, 0],
           lambda shift: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 5 * g + 1, 5))::BIGINT >> shift::INT) & 31)::INT, 1)))), '') AS payload_digest
  FROM digested),
placed AS (
  SELECT *, row_number() OVER w AS k, first_value(page_id) OVER w AS first_id FROM based WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to, CASE WHEN k = 1 THEN true END AS intact
FROM placed
"""
