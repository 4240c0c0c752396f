"""DuckDB SQL for the queries whose whole method it can express."""

from __future__ import annotations

PLAIN_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER_AZ = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = rf"regexp_extract_all({LOWER_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
written AS (
  SELECT *, len(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g'))
    + len(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + len('<|im_start|>') + 1 + len('<|im_end|>') + 1 AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

# the seats are listed one by one here: every quotient of every source, the highest taken
OP3 = rf"""
WITH sized AS (
  SELECT doc_id, source, len({PLAIN_WORDS.format('text')})::BIGINT AS size,
    md5(concat('42:', coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS place FROM documents),
weighed AS (
  SELECT source, source_size, 3 * source_size AS top,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER before, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) * weight > top AS stops
  FROM weighed WINDOW before AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, CASE WHEN stops THEN top::DOUBLE ELSE coalesce(weight * (
    (sum(source_size) OVER () - coalesce(sum(top) FILTER (stops) OVER (), 0))
    / nullif(sum(weight) OVER () - coalesce(sum(weight) FILTER (stops) OVER (), 0), 0)), 0)::DOUBLE END AS target FROM levels),
seats AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place
  FROM targets, unnest(range(3 * source_size // 4)) AS u(k) WHERE target > 0),
quotas AS (
  SELECT t.source, t.source_size, t.target, count(s.place) * 4 AS words
  FROM targets t LEFT JOIN (SELECT * FROM seats WHERE place <= (SELECT round(sum(target))::BIGINT // 4 FROM targets)) s
    ON s.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS first FROM sized)
SELECT p.doc_id, p.size, q.source_size, q.target, CASE WHEN q.source_size = 0 THEN 0 ELSE
  (q.words // q.source_size) * p.size + greatest(0, least(p.size, q.words % q.source_size - p.first)) END::BIGINT AS taken
FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source
"""

OP5 = rf"""
WITH doc_words AS (SELECT row_number() OVER () AS row, doc_id, {ITEM_WORDS.format('text')} AS w FROM documents),
windows AS (
  SELECT DISTINCT item, w[i:i + 9] AS win
  FROM (SELECT item_id::VARCHAR AS item, {ITEM_WORDS.format('text')} AS w FROM benchmark),
    unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT len(win) AS n FROM windows),
places AS (SELECT row, p, n, w[p:p + n - 1] AS win FROM doc_words, lengths, unnest(range(1, len(w) - n + 2)) AS u(p)),
hits AS (SELECT row, p, n, item FROM places JOIN windows USING (win)),
covered AS (SELECT row, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT DISTINCT row, p, n FROM hits), unnest(range(p, p + n)) AS u(q) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (row) LEFT JOIN items USING (row)
"""

# one edit, told by the longest common beginning: what follows the first difference must agree
OP6 = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
lines AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM raw),
firsts AS (SELECT line, len(line) AS n, min((doc_id, line_no)) AS first FROM lines WHERE len(line) >= 10 GROUP BY line),
halves AS (
  SELECT line, n, first, n AS m, 0 AS side, left(line, n // 2) AS part FROM firsts
  UNION ALL SELECT line, n, first, n - 1, 0, left(line, (n - 1) // 2) FROM firsts
  UNION ALL SELECT line, n, first, n, 1, right(line, n - n // 2) FROM firsts
  UNION ALL SELECT line, n, first, n - 1, 1, right(line, n - 1 - (n - 1) // 2) FROM firsts),
near AS (
  SELECT DISTINCT a.line FROM halves a JOIN halves b USING (m, side, part), unnest(range(a.m + 1)) AS u(i)
  WHERE b.first < a.first AND least(a.n, b.n) = m AND left(a.line, i) = left(b.line, i)
    AND substr(a.line, i + 1 + (a.n >= b.n)::INT) = substr(b.line, i + 1 + (b.n >= a.n)::INT)),
marked AS (
  SELECT l.doc_id, l.line_no, l.raw, f.first IS NOT NULL AND f.first <> (l.doc_id, l.line_no) AS exact,
    coalesce(f.first = (l.doc_id, l.line_no), false) AND n.line IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line)
SELECT d.doc_id, count(m.line_no) AS n_lines, coalesce(sum(m.exact::INT), 0)::BIGINT AS n_exact, coalesce(sum(m.near::INT), 0)::BIGINT AS n_near,
  md5(coalesce(string_agg(m.raw, chr(10) ORDER BY m.line_no) FILTER (NOT m.exact AND NOT m.near), '')) AS text_md5
FROM documents d LEFT JOIN marked m USING (doc_id) GROUP BY d.doc_id
"""

# every candidate against every query
OP12 = r"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x, len(embedding) AS size FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
rows AS (SELECT * FROM whole WHERE size = (SELECT size FROM whole GROUP BY size ORDER BY count(*) DESC, size DESC LIMIT 1)),
cells AS (SELECT vec_id, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM rows),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score
  FROM cells q JOIN cells c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores) WHERE rank <= 5
"""

# every document that holds a term of the item
OP13 = rf"""
WITH terms AS (SELECT row_number() OVER () AS row, doc_id, unnest({ITEM_WORDS.format('text')}) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
sizes AS (SELECT row, count(*) AS n FROM terms GROUP BY row),
total AS (SELECT count(*) AS n, sum(n)::BIGINT AS length FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT n FROM total) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({ITEM_WORDS.format('text')}) AS term FROM benchmark),
scores AS (
  SELECT a.item_id, t.row, any_value(t.doc_id) AS doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * s.n * l.n) // l.length))))::BIGINT AS score
  FROM asked a JOIN tf t USING (term) JOIN weights w USING (term) JOIN sizes s USING (row), total l GROUP BY a.item_id, t.row)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""

ORACLES = {"op2_chat_format": OP2, "op3_mix_sources": OP3, "op5_decontaminate": OP5, "op6_line_dedup": OP6,
           "op12_top_k": OP12, "op13_lexical_search": OP13}
