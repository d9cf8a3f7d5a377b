"""DuckDB SQL for the queries that SQL can express."""

import re

MIX_SOURCES = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'null') AS source_key,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), chr(1)) || '|' || coalesce(source, chr(1)) || '|' || coalesce(text, chr(1))) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source_key, source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources
), weighted AS (
  SELECT *, CAST([5, 2, 1][1 + (rank - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked
), filled AS (
  SELECT *, cap / weight AS fill, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS budget FROM weighted
), levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM filled WINDOW before AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source_key, source_size, budget,
         coalesce(least(cap, (SELECT level FROM levels WHERE fill >= level ORDER BY fill, rank LIMIT 1) * weight), cap) AS target
  FROM levels
), queued AS (
  SELECT s.*, t.source_size, t.target, t.budget, row_number() OVER line AS place,
         coalesce(sum(s.size) OVER (PARTITION BY s.source_key ORDER BY key, s.size, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN targets t USING (source_key)
  WINDOW line AS (PARTITION BY s.source_key ORDER BY key, s.size, doc_id NULLS FIRST)
), turns AS (
  SELECT q.*, turn, CAST(turn * source_size + ahead + size AS DOUBLE) / target AS finish
  FROM queued q, (VALUES (0), (1)) AS v(turn) WHERE target > 0 AND size > 0
), spent AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_key, turn, key, place ROWS UNBOUNDED PRECEDING) AS spent FROM turns
), taken AS (
  SELECT source_key, place, count(*) AS copies FROM spent WHERE spent <= budget GROUP BY ALL
)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM queued LEFT JOIN taken USING (source_key, place)
"""

LINE_DEDUP = r"""
WITH numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS row, doc_id, coalesce(text, '') AS text FROM documents
), every AS (
  SELECT row, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS j FROM numbered
), lines AS (
  SELECT row, j, line, row_number() OVER (PARTITION BY row ORDER BY j) AS i, words,
         lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3, lead(words, 1) OVER w AS words2
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM every) WHERE trim(translate(line, chr(9) || chr(13), '  ')) <> ''
  WINDOW w AS (PARTITION BY row ORDER BY j)
), starts AS (
  SELECT row, i, 3 AS depth, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY row, i) AS nth FROM lines WHERE line3 IS NOT NULL
  UNION ALL SELECT row, i, 2, row_number() OVER (PARTITION BY line, line2 ORDER BY row, i) FROM lines WHERE words + words2 >= 50
  UNION ALL SELECT row, i, 1, row_number() OVER (PARTITION BY line ORDER BY row, i) FROM lines WHERE words >= 50
), gone AS (
  SELECT DISTINCT l.row, l.j FROM lines l JOIN (SELECT row, i + k AS i FROM starts, (VALUES (0), (1), (2)) v(k) WHERE nth > 1 AND k < depth) s USING (row, i)
), runs AS (
  SELECT row, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_runs
  FROM (SELECT row, min(j) AS a, max(j) + 1 AS b FROM (SELECT row, j, j - row_number() OVER (PARTITION BY row ORDER BY j) AS run FROM gone) GROUP BY row, run)
  GROUP BY row
), counts AS (
  SELECT row, count(*) AS n_lines FROM lines GROUP BY row
), removed AS (
  SELECT row, count(*) AS n_removed FROM gone GROUP BY row
), kept AS (
  SELECT row, string_agg(line, chr(10) ORDER BY j) AS kept_text FROM every ANTI JOIN gone USING (row, j) GROUP BY row
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_runs, '') AS removed_runs,
       sha256(CASE WHEN n_removed = n_lines THEN '' ELSE coalesce(kept_text, '') END) AS kept_sha256
FROM numbered LEFT JOIN counts USING (row) LEFT JOIN removed USING (row) LEFT JOIN runs USING (row) LEFT JOIN kept USING (row)
"""

TOP_K_SEARCH = r"""
WITH numbered AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS row, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT row, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS term FROM numbered
), counts AS (
  SELECT row, term, count(*) AS tf FROM words GROUP BY row, term
), lengths AS (
  SELECT row, count(*) AS dl FROM words GROUP BY row
), totals AS (
  SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM lengths
), idf AS (
  SELECT term, ln(1 + ((SELECT n FROM totals) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM counts GROUP BY term
), weights AS (
  SELECT row, term, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT mean FROM totals))) AS weight
  FROM counts JOIN lengths USING (row)
), asked AS (
  SELECT q.row AS query, term, tf * idf AS ask FROM counts q JOIN idf USING (term)
  JOIN numbered n ON n.row = q.row AND n.doc_id % 100 = 0
), scores AS (
  SELECT query, w.row, round(sum(ask * weight), 6) AS score FROM asked JOIN weights w USING (term) GROUP BY query, w.row
), ranked AS (
  SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM scores JOIN numbered USING (row) WHERE score > 0
)
SELECT n.doc_id AS query_id, rank, r.doc_id, score FROM ranked r JOIN numbered n ON n.row = r.query WHERE rank <= 10
"""

# CRC-32 of the UTF-8 bytes of a string, bit by bit
BYTES = "list_transform(regexp_extract_all(hex(encode(@X)), '..'), lambda b: CAST(16 * position(b[1] IN '123456789ABCDEF') + position(b[2] IN '123456789ABCDEF') AS BIGINT))"
CRC = f"""xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {BYTES}),
     lambda c, b: xor(c >> 8, list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))))"""

# units of more than 1/2048 of all bytes are dealt largest first; the others fill up to one level
SHARD_DOCUMENTS = r"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS row, doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, @CRC AS crc, md5(coalesce(text, '')) AS grp,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 16) AS own
  FROM documents
), totals AS (
  SELECT CAST(sum(size) AS BIGINT) AS total FROM sized
), groups AS (
  SELECT grp, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) * 32 > (SELECT total FROM totals) AS overfull FROM sized GROUP BY grp
), rows AS (
  SELECT row, doc_id, size, crc, grp || own || lpad(CAST(row AS VARCHAR), 16, '0') AS key,
         CASE WHEN overfull THEN grp || own || lpad(CAST(row AS VARCHAR), 16, '0') ELSE grp END AS unit
  FROM sized JOIN groups USING (grp)
), units AS (
  SELECT unit, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) * 2048 > (SELECT total FROM totals) AS large FROM rows GROUP BY unit
), queue AS (
  SELECT unit, bytes, row_number() OVER (ORDER BY bytes DESC, unit) AS place FROM units WHERE large
), deal AS (
  SELECT CAST(0 AS BIGINT) AS place, CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS BIGINT) AS shard
  UNION ALL
  SELECT q.place, list_transform(range(8), lambda i: loads[i + 1] + CASE WHEN i + 1 = list_position(loads, list_min(loads)) THEN q.bytes ELSE 0 END), q.unit, list_position(loads, list_min(loads)) - 1
  FROM deal d JOIN queue q ON q.place = d.place + 1
), last AS (
  SELECT loads, (SELECT coalesce(sum(bytes), 0) FROM units WHERE NOT large) AS rest FROM deal ORDER BY place DESC LIMIT 1
), levels AS (
  SELECT k, CAST((rest + list_sum(list_sort(loads)[1:k])) // k AS BIGINT) AS level, list_sort(loads)[k] AS load FROM last, range(1, 9) t(k)
), level AS (
  SELECT level FROM levels WHERE level >= load ORDER BY k DESC LIMIT 1
), borders AS (
  SELECT s, CAST(list_sum(list_transform(loads[1:s], lambda x: greatest(0, level - x))) AS BIGINT) AS border FROM last, level, range(1, 8) t(s)
), filled AS (
  SELECT unit, bytes, coalesce(sum(bytes) OVER (ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM units WHERE NOT large
), placed AS (
  SELECT unit, shard FROM deal WHERE unit IS NOT NULL
  UNION ALL SELECT unit, (SELECT count(*) FROM borders WHERE 2 * before + bytes >= 2 * border) FROM filled
)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows JOIN placed USING (unit)
""".replace("@CRC", CRC.replace("@X", "coalesce(text, '')"))

HARD_NEGATIVES = r"""
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.row, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(coalesce(list_inner_product(a.v, b.v), 0) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS place FROM pairs WHERE same
), negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.row, place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.row = n.row AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score WHERE place <= 5
)
SELECT * FROM negatives WHERE rank <= 10
"""

CONVERSATION_REPAIR = r"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, @CRC % 20 AS kind FROM conversations
), damaged AS (
  SELECT coalesce('c' || CAST(conv_id AS VARCHAR), 'null') AS conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM marked, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS t,
         position(CASE WHEN role = '' THEN '?' ELSE role[1] END IN 'sua') AS i FROM damaged
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY t) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), moves AS (  -- i: 1 system, 2 user, 3 assistant; costs with the edit's initial behind
  SELECT *, CASE fault WHEN 3 THEN 3 WHEN 0 THEN 0 END AS stays FROM faults
), walk AS (  -- cheapest and then least edits up to turn t, by state: the cost in 12 digits, then the initials
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS t, '000000000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM moves
  UNION ALL
  SELECT conv, t, n2, s2, u2, a2 FROM (
    SELECT m.conv, m.t,
           @ADD(n, 4, 'D') AS n2,
           least(@ADD(s, 4, 'D'), CASE WHEN i = 1 THEN @ADD(n, stays, 'K') END) AS s2,
           least(@ADD(u1, 4, 'D'), @ADD(n, stays + CASE WHEN i = 2 THEN 0 ELSE 3 END, CASE WHEN i = 2 THEN 'K' ELSE 'R' END), @ADD(s, stays + CASE WHEN i = 2 THEN 0 ELSE 3 END, CASE WHEN i = 2 THEN 'K' ELSE 'R' END),
                 @ADD(a1, stays + CASE WHEN i = 2 THEN 0 ELSE 3 END, CASE WHEN i = 2 THEN 'K' ELSE 'R' END)) AS u2,
           least(@ADD(a1, 4, 'D'), @ADD(u1, stays + CASE WHEN i = 3 THEN 0 ELSE 3 END, CASE WHEN i = 3 THEN 'K' ELSE 'R' END)) AS a2
    FROM (SELECT *, least(u, @ADD(n, 3, 'I'), @ADD(s, 3, 'I'), @ADD(a, 3, 'I')) AS u1, least(a, @ADD(u, 3, 'I'), @ADD(n, 6, 'II'), @ADD(s, 6, 'II')) AS a1 FROM walk) w
    JOIN moves m ON m.conv = w.conv AND m.t = w.t + 1)
), ends AS (
  SELECT conv, least(n, a, @ADD(u, 3, 'I'), @ADD(s, 6, 'II')) AS best FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY t DESC) AS back FROM walk) WHERE back = 1
), audits AS (
  SELECT conv, CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit FROM ends
), letters AS (
  SELECT conv, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS p FROM audits WHERE audit <> ''
), used AS (
  SELECT *, count_if(letter <> 'I') OVER (PARTITION BY conv ORDER BY p) AS t, count_if(letter <> 'D') OVER (PARTITION BY conv ORDER BY p) AS place FROM letters
), kept AS (
  SELECT used.*, m.role, m.text, m.i, max(CASE WHEN place = 1 AND letter = 'K' AND m.i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY used.conv) AS system
  FROM used LEFT JOIN moves m ON m.conv = used.conv AND m.t = used.t AND letter <> 'I' WHERE letter <> 'D'
), repaired AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS whole
  FROM kept GROUP BY conv
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated, count_if(pair NOT IN (12, 23, 32)) AS illegal
  FROM (SELECT *, i + 10 * lag(i) OVER (PARTITION BY conv ORDER BY t) AS pair FROM moves) GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('c' || CAST(conv_id AS VARCHAR), 'null') AS conv FROM conversations) LEFT JOIN counts USING (conv) LEFT JOIN audits USING (conv) LEFT JOIN repaired USING (conv)
""".replace("@CRC", CRC.replace("@X", "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))
for _column, _cost, _letter in re.findall(r"@ADD\((\w+), (.*?), ('\w+'|CASE.*?END)\)", CONVERSATION_REPAIR):
    _sum = f"lpad(CAST(CAST(substr({_column}, 1, 12) AS BIGINT) + {_cost} AS VARCHAR), 12, '0') || substr({_column}, 13) || {_letter}"
    CONVERSATION_REPAIR = CONVERSATION_REPAIR.replace(f"@ADD({_column}, {_cost}, {_letter})", _sum)
