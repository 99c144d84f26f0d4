"""DuckDB SQL for the operators that SQL can express.

The others are held against brute force in the tests: parsing with automata (1), token files (2), perplexities (6),
piece ids (8) and boosted trees (10).
"""

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), t AS (
  SELECT doc_id, source, text, w, len(w) AS n,
         CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i+1] || chr(10) || w[i+2]) ELSE [] END AS g,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM w
), p AS (
  SELECT row_number() OVER () AS k, * FROM t
), e AS (
  SELECT k, unnest(g) AS g, unnest(range(0, len(g))) AS i FROM p
), twice AS (
  SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM e) WHERE c > 1
), covered AS (
  SELECT k, count(DISTINCT i + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY k
), base AS (
  SELECT doc_id, source, n AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM p LEFT JOIN covered USING (k)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::DOUBLE) AS k FROM judged WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT sum(k) / sum(n) AS mean, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS spread FROM hosts
), prior AS (
  SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2.0), 1000.0) ELSE 1000.0 END AS strength FROM m
), ab AS (
  SELECT CASE WHEN mean > 0 AND mean < 1 THEN mean * strength ELSE 1.0 END AS a, CASE WHEN mean > 0 AND mean < 1 THEN (1 - mean) * strength ELSE 1.0 END AS b FROM prior
), rates AS (
  SELECT source, round((k + a) / (n + (a + b)), 9) AS host_rate FROM hosts, ab
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, NOT base_failed AND coalesce(host_rate, 0) <= 0.6 AS kept
FROM judged LEFT JOIN rates USING (source)
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(reach.b) AS component_id, s.doc_id = min(reach.b) AS kept
FROM s JOIN reach ON reach.a = s.doc_id GROUP BY s.doc_id, s.s
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), l AS (
  SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS line FROM d
), raw AS (
  SELECT doc_id, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM l
), m AS (
  SELECT *, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS m FROM raw WHERE len(raw) > 0
), t AS (
  SELECT doc_id, pos, CASE WHEN len(list_filter(m, lambda x: x <> '<*>')) = 0 THEN raw ELSE m END AS tok FROM m
), lines AS (
  SELECT doc_id, pos, tok, len(tok) AS n, array_to_string(tok, ' ') AS masked FROM t
), seen AS (
  SELECT masked, left(md5(masked), 15) AS m, any_value(tok) AS tok, any_value(n) AS n, min(doc_id) AS low, max(doc_id) AS high FROM lines GROUP BY masked
), leaves AS (
  SELECT n, array_to_string(tok[1:3], ' ') AS head, list({'m': m, 'tok': tok} ORDER BY m) AS l FROM seen WHERE n >= 6 GROUP BY ALL HAVING count(*) > 1
), seeds AS (
  SELECT n, l, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda s:
           100 * list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN s.tok[i] = y[1].tok[i] THEN 1 ELSE 0 END)) >= 75 * n)) > 0 THEN acc ELSE list_concat(acc, y) END) AS seeds
  FROM leaves
), each AS (
  SELECT n, unnest(l) AS x, seeds FROM seeds
), into_ AS (
  SELECT x.m AS m, list_filter(seeds, lambda s: 100 * list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN s.tok[i] = x.tok[i] THEN 1 ELSE 0 END)) >= 75 * n)[1].m AS seed FROM each
), final AS (
  SELECT masked, coalesce(seed, m) AS g, low, high FROM seen LEFT JOIN into_ USING (m)
), groups AS (
  SELECT g, min(low) AS first FROM final GROUP BY g HAVING min(low) <> max(high)
), made AS (
  SELECT doc_id, count(*) AS n_recurring, count(*) FILTER (doc_id <> first) AS n_dropped FROM lines JOIN final USING (masked) JOIN groups USING (g) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(n_recurring, 0)::BIGINT AS n_recurring, coalesce(n_dropped, 0)::BIGINT AS n_dropped
FROM d LEFT JOIN made USING (doc_id)
"""

OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, CASE WHEN regexp_matches(text, '(<<|<|\[)\\*(/?(s|SYS>)>|/?(INST|ROLE)\]|/END\])')
                 THEN regexp_replace(text, '(<<|<|\[)(\\*)(/?(?:s|SYS>)>|/?(?:INST|ROLE)\]|/END\])', '\1\\\2\3', 'g') ELSE text END AS escaped FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 19 + length(role) END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i:i+m-1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i+m-1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)
), hits AS (
  SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw USING (m, g)
), n AS (
  SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
), o AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS t FROM d
), counts AS (SELECT t, count(*) AS c FROM o GROUP BY t),
wt AS (
  SELECT DISTINCT g, unnest(string_split(g, ' ')) AS t FROM bw
), rare AS (
  SELECT g, arg_min(t, (c, t)) AS t, count(*) AS k FROM wt LEFT JOIN counts USING (t) GROUP BY g HAVING count(*) = count(c)
), pairs AS (
  SELECT DISTINCT g, k, doc_id FROM rare JOIN (SELECT DISTINCT doc_id, t FROM o) USING (t)
), full_ AS (
  SELECT g, k, doc_id FROM pairs JOIN wt USING (g) JOIN (SELECT DISTINCT doc_id, t FROM o) USING (doc_id, t) GROUP BY g, k, doc_id HAVING count(*) = k
), found AS MATERIALIZED (
  SELECT g, k, doc_id, p, t FROM full_ JOIN wt USING (g) JOIN o USING (doc_id, t)
), near AS (
  SELECT DISTINCT a.g, a.doc_id FROM found a JOIN found b ON a.g = b.g AND a.doc_id = b.doc_id AND b.p >= a.p AND b.p < a.p + 20 GROUP BY a.g, a.doc_id, a.p, a.k HAVING count(DISTINCT b.t) = a.k
), near_items AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM near JOIN bw USING (g)) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near_items.items, '')) AS near_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": OP3, "op4_near_dedup": OP4, "op5_line_dedup": OP5, "op7_chat_format": OP7, "op9_decontamination": OP9}
