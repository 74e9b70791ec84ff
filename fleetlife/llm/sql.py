"""SQL (DuckDB) for the queries that SQL can express."""

SQL: dict[str, str] = {}

_WORD = "'[^\\x20\\x09-\\x0D]+'"
_NOTICES = ("all rights reserved|copyright|licensed under|released under the|cookie|privacy policy|terms of use|"
            "terms of service|javascript|click here|sign in|sign up|log in|subscribe|newsletter|read more|"
            "share this|back to top|powered by|lorem ipsum|skip to content")

QUALITY = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT k, doc_id, text, regexp_extract_all(text, {_WORD}) AS w, string_split(text, chr(10)) AS l FROM t),
lines AS (SELECT k, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
parts AS (SELECT k, i, line, regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g') AS b,
                 len(regexp_extract_all(line, {_WORD})) AS n FROM lines),
judged AS (SELECT *, n > 0 AND (
      (length(regexp_replace(b, '[^|»›•·¦]', '', 'g')) >= 2
       AND 4 * length(regexp_replace(b, '[^|»›•·¦]', '', 'g')) >= n)
   OR (n < 6 AND NOT contains('.!?…:;"''”’»)]', right(b, 1)))
   OR 100 * length(regexp_replace(b, '[^!-/:-@\\[-`{{-~…“”‘’«»]', '', 'g')) > 20 * length(b)
   OR (n <= 30 AND regexp_matches(lower(line), '{_NOTICES}'))) AS fails FROM parts),
left_lines AS (SELECT k, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) FILTER (WHERE fails) AS gone,
                 coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT fails), '') AS clean,
                 count(*) FILTER (WHERE n > 0) - count(DISTINCT line) FILTER (WHERE n > 0) AS dup
               FROM judged GROUP BY k),
spans AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS s
          FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT k, i FROM spans QUALIFY count(*) OVER (PARTITION BY k, s) > 1),
reps AS (SELECT k, sum(least(8, coalesce(i - prev, 8))) AS r
         FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM twice) GROUP BY k),
base AS (SELECT d.k, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, dup, coalesce(r, 0) AS r,
                gone, lost, length(clean) AS clean_chars
         FROM d JOIN left_lines USING (k) LEFT JOIN reps USING (k))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(r AS BIGINT) AS n_repeat_words,
       (n_words < 20 OR 100 * r > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * r > 30 * n_words) AND 100 * lost <= 50 * n_words AS kept,
       CAST(gone AS BIGINT) AS n_removed_lines, CAST(lost AS BIGINT) AS n_removed_words,
       CAST(clean_chars AS BIGINT) AS clean_chars
FROM base"""
SQL["op2_quality_rules"] = QUALITY

# Every run of ten words or more that an earlier place has; a longer run is made of such runs of at most ten lines.
SQL["op5_line_dedup"] = f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM t),
n AS (SELECT doc_id, line_no, line, len(regexp_extract_all(line, {_WORD})) AS w FROM e),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS place FROM n WHERE w > 0),
d AS (SELECT doc_id, list(line ORDER BY place) AS ls, list(w ORDER BY place) AS ws FROM s GROUP BY doc_id),
i AS (SELECT doc_id, ls, ws, unnest(range(len(ls))) AS place FROM d),
r AS (SELECT *, unnest(range(1, 1 + least(10, len(ls) - place))) AS k FROM i),
spans AS (SELECT doc_id, place, k, array_to_string(ls[place + 1:place + k], chr(10)) AS body FROM r WHERE list_sum(ws[place + 1:place + k]) >= 10),
later AS (SELECT doc_id, place, k FROM spans QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, place) > 1),
covered AS (SELECT DISTINCT doc_id, place + unnest(range(k)) AS place FROM later),
gone AS (SELECT c.doc_id, c.place, s.line_no, coalesce(lag(c.place) OVER (PARTITION BY c.doc_id ORDER BY c.place) + 1 <> c.place, true) AS fresh
         FROM covered c JOIN s ON s.doc_id = c.doc_id AND s.place = c.place)
SELECT doc_id, count(*) AS n_removed, CAST(count(*) FILTER (WHERE fresh) AS BIGINT) AS n_runs,
       string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) AS removed_lines
FROM gone GROUP BY doc_id"""

SQL["op3_ngram_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM d),
n AS (SELECT doc_id, len(s) AS n FROM g),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM g),
o AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
k AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
m AS (SELECT a, count(*) AS c FROM l GROUP BY a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, component_id, CAST(coalesce(m.c, 0) AS BIGINT) AS n_links
FROM n JOIN k ON k.a = n.doc_id LEFT JOIN m ON m.a = n.doc_id"""
