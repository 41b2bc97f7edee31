"""Oracle SQL (DuckDB dialect) for the queries that SQL can express on whole tables."""

ORACLES = {
    "op1_chat_formatting": r"""WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS turns,
         2 + length(replace(replace(replace(role, '\', '\\'), '|', '\p'), chr(10), '\n')) + 3
           + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\])|\|)', '\1\\\2\3', 'g')) + 5
           AS chars
  FROM given
),
grown AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM placed
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR place = turns) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id""",
    "op3_suffix_dedup": """WITH bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
),
strings AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM bytes)
),
firsts AS (SELECT s, min(doc_id) AS f FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT doc_id, p FROM strings JOIN firsts USING (s) WHERE doc_id > f),
stepped AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM hits
),
numbered AS (
  SELECT doc_id, p, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END)
           OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM stepped
),
runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, run
),
pieces AS (
  SELECT doc_id, b AS start, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS stop FROM runs
  UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id
),
left_over AS (
  SELECT k.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (coalesce(stop, length(h) // 2) - start)), ''
           ORDER BY start) AS kept
  FROM pieces k JOIN bytes b ON k.doc_id = b.doc_id GROUP BY k.doc_id
),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT bytes.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM bytes LEFT JOIN sums ON bytes.doc_id = sums.doc_id
LEFT JOIN left_over ON bytes.doc_id = left_over.doc_id""",
    "op12_prefix_trie": """WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
),
marked AS (
  SELECT *, sha256(strlen(role) || ':' || role || strlen(text) || ':' || text) AS mark FROM given
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
                               ORDER BY turn NULLS FIRST, role, substr(mark, 1, 32)) AS place
  FROM marked
),
spelled AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM given),
convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(range(1, length(s) + 1),
             lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 6 AS h
  FROM spelled
),
taken AS (
  SELECT c.conv_id, b.place, b.mark, length(b.text) AS chars
  FROM convs c JOIN placed b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.place <= c.h
  UNION ALL
  SELECT p.conv_id, p.place, p.mark, length(p.text)
  FROM placed p JOIN convs c ON p.conv_id = c.conv_id WHERE p.place > c.h
),
prefixes AS (
  SELECT conv_id, chars, row_number() OVER w AS depth, sha256(string_agg(mark, '') OVER w) AS node
  FROM taken WINDOW w AS (PARTITION BY conv_id ORDER BY place)
),
members AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS chars FROM convs
  UNION ALL
  SELECT conv_id, depth, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth), chars
  FROM prefixes
),
nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * max(chars) AS saved
  FROM members GROUP BY depth, node
),
children AS (
  SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children
  FROM nodes WHERE depth > 0 GROUP BY ALL
),
counted AS (SELECT * FROM nodes LEFT JOIN children USING (depth, node)),
ended AS (
  SELECT depth, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM members GROUP BY conv_id)
  GROUP BY depth, node
),
sums AS (
  SELECT m.depth, m.node, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves,
         sum(c.saved) AS saved_tokens
  FROM counted c JOIN members m ON m.conv_id = c.conv_id AND m.depth <= c.depth
  GROUP BY m.depth, m.node
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, c.n_convs,
       coalesce(c.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.node = c.node
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.node = c.parent
LEFT JOIN ended e ON e.depth = c.depth AND e.node = c.node""",
    "op13_fill_in_middle": """WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents
),
cut AS (
  SELECT *, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS one,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS two,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM drawn
),
formed AS (
  SELECT *, least(one, two) AS low, greatest(one, two) AS high,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parts AS (
  SELECT *, substr(text, 1, low) AS prefix, substr(text, low + 1, high - low) AS middle,
         substr(text, high + 1) AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""",
    "url_rules": r"""WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict
FROM ruled""",
    "quality_counts": r"""WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
),
told AS (
  SELECT r, doc_id, words, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         [line for line in string_split(text, chr(10)) if regexp_matches(line, '[^\x20\x09-\x0D]')] AS lines
  FROM given
),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS text
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM given)
),
again AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, text) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(5) steps(k) GROUP BY r),
counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM told LEFT JOIN covered USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN false END AS base_kept
FROM counted""",
}
