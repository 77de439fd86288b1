"""DuckDB SQL for those queries that SQL can express."""

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ENDS = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

EXACT_DEDUP = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

LINE_DEDUP = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, {_LOWER.format(_ENDS.format('line'))} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""

MIXING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
                  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS shuffle FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
p AS (SELECT arg_min(level, cap / weight) FILTER (WHERE level * weight < cap) AS final FROM o),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR final * weight >= cap THEN CAST(cap AS DOUBLE) ELSE final * weight END AS target FROM o, p),
q AS (SELECT r, doc_id, size, shuffle, source_size, target,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size, r ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0 THEN CAST(turn * source_size + upto AS DOUBLE) / target ELSE 0 END AS finish
      FROM (SELECT *, unnest(CASE WHEN size = 0 THEN [0] ELSE [0, 1] END) AS turn FROM q)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, shuffle, doc_id, size, r, turn ROWS UNBOUNDED PRECEDING) <= 1.5::DOUBLE * (SELECT sum(size) FROM d) AS served FROM e)
SELECT doc_id, size, source_size, target, count(*) FILTER (WHERE served) AS turns, CAST(size * count(*) FILTER (WHERE served) AS BIGINT) AS taken
FROM c GROUP BY r, doc_id, size, source_size, target
"""

_AHEAD = ", ".join(f"lead(word, {k}) OVER (PARTITION BY r ORDER BY i)" for k in range(1, 8))
QUALITY_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
e AS (SELECT r, i, concat_ws(' ', word, {_AHEAD}) AS eight, lead(i, 7) OVER (PARTITION BY r ORDER BY i) AS last FROM w),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, eight) AS n FROM e WHERE last IS NOT NULL),
c AS (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS covered FROM g WHERE n > 1),
m AS (SELECT r, sum(covered) AS n_repeat_words FROM c GROUP BY r),
l AS (SELECT r, doc_id, source, unnest(lines) AS line FROM d),
x AS (SELECT r, doc_id, source, line, {_LOWER.format(_ENDS.format('line'))} AS key, len(regexp_extract_all(line, '{_WORD}')) AS n FROM l
      WHERE regexp_matches(line, '{_WORD}')),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM x GROUP BY r),
o AS (SELECT source, count(*) AS host_rows FROM documents GROUP BY source),
f AS (SELECT source, key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM x GROUP BY source, key) c
      WHERE n > 5 AND 100 * n > 2 * (SELECT host_rows FROM o WHERE o.source IS NOT DISTINCT FROM c.source)),
z AS (SELECT r, sum(n) AS n_common_words FROM x JOIN f ON x.key = f.key AND x.source IS NOT DISTINCT FROM f.source GROUP BY r),
b AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_common_words, 0) AS BIGINT) AS n_common_words
      FROM d LEFT JOIN m USING (r) LEFT JOIN u USING (r) LEFT JOIN z USING (r)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (n_common_words > 0 AND (n_words - n_common_words < 10 OR 100 * (n_words - n_common_words) < 20 * n_words)) AS kept,
       n_common_words
FROM v
"""

_MARKS = r"^(?:[\x20\x09]*>)+"
CHAT = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, * FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
m AS (SELECT *, length(regexp_replace(regexp_extract(line, '{_MARKS}'), '[^>]', '', 'g')) AS level,
             {_LOWER.format("trim(regexp_replace(regexp_replace(line, '" + _MARKS + "', ''), '" + _SPACE + "', ' ', 'g'))")} AS normal FROM l),
a AS (SELECT *, normal = '' OR lag(normal, 1, '') OVER o = '' OR lag(level) OVER o <> level AS opens
      FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS passage FROM a),
w AS (SELECT r, conv_id, turn, level, passage, string_agg(normal, ' ' ORDER BY i) AS normal, count(*) AS n FROM b WHERE normal <> '' GROUP BY ALL),
k AS (SELECT r, conv_id, turn, level, passage, TRUE AS whole, normal FROM w
      UNION ALL SELECT r, conv_id, turn, level, passage, FALSE, b.normal FROM b JOIN w USING (r, conv_id, turn, level, passage)
      WHERE w.n > 1 AND b.normal <> '' AND len(string_split(b.normal, ' ')) >= 3),
q AS (SELECT row_number() OVER () AS id, * FROM k WHERE level > 0),
s AS (SELECT q.id, max(o.turn) AS source FROM q JOIN k o ON o.conv_id = q.conv_id AND o.normal = q.normal AND o.level = 0 AND o.turn < q.turn GROUP BY q.id),
f AS (SELECT *, bool_or(whole) OVER (PARTITION BY r, passage) AS has_whole FROM q JOIN s USING (id)),
g AS (SELECT conv_id, turn, level, source, length(normal) AS size FROM f WHERE whole OR NOT has_whole),
v AS (SELECT conv_id, turn, source, sum(CASE WHEN level = 1 THEN size ELSE 0 END) AS chars, count(*) AS n FROM g GROUP BY ALL),
x AS (SELECT conv_id, turn, string_agg(level || ':' || source, ',' ORDER BY level, source) AS origins FROM (SELECT DISTINCT conv_id, turn, level, source FROM g) GROUP BY ALL),
p AS (SELECT conv_id, turn, sum(n) AS n_linked, (max(struct_pack(chars := chars, source := source)) FILTER (WHERE chars > 0)).source AS parent_turn FROM v GROUP BY ALL),
e AS (SELECT * FROM p WHERE parent_turn IS NOT NULL),
t AS (SELECT conv_id, turn, parent_turn AS up, 1 AS depth FROM e
      UNION ALL SELECT t.conv_id, t.turn, e.parent_turn, t.depth + 1 FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn = t.up),
z AS (SELECT DISTINCT conv_id, turn, [turn] AS path FROM d ANTI JOIN e USING (conv_id, turn) WHERE conv_id IS NOT NULL AND turn IS NOT NULL
      UNION ALL SELECT e.conv_id, e.turn, list_append(z.path, e.turn) FROM z JOIN e ON e.conv_id = z.conv_id AND e.parent_turn = z.turn),
y AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM z),
h AS (SELECT conv_id, turn, min(up) AS thread_root, max(depth) AS depth FROM t GROUP BY ALL),
c AS (SELECT r, count(*) FILTER (WHERE level > 0) AS n_quoted, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS clean_text FROM m GROUP BY r)
SELECT d.conv_id, d.turn, d.role, p.parent_turn, y.position, coalesce(x.origins, '') AS origins, coalesce(h.thread_root, d.turn) AS thread_root, CAST(coalesce(h.depth, 0) AS BIGINT) AS depth,
       CAST(coalesce(c.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked, c.clean_text
FROM d LEFT JOIN c USING (r) LEFT JOIN p ON p.conv_id = d.conv_id AND p.turn = d.turn LEFT JOIN x ON x.conv_id = d.conv_id AND x.turn = d.turn
LEFT JOIN y ON y.conv_id = d.conv_id AND y.turn = d.turn LEFT JOIN h ON h.conv_id = d.conv_id AND h.turn = d.turn
"""

_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_CRC = f"""xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({_KEY}) + 1), lambda i: CAST(ascii(substr({_KEY}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: xor(x >> 1, 3988292384::BIGINT * (x & 1)))))"""
_PAID = "CASE WHEN must THEN 1000000 WHEN cut THEN 5 ELSE 0 END"

#: Costs and grammar of the repair: states 0 nothing yet, 1 after s, 2 after u, 3 after a; `back` holds what is left to pay
#: after i rows, `ahead` walks by the least tight letter.
CHAT_REPAIR = f"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE kind <> 0),
ids AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
o AS (SELECT k, turn, role, text, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i
      FROM e JOIN ids ON e.conv_id IS NOT DISTINCT FROM ids.conv_id),
f AS (SELECT *, {_ENDS.format('text')} = '' AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 AS again,
             right({_ENDS.format('text')}, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS x, left(lag(role) OVER (PARTITION BY k ORDER BY i), 1) AS px FROM o),
r AS MATERIALIZED (SELECT k, i, turn, role, text, blank OR again AS must, cut, x, blank, again, px,
             CASE x WHEN 's' THEN [1, NULL, NULL, NULL] WHEN 'u' THEN [2, 2, NULL, 2] WHEN 'a' THEN [NULL, NULL, 3, NULL] ELSE [NULL, NULL, NULL, NULL] END AS keeps FROM f),
n AS (SELECT ids.k, count(i) AS n FROM ids LEFT JOIN r ON ids.k = r.k GROUP BY ids.k),
back AS (
  SELECT k, n AS i, [0, 10, 5, 0]::BIGINT[] AS v FROM n
  UNION ALL
  SELECT k, i, list_transform([2, 2, 3, 2], lambda t, s: least(w[s], 5 + w[t + 1])) FROM (
    SELECT k, i, list_transform([2, 2, 3, 2], lambda t, s: least(a[s], 5 + a[t + 1])) AS w FROM (
      SELECT back.k, back.i - 1 AS i, list_transform([2, 2, 3, 2], lambda t, s: least(2 + v[s], 1 + {_PAID} + v[t + 1], coalesce({_PAID} + v[keeps[s] + 1], 1000000)))::BIGINT[] AS a
      FROM back JOIN r ON r.k = back.k AND r.i = back.i))),
p AS MATERIALIZED (SELECT b.k, b.i, b.v, c.v AS next, r.role, r.text, r.keeps, {_PAID} AS paid FROM back b
      LEFT JOIN back c ON c.k = b.k AND c.i = b.i + 1 LEFT JOIN r ON r.k = b.k AND r.i = b.i + 1),
ahead AS (
  SELECT k, 0::BIGINT AS i, 0 AS s, 0 AS step, '' AS letter, NULL::VARCHAR AS line, 0::BIGINT AS cost FROM ids
  UNION ALL
  SELECT k, i + CAST(letter <> 'I' AS BIGINT), CASE letter WHEN 'D' THEN s WHEN 'K' THEN keeps[s + 1] ELSE [2, 2, 3, 2][s + 1] END, step + 1, letter,
         CASE letter WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE WHEN s = 2 THEN 'assistant:' ELSE 'user:' END || CASE letter WHEN 'R' THEN text ELSE '' END END,
         CASE letter WHEN 'D' THEN 2 WHEN 'I' THEN 5 WHEN 'K' THEN paid ELSE 1 + paid END
  FROM (SELECT ahead.k, ahead.i, s, step, role, text, keeps, paid,
               CASE WHEN next IS NULL THEN 'I' WHEN 2 + next[s + 1] = v[s + 1] THEN 'D' WHEN 5 + v[[2, 2, 3, 2][s + 1] + 1] = v[s + 1] THEN 'I'
                    WHEN paid + next[keeps[s + 1] + 1] = v[s + 1] THEN 'K' ELSE 'R' END AS letter
        FROM ahead JOIN p ON p.k = ahead.k AND p.i = ahead.i WHERE next IS NOT NULL OR s IN (1, 2))),
w AS (SELECT k, CAST(sum(cost) AS BIGINT) AS cost, string_agg(letter, '' ORDER BY step) AS audit, coalesce(string_agg(line, chr(10) ORDER BY step), '') AS lines FROM ahead GROUP BY k),
c AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
             count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE px IS NOT NULL AND px || x NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, cost, audit, sha256(lines) AS repaired_sha256
FROM ids JOIN w USING (k) LEFT JOIN c USING (k)
"""


def _round(r: int) -> str:
    """Nearest entries and moved entries of one round; a distance and an index in one number, whose least is the answer."""
    return f"""
a{r} AS MATERIALIZED (SELECT r, part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry)::BIGINT AS m FROM p JOIN b{r} USING (part) GROUP BY r, part),
s{r} AS (SELECT part, m % 64 AS entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS BIGINT) AS c FROM a{r} JOIN p USING (r, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS pos) GROUP BY part, m % 64, pos),
m{r} AS (SELECT part, entry, list(c ORDER BY pos) AS c FROM s{r} GROUP BY part, entry),
b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN m{r} USING (part, entry)),"""


VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM k),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x FROM n, (SELECT unnest(range(16)) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 64),{_round(0)}{_round(1)}
a2 AS (SELECT r, part, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + entry)::BIGINT AS m FROM p JOIN b2 USING (part) GROUP BY r, part),
f AS (SELECT r, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
h AS (SELECT sha256(array_to_string(flatten(list(c ORDER BY part, entry)), ',')) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM n JOIN f USING (r), h
"""

ORACLES = {
    "op2_chat_formatting": CHAT,
    "op3_mixing": MIXING,
    "op4_quality_rules": QUALITY_RULES,
    "op5_line_dedup": LINE_DEDUP,
    "op7_exact_dedup": EXACT_DEDUP,
    "op12_conversation_repair": CHAT_REPAIR,
    "op13_vector_codes": VECTOR_CODES,
}
