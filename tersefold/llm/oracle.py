"""The queries that SQL can express, in the dialect of the checking engine."""

WORD = r"'[^\x20\x09-\x0D]+'"
SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP2 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### : </turn>' || chr(10)) + length(role)
      + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(x, y) AS (
  SELECT doc_id, doc_id FROM n
  UNION SELECT r.x, l.b FROM reach r JOIN both_ways l ON r.y = l.a)
SELECT doc_id, n AS n_shingles, least_id AS component_id, least_id = doc_id AS kept
FROM n JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) ON x = doc_id
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORD}))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS g
  FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][g % 3 + 1] AS w, 3 * source_size AS most FROM s),
ahead AS (
  SELECT *, coalesce(sum(most) OVER r, 0) AS most_ahead, coalesce(sum(w) OVER r, 0) AS w_ahead,
    sum(source_size) OVER () AS total, sum(w) OVER () AS w_all
  FROM w WINDOW r AS (ORDER BY most / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (
  SELECT *, most::DOUBLE * (w_all - w_ahead)::DOUBLE < w::DOUBLE * (total - most_ahead)::DOUBLE AS capped FROM ahead),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN most::DOUBLE ELSE
    (w * (total - coalesce(sum(most) FILTER (capped) OVER (), 0)))::DOUBLE
    / greatest(w_all - coalesce(sum(w) FILTER (capped) OVER (), 0), 1)::DOUBLE END AS target FROM capped),
b AS (SELECT *, round(target)::BIGINT AS budget FROM t),
placed AS (
  SELECT doc_id, size, source, sum(size) OVER (PARTITION BY source ORDER BY md5('mix-1:' || doc_id), doc_id, size
    ROWS UNBOUNDED PRECEDING) - size AS ahead FROM d)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE
  (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END)::BIGINT AS taken
FROM placed JOIN b ON placed.source IS NOT DISTINCT FROM b.source
"""

OP5 = r"""
WITH RECURSIVE bits(byte, k, x) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT byte, k + 1, xor(x >> 1, (x & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY byte) AS crc FROM bits WHERE k = 8),
digits AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
d AS (
  SELECT doc_id, size::BIGINT AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM digits, crc),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS ahead,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) AS place, sum(size) OVER () AS total FROM d),
cut AS (SELECT *, (ahead * 8 // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INTEGER AS grown_shard FROM cut
"""


def _op10() -> str:
    from . import quality_rules as rules

    chars = f"length(translate({{}}, {SPACES}, ''))"
    symbols = "length({0}) - length(translate({0}, '" + rules.SYMBOLS + "', ''))"
    bars = "(length(line) - length(translate(line, '|>»•', '')))"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, {WORD}) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE translate(line, {SPACES}, '') <> ''),
judged AS (
  SELECT doc_id, line, {chars.format('line')} AS chars,
    ({bars} >= {rules.NAV_SEPARATORS} AND len(w) <= {bars} * {rules.NAV_WORDS_EACH})
    OR ({symbols.format('line')}) * 100 > {chars.format('line')} * {rules.MAX_SYMBOL_PCT}
    OR (length(line) <= {rules.BOILERPLATE_CHARS} AND regexp_matches(lower(line), '{'|'.join(rules.BOILERPLATE)}'))
    OR (len(w) >= {rules.MIN_RULE_WORDS} AND NOT regexp_matches(line, '[.,;:!?…。！？।؟]'))
    OR (len(w) >= {rules.MIN_RULE_WORDS} AND len(list_distinct(w)) * 100 < len(w) * {rules.MIN_DISTINCT_PCT}) AS fails
  FROM lines),
by_line AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    coalesce(sum(chars) FILTER (NOT fails), 0)::BIGINT AS left_chars FROM judged GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM windows) WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, {chars.format('text')}::BIGINT AS word_chars,
    ({symbols.format('text')})::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words, coalesce(left_chars, 0) AS left_chars
  FROM d LEFT JOIN by_line USING (doc_id) LEFT JOIN repeated USING (doc_id)),
base AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {rules.MAX_REPEAT_PCT} AS base_failed
  FROM counts)
SELECT *, NOT base_failed AND left_chars * 100 >= word_chars * {rules.MIN_LEFT_PCT} AS kept FROM base
"""


OP11 = rf"""
WITH RECURSIVE bits(byte, k, x) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT byte, k + 1, xor(x >> 1, (x & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(x ORDER BY byte) AS crc FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS o,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(doc_id::VARCHAR, '.'),
      lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
n AS (SELECT doc_id, o, len(o) AS n, h // 10 AS g, h % 10 = 0 AND len(o) > 0 AS plants FROM d),
p AS (
  SELECT doc_id, o, n, CASE WHEN plants THEN g % n ELSE n END AS a,
    CASE WHEN plants THEN 1 + (n - g % n) // (3 + g % 8) ELSE 1 END AS p FROM n),
w AS (
  SELECT doc_id, n, i, o[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x
  FROM (SELECT *, unnest(range(n)) AS i FROM p)),
again AS (
  SELECT u.doc_id, u.i, v.i - u.i AS q FROM w u JOIN w v ON u.doc_id = v.doc_id AND u.x = v.x AND u.i < v.i
  WHERE 4 * (v.i - u.i) <= u.n),
stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM again)
  GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length),
by_doc AS (
  SELECT doc_id, count(*) AS n_runs, arg_max({{'s': start, 'l': length, 'p': period}}, [length, -start, -period]) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM runs GROUP BY doc_id),
dropped AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM w ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
  1000 * best.l // best.p AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP12 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), {TERM}) AS t FROM documents),
c AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS terms FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n
  FROM (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, c GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS again FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), {TERM})) AS term FROM benchmark) GROUP BY item_id, term),
s AS (
  SELECT item_id, doc_id, sum(again * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT
    AS score FROM q JOIN tf USING (term) JOIN w USING (term), c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 20
"""

OP13 = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
m AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE doc_id > first),
marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM m),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, min(i) AS b, max(i) + 50 AS e FROM numbered GROUP BY doc_id, k),
ends AS (SELECT doc_id, b, e FROM spans UNION ALL SELECT doc_id, n, n FROM d),
pieces AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b, e), 0) AS a FROM ends),
r AS (
  SELECT doc_id, any_value(n) AS n, sum(e - b)::BIGINT AS n_removed, count(*) FILTER (e > b) AS n_spans,
    string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY b, e) AS kept
  FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM r
"""


SQL = {
    "op2_chat_format": OP2, "op4_near_dup": OP4, "op5_sharding": OP5, "op6_mixing": OP6, "op10_quality_rules": _op10(),
    "op11_periodic_runs": OP11, "op12_lexical_search": OP12,
    "op13_suffix_dedup": OP13,
}
