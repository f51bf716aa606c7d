"""The registered queries in plain SQL over the given tables, for a second engine."""

from __future__ import annotations

from ..functions import fixed
from .inputs import (
    COMMANDS, CONTROL, CONVERSATIONS, LATE_OF, LINES_PER_OUTPUT, LOG_DOCUMENTS, OWN_NAMES, PARTS, PASS, START, WRAP_MARKER,
)

NL = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(names) -> str:
    return ", ".join(_q(n) for n in names)


# --- inputs ---------------------------------------------------------------

OUTPUTS = f"""
SELECT doc_id * 2 + pass AS output_id, {START} + 60 * doc_id + 2592000 * pass AS ts_s,
       2 * (pass * {PASS} + doc_id) AS seq, 'all' AS scope, cmd, family, expected_json,
       CASE WHEN doc_id % 3 = 0 THEN chr(27) || '[32m' || body || chr(27) || '[0m' || repeat({NL}, 5) || 'end'
            ELSE body END AS text
FROM (
  SELECT doc_id, unnest([0, 1]) AS pass,
         CASE doc_id % 6 WHEN 0 THEN 'git diff' WHEN 1 THEN 'cargo build' WHEN 2 THEN '/usr/bin/pytest -q'
              WHEN 3 THEN 'npm install' WHEN 4 THEN 'curl -s host' ELSE 'cat src/f' || (doc_id % 10) || '.py' END AS cmd,
         CASE doc_id % 6 WHEN 0 THEN 'diff' WHEN 1 THEN 'build' WHEN 2 THEN 'test'
              WHEN 3 THEN 'package' ELSE 'other' END AS family,
         CASE WHEN doc_id % 12 = 4 THEN '{{"id":' || doc_id || ',"tags":["' || lang || '"],"user":{{"n":'
              || n_chars || '}},"text":' || to_json(text)::VARCHAR || '}}' || {NL} END AS expected_json,
         CASE WHEN doc_id % 6 = 0 THEN 'diff --git a/f b/f' || {NL} || replace(text, '. ', '.' || {NL} || ' ')
              WHEN doc_id % 6 = 1 THEN repeat('   Compiling dep v1.0' || {NL}, CAST(doc_id % 7 AS INT)) || text || {NL}
                || '   Compiling app v2.0' || {NL} || ' --> src/f' || (doc_id % 10) || '.py:3:1' || {NL}
                || 'at src/f' || (doc_id % 7) || '.py:10' || {NL}
              WHEN doc_id % 6 = 2 THEN 'platform linux' || {NL} || repeat('PASSED tests/a' || {NL}, CAST(doc_id % 5 AS INT))
                || 'collected 3 items' || {NL} || text || {NL} || 'FAILED tests/x' || {NL} || text || {NL}
                || 'PASSED tests/z' || {NL}
              WHEN doc_id % 6 = 3 THEN repeat('npm WARN deprecated' || {NL}, CAST(doc_id % 4 AS INT)) || text || {NL}
                || 'added 3 packages' || {NL} || 'found 0 vulnerabilities' || {NL}
              WHEN doc_id % 12 = 4 THEN '{{"id": ' || doc_id || ', "note": null, "tags": [null, "' || lang
                || '", null], "user": {{"n": ' || n_chars || ', "bio": null}}, "text": '
                || replace(to_json(text)::VARCHAR, 'é', '\\u00e9') || '}}'
              WHEN doc_id % 6 = 4 THEN text || repeat({NL} || 'WARNING: deprecated call', CAST(doc_id % 20 AS INT))
              ELSE replace(text, ' ', {NL}) END AS body
  FROM documents)
"""

CONTROL_SQL = " UNION ALL ".join(
    f"SELECT 'all' AS scope, {2 * (PASS + k) + 1} AS seq, '{kind}' AS kind" for k, kind in CONTROL)


def _event_lines(line: str) -> str:
    return (f"SELECT event_id // {LINES_PER_OUTPUT} AS output_id, event_id % {LINES_PER_OUTPUT} AS pos, "
            f"{line} || {NL} AS line FROM events")


BUILD_LINES = _event_lines(
    "CASE event_type WHEN 'error' THEN 'error[E' || event_id || ']: mismatched types' "
    "ELSE '   Compiling part-' || event_id || ' v1' END")
PACKAGE_LINES = _event_lines(
    "CASE event_type WHEN 'error' THEN 'npm ERR! code E' || event_id "
    "WHEN 'view' THEN 'npm WARN deprecated part-' || event_id WHEN 'click' THEN 'added ' || event_id || ' packages' "
    "WHEN 'signup' THEN 'packages are funding' ELSE 'found ' || event_id || ' issues' END")
DIFF_LINES = _event_lines(
    "CASE event_type WHEN 'error' THEN '+add ' || event_id WHEN 'view' THEN chr(9) || 'ctx ' || event_id "
    "ELSE ' ctx ' || event_id END")
TEST_LINES = _event_lines(
    "CASE event_type WHEN 'view' THEN 'PASSED tests/t.py::t' || event_id "
    "WHEN 'click' THEN 'tests/t.py line ' || event_id WHEN 'signup' THEN '  collected ' || event_id || ' items' "
    "WHEN 'purchase' THEN event_id || ' passed so far' "
    "ELSE CASE WHEN event_id % 5 = 0 THEN 'FAILED tests/t.py::t' || event_id ELSE 'E   assert ' || event_id END END")
CONVERSATION_LINES = f"""
SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY turn, i) - 1 AS pos, piece || {NL} AS line
FROM (SELECT conv_id AS output_id, turn, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n
      FROM (SELECT *, string_split('[' || role || ']' || {NL} || text, {NL}) AS p FROM conversations))
WHERE i < n OR piece <> ''
"""

SPREAD = f"replace(text, ' ', {NL})"
ESCAPED = (f"replace(replace({SPREAD}, {NL} || 'the' || {NL}, {NL} || chr(27) || ']0;the' || {NL}), "
           f"'.' || {NL}, '.' || chr(7) || {NL})")
LINE_END_TEXT = (
    f"'step 1' || chr(13) || {NL} || {NL} || {NL} || {NL} || replace(text, ' ', chr(13)) || chr(13) || chr(27) || '[0m' || {NL} "
    f"|| chr(11) || {NL} || {NL} || {NL} || chr(133) || {NL} || replace(text, '. ', '.' || chr(8232)) || repeat(chr(13), 4) || doc_id")
OVER_LINES = f"""
SELECT doc_id AS output_id, CASE doc_id % 5
    WHEN 0 THEN {NL} || '{{' || {NL} || '  "id": ' || doc_id || ',' || {NL} || '  "note": null,' || {NL} || '  "tags": [' || {NL}
      || '    null,' || {NL} || '    "x"' || {NL} || '  ],' || {NL} || '  "text": ' || replace(to_json(text)::VARCHAR, 'é', '\\u00e9')
      || repeat(',' || {NL} || '  "gone": null', CAST(doc_id % 200 AS INT)) || {NL} || '}}' || {NL} || {NL}
    WHEN 1 THEN 'a' || chr(27) || '[32m' || chr(27) || ']8;;' || {ESCAPED} || chr(7) || ' end' || {NL}
    WHEN 2 THEN {ESCAPED} || {NL} || chr(27) || ']open' || chr(27) || '[0m' || {NL} || 'rest' || {NL} || {NL} || {NL} || {NL}
    WHEN 3 THEN {LINE_END_TEXT}
    ELSE {SPREAD} || chr(27) || ']0;a' || {NL} || 'b' || chr(7) || repeat({NL} || 'same' || chr(27) || ']' || {NL} || chr(7), CAST(doc_id % 9 AS INT))
      || {NL} END AS text,
  CASE WHEN doc_id % 5 = 0 THEN '{{"id":' || doc_id || ',"tags":["x"],"text":' || to_json(text)::VARCHAR || '}}' || {NL} END AS expected_json
FROM documents
"""

ODD = f"""
SELECT doc_id AS output_id, NULL AS expected_json, CASE doc_id % 8
    WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' ' || {NL} || chr(9) || chr(13) || {NL}
    WHEN 3 THEN '{{"a": null, "b": ' || replace(to_json(text)::VARCHAR, 'é', '\\u00e9')
    WHEN 4 THEN chr(27) || '[' || chr(27) || ']0;' || text || chr(27) || {NL} || chr(27) || '(' || repeat({NL}, 4)
    WHEN 5 THEN repeat('[', CAST(doc_id % 50 AS INT)) || text || repeat({NL} || chr(39) || '"', CAST(doc_id % 30 AS INT))
    WHEN 6 THEN repeat(chr(13), 4) || replace(text, ' ', {NL} || chr(13))
    ELSE '[null, ' || replace(to_json(text)::VARCHAR, 'é', '\\u00e9') || ', null] trailing' END AS text
FROM documents
"""

_case = " ".join(f"WHEN {i} THEN {_q(c)}" for i, (_, c) in enumerate(COMMANDS))
_tool = " ".join(f"WHEN {i} THEN {_q(t)}" for i, (t, _) in enumerate(COMMANDS))
COMMANDS_SQL = f"""
SELECT event_id, CASE event_id % 20 {_tool} END AS tool_name,
       CASE event_id % 20 {_case} END || CASE WHEN event_id % 20 IN (0, 1) THEN ' ' || event_id ELSE '' END AS command,
       event_id % 97 = 0 AS broken
FROM events
"""
REF_OUTPUTS = """
SELECT event_id AS output_id, event_id AS seq, 'all' AS scope,
       CASE WHEN event_type = 'view' THEN 'cat src/f' || (user_id % 10) || '.py' ELSE 'cargo build' END AS cmd,
       CASE WHEN event_type = 'view' THEN 'src/f' || (user_id % 10) || '.py' END AS path,
       '  --> src/f' || (event_id % 12) || '.py:3:1' || chr(10) || 'at src/f' || (event_id % 7) || '.py:10' || chr(10) AS text
FROM events
"""
LOG = f"""
SELECT {START} + 3600 * doc_id AS ts_s, CASE doc_id % 3 WHEN 0 THEN 'git' WHEN 1 THEN 'cargo' ELSE 'ls' END AS cmd,
       n_chars AS original_tokens, n_chars - n_chars * (doc_id % 10) // 10 AS compressed_tokens
FROM documents
"""

# --- rules ----------------------------------------------------------------

ANSI = r"'\x1b\[[0-9;]*[mGKHF]|\x1b\][^\x07]*\x07|\x1b[()][AB012]'"
STRIPPED = f"regexp_replace(text, {ANSI}, '', 'g')"
SECRET = (
    "'(?i)(?:api[_-]?key|secret|token|password|passwd|auth)[^\\n]{0,4}[:=]\\s*[''\"]?[A-Za-z0-9+/=_\\-]{16,}"
    "|sk-[A-Za-z0-9]{32,}|gh[pousr]_[A-Za-z0-9]{36,}|AKIA[A-Z0-9]{16}|eyJ[A-Za-z0-9_\\-]{20,}'")
CONTEXT_LINE = "(line LIKE ' %' OR line LIKE chr(9) || '%')"
BUILD_LINE = "starts_with(line, '   Compiling ')"
PACKAGE_LINE = r"regexp_matches(line, '\A(npm WARN|added \d|packages? are|found \d)')"
MARKER = "(" + " OR ".join(f"starts_with(line, {_q(m)})" for m in fixed.TEST_MARKERS) + ")"
TELLING = (
    "(starts_with(trim(line, chr(10) || chr(9) || ' '), 'collected') OR contains(line, 'passed') OR contains(line, 'failed')"
    " OR trim(line, chr(10) || chr(9) || ' ') = '' OR starts_with(line, 'platform') OR starts_with(line, 'rootdir'))")


def _kept(failing: str) -> str:
    return f"(NOT starts_with(line, 'PASSED ') AND ({failing} OR {TELLING}))"


def _runs(lines: str, keys: str, order: str, key: str, name: str = "r") -> str:
    """CTEs: every line with the number of its run, a run being equal non-null keys in a row."""
    return f"""
{name}_k AS (SELECT *, {key} AS key FROM ({lines})),
{name}_s AS (SELECT *, CASE WHEN key = lag(key) OVER (PARTITION BY {keys} ORDER BY {order}) THEN 0 ELSE 1 END AS s
             FROM {name}_k),
{name} AS (SELECT *, sum(s) OVER (PARTITION BY {keys} ORDER BY {order}) AS run FROM {name}_s)"""


def _line_fold(lines: str, key: str, folds: str, note: str) -> str:
    """Line tables in which a run that folds becomes one line at its last position."""
    return f"""WITH {_runs(lines, 'output_id', 'pos', key)},
g AS (SELECT *, count(*) OVER (PARTITION BY output_id, run) AS n,
             row_number() OVER (PARTITION BY output_id, run ORDER BY pos) AS k FROM r)
SELECT output_id, pos, CAST(0 AS BIGINT) AS part, CASE WHEN {folds} THEN {note} ELSE line END AS line
FROM g WHERE NOT ({folds}) OR k = n"""


REPEAT_KEY = "rtrim(line, chr(10))"


def _lines_of(source: str, text: str, keys: str) -> str:
    return f"""SELECT {keys}, i, piece || CASE WHEN i < n THEN {NL} ELSE '' END AS line
FROM (SELECT {keys}, unnest(p) AS piece, generate_subscripts(p, 1) AS i, len(p) AS n
      FROM (SELECT {keys}, string_split({text}, {NL}) AS p FROM {source}))
WHERE i < n OR piece <> ''"""


def _collapse(source: str, text: str, keys: str, name: str) -> str:
    """CTEs ending in `name`: keys and `folded`, the text with its repeats collapsed."""
    return f"""{_runs(_lines_of(source, text, keys), keys, 'i', REPEAT_KEY, name + '_r')},
{name} AS (
  SELECT {keys}, string_agg(t, '' ORDER BY run) AS folded
  FROM (SELECT {keys}, run, CASE WHEN count(*) >= 3 THEN min(rtrim(line, {NL})) || ' (×' || count(*) || ')' || {NL}
               ELSE string_agg(line, '' ORDER BY i) END AS t
        FROM {name}_r GROUP BY {keys}, run)
  GROUP BY {keys})"""


def _cut_lines(text: str) -> str:
    return f"""(SELECT CASE WHEN n > 500 THEN array_to_string(list_concat(p[1:200],
    ['[... ' || (n - 250) || ' lines truncated]'], p[n - 49:n]), {NL}) ELSE {text} END
  FROM (SELECT p, len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS n
        FROM (SELECT string_split({text}, {NL}) AS p)))"""


def _tokens(n: str) -> str:
    return f"CAST(greatest(1, ({n} + 3) // 4) AS BIGINT)"


def _pct(original: str, compressed: str) -> str:
    # Exact decimal ties go to even, as in the query.
    return (f"CASE WHEN {original} > 0 THEN round_even(({original} - {compressed})::DOUBLE / {original} * 100, 1) "
            "ELSE 0.0 END")


SAVINGS = f"""CAST(count(*) AS BIGINT) AS compressions,
CAST(coalesce(sum(original_tokens), 0) AS BIGINT) AS original_tokens,
CAST(coalesce(sum(compressed_tokens), 0) AS BIGINT) AS compressed_tokens,
CAST(coalesce(sum(original_tokens), 0) - coalesce(sum(compressed_tokens), 0) AS BIGINT) AS tokens_saved,
CAST({_pct('coalesce(sum(original_tokens), 0)', 'coalesce(sum(compressed_tokens), 0)')} AS DOUBLE) AS reduction_pct"""

_END = r"[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
_NO_END = _END.replace("[", "[^", 1)
ANY_LINES = f"'{_NO_END}*(?:\\r\\n|{_END})|{_NO_END}+'"


def _any_lines_of(source: str, text: str, keys: str) -> str:
    """Lines by every line end, with theirs."""
    return f"""SELECT {keys}, unnest(p) AS line, generate_subscripts(p, 1) AS i
FROM (SELECT {keys}, regexp_extract_all({text}, {ANY_LINES}) AS p FROM {source})"""


def _compact_other(outputs: str) -> str:
    """CTEs ending in `done`: texts of no family (output_id, text, expected_json) by every line end."""
    return f"""
outputs AS ({outputs}),
k AS (SELECT *, {STRIPPED} AS stripped FROM outputs),
b AS (
  SELECT output_id, stripped, regexp_replace(CASE WHEN length(rtrim(expected_json, {NL})) < length(trim(stripped, {NL})) * 0.9
    THEN expected_json ELSE stripped END, '\\n{{3,}}', {NL} || {NL}, 'g') AS t FROM k),
{_runs(_any_lines_of('b', 't', 'output_id'), 'output_id', 'i', REPEAT_KEY)},
f AS (
  SELECT output_id, list(t ORDER BY run) AS parts FROM (
    SELECT output_id, run, CASE WHEN count(*) >= 3 THEN min(rtrim(line, {NL})) || ' (×' || count(*) || ')' || {NL}
      ELSE string_agg(line, '' ORDER BY i) END AS t FROM r GROUP BY output_id, run) GROUP BY output_id),
l AS (SELECT output_id, array_to_string(parts, '') AS folded,
        regexp_extract_all(array_to_string(parts, ''), {ANY_LINES}) AS p FROM f),
e AS (SELECT *, list_transform(p, lambda x: regexp_replace(x, '(\\r\\n|{_END})$', '')) AS bare, len(p) AS n FROM l),
c AS (
  SELECT output_id, CASE WHEN n > 500 THEN array_to_string(list_concat(bare[1:200],
    ['[... ' || (n - 250) || ' lines truncated]'], bare[n - 49:n]), {NL}) ELSE folded END AS result FROM e),
done AS (
  SELECT b.output_id, length(c.result) < length(b.stripped) AS shrinks, k.text, b.stripped,
    CASE WHEN length(c.result) < length(b.stripped) THEN c.result ELSE b.stripped END AS result
  FROM b JOIN c ON b.output_id = c.output_id JOIN k ON k.output_id = b.output_id)"""


LOG_FILES = f"""
SELECT doc_id // {LOG_DOCUMENTS} AS id, string_agg({LINE_END_TEXT} || chr(30), '' ORDER BY doc_id) AS text FROM documents GROUP BY 1"""
TURN_FILES = f"""
SELECT conv_id // {CONVERSATIONS} AS output_id, string_agg(text || {NL}, '' ORDER BY conv_id, turn, text) AS text,
  NULL AS expected_json FROM conversations GROUP BY 1"""

# --- whole compaction -------------------------------------------------------

FOLD = f"""
outputs AS ({OUTPUTS}),
keyed AS (SELECT *, sha256(stripped) AS fp FROM (SELECT *, {STRIPPED} AS stripped FROM outputs)),
texts AS (SELECT fp, family, any_value(stripped) AS stripped, any_value(expected_json) AS expected_json
          FROM keyed GROUP BY fp, family),
{_runs(_lines_of('texts', 'stripped', 'fp, family'), 'fp, family', 'i',
       f"CASE family WHEN 'diff' THEN CASE WHEN {CONTEXT_LINE} THEN 1 END WHEN 'build' THEN CASE WHEN {BUILD_LINE} THEN 1 END "
       f"WHEN 'package' THEN CASE WHEN {PACKAGE_LINE} THEN 1 END WHEN 'test' THEN CASE WHEN NOT {MARKER} THEN 1 END END", 'f')},
f_total AS (SELECT *, max(i) OVER (PARTITION BY fp, family) AS total,
                   CASE WHEN family = 'test' AND key = 1 THEN CASE WHEN run = 1 THEN {_kept('false')} ELSE {_kept('true')} END
                        ELSE true END AS kept FROM f),
f_runs AS (
  SELECT fp, family, run, max(key) AS key, count(*) AS n, arg_min(line, i) AS first, arg_max(line, i) AS last,
         string_agg(line, '' ORDER BY i) AS whole,
         coalesce(string_agg(line, '' ORDER BY i) FILTER (kept), '') AS kept,
         count(*) FILTER (NOT kept) AS dropped, max(i) = max(total) AS closing
  FROM f_total GROUP BY fp, family, run),
by_family AS (
  SELECT fp, family, string_agg(CASE
    WHEN key IS NULL THEN whole
    WHEN family = 'diff' THEN CASE WHEN n > 3 THEN first || '  ... (' || (n - 2) || ' unchanged lines)' || {NL} || last ELSE whole END
    WHEN family = 'build' THEN '   Compiling ... (' || n || ' crates)' || {NL}
    WHEN family = 'package' THEN '[npm: ' || n || ' info lines omitted]' || {NL}
    ELSE kept || CASE WHEN dropped = 0 THEN '' WHEN closing THEN '[' || dropped || ' lines omitted]' || {NL}
                      ELSE '[' || dropped || ' passed]' || {NL} END END, '' ORDER BY run) AS t
  FROM f_runs GROUP BY fp, family),
by_json AS (
  SELECT b.fp, b.family, t.stripped, b.t AS after_family,
         CASE WHEN length(rtrim(expected_json, {NL})) < length(t.stripped) * 0.9 THEN expected_json ELSE b.t END AS after_json
  FROM by_family b JOIN texts t ON b.fp = t.fp AND b.family = t.family),
by_blank AS (SELECT *, regexp_replace(after_json, '\\n{{3,}}', {NL} || {NL}, 'g') AS after_blank FROM by_json),
{_collapse('by_blank', 'after_blank', 'fp, family', 'rep')},
folded AS (
  SELECT *, length(result) < length(stripped) AS shrinks, regexp_matches(stripped, {SECRET}) AS is_secret
  FROM (SELECT b.*, r.folded AS after_repeats, {_cut_lines('r.folded')} AS result
        FROM by_blank b JOIN rep r ON b.fp = r.fp AND b.family = r.family))"""

DEDUP = f"""{FOLD},
control AS ({CONTROL_SQL}),
marked AS (
  SELECT *, CASE WHEN p IS NULL OR r > p THEN l IS NOT NULL ELSE coalesce(l > p, false) END AS is_ref
  FROM (
    SELECT k.*, f.result AS folded, f.shrinks, f.is_secret, f.shrinks AND NOT f.is_secret AS storable,
           (SELECT max(c.seq) FROM control c WHERE c.kind = 'compact' AND c.seq <= k.seq) AS p,
           (SELECT max(c.seq) FROM control c WHERE c.kind = 'resume' AND c.seq <= k.seq) AS r,
           max(CASE WHEN f.shrinks AND NOT f.is_secret THEN k.seq END) OVER (
             PARTITION BY k.scope, k.fp ORDER BY k.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l
    FROM keyed k JOIN folded f ON k.fp = f.fp AND k.family = f.family))"""

TOKEN = "'§ref:' || substr(fp, 1, 16) || '§'"


def _noted_steps() -> str:
    """One CTE per known path, in path order."""
    steps, source = [], "marked"
    for k in range(10):
        path = f"src/f{k}.py"
        steps.append(
            f"n{k} AS (SELECT {source}.* REPLACE (CASE WHEN kn.added_seq <= {source}.seq THEN "
            f"replace(replace(folded, '--> {path}', '--> {path} [in context]'), 'at {path}:', 'at {path} [in context]:') "
            f"ELSE folded END AS folded) FROM {source} LEFT JOIN known kn ON kn.path = '{path}')")
        source = f"n{k}"
    return ",\n".join(steps)


COMPACTED = f"""{DEDUP},
known AS (SELECT substr(cmd, 5) AS path, min(seq) AS added_seq FROM outputs WHERE starts_with(cmd, 'cat ') GROUP BY 1),
{_noted_steps()},
compacted AS (
  SELECT output_id, seq, fp, family, cmd, text,
         CASE WHEN is_ref THEN {TOKEN} WHEN shrinks AND length(folded) < length(stripped) THEN folded ELSE stripped END AS result,
         CASE WHEN is_ref THEN 'ref' WHEN shrinks AND length(folded) < length(stripped) THEN 'compressed' ELSE 'unchanged' END AS outcome,
         is_secret, {_tokens('length(text)')} AS orig_tokens
  FROM n9)"""

STATELESS = f"""{FOLD}
SELECT output_id, k.seq, k.family, f.is_secret, CASE WHEN shrinks THEN f.result ELSE k.stripped END AS result,
       CASE WHEN shrinks THEN 'compressed' ELSE 'unchanged' END AS outcome,
       {_tokens('length(k.text)')} AS orig_tokens,
       {_tokens('length(CASE WHEN shrinks THEN f.result ELSE k.stripped END)')} AS comp_tokens
FROM keyed k JOIN folded f ON k.fp = f.fp AND k.family = f.family"""

CACHE = """cache AS (
  SELECT scope, fp, substr(fp, 1, 16) AS ref, folded AS compressed, length(stripped) AS n_in, seq AS last_storable_seq, ts_s AS created_s
  FROM (SELECT *, row_number() OVER (PARTITION BY scope, fp ORDER BY seq DESC) AS back FROM marked
        WHERE storable AND NOT is_ref) WHERE back = 1)"""

# --- commands ---------------------------------------------------------------

BASE = (r"lower(regexp_replace(regexp_replace(regexp_extract(command, '^\s*(\S+)', 1), '^.*/', ''), '^.*\\', ''))")
BARE = r"""regexp_replace(cmd, '''[^'']*(''|$)|"[^"]*("|$)', '', 'g')"""
SKIP = (
    f"CASE WHEN base_cmd IN ({_list(fixed.INTERACTIVE)}) THEN 'interactive' "
    + "".join(f"WHEN contains(cmd, {_q(f)}) THEN 'watch-mode' " for f in fixed.WATCH_FLAGS)
    + "".join(f"WHEN contains(cmd, {_q(o)}) THEN {_q('shell-op:' + o.strip())} " for o in fixed.SHELL_OPS)
    + "".join(f"WHEN contains(cmd, {_q(o)}) THEN {_q('redirect:' + o.strip())} " for o in fixed.REDIRECTS)
    + f"WHEN contains({BARE}, ';') THEN 'shell-op:;' "
    + "WHEN suffix(cmd, ' &') OR contains(cmd, ' & ') THEN 'background-job' END")
CLASSIFIED = f"""
SELECT event_id, command, base_cmd, {SKIP} AS skip_reason
FROM (SELECT event_id, command, trim(command) AS cmd, {BASE} AS base_cmd FROM ({COMMANDS_SQL}))"""
GUARDED = SKIP.replace("CASE WHEN", f"CASE WHEN contains(cmd, {_q(WRAP_MARKER)}) THEN 'already-compressed' "
                       f"WHEN base_cmd IN ({_list(OWN_NAMES)}) THEN 'self' WHEN", 1)
PARSED = f"""
SELECT event_id, CASE WHEN NOT broken THEN tool_name END AS tool_name, CASE WHEN NOT broken THEN command END AS command,
       CASE WHEN broken THEN 'invalid-json' WHEN tool_name = 'Read' THEN 'other-tool'
            WHEN trim(command) = '' THEN 'no-command' END AS reject_reason
FROM ({COMMANDS_SQL})"""


def _annotated() -> str:
    steps, source = [f"o AS ({REF_OUTPUTS})",
                     "known AS (SELECT path, min(seq) AS added_seq FROM o WHERE path IS NOT NULL GROUP BY path)"], "o"
    for k in range(10):
        path = f"src/f{k}.py"
        steps.append(
            f"n{k} AS (SELECT {source}.* REPLACE (CASE WHEN kn.added_seq <= {source}.seq THEN "
            f"replace(replace(text, '--> {path}', '--> {path} [in context]'), 'at {path}:', 'at {path} [in context]:') "
            f"ELSE text END AS text) FROM {source} LEFT JOIN known kn ON kn.path = '{path}')")
        source = f"n{k}"
    return f"WITH {', '.join(steps)} SELECT output_id, text AS annotated FROM {source}"


# --- queries ----------------------------------------------------------------

_steps = [("escapes", "length(text)", "length(stripped)"), ("family_rule", "length(stripped)", "length(after_family)"),
          ("json", "length(after_family)", "length(after_json)"), ("blank_lines", "length(after_json)", "length(after_blank)"),
          ("repeats", "length(after_blank)", "length(after_repeats)"), ("line_cut", "length(after_repeats)", "length(result)")]
_saved = ", ".join(f"CAST(sum({a} - {b}) AS BIGINT) AS {n}" for n, a, b in _steps)

SQL = {
    "ansi_strip": f"SELECT output_id, {STRIPPED} AS stripped FROM ({OUTPUTS})",
    "blank_guard": f"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, regexp_matches(piece, '^\\s*$') AS blank
FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
      FROM (SELECT doc_id, string_split(text, {NL}) AS p FROM documents))""",
    "secret_scan": f"SELECT doc_id, regexp_matches(text, {SECRET}) AS is_secret FROM documents",
    "blank_collapse": f"SELECT output_id, regexp_replace(text, '\\n{{3,}}', {NL} || {NL}, 'g') AS collapsed FROM ({OUTPUTS})",
    "collapse_runs_doc": f"WITH {_collapse('documents', 'text', 'doc_id', 'c')} SELECT doc_id, folded FROM c",
    "collapse_runs_lines": _line_fold(CONVERSATION_LINES, REPEAT_KEY, "n >= 3",
                                      f"rtrim(line, {NL}) || ' (×' || n || ')' || {NL}"),
    "fold_build_lines": _line_fold(BUILD_LINES, f"CASE WHEN {BUILD_LINE} THEN 1 END", "coalesce(key = 1, false)",
                                   f"'   Compiling ... (' || n || ' crates)' || {NL}"),
    "fold_package_lines": _line_fold(PACKAGE_LINES, f"CASE WHEN {PACKAGE_LINE} THEN 1 END", "coalesce(key = 1, false)",
                                     f"'[npm: ' || n || ' info lines omitted]' || {NL}"),
    "fold_diff_context": f"""WITH {_runs(DIFF_LINES, 'output_id', 'pos', f"CASE WHEN {CONTEXT_LINE} THEN 1 END")},
g AS (SELECT *, count(*) OVER (PARTITION BY output_id, run) AS n,
             row_number() OVER (PARTITION BY output_id, run ORDER BY pos) AS k FROM r)
SELECT output_id, pos, CAST(0 AS BIGINT) AS part,
       CASE WHEN n > 3 AND k = n - 1 THEN '  ... (' || (n - 2) || ' unchanged lines)' || {NL} ELSE line END AS line
FROM g WHERE n <= 3 OR k = 1 OR k >= n - 1""",
    "extract_test_failures": f"""WITH {_runs(TEST_LINES, 'output_id', 'pos', f"CASE WHEN NOT {MARKER} THEN 1 END")},
g AS (SELECT *, CASE WHEN key IS NULL THEN true WHEN run = 1 THEN {_kept('false')} ELSE {_kept('true')} END AS kept,
             max(pos) OVER (PARTITION BY output_id) AS last_pos FROM r)
SELECT output_id, pos, CAST(0 AS BIGINT) AS part, line FROM g WHERE kept
UNION ALL
SELECT output_id, max(pos), CAST(1 AS BIGINT), '[' || count(*) FILTER (NOT kept)
       || CASE WHEN max(pos) = max(last_pos) THEN ' lines omitted]' ELSE ' passed]' END || {NL}
FROM g WHERE key = 1 GROUP BY output_id, run HAVING count(*) FILTER (NOT kept) > 0""",
    "json_strip_minify": """SELECT event_id AS output_id, '{"id":' || event_id || ',"tags":["' || event_type
|| '","aé/b"],"user":{"id":' || user_id || ',"rate":1.50},"none":[]}' || chr(10) AS minified FROM events""",
    "truncate_lines": f"""SELECT output_id, {_cut_lines('text')} AS cut FROM (
SELECT c_custkey AS output_id, array_to_string(list_transform(range(1, 401 + (c_custkey % 7) * 50),
       lambda i: c_name || ' row ' || i), {NL}) AS text FROM customer)""",
    "truncate_bytes": f"""SELECT output_id, md5(CASE WHEN strlen(text) > 500000 THEN array_to_string(p[1:200], {NL}) || {NL} || {NL} || '[... 50 lines truncated]'
       || {NL} || array_to_string(p[251:300], {NL}) ELSE text END) AS cut_md5
FROM (SELECT *, string_split(text, {NL}) AS p FROM (
  SELECT s_suppkey AS output_id, array_to_string(list_transform(range(1, 301),
         lambda i: s_name || ' ' || i || ' ' || repeat('x', CAST(1500 + (s_suppkey % 5) * 200 AS INT))), {NL}) AS text FROM supplier))""",
    "base_command": f"SELECT event_id, {BASE} AS base_cmd FROM ({COMMANDS_SQL})",
    "skip_reason": CLASSIFIED,
    "skip_report": f"SELECT coalesce(skip_reason, 'eligible') AS skip_reason, CAST(count(*) AS BIGINT) AS commands FROM ({CLASSIFIED}) GROUP BY 1",
    "parse_tool_events": PARSED,
    "fingerprint": "SELECT doc_id, sha256(text) AS fp, substr(sha256(text), 1, 16) AS ref FROM documents",
    "dedup_asof": f"WITH {DEDUP} SELECT output_id, seq, fp, family, is_ref FROM marked",
    "cache_merge": f"""WITH {DEDUP}, {CACHE}
SELECT scope, fp, ref, compressed, {_tokens('n_in')} AS original_tokens, {_tokens('length(compressed)')} AS compressed_tokens,
       last_storable_seq, created_s FROM cache""",
    "resolve_refs": f"""WITH {COMPACTED}, {CACHE}
SELECT c.output_id, coalesce(k.compressed, c.result) AS content, CAST(CASE WHEN c.outcome = 'ref' THEN 1 ELSE 0 END AS BIGINT) AS ref_matches
FROM compacted c LEFT JOIN cache k ON c.outcome = 'ref' AND k.ref = substr(c.result, 6, 16)""",
    "known_paths": f"SELECT scope, path, CAST(min(seq) AS BIGINT) AS added_seq FROM ({REF_OUTPUTS}) WHERE path IS NOT NULL GROUP BY 1, 2",
    "annotate_refs": _annotated(),
    "token_estimate": f"SELECT doc_id, {_tokens('length(text)')} AS tokens FROM documents",
    "row_reduction": f"""SELECT ts_s, original_tokens, compressed_tokens, CASE WHEN original_tokens > compressed_tokens
THEN round_even((original_tokens - compressed_tokens)::DOUBLE / original_tokens * 100, 0) END AS reduction_pct FROM ({LOG})""",
    "lookback_stats": f"SELECT {SAVINGS} FROM ({LOG}) WHERE ts_s >= (SELECT max(ts_s) FROM ({LOG})) - 168 * 3600",
    "lookback_windows": f"""WITH w AS (
  SELECT doc_id AS window_id, {START} + 3600 * doc_id - 1800 * (doc_id % 193 + 1) AS a, {START} + 3600 * doc_id + doc_id % 7 * 600 AS b
  FROM documents WHERE doc_id % 10 = 0),
j AS (SELECT window_id, original_tokens, compressed_tokens FROM w JOIN ({LOG}) ON ts_s >= a AND ts_s < b)
SELECT w.window_id, CAST(count(original_tokens) AS BIGINT) AS compressions, {SAVINGS.split(',', 1)[1].strip()}
FROM w LEFT JOIN j ON w.window_id = j.window_id GROUP BY w.window_id""",
    "stats_by_command": f"""WITH {COMPACTED}
SELECT cmd, {SAVINGS} FROM (SELECT cmd, orig_tokens AS original_tokens, {_tokens('length(result)')} AS compressed_tokens FROM compacted)
GROUP BY cmd""",
    "reduction_by_technique": f"""WITH {FOLD}
SELECT family, CAST(count(*) AS BIGINT) AS outputs, CAST(sum(length(text)) AS BIGINT) AS chars_in, {_saved}
FROM (SELECT k.family, k.text, f.* EXCLUDE (fp, family) FROM keyed k JOIN folded f ON k.fp = f.fp AND k.family = f.family) GROUP BY family""",
    "compact_outputs": f"""WITH {COMPACTED}
SELECT output_id, seq, fp, family, result, outcome, is_secret, orig_tokens, {_tokens('length(result)')} AS comp_tokens FROM compacted""",
    "compact_text": f"WITH {STATELESS}",
    "stream_compact": f"WITH {STATELESS}",
    "stream_dedup": f"""WITH {COMPACTED}
SELECT output_id, seq, fp, outcome, md5(result) AS result_md5 FROM compacted""",
    "stream_dedup_late": f"""WITH {COMPACTED}
SELECT output_id, seq, fp, outcome, md5(result) AS result_md5 FROM compacted""",
    "stream_first": f"""WITH parted AS (
  SELECT scope, sha256({STRIPPED}) AS fp, d, CAST(d // CASE WHEN output_id % 2 = 0 THEN 7 ELSE 5 END % {PARTS} AS BIGINT) AS part
  FROM (SELECT *, output_id // 2 AS d FROM ({OUTPUTS}))),
-- What comes two parts late is behind the watermark: nothing else is that far back.
here AS (SELECT DISTINCT scope, fp, part FROM parted WHERE NOT (d % 11 = 3 AND part < {PARTS - 2})),
kept0 AS (SELECT scope, fp FROM here WHERE part = 0),
{', '.join(f"kept{k} AS (SELECT scope, fp FROM here WHERE part = {k} EXCEPT SELECT scope, fp FROM kept{k - 1})" for k in range(1, PARTS))}
{' UNION ALL '.join(f"SELECT scope, fp, CAST({k} AS BIGINT) AS part FROM kept{k}" for k in range(PARTS))}""",
    "stream_stats": f"""WITH log AS ({LOG}),
q AS (SELECT *, (ts_s - (SELECT min(ts_s) FROM log)) * 4 // (SELECT max(ts_s) - min(ts_s) + 1 FROM log) AS quarter,
      original_tokens % {LATE_OF} = 0 AS late FROM log),
mark AS (SELECT coalesce(max(ts_s), -1e15) - 3600 AS at FROM q WHERE NOT late AND quarter < 3)
SELECT w * 3600 AS window_start_s, {SAVINGS}
FROM (SELECT *, unnest(range(ts_s // 3600 - 23, ts_s // 3600 + 1)) AS w FROM q), mark
WHERE NOT late OR (w + 24) * 3600 > mark.at GROUP BY w""",
    "stream_skip": f"""SELECT p.event_id, p.reject_reason, CASE WHEN p.command IS NOT NULL THEN c.base_cmd END AS base_cmd,
CASE WHEN p.command IS NOT NULL THEN c.skip_reason END AS skip_reason FROM ({PARSED}) p JOIN ({CLASSIFIED}) c ON p.event_id = c.event_id""",
    "skip_guarded": f"""SELECT event_id, command, base_cmd, {GUARDED} AS skip_reason
FROM (SELECT event_id, command, trim(command) AS cmd, {BASE} AS base_cmd FROM ({COMMANDS_SQL}))""",
    "log_roundtrip": f"""WITH {DEDUP}
SELECT cmd, {SAVINGS} FROM (
  SELECT cmd, {_tokens('length(text)')} AS original_tokens,
         {_tokens(f"length(CASE WHEN is_ref THEN {TOKEN} WHEN shrinks THEN folded ELSE stripped END)")} AS compressed_tokens
  FROM marked WHERE ts_s >= {START + 2_592_000}) GROUP BY cmd""",
    "cache_snapshot": f"WITH {DEDUP}, {CACHE} SELECT scope, fp, ref, last_storable_seq FROM cache",
    "known_merge": f"SELECT scope, path, CAST(min(seq) AS BIGINT) AS added_seq FROM ({REF_OUTPUTS}) WHERE path IS NOT NULL GROUP BY 1, 2",
    "text_source": f"""WITH {_compact_other(TURN_FILES)}
SELECT output_id AS id, regexp_matches(stripped, {SECRET}) AS is_secret, CASE WHEN shrinks THEN 'compressed' ELSE 'unchanged' END AS outcome,
{_tokens('length(text)')} AS orig_tokens, {_tokens('length(result)')} AS comp_tokens, md5(result) AS result_md5 FROM done""",
    "log_lines": f"SELECT id, CAST(i - 1 AS BIGINT) AS pos, md5(line) AS line_md5 FROM ({_any_lines_of(f'({LOG_FILES})', 'text', 'id')})",
    "control_epochs": """SELECT event_id, coalesce(c, -1) AS epoch, coalesce(c IS NOT NULL AND (r IS NULL OR c > r), false) AS stale
FROM (SELECT event_id, event_type,
             max(CASE WHEN event_type = 'error' THEN event_id END) OVER w AS c,
             max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER w AS r
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
WHERE event_type NOT IN ('error', 'purchase')""",
    "compact_over_lines": f"WITH {_compact_other(OVER_LINES)} SELECT output_id, md5(result) AS result_md5 FROM done",
    "compact_odd": f"""WITH {_compact_other(ODD)}
SELECT o.output_id, CASE WHEN blank THEN 'empty' WHEN shrinks THEN 'compressed' ELSE 'unchanged' END AS outcome,
       {_tokens('coalesce(length(o.text), 0)')} AS orig_tokens, {_tokens('coalesce(length(CASE WHEN blank THEN o.text ELSE result END), 0)')} AS comp_tokens,
       md5(CASE WHEN blank THEN o.text ELSE result END) AS result_md5
FROM (SELECT *, text IS NULL OR regexp_matches(text, '^\\s*$') AS blank FROM outputs) o LEFT JOIN done ON o.output_id = done.output_id""",
    "compact_lines": f"""WITH {FOLD}
SELECT output_id, md5(CASE WHEN shrinks THEN f.result ELSE k.stripped END) AS result_md5
FROM keyed k JOIN folded f ON k.fp = f.fp AND k.family = f.family""",
}
