"""Single-text rules with exact expected values."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tersefold.functions import text as T
from tersefold.functions.commands import base_command, family, read_path, skip_reason
from tersefold.operators import folds_doc

WS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u2029\u202f\u205f\u3000"


def one_column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    out = df.withColumn("o", make(F.col("t"))) if not isinstance(make, str) else df
    return [r.o for r in out.orderBy("i").collect()]


def test_ansi(spark):
    cases = {
        "\x1b[32mok\x1b[0m": "ok", "\x1b[1;31mx\x1b[K": "x", "\x1b[2Jkept": "\x1b[2Jkept",
        "\x1b]0;title\x07after": "after", "\x1b(Bq\x1b)0": "q", "plain": "plain", "\x1b]open": "\x1b]open",
    }
    assert one_column(spark, list(cases), T.strip_ansi) == list(cases.values())


def test_blank_and_strip(spark):
    values = ["", " ", WS, "a", WS + "a b" + WS, "\u200b"]
    assert one_column(spark, values, T.is_blank) == [not v.strip() for v in values]
    assert one_column(spark, values, T.strip) == [v.strip() for v in values]


def test_secrets(spark):
    v = "A" * 16
    cases = {
        f"api_key = {v}": True, f"API-KEY:'{v}": True, f"password:\u00a0{v}": True, "password: short": False,
        f"token....={v}": True, f"token.....={v}": False, f"secret\n={v}": False, "sk-" + "a" * 32: True,
        "sk-" + "a" * 31: False, "ghp_" + "b" * 36: True, "ghx_" + "b" * 36: False, "AKIA" + "C" * 16: True,
        "akia" + "c" * 16: True, "eyJ" + "d-_" * 7: True, f"\u017fecret={v}": True, f"a\u0131kia auth={v[:15]}": False,
        f"AP\u0130KEY={v}": True, "": False,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.o for r in T.with_secret(df, "t", "o").orderBy("i").collect()]
    assert got == list(cases.values())


def test_blank_lines(spark):
    assert one_column(spark, ["a\n\n\n\nb", "a\n\nb", "\n\n\n", "a\r\n\r\n\r\nb"], T.collapse_blank_lines) == [
        "a\n\nb", "a\n\nb", "\n\n", "a\r\n\r\n\r\nb"]


def test_tokens_count_code_points(spark):
    got = one_column(spark, ["", "a", "abcd", "abcde", "漢字漢字漢", "😀" * 4], lambda c: T.token_estimate(F.length(c)))
    assert got == [1, 1, 1, 2, 2, 1]


def test_reduction_ties_to_even(spark):
    df = spark.createDataFrame([(200, 199), (400, 399), (10, 10), (0, 0), (400, 397)], "o long, c long")
    pct0 = [r[0] for r in df.select(T.reduction_pct(F.col("o"), F.col("c"), 0)).collect()]
    assert pct0 == [float(round((o - c) / o * 100)) if o else 0.0
                    for o, c in [(200, 199), (400, 399), (10, 10), (0, 0), (400, 397)]]


JSON_OK = [
    '{"a": null, "b": 1}', '[1, null, 2]', '{"x": {"y": null, "z": 2}}', '[null,null,null]', '{}',
    '{"a": [], "b": {}, "c": [null]}', '  {"k": "v: null, "}  ', '{"q\\"null": null, "e": "\\\\"}',
    '{"u": "\\u00e9\\u6f22\\ud83d\\ude00 \\/ \\u001f \\u000B \\u0008"}', '{"\\u0041": null, "\\u0042": 1, "pad": null}',
    '{"n": "\\\\u00e9 stays", "m": null, "o": null}', "[true, false, null, 0.5, -3, 12345678901234567890]",
    '{"a":\t[\n{"b":\r\n null}, {"c": "' + "x\\n" * 3000 + '"}]}', "[" * 200 + "null" + "]" * 200,
]
JSON_BAD = [
    "{'a': null, 'b': 1, 'c': 2}", '{"a": null} trailing text here', '{"a": null}{"b": null}', "[1, 2", '{"a": nul}',
    "[01, null, null]", '{"a": "raw \x01 control", "b": null}', '{"a": "tab\there", "b": null}', '["a", null, null,]',
    '{} , "E"', '{}] junk [', "plain", "", '"just a string"', "[NaN, null, null]", '{"a" : "bad \\x escape", "b": null}',
]


def drop_nulls(v):
    if isinstance(v, dict):
        return {k: drop_nulls(x) for k, x in v.items() if x is not None}
    return [drop_nulls(x) for x in v if x is not None] if isinstance(v, list) else v


def expected_json(text):
    body = text.strip()
    small = json.dumps(drop_nulls(json.loads(body)), separators=(",", ":"), ensure_ascii=False)
    return small + "\n" if len(small) < len(body) * 0.9 else text


def minify(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.o for r in folds_doc.minify_json(df, "t", "o").orderBy("i").collect()]


def test_json_documents(spark):
    assert minify(spark, JSON_OK) == [expected_json(t) for t in JSON_OK]


def test_not_json_stays(spark):
    assert minify(spark, JSON_BAD) == JSON_BAD


def test_json_lone_surrogates_stay(spark):
    text = '{"a": "\\ud83d x \\u00e9", "b": "\\u00e9", "c": null, "d": "\\ude00"}'
    assert minify(spark, [text]) == ['{"a":"\\ud83d x \\u00e9","b":"é","d":"\\ude00"}\n']


def test_json_number_spelling_stays(spark):
    assert minify(spark, ['{"a": 1.50, "b": 1e5, "c": null}']) == ['{"a":1.50,"b":1e5}\n']


def random_value(rng, depth):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind >= 6:
        n = rng.randrange(5)
        if kind == 6:
            return [random_value(rng, depth + 1) for _ in range(n)]
        return {random_text(rng): random_value(rng, depth + 1) for _ in range(n)}
    return [None, None, True, rng.randrange(-9, 10**6), rng.randrange(100) + 0.25, random_text(rng)][kind]


def random_text(rng):
    return "".join(rng.choice('ab" \\/{}[],:né漢😀\n\t\x01\x1f\x7f\u2028null') for _ in range(rng.randrange(8)))


@pytest.mark.parametrize("ascii_only", [True, False])
def test_json_random(spark, ascii_only):
    rng = random.Random(5)
    texts = []
    for _ in range(1500):
        value = random_value(rng, 0)
        value = value if isinstance(value, (dict, list)) else [value]
        texts.append(json.dumps(value, ensure_ascii=ascii_only, indent=rng.choice([None, 1, 4])))
    assert minify(spark, texts) == [expected_json(t) for t in texts]


def test_commands(spark):
    cases = {
        "git status": "git", "/usr/bin/Cargo build": "cargo", r"C:\bin\Tool.EXE x": "tool.exe", "  ls": "ls",
        "": "", " \t": "", "\u3000a/b\\c d": "c", "a/": "",
    }
    assert one_column(spark, list(cases), base_command) == list(cases.values())
    got = one_column(spark, ["git", "rustc", "python3", "bun", "ls", ""], family)
    assert got == ["diff", "build", "test", "package", "other", "other"]


def test_skip_reasons(spark):
    cases = {
        "wrapper run x": "already-compressed", "git log 2>&1 | wrapper run": "already-compressed", "mytool stats": "self",
        "vim a": "interactive", "/usr/bin/SSH host": "interactive", "ls --watch": "watch-mode", "grep -w x f": "watch-mode",
        "ls -w": None, "a && b": "shell-op:&&", "a || b": "shell-op:||", "a || b && c": "shell-op:&&", "a | b": "shell-op:|",
        "a|b": None, "echo $(x)": "shell-op:$(", "echo `x`": "shell-op:`", "cat << E": "shell-op:<<", "a >> f": "shell-op:>>",
        "a > f": "redirect:>", "a < f": "redirect:<", "a 2> f": "redirect:2>", "a &> f": "redirect:&>", "a>f": None,
        "a; b": "shell-op:;", "echo 'a; b'": None, 'echo "a; b"': None, "echo 'a\" ; b": None, "echo 'it'; b": "shell-op:;",
        "a &": "background-job", " a & b ": "background-job", "a&b": None, "git status": None,
    }
    got = one_column(spark, list(cases), lambda c: skip_reason(c, "wrapper run", ["mytool"]))
    assert got == list(cases.values())


def test_read_paths(spark):
    cases = {
        "cat src/a.py": "src/a.py", "head -n 5 b.tar.gz": "b.tar.gz", "/bin/CAT x.y": "x.y", "cat": None, "cat README": None,
        "cat .bashrc": None, "cat d.x/file": None, "cat a.": None, "ls a.py": None, "cat a.py b": None, "cat x.py/": "x.py/",
        "cat ..py": "..py", "": None, "cat dir/.": None, "tail 'a b.txt'": "b.txt'",
    }
    assert one_column(spark, list(cases), read_path) == list(cases.values())
