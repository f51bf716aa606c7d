"""The whole compaction, the cache, notes, epochs and streams against a sequential model."""

import hashlib
import random
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import models
from tersefold.operators import dedup, refs
from tersefold.operators.epochs import with_epoch
from tersefold.operators.skew import DEFAULT_LIMITS, SkewLimits, heavy_keys, join_unique
from tersefold.functions.text import with_lines
from tersefold.plans.compact import _fold_secrets, compact, compact_text, prepare
from tersefold.plans.compact_lines import compact_lines
from tersefold.session import new_dir, stage
from tersefold.streaming import jobs

TIGHT = SkewLimits(heavy_rows=5, heavy_keys_max=3, heavy_chars=100)
OUTPUT = "output_id long, ts_s long, seq long, scope string, cmd string, text string"
TEXTS = [
    "x\nx\nx\nx\n", "\x1b[32mx\nx\nx\nx\n\x1b[0m", "plain\n", "   Compiling a\n   Compiling b\nerr\n",
    " a\n b\n c\n d\n e\n+f\n", "api_key=ABCDEFGHIJKLMNOPQRST\nz\nz\nz\nz\n", "a\n\n\n\n\nb", " \n\t\n", "",
    '{"a": null, "b": [null, 1]}', "PASSED 1\nPASSED 2\nPASSED 3\nFAILED x\n",
    " --> src/a.py:1\nat src/b.py:2 see 0123456789012345678901234567890123456789\nq\nq\nq\nq\nq\nq\nq\nq\nq\nq\n",
    " --> src/a.py\nk\nk\nk\n",
]
COMMANDS = ["git diff", "cargo build", "pytest", "npm i", "ls", "cat src/a.py", "head src/b.py", "cat notes", ""]
FAMILY = {"git": "diff", "cargo": "build", "pytest": "test", "npm": "package"}


def tokens(text):
    return max(1, (len(text) + 3) // 4)


def fold_one(text, family):
    """Sequential reading of the rules; returns (stripped, folded)."""
    import json
    import re
    s = re.sub(r"\x1b\[[0-9;]*[mGKHF]|\x1b\][^\x07]*\x07|\x1b[()][AB012]", "", text)
    lines = s.splitlines(keepends=True)
    out = "".join(models.FAMILY[family](lines)) if family in models.FAMILY else s
    if family == "other" and s.strip()[:1] in ("{", "["):
        small = json.dumps({k: [x for x in v if x is not None] if isinstance(v, list) else v
                            for k, v in json.loads(s).items() if v is not None}, separators=(",", ":"))
        out = small + "\n" if len(small) < 0.9 * len(s.strip()) else s
    out = re.sub(r"\n{3,}", "\n\n", out)
    return s, "".join(models.repeats(out.splitlines(keepends=True)))


def model(events):
    """events in seq order: ('row', id, scope, cmd, text) or ('compact'|'resume', scope)."""
    cache, known, out = {}, {}, {}
    for kind, *rest in events:
        if kind != "row":
            for key in cache:
                if key[0] == rest[0]:
                    cache[key] = kind == "resume"
            continue
        oid, scope, cmd, text = rest
        words = cmd.split()
        base = words[0] if words else ""
        if base in ("cat", "head") and "." in words[-1]:
            known.setdefault(scope, set()).add(words[-1])
        if not text.strip():
            out[oid] = (text, "empty")
            continue
        stripped, folded = fold_one(text, FAMILY.get(base, "other"))
        fp = hashlib.sha256(stripped.encode()).hexdigest()
        if cache.get((scope, fp)):
            out[oid] = (f"§ref:{fp[:16]}§", "ref")
            continue
        if "api_key" not in stripped and len(folded) < len(stripped):
            cache[(scope, fp)] = True
        for path in sorted(known.get(scope, ())):
            folded = folded.replace(f"--> {path}", f"--> {path} [in context]")
            folded = folded.replace(f"at {path}:", f"at {path} [in context]:")
        shorter = len(folded) < len(stripped)
        out[oid] = (folded if shorter else stripped, "compressed" if shorter else "unchanged")
    return out


def random_history(n, seed, n_control):
    rng = random.Random(seed)
    seqs = sorted(rng.sample(range(10 * n), n + n_control))
    marks = set(rng.sample(range(n + n_control), n_control))
    events, rows, control = [], [], []
    for i, seq in enumerate(seqs):
        scope = rng.choice(["a", "a", "a", "b"])
        if i in marks:
            kind = rng.choice(["compact", "compact", "resume"])
            control.append((scope, seq, kind))
            events.append((kind, scope))
        else:
            cmd, text = rng.choice(COMMANDS), rng.choice(TEXTS)
            rows.append((i, seq, seq, scope, cmd, text))
            events.append(("row", i, scope, cmd, text))
    rng.shuffle(rows)
    return events, rows, control


def table(spark, rows):
    return spark.createDataFrame(rows, OUTPUT).withColumn("ts", F.timestamp_seconds("ts_s")).drop("ts_s")


def results(df):
    return {r.output_id: (r.result, r.outcome) for r in df.select("output_id", "result", "outcome").collect()}


@pytest.mark.parametrize("limits", [DEFAULT_LIMITS, TIGHT])
def test_compact_as_sequential(spark, limits):
    events, rows, control = random_history(700, seed=11, n_control=14)
    outputs = table(spark, rows)
    control = spark.createDataFrame(control, "scope string, seq long, kind string")
    run = compact(outputs, control, refs.known_paths(outputs), limits=limits)
    got, want = results(run.compacted), model(events)
    assert got == want
    assert len({o for _, o in want.values()}) == 4
    by_id = {r[0]: r[5] for r in rows}
    for r in run.compacted.collect():
        assert (r.orig_tokens, r.comp_tokens) == (tokens(by_id[r.output_id]), tokens(r.result))
    log = run.log
    assert log.count() == 700 and log.columns == ["ts", "scope", "cmd", "original_tokens", "compressed_tokens"]


def test_compact_in_runs_with_cache(spark):
    """Runs one after the other, each with the cache so far, equal one run over all."""
    events, rows, control = random_history(400, seed=12, n_control=9)
    known = refs.known_paths(table(spark, rows))
    control = spark.createDataFrame(control, "scope string, seq long, kind string")
    cache, got = None, {}
    for lo in range(0, 4000, 1000):
        part = table(spark, [r for r in rows if lo <= r[2] < lo + 1000])
        run = compact(part, control, known, cache)
        got |= results(run.compacted)
        cache = stage(dedup.merge_cache(cache, run.cache_entries), "cache")
    assert got == model(events)
    assert cache.count() == cache.select("scope", "fp").distinct().count()


def test_references_resolve(spark):
    _, rows, _ = random_history(200, seed=13, n_control=0)
    run = compact(table(spark, rows))
    cache = dedup.merge_cache(None, run.cache_entries)
    compacted = stage(run.compacted, "compacted")
    for limits in (DEFAULT_LIMITS, TIGHT):
        out = dedup.resolve_refs(compacted, cache, limits=limits).collect()
        assert len(out) == 200
        for r in out:
            assert r.ref_matches == (1 if r.outcome == "ref" else 0)
            assert (r.content == r.result) == (r.outcome != "ref")
    twins = spark.createDataFrame([("a", "f1", "0" * 16, "one"), ("a", "f2", "0" * 16, "two")],
                                  "scope string, fp string, ref string, compressed string")
    row = spark.createDataFrame([("a", 1, "§ref:" + "0" * 16 + "§")], "scope string, seq long, result string")
    assert dedup.resolve_refs(row, twins).first()[3:] == (None, 2)


@pytest.mark.parametrize("ranges", [1, 4, 60])
def test_epochs_by_ranges_equal_intervals(spark, ranges):
    _, rows, control = random_history(300, seed=14, n_control=25)
    rows = table(spark, rows).select("scope", "seq")
    control = spark.createDataFrame(control, "scope string, seq long, kind string")
    a = with_epoch(rows, control).collect()
    b = with_epoch(rows, control, broadcast_events=0, ranges=ranges).collect()
    assert sorted(a) == sorted(b)
    assert any(r.stale for r in a) and any(r.epoch >= 0 and not r.stale for r in a)


def test_heavy_keys_are_split(spark):
    rows = stage(spark.range(900).select(
        F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 200).cast("string"))).alias("k"),
        F.col("id").alias("seq")), "rows")
    lookup = rows.select("k").distinct().withColumn("v", F.length("k"))
    limits = SkewLimits(heavy_rows=10, heavy_keys_max=20)
    assert [tuple(r) for r in heavy_keys(rows, ["k"], 900, limits).collect()] == [("hot", 7)]
    assert heavy_keys(rows, ["k"], 900) is None
    plain, split = rows.join(lookup, "k"), join_unique(rows, lookup, ["k"], "seq", 900, "inner", limits)
    assert sorted(plain.collect()) == sorted(split.select(plain.columns).collect())


def test_few_long_texts_are_heavy(spark):
    rows = spark.createDataFrame([(1, 400)] * 3 + [(2, 1)] * 50, "k int, n int")
    limits = SkewLimits(heavy_rows=1000, heavy_chars=500)
    assert heavy_keys(rows, ["k"], 53, limits) is None
    assert [tuple(r) for r in heavy_keys(rows, ["k"], 1250, limits, "n").collect()] == [(1, 3)]
    # A text that never shrinks is no reference: each of its copies gets it again.
    outputs = table(spark, [(i, i, i, "s", "ls", "".join(map(chr, range(97, 123))) * 20) for i in range(30)])
    done = compact(outputs, limits=SkewLimits(heavy_rows=1000, heavy_chars=500)).compacted
    assert "_parts" in done._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.outcome, len(r.result)) for r in done.collect()} == {("unchanged", 520)}


def test_notes(spark):
    known = spark.createDataFrame([("s", "a.p", 1), ("s", "a.py", 1), ("s", "late.py", 50), ("t", "other.py", 1)],
                                  "scope string, path string, added_seq long")
    texts = {
        "--> a.py:1": "--> a.p [in context]y:1", "at a.py:3": "at a.py [in context]:3", "at a.py: at a.p:":
        "at a.py [in context]: at a.p [in context]:", "--> late.py": "--> late.py", "--> other.py": "--> other.py",
        "--> --> a.p": "--> --> a.p [in context]", "that a.p:": "that a.p [in context]:", "at x:a.p:": "at x:a.p:",
        "-->  a.p": "-->  a.p", "nothing": "nothing", "at\ta.p:": "at\ta.p:", "--> a.p": "--> a.p [in context]",
    }
    rows = spark.createDataFrame([(i, 10, "s", t) for i, t in enumerate(texts)],
                                 "output_id long, seq long, scope string, text string")
    got = [r.text for r in refs.annotate(rows, known).orderBy("output_id").collect()]
    assert got == list(texts.values())
    later = refs.annotate(rows.withColumn("seq", F.lit(50)), known).filter("text LIKE '%late.py [in context]'")
    assert later.count() == 1
    none = refs.annotate(rows, known.limit(0))
    assert sorted(r.text for r in none.collect()) == sorted(texts)


def test_stateless_and_deterministic(spark):
    _, rows, _ = random_history(150, seed=15, n_control=0)
    got = results(compact_text(table(spark, rows)))
    for oid, _, _, _, cmd, text in rows:
        if not text.strip():
            assert got[oid] == (text, "empty")
        else:
            stripped, folded = fold_one(text, FAMILY.get(cmd.split()[0] if cmd else "", "other"))
            assert got[oid][0] == (folded if len(folded) < len(stripped) else stripped)


def test_published_samples(spark):
    """The four samples that come with published reductions."""
    error = ("error[E0308]: mismatched types\n  --> src/main.rs:42:5\n42 |     do_thing(42u32);\n"
             "   |              ^^^^^ expected &str, found u32\n")
    response = """{
  "status": "ok",
  "user": { "id": 42, "name": "someone", "avatar": null,
            "bio": null, "location": null,
            "preferences": { "theme": "dark", "notifications": null,
                             "language": "en", "timezone": null } },
  "metadata": null, "errors": null, "warnings": null
}
"""
    log = "WARNING: deprecated API call\n" * 20 + "Build completed: 1 error\n"
    rows = [
        (1, 1, 1, "s", "make", log),
        (2, 2, 2, "s", "cargo build", "".join(f"   Compiling serde v1.0.{i}\n" for i in range(16)) + error),
        (3, 3, 3, "s", "curl -s api", response),
        (4, 4, 4, "s", "make", log),
    ]
    got = {k: v for k, (v, _) in results(compact(table(spark, rows)).compacted).items()}
    assert got[1] == "WARNING: deprecated API call (×20)\nBuild completed: 1 error\n"
    assert 1 - len(got[1]) / len(log) > 0.89
    assert got[2] == "   Compiling ... (16 crates)\n" + error
    assert got[3] == ('{"status":"ok","user":{"id":42,"name":"someone","preferences":'
                      '{"theme":"dark","language":"en"}}}\n')
    assert 1 - len(got[3]) / len(response) > 0.69
    assert len(got[4]) == 22 and got[4].startswith("§ref:")


def test_stream_dedup_batches_and_retry(spark):
    """Batches in order equal one run; a batch run twice changes nothing; control events arrive on the way."""
    events, rows, control = random_history(240, seed=16, n_control=6)
    state, out, arrived = new_dir(spark, "state"), new_dir(spark, "out"), new_dir(spark, "control")
    run = jobs.dedup_batches(state, out, arrived, merge_every=2)
    for batch in range(4):
        inside = lambda seq: batch * 600 <= seq < (batch + 1) * 600
        part = [c for c in control if inside(c[1])]
        spark.createDataFrame(part, jobs.CONTROL_SCHEMA).write.mode("append").parquet(arrived)
        part = table(spark, [r for r in rows if inside(r[2])])
        run(part, batch)
        if batch in (1, 2):
            run(part, batch)
    done = spark.read.parquet(out)
    assert results(done) == model(events)
    resolved = dedup.resolve_refs(done, jobs.read_cache(spark, state)).filter("outcome = 'ref'").collect()
    assert resolved and all(r.content is not None for r in resolved)


def test_rows_that_come_late_correct_what_they_change(spark):
    """Rows dealt to batches at random, control events first: the last word on each row is that of one run."""
    events, rows, control = random_history(240, seed=21, n_control=6)
    want = model(events)
    for seed in (1,):
        rng = random.Random(seed)
        state, out, arrived = new_dir(spark, "state"), new_dir(spark, "out"), new_dir(spark, "control")
        spark.createDataFrame(control, jobs.CONTROL_SCHEMA).write.parquet(arrived)
        run = jobs.dedup_batches(state, out, arrived, merge_every=2)
        reads = [r for r in rows if str(r[4]).split(" ")[0].split("/")[-1] in ("cat", "head", "tail", "less", "bat", "read")]
        rest = [r for r in rows if r not in reads]
        dealt = {r[0]: rng.randrange(4) for r in rest} | {r[0]: 0 for r in reads}
        for batch in range(4):
            part = table(spark, [r for r in rows if dealt[r[0]] == batch])
            run(part, batch)
            if batch == 2:
                run(part, batch)
        assert results(jobs.read_results(spark, state, out)) == want


def strings_in(folders):
    """All strings in the tables of some local folders."""
    files = [f for d in folders for f in Path(urlparse(str(d)).path).rglob("*.parquet")]
    return "\n".join(str(pq.read_table(f).to_pylist()) for f in files)


def test_secrets_are_staged_nowhere_and_staged_tables_go(spark, tmp_path):
    secret = "password = 'ABCDEFGHIJKLMNOPQRST'"
    rows = [(i, i, 10 * i, "s", "cat src/a.py" if i % 2 else "ls", f"{secret}\n--> src/a.py:1\n" + "same\n" * (5 + i % 3))
            for i in range(12)]
    rows += [(20 + i, i, 1000 + i, "s", "ls", "plain\n" * 9) for i in range(3)]
    outputs = table(spark, rows)
    run = compact(outputs, None, refs.known_paths(outputs))
    got = run.compacted.collect()
    assert sum(r.is_secret for r in got) == 12
    assert all(r.result.startswith(secret) and "(×" in r.result for r in got if r.is_secret)
    assert "[in context]" in next(r.result for r in got if r.output_id == 3)
    staged = list(run.staged)
    assert "plain" in strings_in(staged) and "ABCDEFGHIJKLMNOPQRST" not in strings_in(staged)
    run.close()
    assert strings_in(staged) == "" and run.staged == []
    shared = Path(urlparse(new_dir(spark, "x")).path).parent
    before = set(shared.glob("*"))
    step = jobs.dedup_batches(str(tmp_path / "state"), str(tmp_path / "out"))
    for batch in range(3):
        step(table(spark, [r for r in rows if r[0] % 3 == batch]), batch)
    assert set(shared.glob("*")) == before
    assert "ABCDEFGHIJKLMNOPQRST" not in strings_in([tmp_path / "state"])


def test_only_texts_with_secrets_are_read_again(spark):
    secret = "token = 'ABCDEFGHIJKLMNOPQRST'\n"
    rows = [(i, i, 10 * i, "s", "ls", None if i == 3 else " \n" if i == 4 else f"{secret if i % 7 == 0 else 'x'}\n" * 5) for i in range(40)]
    again = _fold_secrets(prepare(table(spark, rows)))
    assert sorted(r.output_id for r in again.collect()) == list(range(0, 40, 7))
    assert all(r.is_secret and secret in r.body for r in again.collect())


def test_few_rows_with_secrets_are_read_by_their_ids(spark, monkeypatch):
    import importlib

    module = importlib.import_module("tersefold.plans.compact")
    secret = "token = 'ABCDEFGHIJKLMNOPQRST'\n"
    rows = [(i, i, 10 * i, "s", "ls", f"{secret if i % 7 == 0 else 'x'}\n" * 5 + str(i % 14)) for i in range(40)]
    plain, seen = module._fold_secrets, []

    def spied(prepared):
        seen.append(prepared.count())
        return plain(prepared)

    monkeypatch.setattr(module, "_fold_secrets", spied)
    few = sorted(map(tuple, compact(table(spark, rows)).compacted.collect()))
    monkeypatch.setattr(module, "BROADCAST_TEXTS", 0)
    assert sorted(map(tuple, compact(table(spark, rows)).compacted.collect())) == few
    assert seen == [6, 40]


def test_few_copies_among_many_texts_shuffle_no_text(spark, monkeypatch, capsys):
    import importlib

    module = importlib.import_module("tersefold.plans.compact")
    rows = [(i, i, 10 * i, "s", "ls", " \n" if i == 4 else f"{min(i, 30)}\n" * 5) for i in range(40)]
    plain, plans = module._fold_distinct, []

    def spied(*given):
        folded = plain(*given)
        folded.explain()
        plans.append(capsys.readouterr().out)
        return folded

    monkeypatch.setattr(module, "_fold_distinct", spied)
    few = sorted(map(tuple, compact(table(spark, rows)).compacted.collect()))
    monkeypatch.setattr(module, "BROADCAST_TEXTS", 15)
    assert sorted(map(tuple, compact(table(spark, rows)).compacted.collect())) == few
    assert all("BroadcastHashJoin" in p and "ShuffledHashJoin" not in p and "SortMergeJoin" not in p for p in plans)


def test_a_batch_is_kept_nowhere_but_in_its_source(spark, monkeypatch):
    from tersefold.plans import inputs, registry

    df, paths, plain = spark.range(1), [], registry.new_dir
    monkeypatch.setattr(type(df), "persist", lambda *given: pytest.fail("a batch is kept"))
    monkeypatch.setattr(registry, "new_dir", lambda spark, label: paths.append((label, plain(spark, label))) or paths[-1][1])
    docs = spark.createDataFrame([(i, f"line {i} \n" * 5, "en", 40) for i in range(20)], "doc_id long, text string, lang string, n_chars long")
    outputs = inputs.outputs_of(docs)
    assert registry._dedup_in_batches(spark, outputs, F.col("seq")).count() == 40
    assert not Path(urlparse(dict(paths)["landing"]).path).exists()


def test_line_form_equals_text_form(spark):
    """Outputs in blocks of a few lines, among them blank, long, wide, JSON and open-ended ones."""
    rng = random.Random(3)
    pieces = ["x\n", "x\n", "\n", "\n", " c\n", "   Compiling a\n", "PASSED t\n", "FAILED t\n", "npm WARN d\n", "added 1\n",
              "\x1b[32mg\x1b[0m\n", "passed\n", "===== s\n", "y\r\n", "end"]
    texts = ["".join(rng.choices(pieces[:-1], k=rng.randint(0, 40))) + rng.choice(["", "end"]) for _ in range(60)]
    texts += ["a\n" * 700, "".join(f"{i}\n" for i in range(900)), "".join(f"{i} {'w' * 3000}\n" for i in range(251)),
              '{"a": null, "b": [1, null], "c": "long enough to count"}', "\n\n\n\nz\n", " \n\t\n", "\n"]
    rows = [(k, k, k, "s", rng.choice(["git", "cargo", "pytest", "npm", "ls", None]), t) for k, t in enumerate(texts)]
    outputs = table(spark, rows)
    lines = with_lines(outputs, "text", "lines").select("output_id", F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("pos", F.col("pos").cast("long") * 3 + 5)
    got = {}
    for r in compact_lines(lines, outputs.select("output_id", "cmd"), block_rows=7).orderBy("output_id", "pos").collect():
        got[r.output_id] = got.get(r.output_id, "") + r.line
    want = {r.output_id: r.result for r in compact_text(outputs).collect() if r.result}
    assert got == want


def test_cache_is_cut_to_the_batch(spark):
    """A large cache of other texts changes nothing."""
    rows = [(i, i, i, "s", "ls", "same\n" * 5) for i in range(3)]
    first = compact(table(spark, rows[:1])).cache_entries
    other = spark.range(5000).select(F.lit("s").alias("scope"), F.sha2(F.col("id").cast("string"), 256).alias("fp"),
                                     F.lit(0).cast("long").alias("last_storable_seq"))
    cache = first.select("scope", "fp", "last_storable_seq").unionByName(other)
    got = {r.output_id: r.outcome for r in compact(table(spark, rows[1:]), cache=cache).compacted.collect()}
    assert got == {1: "ref", 2: "ref"}


def test_staged_tables_stay_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = new_dir(spark, "x")
    assert path.startswith(shared or spark.conf.get("tersefold.local.dir"))


def test_odd_texts_never_fail_and_no_row_is_lost(spark):
    long_json = '{"k": "' + "\\n\\\"" * 60_000 + '", "n": null}'
    texts = [
        None, "\x00", "\x00\n\x00\n\x00\n\x00\n", "x" * 2_000_000, "y\n" * 300_000, "'" * 1000, '"' * 999, "[" * 5000,
        "{" * 5000, "\\" * 4001, long_json, "\x1b" * 3000, "\x1b]" + "z" * 10_000, " \n" * 50_000 + "a", "\r\n" * 700,
        "a.py" + "/" * 20_000, "at " + "p" * 50_000 + ":", "--> " * 3000, "𝕏" * 1001, " " * 501 + "end", "﻿{}",
        "PASSED \n" * 5000, "=====\n" * 600, "§ref:0000000000000000§",
    ]
    rows = []
    for i, (text, cmd) in enumerate((t, c) for t in texts for c in ("git", "cargo", "pytest", "npm", "cat a.py", None)):
        rows.append((i, i, i, "s", cmd, text))
    rows.append((len(rows), len(rows), len(rows), None, "ls", "no scope"))
    outputs = table(spark, rows)
    got = {r.output_id: r for r in compact(outputs, None, refs.known_paths(outputs)).compacted.collect()}
    assert sorted(got) == list(range(len(rows)))
    for oid, _, _, _, _, text in rows:
        if text is None:
            assert (got[oid].result, got[oid].outcome) == (None, "empty")
        elif got[oid].outcome != "ref":
            assert got[oid].result is not None and len(got[oid].result) <= len(text)
    cut = next(got[r[0]] for r in rows if r[5] == "y\n" * 300_000)
    assert cut.result == "y (×200)\n\n[... 299750 lines truncated]\ny (×50)\n"
    each = {r.output_id: r for r in compact_text(outputs).collect()}
    assert sorted(each) == sorted(got)
    assert all((each[k].result, each[k].outcome) == (None, "empty") for k, r in enumerate(rows) if r[5] is None)


def test_many_known_paths_are_found_in_order(spark, monkeypatch):
    """Paths that begin others, in ranges that split them, give what looking up every length gives."""
    rng = random.Random(8)
    piece = lambda: rng.choice(["a", "b.", "/", "é", ":", "x.py", "漢", "a.b/"])
    paths = sorted({"".join(piece() for _ in range(rng.randint(1, 7))) for _ in range(400)})
    known = [(rng.choice("st"), p, rng.randrange(50)) for p in paths] + [("s", "a", 3), ("t", "a", 9)]
    known = list({(s, p): (s, p, q) for s, p, q in known}.values())
    texts = []
    for i in range(300):
        words = [rng.choice(paths) + "".join(piece() for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(0, 4))]
        texts.append((i, rng.randrange(60), rng.choice("st"), "\n".join(rng.choice(["--> ", "at ", "at it --> "]) + w + rng.choice(["", ":", ":3"]) for w in words)))
    outputs = spark.createDataFrame(texts, "output_id long, seq long, scope string, text string")
    table_ = spark.createDataFrame(known, "scope string, path string, added_seq long")
    few = {r.output_id: r.text for r in refs.annotate(outputs, table_).collect()}
    monkeypatch.setattr(refs, "FEW_PATHS", 0)
    staged = []
    monkeypatch.setattr(refs, "stage", lambda df, label: staged.append((label, stage(df, label))) or staged[-1][1])
    many = {r.output_id: r.text for r in refs.annotate(outputs, table_).collect()}
    assert many == few and sum("[in context]" in t for t in few.values()) > 100
    sizes = {label: df.count() for label, df in staged}
    assert sizes["ranges"] <= sizes["mentions"] + len(known)
