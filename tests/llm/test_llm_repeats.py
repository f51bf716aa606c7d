"""Removal of repeated byte strings against sets of all strings."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import documents, frame, prose
from tersefold.llm import suffix_dedup as sd
from tersefold.llm.common import text_bytes
from tersefold.llm.suffix_dedup import RepeatPlan, without_repeats


def plain(rows, match=50):
    """(id, n_bytes, spans, kept) of each row: every string of every row with a smaller id."""
    data = [((i if i is not None else 1 << 62), (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in data:
        for p in range(len(b) - match + 1):
            s = b[p:p + match]
            first[s] = min(i, first.get(s, i))
    out = []
    for (i, b), (own, _) in zip(data, rows):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - match + 1):
            if first[b[p:p + match]] < i:
                gone[p:p + match] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = [(int(x), int(y)) for x, y in zip(edges[::2], edges[1::2])]
        out.append((own, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=str)


def found(spark, rows, plan=RepeatPlan(), parts=5):
    df = frame(spark, rows, "doc_id long, text string").repartition(parts)
    return sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept))
                   for r in without_repeats(df, plan).collect()), key=str)


def corpus(seed):
    """Texts that share passages of many lengths around the limit, copies, edited copies, and periodic texts."""
    rng = random.Random(seed)
    base = [prose(f"{seed}-{i}", rng.choice([2, 8, 30, 120])) for i in range(25)]
    passages = [prose(f"{seed}-p{i}", 40)[: rng.choice([30, 49, 50, 51, 52, 60, 74, 99, 130])] for i in range(12)]
    texts = list(base)
    for _ in range(60):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(t))
            t = t[:at] + rng.choice([*passages, "ż", "x", " 漢字 "]) + t[at + rng.choice([0, 0, 1, 7]):]
        texts.append(t)
    texts += ["a" * 300, "a" * 49, "a" * 50, "b" + "a" * 60, "ab" * 90, "ba" * 40, "abc" * 50, "ż" * 40, "", None, base[3], base[3]]
    return list(zip(rng.sample(range(10_000), len(texts)), texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_strings(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == plain(rows)


def test_other_lengths_and_many_buckets(spark):
    rows = corpus(4)
    for match, gram in ((12, 5), (50, 49)):
        assert found(spark, rows, RepeatPlan(match, gram, 50)) == plain(rows, match)


def test_null_and_repeated_ids_and_ids_far_apart(spark):
    rows = corpus(5)
    rows = [(None if k % 5 == 0 else i // 40, t) for k, (i, t) in enumerate(rows)]
    assert found(spark, rows, parts=3) == plain(rows)
    rows = [(i * (1 << 40), t) for i, t in corpus(6)]
    assert found(spark, rows, parts=1) == plain(rows)


def test_a_group_of_copies(spark):
    text = prose("copies", 200)
    rows = [(i, text) for i in range(500, 100, -1)] + [(7, prose("other", 50))]
    got = {r[0]: r for r in found(spark, rows, parts=8)}
    assert got[101][2] == [] and got[7][2] == []
    assert all(got[i][2] == [(0, len(text))] and got[i][3] == b"" for i in range(102, 501))


def test_sampled_windows_cover_each_window_once():
    texts = __import__("pyarrow").array([t for _, t in corpus(8)])
    data, offsets = text_bytes(texts)
    first, last, gram, string = sd.sampled(data, offsets, RepeatPlan())
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    want = np.concatenate([np.arange(a, b - 49) for a, b in zip(offsets[:-1], offsets[1:])])
    assert (windows == want).all()
    assert (last - first <= 30).all()
    by_string = {}
    for a, b, g, s in zip(first, last, gram, string):
        assert by_string.setdefault(data[a:b + 50].tobytes(), (g, s)) == (g, s)


def test_texts_are_not_shuffled(spark, capsys):
    docs = frame(spark, corpus(9), "doc_id long, text string").repartition(6)
    rows = sd._in_blocks(docs, "doc_id", "text", RepeatPlan())
    rows.groupBy("block").applyInArrow(lambda t: t.select(["block"]), "block bigint").explain()
    assert "Exchange" not in capsys.readouterr().out
    assert rows.groupBy("block").count().count() <= 6


def test_blocks_are_bounded_and_give_the_same(spark):
    rows = [(i, t) for i, t in corpus(10)]
    plan = RepeatPlan(block_bytes=2000)
    docs = frame(spark, rows, "doc_id long, text string").coalesce(2)
    blocks = sd._in_blocks(docs, "doc_id", "text", plan).groupBy("block").agg(F.sum("n_bytes").alias("n"), F.max("n_bytes").alias("most")).collect()
    assert len(blocks) > 10
    assert all(b.n < plan.block_bytes + b.most for b in blocks)
    assert found(spark, rows, plan, parts=2) == plain(rows)
    assert found(spark, rows, RepeatPlan(block_bytes=2000, max_blocks=3), parts=2) == plain(rows)


def test_strings_that_share_a_gram_only_are_not_ranked_by_windows(spark, monkeypatch):
    gram, asked = "ABCDEFGHIJKLMNOPQRST", []
    rows = [(i, prose(f"x{i}", 12)[:45] + gram + prose(f"y{i}", 12)[:45]) for i in range(30)] + [(90, prose("x3", 12)[:45] + gram + prose("z", 20))]
    monkeypatch.setattr(sd, "stage", lambda df, label: asked.append((label, real(df, label))) or asked[-1][1])
    assert found(spark, rows, parts=3) == plain(rows)
    keys = {label: sum(len(r.states) for r in df.collect()) for label, df in asked}
    # The string before the gram is that of one other text: its windows are all that is left.
    assert keys["answers-2"] > 30 and 0 < keys["answers-3"] <= 2 * 31


real = sd.stage


@pytest.mark.parametrize("span", [1, 2, 3, 5, 8, 30, 31])
def test_windows_in_groups_of_any_width(spark, span):
    rows = corpus(11)
    assert found(spark, rows, RepeatPlan(span=span)) == plain(rows)


def test_odd_rows(spark):
    docs = frame(spark, documents())
    got = without_repeats(docs).collect()
    assert len(got) == docs.count()
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(((r.doc_id, r.n_bytes, [tuple(x) for x in r.spans], bytes(r.kept)) for r in got), key=str) == want
    assert without_repeats(docs.limit(0)).collect() == []
