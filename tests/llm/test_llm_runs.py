"""Periodic runs against plain comparison at every lag."""

import random
import re

import numpy as np

from llm_cases import documents, frame
from tersefold.llm import periodic_runs as pr


def plain_runs(w):
    """All runs (start, length, period) by comparing words at every lag."""
    n, out = len(w), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            stretch = w[i:j + q]
            if j > i and len(stretch) >= max(6, 4 * q) and min(
                    p for p in range(1, len(stretch)) if stretch[p:] == stretch[:-p]) == q:
                out.add((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    drop = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in drop)


def repetitive(rng):
    out = []
    for _ in range(rng.randint(1, 6)):
        block = [f"w{rng.randrange(rng.randint(1, 9))}" for _ in range(rng.randint(1, 7))]
        out += block * rng.randint(1, 7) + block[:rng.randint(0, len(block))]
    return out


def test_runs_equal_plain_comparison(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t  "]).join(repetitive(rng)) for _ in range(400)]
    got = pr.periodic_runs(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    for r in got:
        w = texts[r.doc_id].split()
        want = plain_runs(w)
        assert [tuple(x) for x in r.runs] == want
        assert (r.n_words, r.collapsed) == (len(w), plain_collapsed(w, want))
    assert sum(len(r.runs) > 1 for r in got) > 50


def test_few_rounds_of_splitting_give_the_same(monkeypatch):
    rng = random.Random(6)
    seqs = [repetitive(rng) for _ in range(200)]
    names = {x: i for i, x in enumerate(sorted({x for s in seqs for x in s}))}
    ids = np.array([names[x] for s in seqs for x in s])
    bounds = np.cumsum([0] + [len(s) for s in seqs])
    want = pr.runs_of(ids, bounds)
    for rounds, pairs in ((1, 1 << 20), (0, 1 << 20), (64, 7)):
        monkeypatch.setattr(pr, "ROUNDS", rounds)
        monkeypatch.setattr(pr, "PAIRS_AT_ONCE", pairs)
        assert (pr.runs_of(ids, bounds) == want).all()


def test_pieces_keep_no_rare_word():
    ids = np.array([0, 1, 0, 1, 0, 1, 0, 1, 2, 3, 3, 3, 3, 3, 3, 2, 2, 4, 4])
    pieces = sorted((int(s), int(e)) for a, b in pr.surviving(ids, np.array([0, len(ids)])) for s, e in zip(a, b, strict=True))
    assert pieces == [(0, 8), (9, 15)]


def test_long_texts_of_one_word_and_of_one_period():
    n = 300_000
    assert pr.runs_of(np.zeros(n, dtype=np.int64), np.array([0, n])).tolist() == [[0, n, 1]]
    assert pr.runs_of(np.arange(n) % 1000, np.array([0, n])).tolist() == [[0, n, 1000]]


def test_odd_rows(spark):
    docs = frame(spark, documents())
    got = pr.periodic_runs(docs).collect()
    assert sorted(r.doc_id is None for r in got) == sorted(r.doc_id is None for r in docs.collect())
    by_id = {r.doc_id: r for r in got}
    for i in (100, 101, 102):
        assert (by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) == (0, [], "")
    assert by_id[103].n_words == 60_000 and by_id[104].collapsed == "Über ßtraße żółw 漢字"
    assert sum(r.doc_id == 105 for r in got) == 2
    assert pr.periodic_runs(docs.limit(0)).collect() == []


def test_planting(spark):
    import zlib

    texts = [(i, " ".join(f"v{k}" for k in range(3 + i % 40))) for i in range(300)] + [(1000, None), (1001, " "), (None, "a b c")]
    rows = frame(spark, texts, "doc_id long, text string")
    got = {r.doc_id: r.t for r in rows.select("doc_id", pr.planted_text(rows.doc_id, rows.text).alias("t")).collect()}
    for i, text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(i).encode())
        if i is None or h % 10 or not w:
            assert got[i] == text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got[i].split(" ") == [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
