"""Lexical search against scores added up term by term."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm_cases import documents, frame
from tersefold.llm.lexical_search import SearchPlan, mined, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = "Alpha beta GAMMA delta épsilon zeta9 eta Θ iota kappa lambda mu nu xi omikron pi".split()


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain(docs, items, top=20):
    """(item_id, rank, doc_id, score) of all items, by plain sums."""
    docs = [(i, terms(t)) for i, t in docs]
    docs = [(i, t) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    out = []
    for item, text in items:
        scored = []
        for i, t in docs:
            tf, m = Counter(t), 75 + 25 * len(t) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (
                1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in terms(text) if tf[x])
            if score > 0:
                scored.append((-score, i is None, i, score))
        out += [(item, k + 1, i, score) for k, (*_, i, score) in enumerate(sorted(scored, key=lambda r: r[:2] + (r[2] or 0,))[:top])]
    return sorted(out, key=str)


def texts(seed, n, most):
    rng = random.Random(seed)
    word = lambda: rng.choice(VOCABULARY[: rng.randint(1, len(VOCABULARY))]) + rng.choice(["", "", "-", "x", "7"])
    return ["; ".join(word() for _ in range(rng.randint(0, most))) for _ in range(n)]


def ranked(spark, docs, items, plan=SearchPlan()):
    d = frame(spark, docs, "doc_id long, text string").repartition(5)
    i = frame(spark, items, "item_id long, text string")
    return sorted((tuple(r) for r in search(d, i, plan).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("plan", [SearchPlan(), SearchPlan(top=5, pass_terms=40, block_queries=7, cells=300, buffered=10)])
def test_ranks_equal_plain_sums(spark, plan):
    docs = list(enumerate(texts(1, 150, 40)))
    docs += [(i + 500, t) for i, t in docs[:60]] + [(900, None), (901, ""), (902, " -- "), (None, docs[3][1])]
    items = list(enumerate(texts(2, 30, 25))) + [(77, None), (78, ""), (79, "unknown words only")]
    assert ranked(spark, docs, items, plan) == plain(docs, items, plan.top)


def test_shared_sets_are_added_once():
    rng = random.Random(3)
    common = list(range(12))
    queries = [common[: rng.randint(6, 12)] + [rng.randint(12, 60) for _ in range(4)] + [0, 0] for _ in range(40)] + [[], [5]]
    graph = mined(queries, 61)
    leaves = np.array([[rng.randint(0, 1000) for _ in range(9)] for _ in range(61)])
    want = np.array([leaves[q].sum(axis=0) for q in queries])
    assert (graph.scores(leaves) == want).all()
    assert graph.additions < sum(max(0, len(q) - 1) for q in queries) / 2
    blocks = mined(queries, 61, SearchPlan(block_queries=5, block_terms=30))
    assert (blocks.scores(leaves) == want).all()


def test_odd_rows(spark):
    docs = documents()
    got = search(frame(spark, docs), frame(spark, [(1, "house river, the STONE"), (1, "漢字")], "item_id long, text string"))
    rows = [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]
    want = plain([(d[0], d[1]) for d in docs], [(1, "house river, the STONE"), (1, "漢字")])
    # Rows that repeat an id and a text cannot be told apart.
    assert sorted(rows, key=str) == want
    empty = frame(spark, [], "item_id long, text string")
    assert search(frame(spark, docs), empty).collect() == []
    assert search(frame(spark, docs).limit(0), frame(spark, [(1, "a")], "item_id long, text string")).collect() == []
