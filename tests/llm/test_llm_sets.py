"""Operators on pairs: near-duplicates and decontamination, against brute force."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import documents, frame, prose
from tersefold.llm import decontamination, near_dup
from tersefold.llm.common import text_id, without_rows
from tersefold.llm.components import components
from tersefold.llm.decontamination import leaks, without_leaks
from tersefold.llm.near_dup import JoinPlan, keep_one, near_duplicates, similar_links

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(rows, percent):
    """Smallest id of each row's component; equal ids are one document."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [least.get(root(k)) if sets[k][1] else rows[k][0] for k in range(len(rows))]


def edited(text, rng, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = f"new{rng.randint(0, 999)}"
    return " ".join(w)


def corpus(seed):
    """Originals with copies that differ in few to many words, a large group among them."""
    rng = random.Random(seed)
    texts = [prose(f"{seed}-{i}", rng.choice([3, 6, 40, 150])) for i in range(25)]
    texts += [edited(prose(f"{seed}-big", 160), rng, rng.randint(0, 4)) for _ in range(70)]
    texts += [edited(prose(f"{seed}-{k}", 150), rng, rng.randint(1, 6)) for k in range(5) for _ in range(6)]
    texts += [texts[0].upper(), texts[3] + " \t", "", None, " \n", "One", "one"]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("seed,plan", [
    (1, JoinPlan()), (2, JoinPlan(percent=80)), (3, JoinPlan(node_limit=4, block_shingles=1500, broadcast_rows=0)),
    (4, JoinPlan(percent=80, node_limit=4, block_shingles=700, pair_blocks=2, leaders=3))])
def test_components_equal_brute_force(spark, seed, plan):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, plan).collect()}
    want = groups(rows, plan.percent)
    assert got == {i: (len(shingles(t)), w, w == i) for (i, t), w in zip(rows, want, strict=True)}


def test_near_duplicates_of_odd_rows(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for i in (100, 101, 102) for r in by_id[i])
    assert [r.component_id for r in by_id[105]] == [1, 1]
    assert sorted(r.component_id for r in by_id[106]) == [2, 3]
    assert sorted(str(r.component_id) for r in by_id[None]) == ["4", "None"]
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= set(range(40)) | {100, 101, 102, 103, 104, 107}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_links_inside_a_task_join_what_brute_force_joins():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 8)).astype(np.uint64)]))
            for _ in range(60)]
    for side in (np.zeros(60, int), rng.integers(0, 2, 60)):
        want = {frozenset((i, j)) for i in range(60) for j in range(i) if side.max() == 0 or side[i] != side[j]
                if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
        got = similar_links(sets, side, 80)
        assert {frozenset(x) for x in got} <= want
        assert closure(60, got) == closure(60, want)


def closure(n, edges):
    label = list(range(n))
    for _ in range(n):
        for e in edges:
            a, b = e
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 360)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([7, *range(300, 360)], 7), 5: 5}


# Decontamination.

def test_passages_with_substitutions_are_found(spark):
    rng = random.Random(1)
    items = [(i, prose(f"item-{i}", 40)) for i in range(30)] + [(50, "alpha beta gamma delta epsilon zeta"), (51, "only four words here")]
    docs, want = [], set()
    for d in range(120):
        body = prose(f"doc-{d}", 200).split()
        if d % 3 == 0:
            i, text = items[rng.randrange(30)]
            put = edited(text, rng, d % 5).upper() if d % 2 else edited(text, rng, d % 5).replace(" ", ",\n")
            at = rng.randrange(len(body))
            body[at:at] = put.split(" ")
            want.add((d, i))
        docs.append((d, " ".join(body)))
    docs += [(200, "x y Alpha, beta: gamma delta EPSILON zeta z"), (201, "only four words here"), (202, None), (203, ""),
             (204, "alpha beta gamma delta epsilon eta")]
    want.add((200, 50))
    frame_ = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([*items, (60, items[0][1].upper()), (61, None), (None, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks(frame_, bench).collect()}
    assert got == want
    clean = without_leaks(frame_, bench)
    assert clean.columns == frame_.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_odd_rows(spark):
    docs = frame(spark, documents())
    bench = spark.createDataFrame([(1, prose(4)), (2, prose("absent", 50))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in leaks(docs, bench).collect())
    assert got == [("4", 1), ("None", 1)]
    # The row that has neither id nor text holds no passage.
    assert without_leaks(docs, bench).count() == docs.count() - 2
    assert leaks(docs.limit(0), bench).count() == 0
    assert leaks(docs, bench.limit(0)).count() == 0


def test_leaks_of_the_table_equal_whole_items(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())) + " "
    items = [(r.item_id, plain(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in plain(r.text)}
    assert want <= {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}


def test_every_place_of_the_substitutions_is_covered(spark):
    """Items of 5 to 13 words with 1 and 2 words replaced anywhere, and longer ones with more, by the rule itself."""
    rng = random.Random(3)
    items = {n: [f"q{n}x{k}" for k in range(n)] for n in [*range(5, 14), 16, 20]}
    texts = [(n, w, c) for n, w in items.items() if n <= 13 for e in (0, 1, 2) for c in itertools.combinations(range(n), e)]
    texts += [(n, items[n], tuple(rng.sample(range(n), e))) for n, e in ((16, 3), (20, 5)) for _ in range(150)]
    docs, want = [], set()
    for d, (n, w, changed) in enumerate(texts):
        put = [f"new{d}" if k in changed else word for k, word in enumerate(w)]
        docs.append((d, f"{prose(d, 30)} {' '.join(put)} {prose(-d, 30)}"))
        width = min(13, n)
        equal = max(sum(k not in changed for k in range(at, at + width)) for at in range(n - width + 1))
        if equal * 100 >= width * 80 if n >= 7 else not changed:
            want.add((d, n))
    found = leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                  spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_clean_rows_stay_beside_copies_and_leaks_of_their_id(spark):
    """Rows without an id, and texts that share one, are judged by themselves."""
    rows = [(1, prose(1)), (None, prose(1)), (None, prose("clean")), (None, ""), (7, prose(1)), (7, prose("other")),
            (None, prose("leak")), (8, prose("leak")), (8, prose("fine"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_id", F.lit("clash"))
    order = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str)
    want = [rows[k] for k in (0, 2, 3, 5, 7, 8)]
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert order(got.collect()) == sorted(want, key=str)
    got = without_leaks(docs, spark.createDataFrame([(1, prose("leak", 40))], "item_id long, text string"))
    assert got.columns == docs.columns
    assert order(got.collect()) == sorted((r for k, r in enumerate(rows) if k not in (6, 7)), key=str)


def test_rows_without_ids_cost_no_more_and_one_id_may_be_all_rows(spark):
    """Texts are looked up by id and text: representatives do not meet all rows of their id."""
    rng = random.Random(12)
    texts = [prose(f"n{i // 4}", 60) if i % 4 == 0 else edited(prose(f"n{i // 4}", 60), rng, 1) for i in range(240)] + [prose("n0", 60)] * 40
    for ids in ([None] * len(texts), [7] * len(texts)):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
        got = keep_one(docs, JoinPlan(percent=70)).collect()
        # Copies of a null id have no smaller id than their own, so all stay; equal ids are one document.
        assert len(got) == len(texts)
    plan = JoinPlan()
    prints = near_dup.stage(near_dup.fingerprints(docs), "prints")
    first = prints.dropDuplicates(["fp1"]).select(
        F.monotonically_increasing_id().alias("node"), F.lit(0).cast("long").alias("cluster"), F.lit(0).alias("block"),
        F.lit(1).alias("blocks"), F.lit(False).alias("leads"), F.struct("doc_id", "text_id").alias("first"))
    first = near_dup.stage(first, "wanted")
    sets = near_dup._with_sets(docs, first, plan, first.count(), "doc_id", "text")
    n = first.count()
    assert n <= sets.count() <= n + 3 * 4 and sets.select("node").distinct().count() == n


def test_unrelated_documents_share_no_node(spark):
    """Roots have 32 bits, so what shares nothing meets nowhere."""
    docs = spark.createDataFrame([(i, " ".join(f"{i}-{k}" for k in range(12))) for i in range(3000)], "doc_id long, text string")
    prints = near_dup.stage(near_dup.fingerprints(docs), "prints")
    reps = near_dup.stage(prints.withColumnsRenamed({"n_shingles": "n"}).withColumn("node", F.monotonically_increasing_id()), "reps")
    roots = F.array(*[F.xxhash64(F.lit(t), F.substring("roots", 4 * t + 1, 4)) for t in range(20)])
    met = reps.select(F.explode(roots).alias("path")).groupBy("path").count().filter("count > 1")
    assert met.count() <= 3


def test_staged_tables_go(spark, tmp_path):
    from tersefold import session

    rows = corpus(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    with session.collected() as paths:
        kept = keep_one(docs)
        n = kept.count()
    import os

    assert sum(os.path.exists(p) for p in paths) == 1 and n > 0
    with session.collected() as paths:
        found = near_duplicates(docs)
        assert found.count() == len(rows)
    assert sum(os.path.exists(p) for p in paths) == 2


def test_rows_that_go_beyond_the_broadcast_bound(spark):
    rows = [(i % 50 if i % 9 else None, f"text {i % 70}" if i % 11 else None, "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id string").withColumn("_maybe", F.lit(1))
    gone = docs.filter("doc_id % 3 = 0 OR (doc_id IS NULL AND text IS NULL)").select(
        "doc_id", text_id(F.col("text")).alias("text_id")).distinct()
    want = {(i, t) for i, t, _ in rows if (i is not None and i % 3 == 0) or (i is None and t is None)}
    for bound in (300_000, 0):
        left = without_rows(docs, near_dup.stage(gone, "gone"), bound)
        assert left.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted(
            ((i, t) for i, t, _ in rows if (i, t) not in want), key=str)


# Words that repeat.

def plain_best(a, b):
    """Most equal words of an alignment with a passage, trying every shift."""
    width, best = min(13, len(b)), None
    for shift in range(1 - len(b), len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == b[i] for i in range(len(b))]
        inside = [i for i in range(len(b)) if 0 <= i + shift < len(a)]
        if any(100 * sum(same[i:i + width]) >= 80 * width for i in inside if i + width - 1 in inside):
            best = max(best or 0, sum(same))
    return best


def aligned(a, b):
    a, b = (np.array(x, dtype=np.int64) for x in (a, b))
    none = np.zeros(0, dtype=np.int64)
    tokens = decontamination.Tokens(none, none, none, none, np.zeros(len(a), dtype=np.int64), none, a.view(np.uint64))
    found = [decontamination._hashes(tokens, s) for s in decontamination._seeds(len(b))]
    at, hashes = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return decontamination._best_alignment(a, b, hashes.view(np.int64), at)


@pytest.mark.parametrize("most", [200_000, 0])
def test_best_alignment_equals_all_shifts(monkeypatch, most):
    monkeypatch.setattr(decontamination, "MAX_PAIRS", most)
    rng = random.Random(4)
    for _ in range(300):
        words = rng.randint(1, 5)
        b = [rng.randrange(words) for _ in range(rng.randint(7, 40))]
        a = [rng.randrange(words) for _ in range(rng.randint(0, 30))] + [x if rng.random() < 0.9 else 9 for x in b[rng.randint(0, 5):]]
        a += [rng.randrange(words) for _ in range(rng.randint(0, 10))]
        assert aligned(a, b) == plain_best(a, b)


def test_one_word_again_and_again(spark):
    start = time.time()
    assert aligned([5] * 100_000, [5] * 100_000) == 100_000
    assert aligned([5, 6] * 50_000, [6, 5] * 40_000) == 80_000
    docs = spark.createDataFrame([(1, "word " * 100_000), (2, prose("none", 300))], "doc_id long, text string")
    bench = spark.createDataFrame([(3, "Word, " * 100_000)], "item_id long, text string")
    assert [tuple(r) for r in leaks(docs, bench).collect()] == [(1, 3, 100_000)]
    assert time.time() - start < 60


@pytest.mark.parametrize("percent,pct", [(50, 100), (70, 43), (80, 25), (85, 18), (95, 6)])
def test_similar_pairs_meet_in_one_child_a_node(percent, pct):
    plan = JoinPlan(percent=percent)
    assert plan.second_branch_pct == pct
    assert (100 + plan.second_branch_pct) * percent >= 10_000
