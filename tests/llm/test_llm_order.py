"""Prefix sums, sharding, mixing and the pipeline."""

import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from check_oracle import compare, connect
from llm_cases import documents, frame
from tersefold.llm.common import prefix_sums
from tersefold.llm.mixing import mix, mixed_documents
from tersefold.llm.sharding import assign_shards, shard_documents

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
import tersefold.llm.registry as registry  # noqa: E402


def test_prefix_sums_of_ties_and_groups(spark):
    rows = [(i % 2, 5 if i < 400 else i, i % 7) for i in range(900)]
    got = prefix_sums(spark.createDataFrame(rows, "g int, k long, v long"), ["g"], ["k"], "v").collect()
    for g in (0, 1):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r._index)
        assert [r._index for r in mine] == list(range(450))
        assert [r.k for r in mine] == sorted(r.k for r in mine)
        total = 0
        for r in mine:
            assert r._before == total
            total += r.v


def test_shards_are_contiguous_and_near_equal(spark):
    rows = documents(60)
    docs = frame(spark, rows)
    got = assign_shards(docs, 4).collect()
    size = lambda t: len((t or "").encode()) + 1
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, size(r[1]), zlib.crc32((r[1] or "").encode())))
    total, at, want, slots = sum(size(r[1]) for r in rows), 0, [], {}
    for r in order:
        s = at * 4 // total
        want.append((r[0], size(r[1]), zlib.crc32((r[1] or "").encode()), s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        at += size(r[1])
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    whole = shard_documents(docs, 4)
    assert whole.columns == docs.columns
    once = lambda rs: sorted(rs, key=key)
    unique = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    assert once((r.doc_id, r.shard) for r in whole.collect() if r.doc_id in unique) == once(
        (r.doc_id, r.shard) for r in got if r.doc_id in unique)
    assert assign_shards(docs.limit(0)).count() == 0 and shard_documents(docs.limit(0)).count() == 0


def test_shards_of_the_table(spark):
    got = registry.QUERIES["op5_sharding"](spark, "/root/testdata/sf0.001").collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    assert sorted(sizes) == list(range(8))
    most = max(r.size for r in got)
    each = [sum(r.size for r in rows) for rows in sizes.values()]
    assert max(each) - min(each) <= 2 * most
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in sizes.values())


def test_mix_takes_each_budget(spark):
    docs = frame(spark, documents(60)).withColumn("source", F.when(F.col("doc_id") < 3, "tiny").otherwise(F.col("source")))
    done = mix(docs)
    assert done.rows.count() == docs.count()
    n_words = {}
    for r in docs.collect():
        n_words[r.source] = n_words.get(r.source, 0) + len((r.text or "").split())
    targets = {r._source: r.target for r in done.sources.collect()}
    sizes = {s: (n, targets["null" if s is None else f"s{s}"]) for s, n in n_words.items()}
    total = sum(s for s, _ in sizes.values())
    names = sorted([s for s in sizes if s is not None]) + [None]
    assert sum(t for _, t in sizes.values()) == pytest.approx(total)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free = {s for s, (n, t) in sizes.items() if t < 3 * n}
    assert all(t <= 3 * n for n, t in sizes.values())
    assert free and len(free) < len(sizes)
    shares = [sizes[s][1] / weight[s] for s in free]
    assert max(shares) == pytest.approx(min(shares))
    for s, (n, target) in sizes.items():
        mine = done.rows.filter(F.col("source_size") == n).collect()
        assert abs(sum(r.taken for r in mine) - target) <= 1
        assert all(r.taken <= 3 * r.size for r in mine)
    again = {(r.doc_id, r.size, r.taken) for r in mix(docs).rows.collect()}
    assert again == {(r.doc_id, r.size, r.taken) for r in done.rows.collect()}


def test_mixed_rows_are_whole_and_repeated(spark):
    docs = frame(spark, documents(60))
    copies = mix(docs).rows.groupBy("doc_id").agg(F.sum("copies").alias("n"))
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    counted = dict(got.groupBy("doc_id").count().collect())
    assert counted == {r.doc_id: r.n for r in copies.collect() if r.n}
    empty = mix(docs.limit(0))
    assert empty.rows.count() == 0 and mixed_documents(docs.limit(0)).count() == 0
    blank = docs.withColumn("text", F.lit(None).cast("string"))
    assert {(r.target, r.taken) for r in mix(blank).rows.collect()} == {(0.0, 0)}


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [docs]
    for _, step in corpus_pipeline.STAGES:
        done = step(spark, kept[-1], folder)
        kept.append(spark.createDataFrame(done.collect(), done.schema))
    assert [k.columns for k in kept[:-1]] == [docs.columns] * 5
    assert kept[-1].columns == [*docs.columns, "shard"]
    n = [k.count() for k in kept]
    assert n[0] > n[1] > n[2] >= n[3]
    bad = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("quality = 0").collect()}
    left = {r.doc_id for r in kept[1].collect()}
    assert len(bad & left) <= 0.1 * len(bad)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.count() == n[5] and whole.columns == kept[-1].columns


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_equals_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, connect(folder), name, registry.QUERIES[name], registry.SQL[name], folder)


def test_every_query_has_its_number():
    assert [int(k[2:].split("_")[0]) for k in registry.QUERIES] == list(range(1, 14))
    assert set(registry.SQL) <= set(registry.QUERIES)
