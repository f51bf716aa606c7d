"""Near-duplicates by a chosen-path similarity join over minwise tokens.

A tree branches on one coordinate of the documents' minwise signatures at a
time: documents with the same value go to the same child. The coordinate of a
node follows from a hash of the path to it, and some nodes branch on a second
one, so similar sets are expected to meet in about one child per node. Nodes
with few documents are compared exhaustively by sketch; large ones branch
again, until a child keeps most of its parent: those documents are taken as
alike. Trees are independent, and their number sets the recall. What the trees
bring together makes candidate clusters, inside which all pairs are compared on
the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import SkewLimits, join_unique
from ..session import collected, remove, stage
from .common import LOWER, WORD, chunks, mix, only_last, table, text_bytes, text_id, tokenize, without_rows
from .components import components

SHINGLE = 5
SIGNATURE = 128
_MULTIPLIERS = mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass(frozen=True)
class JoinPlan:
    """Similarity in percent, what sets recall and cost of the trees, and how much one task compares.

    Clusters with more than block_shingles shingles are cut into blocks that are
    compared two by two; with more than pair_blocks blocks, all documents are
    compared with about `leaders` of them first. Up to broadcast_rows documents
    (of about 100 bytes each) or nodes (16 bytes) are looked up through a broadcast, more
    by a shuffle; a node of more than hot_rows documents is split there.
    """

    percent: int = 85
    trees: int = 20
    depth: int = 8
    node_limit: int = 24
    alike_pct: int = 60
    block_shingles: int = 200_000
    pair_blocks: int = 8
    leaders: int = 64
    broadcast_rows: int = 300_000
    hot_rows: int = 20_000

    @property
    def second_branch_pct(self) -> int:
        """Nodes that branch twice: as many as bring pairs of just this similarity together in one child a node."""
        return -(-10_000 // self.percent) - 100

    @property
    def most_bits(self) -> int:
        """Different sketch bits that a similar pair exceeds with a chance below 1e-6."""
        p = (1 - self.percent / 100) / 2
        return math.ceil(SIGNATURE * p + 5.5 * math.sqrt(SIGNATURE * p * (1 - p)))


# Sets and signatures, batch by batch. --------------------------------------

def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of the texts in a row, and where each text's begin."""
    data, offsets = text_bytes(texts)
    tokens = tokenize(LOWER[data], offsets, WORD)
    at = tokens.runs(SHINGLE)
    hashes, owner = [tokens.run_hash(at, list(range(SHINGLE)))], [tokens.text[at]]
    count = np.diff(tokens.first)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        hashes.append(tokens.run_hash(tokens.first[short], list(range(n))))
        owner.append(short)
    h, text = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(text, kind="stable")
    h, text = h[order], text[order]
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        h[s:e].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def _root_places(trees: int) -> list[int]:
    """The coordinate at the root of each tree."""
    return [t * 6 % SIGNATURE + t // 21 for t in range(trees)]


def _prints(texts: pa.Array, trees: int) -> dict[str, np.ndarray]:
    h, bounds = shingle_sets(texts)
    n, sizes = len(texts), np.diff(bounds)
    some = sizes > 0
    starts = bounds[:-1][some]
    low = np.zeros((n, SIGNATURE), dtype=np.uint32)
    sums = np.zeros((2, n), dtype=np.uint64)
    if len(starts):
        for j, a in enumerate(_MULTIPLIERS):
            low[some, j] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), starts)
        sums[0, some] = np.add.reduceat(mix(h), starts)
        sums[1, some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), starts)
    bits = np.packbits((low & 1).astype(np.uint8), axis=1).view(np.int64)
    return {"n_shingles": sizes.astype(np.int64), "fp1": sums[0].view(np.int64), "fp2": sums[1].view(np.int64),
            "sig": low.astype(np.uint16), "roots": low[:, _root_places(trees)], "s1": bits[:, 0].copy(), "s2": bits[:, 1].copy()}


_PRINTS = "n_shingles bigint, fp1 bigint, fp2 bigint, sig binary, roots binary, s1 bigint, s2 bigint"


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as its bytes."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(
        pa.binary(wide), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", trees: int = JoinPlan.trees) -> DataFrame:
    """doc_id, text_id, set size, 128-bit fingerprint of the set, signature, roots and sketch of each row.

    The signature has 16 bits of each minimum; roots have all 32 bits of those at which the trees begin,
    as every document meets every other one there.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_id(F.col(text)).alias("text_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(2)):
                p = _prints(texts, trees)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, len(texts)) for c in batch.columns[:2]],
                     *[pa.array(v) if v.ndim == 1 else _binary(v) for v in p.values()]], ["doc_id", "text_id", *p])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_id binary, {_PRINTS}")


def _with_sets(docs: DataFrame, wanted: DataFrame, plan: JoinPlan, n_wanted: int, key: str, text: str) -> DataFrame:
    """(node, cluster, block, blocks, leads, shingles) of the wanted representatives; a task gives each once."""
    wanted = F.broadcast(wanted) if n_wanted <= plan.broadcast_rows else wanted
    own = ["node", "cluster", "block", "blocks", "leads"]
    rows = docs.select(F.col(key).alias("_id"), text_id(F.col(text)).alias("_text_id"), F.col(text).alias("text")).join(
        wanted, F.expr("_id <=> first.doc_id AND _text_id = first.text_id")).select(*own, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row may be there again and again, with id and text.
        seen: set[int] = set()
        for batch in batches:
            new = [node not in seen and not seen.add(node) for node in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(new, type=pa.bool_()))
            for at, texts in chunks(batch.column(5)):
                h, bounds = shingle_sets(texts)
                sets = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).slice(at, len(texts)) for k in range(5)], sets], [*own, "shingles"])

    return rows.mapInArrow(run, "node bigint, cluster bigint, block int, blocks int, leads boolean, shingles array<bigint>")


# Trees. --------------------------------------------------------------------

def _coordinate(sig: str, i: Column) -> Column:
    return F.substring(F.col(sig), (2 * i + 1).cast("int"), F.lit(2))


def _alike(plan: JoinPlan, a: Column, b: Column) -> Column:
    """Neither size nor sketch rules the pair out."""
    n, m = a["n"], b["n"]
    bits = F.bit_count(a["s1"].bitwiseXOR(b["s1"])) + F.bit_count(a["s2"].bitwiseXOR(b["s2"]))
    return (F.least(n, m) * 100 >= F.greatest(n, m) * plan.percent) & (bits <= plan.most_bits)


def _joined(rows: DataFrame, lookup: DataFrame, total: int, plan: JoinPlan) -> DataFrame:
    """Rows with what a written table has for their path, if it has any; a hot path is split."""
    n = lookup.count()
    if n <= plan.broadcast_rows:
        return rows.join(F.broadcast(lookup), "path")
    hot = SkewLimits(heavy_rows=plan.hot_rows)
    return join_unique(rows, lookup, ["path"], "node", total, "inner", hot)


def _counted(rows: DataFrame, total: int, plan: JoinPlan) -> DataFrame:
    """Rows of nodes with two documents or more, with their number; no group meets in one task."""
    counts = stage(rows.groupBy("path").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "counts")
    return stage(_joined(rows, counts, total, plan), "paths")


def _pairs_of_small(rows: DataFrame, plan: JoinPlan) -> DataFrame:
    """All pairs inside nodes of at most node_limit documents that may be similar."""
    member = F.struct("node", "n", "s1", "s2")
    grouped = rows.filter(F.col("members") <= plan.node_limit).groupBy("path").agg(
        F.sort_array(F.collect_list(member)).alias("_m"))
    pairs = F.flatten(F.transform("_m", lambda a, i: F.transform(
        F.filter("_m", lambda b, k: (k > i) & (b["node"] != a["node"]) & _alike(plan, a, b)),
        lambda b: F.struct(a["node"].alias("a"), b["node"].alias("b")))))
    return grouped.select(F.explode(pairs).alias("_p")).select("_p.*")


def _branch(rows: DataFrame, reps: DataFrame, plan: JoinPlan) -> DataFrame:
    """Rows of large nodes in their children: one chosen coordinate, in some nodes two."""
    chosen = lambda seed: F.pmod(F.xxhash64("path", F.lit(seed)), F.lit(SIGNATURE))
    child = lambda seed: F.xxhash64("path", chosen(seed), _coordinate("sig", chosen(seed)))
    twice = F.pmod(F.xxhash64("path", F.lit(0)), F.lit(100)) < plan.second_branch_pct
    children = F.when(twice, F.array(child(1), child(2))).otherwise(F.array(child(1)))
    return rows.join(reps.select("node", "sig"), "node").select(
        F.explode(children).alias("path"), "node", "n", "s1", "s2", F.col("members").alias("parent"))


def _stars(rows: DataFrame, total: int, plan: JoinPlan) -> DataFrame:
    """Every document of a node with the node's first."""
    centres = stage(rows.groupBy("path").agg(F.min("node").alias("a")), "centres")
    return _joined(rows, centres, total, plan).filter("a != node").select("a", F.col("node").alias("b"))


def _candidates(reps: DataFrame, plan: JoinPlan) -> DataFrame:
    """Edges (a, b): alike pairs of small nodes, and stars of nodes whose documents are taken as alike.

    Alike are the documents of a large node that holds most of its parent, or is
    as deep as trees go.
    """
    spark = reps.sparkSession
    roots = F.array(*[F.xxhash64(F.lit(t), F.substring("roots", 4 * t + 1, 4)) for t in range(plan.trees)])
    rows = reps.select(F.explode(roots).alias("path"), "node", "n", "s1", "s2", F.lit(None).cast("long").alias("parent"))
    total = reps.count() * plan.trees
    edges, before = [], []
    for level in range(plan.depth):
        with only_last(spark), collected() as staged:
            if level:
                rows = stage(rows, "children")
                total = rows.count()
            rows = _counted(rows, total, plan)
        with only_last(spark):
            found = _pairs_of_small(rows, plan)
            large = rows.filter(F.col("members") > plan.node_limit)
            more = not large.isEmpty()
            if more:
                alike = F.coalesce(F.col("members") * 100 >= F.col("parent") * plan.alike_pct, F.lit(False))
                last = level + 1 == plan.depth
                found = found.unionByName(_stars(large if last else large.filter(alike), total, plan))
            edges.append(stage(found, "edges"))
        remove(spark, before)
        if not more:
            break
        rows, before = _branch(large.filter(~alike), reps, plan), staged[-1:]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return stage(out.distinct(), "candidates")


# Links. --------------------------------------------------------------------

def similar_links(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sorted sets that join everything similar, fewest possible, by exact comparison.

    If there are two sides, only pairs across them count. By size, each set is
    compared with the smaller ones that share one of its rarest shingles:
    similar sets must. Pairs that are joined already are not compared again.
    """
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    across = len(np.unique(side)) > 1
    _, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ends = np.cumsum([len(x) for x in sets])
    holders: dict[int, list[int]] = {}
    links = []
    for i in sorted(range(len(sets)), key=lambda k: (len(sets[k]), k)):
        mine, n = sets[i], len(sets[i])
        place = places[ends[i] - n: ends[i]]
        rare = place[np.lexsort((place, counts[place]))[: n - -(-percent * n // 100) + 1]]
        seen = set()
        for p in rare.tolist():
            seen.update(holders.get(p, ()))
            holders.setdefault(p, []).append(i)
        for j in sorted(seen):
            m = len(sets[j])
            if 100 * m < percent * n or (across and side[i] == side[j]) or root(i) == root(j):
                continue
            at = np.searchsorted(mine, sets[j])
            both = int(np.count_nonzero(mine[np.minimum(at, n - 1)] == sets[j]))
            if 100 * both >= percent * (n + m - both):
                parent[root(i)] = root(j)
                links.append((i, j))
    return links


def _compared(groups: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside the groups: arrays of nodes, sides and sets, each of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, sides, sets in zip(*batch.columns, strict=True):
                nodes, sides = nodes.values.to_numpy(), sides.values.to_numpy()
                # Sorted, and each node once a side.
                _, order = np.unique(np.stack([nodes, sides], axis=1), axis=0, return_index=True)
                lists = sets.values
                each = [lists[int(k)].values.to_numpy().view(np.uint64) for k in order]
                found = similar_links(each, sides[order], percent)
                pairs = nodes[order][np.array(found, dtype=np.int64).reshape(-1, 2)]
                pairs = pairs[pairs[:, 0] != pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    members = groups.agg(F.collect_list(F.struct("node", "side", "shingles")).alias("_d"))
    return members.filter(F.size("_d") > 1).select(
        F.col("_d.node").alias("nodes"), F.col("_d.side").alias("sides"), F.col("_d.shingles").alias("sets")).mapInArrow(
        run, "a bigint, b bigint")


def _blocks_of(shingles: Column, plan: JoinPlan) -> Column:
    return F.ceil(shingles / plan.block_shingles).cast("int")


def _all_blocks(column: str) -> Column:
    return F.sequence(F.lit(0), F.col(column) - 1)


def _pairwise(sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """Every block of a cluster with every other and with itself."""
    meets = F.transform(_all_blocks("blocks"), lambda j: F.struct(
        F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return _compared(sets.select("cluster", F.explode(meets).alias("_meet"), "node", F.col("block").alias("side"),
                                 "shingles").groupBy("cluster", "_meet"), plan.percent)


def _against(some: DataFrame, sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """Some documents (with block `part` of `parts`) against all of their cluster, block by block."""
    ours = some.select("cluster", "part", F.explode(_all_blocks("blocks")).alias("block"), "node", F.lit(1).alias("side"),
                       "shingles")
    parts = some.select("cluster", "part").distinct()
    theirs = sets.join(parts, "cluster").select("cluster", "part", "block", "node", F.lit(0).alias("side"), "shingles")
    return _compared(ours.unionByName(theirs).groupBy("cluster", "part", "block"), plan.percent)


def _led(sets: DataFrame, plan: JoinPlan) -> DataFrame:
    """Links inside clusters of many blocks: through leaders, then what these have not joined with all.

    Members of a cluster's largest component need not be compared with each
    other any more; each other document is, with every document of the cluster.
    """
    led = stage(_against(sets.filter("leads").withColumn("part", F.lit(0)), sets, plan), "links")
    joined = sets.select("node", "cluster", F.size("shingles").alias("n"))
    if led.isEmpty():
        joined = joined.withColumn("label", F.col("node"))
    else:
        joined = joined.join(components(led), "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = stage(joined, "joined")
    main = joined.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("_n")).groupBy("cluster").agg(
        F.max(F.struct("_n", "label"))["label"].alias("main"))
    outside = joined.join(main, "cluster").filter("label != main")
    size = outside.groupBy("cluster").agg(F.sum("n").alias("_shingles"))
    outside = stage(outside.join(size, "cluster").select("node", F.pmod(
        F.xxhash64("node"), _blocks_of(F.col("_shingles"), plan)).cast("int").alias("part")), "outside")
    if outside.isEmpty():
        return led
    return led.unionByName(_against(sets.join(outside, "node"), sets, plan))


def _links(docs: DataFrame, reps: DataFrame, clusters: DataFrame, plan: JoinPlan, key: str, text: str) -> DataFrame:
    """Confirmed links (a, b) inside the clusters (node, label)."""
    members = clusters.join(reps.select("node", "n", "first"), "node")
    sizes = members.groupBy("label").agg(F.sum("n").alias("_shingles"), F.count(F.lit(1)).alias("_members"))
    blocks = _blocks_of(F.col("_shingles"), plan)
    drawn = F.pmod(F.xxhash64("node", F.lit("leads")), F.lit(1 << 20)) * F.col("_members") < F.lit(plan.leaders << 20)
    wanted = stage(members.join(sizes, "label").select(
        "node", F.col("label").alias("cluster"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
        blocks.alias("blocks"), drawn.alias("leads"), "first"), "wanted")
    large = F.col("blocks") > plan.pair_blocks
    n_wanted = wanted.count()
    links = _pairwise(_with_sets(docs, wanted.filter(~large), plan, n_wanted, key, text), plan)
    if not wanted.filter(large).isEmpty():
        sets = stage(_with_sets(docs, wanted.filter(large), plan, n_wanted, key, text), "sets")
        links = links.unionByName(_led(sets, plan))
    return stage(links, "links")


def near_duplicates(docs: DataFrame, plan: JoinPlan = JoinPlan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Sets are the distinct 5-word shingles of the text with A-Z lowered, or all
    of its words if they are fewer. Documents are linked from `percent` percent
    Jaccard similarity on; component_id is the smallest id reachable. Documents
    with equal sets are one node of the join. Null, empty and blank texts have
    no shingles and are linked with nothing. Rows that repeat an id share its
    component; a null id counts as no id. Other columns are not read.
    """
    return _marked(docs, plan, key, text)[0].drop("text_id")


def _marked(docs: DataFrame, plan: JoinPlan, key: str, text: str) -> tuple[DataFrame, list[str]]:
    """What near_duplicates returns, with text_id, and the folders it reads."""
    spark = docs.sparkSession
    with collected() as kept:
        prints = stage(fingerprints(docs, key, text, plan.trees), "prints")
    own = prints.filter("n_shingles > 0").groupBy("fp1", "fp2", F.col("n_shingles").alias("n")).agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_id")).alias("first"),
        F.any_value("sig").alias("sig"), F.any_value("roots").alias("roots"),
        F.any_value("s1").alias("s1"), F.any_value("s2").alias("s2"))
    with only_last(spark), collected() as last:
        reps = stage(own.withColumn("node", F.monotonically_increasing_id()), "reps")
        with only_last(spark):
            candidates = _candidates(reps, plan)
        own = reps.select("node", "fp1", "fp2", "first_id")
        if candidates.isEmpty():
            labelled = own.withColumn("label", F.col("node"))
        else:
            with only_last(spark):
                clusters = components(candidates)
            with only_last(spark):
                links = _links(docs, reps, clusters, plan, key, text)
            with only_last(spark):
                joined = components(links)
            labelled = own.join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
        smallest = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
        classes = stage(labelled.join(smallest, "label").select("fp1", "fp2", "component_id"), "classes")
    # Copies are many rows of one class; the class table has one row each.
    rows = prints.select("doc_id", "text_id", "n_shingles", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left")
    component = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), F.col("doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"),
                       component.eqNullSafe(F.col("doc_id")).alias("kept"), "text_id"), kept + last[-1:]


def keep_one(docs: DataFrame, plan: JoinPlan = JoinPlan()) -> DataFrame:
    """The rows of one document of each component, columns unchanged.

    Rows go by id and text: other texts under the id of a copy, or without an id as it, stay.
    """
    found, read = _marked(docs, plan, "doc_id", "text")
    copies = stage(found.filter(~F.col("kept")).select("doc_id", "text_id").distinct(), "copies")
    remove(docs.sparkSession, read)
    return without_rows(docs, copies)


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
