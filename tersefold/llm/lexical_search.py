"""Ranked lexical search of many queries at once, by shared parts of them.

Queries that hold the same terms repeat the same sums. So the term sets that
several queries share are mined first and become nodes of a directed acyclic
graph: leaves are terms, inner nodes are shared sets, a query is the sum of a
few nodes. For every batch of documents the scores of the leaves are looked up,
every shared set is added up once, and the queries combine what is there.

The documents are read once per pass of queries; counts of documents are taken
over all of them. Every task keeps the best of each query only, and those are
ranked in two steps.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import collected, remove, stage
from .common import ALNUM, LOWER, chunks, prefix_sums, table, text_bytes, tokenize

NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchPlan:
    """How many results a query gets, and bounds of what is kept at once.

    A pass has queries of at most pass_terms terms and one query more; that is
    all the driver and the tasks ever hold of the queries. Shared sets are mined
    in blocks of block_queries queries and block_terms terms. Sets of less
    than shared_by queries are not worth a node of their own. `cells` bounds the scores that a
    task works on at once, `buffered` the results it keeps before it drops all but the best.
    """

    top: int = 20
    pass_terms: int = 100_000
    block_queries: int = 256
    block_terms: int = 16_384
    shared_by: int = 3
    cells: int = 1 << 20
    buffered: int = 1 << 16


# Queries as a graph. -------------------------------------------------------

@dataclass
class Sharing:
    """Nodes 0 to n_leaves - 1 are terms; then `sums` gives the children of each inner node, `queries` those of each query."""

    n_leaves: int
    sums: list[np.ndarray] = field(default_factory=list)
    queries: list[np.ndarray] = field(default_factory=list)

    @property
    def additions(self) -> int:
        return sum(len(c) - 1 for c in [*self.sums, *self.queries] if len(c))

    def scores(self, leaves: np.ndarray) -> np.ndarray:
        """Scores (query, document) from those of the terms (term, document)."""
        nodes = np.zeros((self.n_leaves + len(self.sums), leaves.shape[1]), dtype=np.int64)
        nodes[: self.n_leaves] = leaves
        for k, children in enumerate(self.sums, self.n_leaves):
            nodes[children].sum(axis=0, out=nodes[k])
        out = np.zeros((len(self.queries), leaves.shape[1]), dtype=np.int64)
        for k, children in enumerate(self.queries):
            nodes[children].sum(axis=0, out=out[k])
        return out


def _blocks(sizes: list[int], plan: SearchPlan) -> Iterator[range]:
    start = terms = 0
    for k, size in enumerate(sizes):
        if k > start and (k - start >= plan.block_queries or terms + size > plan.block_terms):
            yield range(start, k)
            start, terms = k, 0
        terms += size
    if sizes:
        yield range(start, len(sizes))


def mined(queries: list[list[int]], n_leaves: int, plan: SearchPlan = SearchPlan()) -> Sharing:
    """The graph of queries given as lists of terms, repeats included.

    The k-th occurrence of a term in a query is an element of its own. Elements of
    exactly the same queries become one node at once. Then, round by round, nodes
    that share most queries with each other are joined in those, until no
    two share enough.
    """
    out = Sharing(n_leaves, [], [np.zeros(0, dtype=np.int64)] * len(queries))
    for block in _blocks([len(q) for q in queries], plan):
        holders: dict[tuple[int, int], list[int]] = {}
        for place, q in enumerate(block):
            for term, n in Counter(queries[q]).items():
                for k in range(n):
                    holders.setdefault((term, k), []).append(place)
        alike: dict[tuple[int, ...], list[int]] = {}
        for (term, _), places in holders.items():
            alike.setdefault(tuple(places), []).append(term)
        parts: list[list[int]] = [[] for _ in block]
        node, used = [], []

        def joined(children: list[int]) -> int:
            out.sums.append(np.array(children, dtype=np.int64))
            return n_leaves + len(out.sums) - 1

        for places, terms in alike.items():
            if len(places) < plan.shared_by:
                for place in places:
                    parts[place] += terms
                continue
            row = np.zeros(len(block), dtype=np.float32)
            row[list(places)] = 1
            node.append(joined(terms) if len(terms) > 1 else terms[0])
            used.append(row)
        while len(used) > 1:
            rows = np.stack(used)
            shared = rows @ rows.T
            np.fill_diagonal(shared, 0)
            best, most = shared.argmax(axis=1), shared.max(axis=1)
            pairs = [(a, b) for a, b in enumerate(best.tolist()) if most[a] >= plan.shared_by and a < b and best[b] == a]
            if not pairs and most.max() >= plan.shared_by:
                pairs = [tuple(divmod(int(shared.argmax()), len(used)))]
            if not pairs:
                break
            for a, b in pairs:
                both = rows[a] * rows[b]
                node.append(joined([node[a], node[b]]))
                used.append(both)
                used[a], used[b] = rows[a] - both, rows[b] - both
            left = [k for k, row in enumerate(used) if row.any()]
            # What a single query is left with needs no further look.
            node, used = [node[k] for k in left], [used[k] for k in left]
        for n, row in zip(node, used, strict=True):
            for place in np.flatnonzero(row):
                parts[place].append(n)
        for place, q in enumerate(block):
            out.queries[q] = np.array(parts[place], dtype=np.int64)
    return out


# Terms of documents. -------------------------------------------------------

def _terms(texts: pa.Array):
    data, offsets = text_bytes(texts)
    return tokenize(LOWER[data], offsets, ALNUM)


def _postings(docs: DataFrame, vocabulary: np.ndarray, key: str, text: str) -> DataFrame:
    """doc_id, n (terms), terms and tfs of the vocabulary's terms, for documents with terms. Vocabulary: sorted hashes."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                tokens = _terms(texts)
                n = np.diff(tokens.first).astype(np.int64)
                term = np.minimum(np.searchsorted(vocabulary, tokens.hash), len(vocabulary) - 1)
                known = vocabulary[term] == tokens.hash
                both, tf = np.unique(tokens.text[known] * len(vocabulary) + term[known], return_counts=True)
                places = np.searchsorted(both // len(vocabulary), np.arange(len(texts) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(places), pa.array(v.astype(np.int32)))
                         for v in (both % len(vocabulary), tf)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"]).filter(
                    pa.array(n > 0))

    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _document_counts(postings: DataFrame, n_terms: int) -> dict[int, int]:
    """Documents per term of the vocabulary; tasks add up what they see before anything is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, dtype=np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0)), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    counts = postings.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counts.collect()}


# Ranking. ------------------------------------------------------------------

class _Best:
    """The best documents of each query so far."""

    def __init__(self, n_queries: int, plan: SearchPlan):
        self.plan, self.held = plan, 0
        self.least = np.ones(n_queries, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, scores: np.ndarray, doc_id: np.ndarray) -> None:
        query, doc = np.nonzero(scores >= self.least[:, None])
        self.parts.append((query, scores[query, doc], doc_id[doc]))
        self.held += len(query)
        if self.held > self.plan.buffered:
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, doc_id = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, dtype=np.int64)]) for k in range(3))
        order = np.lexsort((doc_id, -score, query))
        query, score, doc_id = query[order], score[order], doc_id[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.plan.top
        last = rank == self.plan.top - 1
        self.least[query[last]] = score[last]
        self.parts, self.held = [(query[keep], score[keep], doc_id[keep])], 0
        return self.parts[0]


def _ranked_in_tasks(postings: DataFrame, numbers: np.ndarray, sharing: Sharing, weights: np.ndarray, n_docs: int,
                     n_terms: int, plan: SearchPlan) -> DataFrame:
    """query (its number), score, doc_id of the best documents of every task."""
    wide = sharing.n_leaves + len(sharing.sums) + len(sharing.queries)
    step = max(1, min(1024, plan.cells // max(1, wide)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(sharing.queries), plan)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                doc_id, n, terms, tfs = batch.slice(at, step).columns
                n = n.to_numpy()
                m = 75 + 25 * n * n_docs // n_terms
                doc = np.repeat(np.arange(len(n)), terms.value_lengths().to_numpy())
                term, tf = _flat(terms), _flat(tfs).astype(np.int64)
                leaves = np.zeros((sharing.n_leaves, len(n)), dtype=np.int64)
                leaves[term, doc] = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
                best.add(sharing.scores(leaves), doc_id.fill_null(NO_ID).to_numpy())
        query, score, doc_id = best.best()
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[query]), pa.array(score), pa.array(doc_id, mask=doc_id == NO_ID)], ["query", "score", "doc_id"])

    return postings.mapInArrow(run, "query bigint, score bigint, doc_id bigint")


def _top(rows: DataFrame, n_parts: int, top: int) -> DataFrame:
    """rank within each query: first inside parts of the tasks, then among what is left."""
    best_first = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    inside = Window.partitionBy("query", "part").orderBy(*best_first)
    across = Window.partitionBy("query").orderBy(*best_first)
    few = rows.withColumn("part", F.spark_partition_id() % n_parts).withColumn("rank", F.row_number().over(inside)).filter(
        F.col("rank") <= top)
    return few.withColumn("rank", F.row_number().over(across)).filter(F.col("rank") <= top).drop("part")


def _one_pass(docs: DataFrame, queries: list, plan: SearchPlan, key: str, text: str) -> DataFrame | None:
    """query (its number), rank, doc_id, score; None if no query has a term. Queries: rows of number and text."""
    tokens = _terms(pa.array([q.text for q in queries], type=pa.string()))
    if not len(tokens.hash):
        return None
    vocabulary, term = np.unique(tokens.hash, return_inverse=True)
    lists = [term[a:b].tolist() for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
    sharing = mined(lists, len(vocabulary), plan)
    postings = stage(_postings(docs, vocabulary, key, text), "postings")
    n_docs, n_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_counts(postings, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(k, 0) + 1)))
                        for k in range(len(vocabulary))], dtype=np.int64)
    n_parts = math.isqrt(postings.rdd.getNumPartitions()) + 1
    numbers = np.array([q.number for q in queries], dtype=np.int64)
    best = _ranked_in_tasks(postings, numbers, sharing, weights, n_docs, max(1, n_terms), plan)
    return stage(_top(best, n_parts, plan.top), "ranked")


def search(docs: DataFrame, items: DataFrame, plan: SearchPlan = SearchPlan(), key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the plan.top best documents of each item, by score and then key.

    Terms are stretches of letters, digits and all characters from U+0080 on,
    with A-Z lowered, of whole texts. A term's weight falls with the number of
    documents that hold it; its part in a score grows with its occurrences and
    falls with the document's length. Only scores above 0 count. Null and
    blank texts have no terms: such documents are not found nor counted, such
    items find nothing. Repeated rows are documents of their own; null keys
    come last among equals. Repeated items are ranked each by itself.
    Keys of documents are integers. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = stage(items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"),
                              F.monotonically_increasing_id().alias("number"),
                              (F.coalesce(F.length(item_text), F.lit(0)) + 1).cast("long").alias("size")), "items")
    # A term has a character and a separator at least, so characters bound the terms.
    size = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    per_pass = 2 * plan.pass_terms
    passes = -(-size // per_pass)
    if passes > 1:
        rows = stage(prefix_sums(rows, [], ["number"], "size").withColumn(
            "pass", F.expr(f"_before div {per_pass}")).drop("_before", "_index"), "items")
    found = None
    for k in range(passes):
        some = rows if passes == 1 else rows.filter(F.col("pass") == k)
        queries = some.select("number", "text").collect()
        with collected() as paths:
            one = _one_pass(docs, queries, plan, key, text)
        if one is None:
            continue
        remove(spark, paths[:-1])
        found = one if found is None else found.unionByName(one)
    names = rows.select(F.col("number").alias("query"), "item_id")
    if found is None:
        kind = docs.schema[key].dataType.simpleString()
        return names.selectExpr("item_id", "0 AS rank", f"CAST(NULL AS {kind}) AS doc_id", "0L AS score").limit(0)
    return found.join(names, "query").select("item_id", "rank", F.col("doc_id").cast(docs.schema[key].dataType), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                  table(spark, sf_dir, "benchmark").select("item_id", "text"))
