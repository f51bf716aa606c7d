"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WORD, chunks, crc_bucket, table, text_bytes, tokenize

WORD_BITS = 14
FACTORS = 8
# Bound of the labelled sample a model is fitted on, in documents (drawn by hash of id and text).
SAMPLE_DOCS = 5_000
HELD_OUT_OF = 5
THRESHOLD = 0.3
STEPS, BATCH, RATE, DECAY = 500, 128, 0.08, 1e-5
# Structure statistics: shares of these bytes, then word shapes; metadata: sizes of text and lines.
BYTE_CLASSES = ("#*$%&<>@^~", "|", "0123456789", ".,;:!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\n", "()[]{}\"'/\\=_-+")
SHAPES = ("word_bytes", "distinct_words", "same_as_before", "log_words", "log_bytes", "log_lines")
N_DENSE = len(BYTE_CLASSES) + len(SHAPES)
N_FEATURES = (1 << WORD_BITS) + N_DENSE


@dataclass
class Sparse:
    """Rows of features: `bounds` cut `index` and `value` into rows; `dense` are the statistics."""

    index: np.ndarray
    value: np.ndarray
    bounds: np.ndarray
    dense: np.ndarray


def features(texts: pa.Array) -> Sparse:
    """Hashed words of each text by square root of their count, of length 1, and its statistics."""
    data, offsets = text_bytes(texts)
    n = len(texts)
    tokens = tokenize(LOWER[data], offsets, WORD)
    n_words, n_bytes = np.diff(tokens.first).astype(float), np.diff(offsets).astype(float)
    key = (tokens.text << WORD_BITS) | (tokens.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    text, index = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    value = np.sqrt(count / np.maximum(n_words[text], 1))
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    dense = np.zeros((n, N_DENSE))
    for j, chars in enumerate(BYTE_CLASSES):
        kind = np.zeros(256, dtype=bool)
        kind[list(chars.encode())] = True
        found = per_text(kind[data])
        dense[:, j] = np.sqrt(found / np.maximum(n_bytes, 1))
        if chars == "\n":
            lines = found
    again = np.zeros(len(tokens.hash) + 1)
    again[2:] = np.cumsum((tokens.hash[1:] == tokens.hash[:-1]) & (tokens.text[1:] == tokens.text[:-1])) \
        if len(tokens.hash) else 0
    first, some = tokens.first, np.maximum(n_words, 1)
    distinct = np.diff(np.searchsorted(text, np.arange(n + 1)))
    dense[:, len(BYTE_CLASSES):] = np.stack([
        n_bytes / some / 10, distinct / some, (again[first[1:]] - again[first[:-1]]) / some,
        np.log1p(n_words) / 10, np.log1p(n_bytes) / 10, np.log1p(lines) / 10], axis=1)
    return Sparse(index, value.astype(np.float32), np.searchsorted(text, np.arange(n + 1)),
                  dense.astype(np.float32))


@dataclass
class Machine:
    """w0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, x: Sparse, pick: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of the rows picked, statistics standardised."""
        n = len(x.dense)
        pick = np.arange(n) if pick is None else pick
        sizes = np.diff(x.bounds)[pick]
        row = np.repeat(np.arange(len(pick)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(x.bounds[:-1][pick], sizes)
        dense = np.clip((x.dense[pick] - self.mean) / self.scale, -4, 4) / 2
        return (np.concatenate([row, np.repeat(np.arange(len(pick)), N_DENSE)]),
                np.concatenate([x.index[at], np.tile(np.arange(N_DENSE) + (1 << WORD_BITS), len(pick))]),
                np.concatenate([x.value[at], dense.ravel()]).astype(np.float32))

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Margins in time linear in the features: half of (sum v x)^2 less sum (v x)^2; and sum v x."""
        vx = self.factors[feature] * value[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(row, np.square(vx).sum(axis=1), n)
        linear = np.bincount(row, self.linear[feature] * value, n)
        return self.bias + linear + 0.5 * (np.square(sums).sum(axis=1) - squares), sums

    def scores(self, x: Sparse) -> np.ndarray:
        n = len(x.dense)
        margin, _ = self.margin(*self.rows(x), n)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(x: Sparse, y: np.ndarray, seed: int = 1) -> Machine:
    """Logistic loss, minibatches with per-weight rates. With one kind of label all scores are its share."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 1) / (len(y) + 2)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES, dtype=np.float32),
                rng.normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32),
                x.dense.mean(axis=0) if len(y) else np.zeros(N_DENSE), np.ones(N_DENSE))
    if len(y):
        m.scale = np.maximum(x.dense.std(axis=0), 1e-3)
    seen_w, seen_v = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6)
    if not 0 < y.sum() < len(y):
        m.factors[:] = 0
        return m
    batches = max(1, len(y) // min(BATCH, max(16, len(y) // 20)))
    for _ in range(-(-STEPS // batches)):
        for pick in np.array_split(rng.permutation(len(y)), batches):
            row, feature, value = m.rows(x, pick)
            margin, sums = m.margin(row, feature, value, len(pick))
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
            m.bias -= RATE * float(error.sum())
            own, back = np.unique(feature, return_inverse=True)
            ev = error[row] * value
            gw = np.bincount(back, ev, len(own)) + DECAY * m.linear[own]
            vx = m.factors[feature] * value[:, None]
            gv = np.stack([np.bincount(back, ev * (sums[row, f] - vx[:, f]), len(own)) for f in range(FACTORS)], axis=1)
            gv += DECAY * m.factors[own]
            seen_w[own] += gw * gw
            seen_v[own] += gv * gv
            m.linear[own] -= RATE * gw / np.sqrt(seen_w[own])
            m.factors[own] -= 0.3 * RATE * gv / np.sqrt(seen_v[own])
    return m


def _sample(docs: DataFrame, labels: DataFrame, bound: int) -> tuple[Sparse, np.ndarray]:
    """Features and labels of at most `bound` labelled documents in the learning part, those of the least hashes.

    A document is an id with its text; rows that repeat both are one, whatever their number.
    """
    one = labels.filter("quality is not null and doc_id is not null").filter(
        crc_bucket(F.col("doc_id"), HELD_OUT_OF) != 0).groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("y"))
    share = min(1.0, 2 * bound / max(1, one.count()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    drawn = F.broadcast(one.filter(place <= share))  # about two times the bound, each id once
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("hash")).join(drawn, "doc_id")
    least = found.select("hash").distinct().orderBy("hash").limit(bound)
    rows = found.join(F.broadcast(least), "hash").select("hash", "y", "text").dropDuplicates(["hash"]).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                x = features(texts)
                cut = pa.array(x.bounds, type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(cut, pa.array(x.index)),
                     pa.ListArray.from_arrays(cut, pa.array(x.value)), pa.array(list(x.dense))],
                    ["y", "index", "value", "dense"])

    got = rows.mapInArrow(run, "y double, index array<bigint>, value array<float>, dense array<float>").toArrow()
    got = got.combine_chunks()
    flat = lambda c, kind: got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    sizes = [len(v) for v in got["index"]]
    x = Sparse(flat("index", np.int64), flat("value", np.float32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
               flat("dense", np.float32).reshape(-1, N_DENSE))
    order = np.lexsort(tuple(x.dense.T[::-1]))  # independent of the order in which tasks end
    sizes = np.diff(x.bounds)[order]
    at = np.concatenate([np.arange(x.bounds[i], x.bounds[i + 1]) for i in order]) if len(order) else np.zeros(0, int)
    return Sparse(x.index[at], x.value[at], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                  x.dense[order]), got["y"].to_numpy()[order]


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Fitted on at most `sample` labelled documents whose crc32 of the id leaves
    a remainder but 0 by HELD_OUT_OF; several labels of one id count by their
    mean, null labels and ids not at all. Only the text is scored; null and
    empty texts by their (zero) statistics. Without labels, or with one kind of
    label only, every row has the same score. Rows that repeat an id are scored
    alike; other columns are not read.
    """
    model = fit(*_sample(docs, labels, sample))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(model.scores(features(texts)))],
                    ["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", (crc_bucket(F.col("doc_id"), HELD_OUT_OF) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The rows that are predicted good, in one pass over the texts, columns unchanged."""
    model = fit(*_sample(docs, labels, sample))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(place)):
                yield batch.slice(at, len(texts)).filter(
                    pa.array(model.scores(features(texts)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
