"""Language of texts by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, crc_bucket, table, text_bytes

HIDDEN = 8
# Texts are read in segments of this many bytes; both directions start anew in each.
SEGMENT = 64
HELD_OUT_OF, HELD_OUT = 3, 1
# Bounds of the sample: languages (the most frequent), documents per language (drawn by hash of
# id and text), and windows of this many characters per document.
MAX_LANGUAGES, SAMPLE_DOCS, WINDOWS, WINDOW_CHARS = 200, 300, 3, 180
EPOCHS, BATCH, RATE = 6, 128, 0.01
CHUNK = 1 << 17
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


@dataclass
class Direction:
    """One gated recurrent layer; a byte's input to the gates is a row of `inputs`."""

    inputs: np.ndarray    # 256 x 3H: reset, update, candidate
    gates: np.ndarray     # H x 2H
    candidate: np.ndarray  # H x H
    bias: np.ndarray      # H, inside the reset

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (time, row, H) over bytes x (time, row); states are 0 where the mask is."""
        steps, n = x.shape
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        states, tape = np.empty((steps, n, HIDDEN), dtype=np.float32), []
        for t in range(steps):
            given = self.inputs[x[t]]
            rz = _sigmoid(h @ self.gates + given[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            inner = h @ self.candidate + self.bias
            c = np.tanh(given[:, 2 * HIDDEN:] + r * inner)
            new = (c + z * (h - c)) * mask[t][:, None]
            if keep:
                tape.append((h, r, z, inner, c))
            h = new
            states[t] = h
        return states, tape

    def back(self, x: np.ndarray, mask: np.ndarray, tape: list, grad: np.ndarray) -> list[np.ndarray]:
        """Gradients of the parameters from those of the states, through time."""
        d_gates, d_candidate, d_bias = (np.zeros_like(p) for p in (self.gates, self.candidate, self.bias))
        into = np.empty((*x.shape, 3 * HIDDEN), dtype=np.float32)
        later = np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, r, z, inner, c = tape[t]
            d = (grad[t] + later) * mask[t][:, None]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            d_inner = dc * r
            rz = np.concatenate([dr, dz], axis=1)
            into[t, :, : 2 * HIDDEN], into[t, :, 2 * HIDDEN:] = rz, dc
            d_gates += h.T @ rz
            d_candidate += h.T @ d_inner
            d_bias += d_inner.sum(axis=0)
            later = d * z + rz @ self.gates.T + d_inner @ self.candidate.T
        flat, column = x.ravel(), into.reshape(-1, 3 * HIDDEN)
        d_inputs = np.stack([np.bincount(flat, column[:, j], 256) for j in range(3 * HIDDEN)], axis=1)
        return [d_inputs.astype(np.float32), d_gates, d_candidate, d_bias]

    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.gates, self.candidate, self.bias]


@dataclass
class Network:
    languages: list[str]
    forward: Direction
    backward: Direction
    output: np.ndarray  # 2H x languages
    bias: np.ndarray

    def positions(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probabilities (time, row, language) at every byte."""
        f, _ = self.forward.run(x, mask)
        b, _ = self.backward.run(x[::-1], mask[::-1])
        return _softmax(f @ self.output[:HIDDEN] + b[::-1] @ self.output[HIDDEN:] + self.bias)

    def pooled(self, texts: pa.Array) -> np.ndarray:
        """Mean probabilities over the letters of each text."""
        x, mask, owner = segments(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for rows in np.array_split(np.arange(x.shape[1]), max(1, x.shape[1] * SEGMENT // CHUNK)):
            own, inside = np.ascontiguousarray(x[:, rows]), np.ascontiguousarray(mask[:, rows])
            p = self.positions(own, inside) * (LETTER[own] & (inside > 0))[:, :, None]
            np.add.at(out, owner[rows], p.sum(axis=0))
        return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (SEGMENT, row), mask of those that are there, and the text of each row."""
    data, offsets = text_bytes(texts)
    sizes = np.diff(offsets)
    per_text = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), per_text)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = offsets[:-1][owner] + nth * SEGMENT + np.arange(SEGMENT)[:, None]
    inside = at < offsets[1:][owner]
    x = data[np.where(inside, at, 0)] if len(data) else np.zeros(at.shape, dtype=np.uint8)
    return np.where(inside, x, 0).astype(np.uint8), inside.astype(np.float32), owner


def fit(texts: list[str], langs: list[str], seed: int = 1) -> Network | None:
    """Backpropagation through time with adaptive steps; None without samples."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    order = sorted(range(len(texts)), key=lambda i: (langs[i], texts[i]))
    languages = sorted(set(langs))
    x, mask, owner = segments(pa.array([texts[i] for i in order]))
    y = np.array([languages.index(langs[i]) for i in order])[owner]
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    layer = lambda: Direction(draw(256, 3 * HIDDEN), draw(HIDDEN, 2 * HIDDEN), draw(HIDDEN, HIDDEN),
                              np.zeros(HIDDEN, dtype=np.float32))
    net = Network(languages, layer(), layer(), draw(2 * HIDDEN, len(languages)),
                  np.zeros(len(languages), dtype=np.float32))
    parameters = [*net.forward.parameters(), *net.backward.parameters(), net.output, net.bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            for grad, p, m, v in zip(_gradients(net, x[:, pick], mask[:, pick], y[pick]), parameters, first, second,
                                     strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                t = step + 1
                p -= RATE * 0.7 ** epoch * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
            step += 1
    return net


def _gradients(net: Network, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the letters."""
    f, tape_f = net.forward.run(x, mask, keep=True)
    b, tape_b = net.backward.run(x[::-1], mask[::-1], keep=True)
    b = b[::-1]
    d = _softmax(f @ net.output[:HIDDEN] + b @ net.output[HIDDEN:] + net.bias)
    d[:, np.arange(len(y)), y] -= 1
    counted = (LETTER[x] & (mask > 0)).astype(np.float32)
    d *= counted[:, :, None] / max(counted.sum(), 1)
    flat = lambda a: a.reshape(-1, a.shape[-1])
    d_output = np.concatenate([flat(f).T @ flat(d), flat(np.ascontiguousarray(b)).T @ flat(d)])
    back = net.backward.back(x[::-1], mask[::-1], tape_b, (d @ net.output[HIDDEN:].T)[::-1])
    return [*net.forward.back(x, mask, tape_f, d @ net.output[:HIDDEN].T), *back, d_output, flat(d).sum(axis=0)]


def _sample(docs: DataFrame, per_language: int) -> tuple[list[str], list[str]]:
    """Windows at hashed places of at most `per_language` documents of each language, those of the least hashes.

    A document is an id with its text; rows that repeat both are one, whatever their number.
    """
    known = docs.filter("lang is not null and text is not null").filter(
        crc_bucket(F.col("doc_id"), HELD_OUT_OF) != HELD_OUT).select("lang", "text", F.xxhash64("doc_id", "text").alias("hash"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    # Enough to have the least hashes, as the number is known nearly; cut below.
    few = counts.select("lang", F.least(F.lit(1.0), 2 * (per_language + 50) / F.col("n")).alias("share"))
    place = F.shiftrightunsigned("hash", 11) / float(1 << 53)
    drawn = known.join(F.broadcast(few), "lang").filter(place <= F.col("share"))
    room = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1
    window = lambda i: F.substring(
        F.col("text"), (F.pmod(F.xxhash64("hash", i), room) + 1).cast("int"), F.lit(WINDOW_CHARS))
    once = drawn.select("lang", F.shiftrightunsigned("hash", 11).alias("place"), F.array(
        *[window(F.lit(i)) for i in range(WINDOWS)]).alias("windows")).groupBy("lang", "place").agg(F.min("windows").alias("windows"))
    least = Window.partitionBy("lang").orderBy("place")
    rows = once.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= per_language).select(
        "lang", F.explode("windows").alias("text")).collect()
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def languages(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row.

    Learnt from windows of at most `per_language` documents of each of the
    MAX_LANGUAGES most frequent languages (others are never predicted), none of
    them held out (crc32 of the id modulo HELD_OUT_OF is HELD_OUT), none with
    a null language. Every byte of a text is labelled; the prediction is the
    language with the largest mean over its letters, the score that mean. Null
    texts and texts without letters are `und` with score 0, and all are if there
    is nothing to learn from. Rows that repeat an id are labelled alike.
    """
    net = fit(*_sample(docs, per_language))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1), CHUNK):
                lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
                lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if net is not None:
                    p = net.pooled(texts)
                    best = p.argmax(axis=1)
                    lang[lettered] = np.array(net.languages, dtype=object)[best[lettered]]
                    score[lettered] = p[np.arange(len(p)), best][lettered].clip(0, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(lang, type=pa.string()), pa.array(score)],
                    ["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", (crc_bucket(F.col("doc_id"), HELD_OUT_OF) == HELD_OUT).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
