"""Benchmark passages in training texts, found by spaced seeds and verified position by position."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .common import ALNUM, Tokens, chunks, filter_words, in_filter, mix, only_last, table, text_bytes, text_id, tokenize, without_rows

# A leak has this many words on one alignment, of which this share is equal.
MIN_OVERLAP, MIN_EQUAL_PCT = 13, 80
# Below MIN_ITEM words items say nothing, below MIN_EDITED they are looked for as a whole.
MIN_ITEM, MIN_EDITED = 5, 7
# Token positions that count; the others may hold any word. In a stretch of MIN_OVERLAP words (a whole item
# of the length, if that is shorter) with as many substitutions as MIN_EQUAL_PCT lets pass, wherever they
# are, one mask at least meets none of them at some place.
MASKS = {
    13: ("111110111", "1101011111", "11111001011", "111001100111", "110111111"),
    12: ("11110111", "1100101111", "11011001011", "111111001", "1111111"),
    11: ("1111011", "110001111", "1101100011"),
    10: ("111011", "11010011", "11111"),
    9: ("1111011", "11011101"),
    8: ("1111101", "1110111", "1011111"),
    7: ("111101", "110111", "11111"),
}
CONTEXT = 20
# Alignments of a region and an item that are gone through one by one; of more, the best by equal words first.
MAX_PAIRS = 200_000


@dataclass(frozen=True)
class Seeds:
    """Offsets that are hashed, the window's length, and a number that keeps seeds apart."""

    offsets: tuple[int, ...]
    length: int
    salt: int


def _seeds(n: int) -> list[Seeds]:
    """The seeds of items of n words."""
    n = min(n, MIN_OVERLAP)
    masks = MASKS[n] if n >= MIN_EDITED else ("1" * n,)
    return [Seeds(tuple(i for i, c in enumerate(m) if c == "1"), len(m), 100 * n + k) for k, m in enumerate(masks)]


def _tokens(texts: pa.Array) -> Tokens:
    """Words: runs of letters and digits, lower case; all other ASCII characters separate."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    return tokenize(data, offsets, ALNUM)


def _hashes(tokens: Tokens, seed: Seeds) -> tuple[np.ndarray, np.ndarray]:
    at = tokens.runs(seed.length)
    return at, mix(tokens.run_hash(at, list(seed.offsets)) + np.uint64(seed.salt))


def _items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, words) of each different benchmark text, under its smallest id."""
    rows = benchmark.select(F.col(key).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                tokens = _tokens(texts)
                words = pa.ListArray.from_arrays(
                    pa.array(tokens.first, type=pa.int32()), pa.array(tokens.hash.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), words], ["item_id", "words"])

    kind = rows.schema["item_id"].dataType.simpleString()
    every = rows.mapInArrow(run, f"item_id {kind}, words array<bigint>")
    return every.groupBy("words").agg(F.min("item_id").alias("item_id")).filter(F.size("words") >= MIN_ITEM)


def _windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every window of an item of these word hashes."""
    none = np.zeros(0, dtype=np.int64)
    tokens = Tokens(none, none, none, none, np.zeros(len(words), dtype=np.int64), none, words)
    at, hashes = zip(*[_hashes(tokens, seed) for seed in _seeds(len(words))], strict=True)
    return np.concatenate(at), np.concatenate(hashes)


def _item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item) of every window of every item; equal ones of an item once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = np.unique(_windows(words.values.to_numpy().view(np.uint64))[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array([item] * len(hashes), type=pa.int64())], ["hash", "item"])

    return items.select("item", "words").mapInArrow(run, "hash bigint, item bigint")


_REGIONS = "start bigint, words array<bigint>, hashes array<bigint>, at array<bigint>"


def _regions(docs: DataFrame, filter_words: np.ndarray, lengths: list[int], key: str, text: str) -> DataFrame:
    """Stretches of each text around windows that may be in the benchmark, with those windows.

    Only these leave the scan; near stretches of one text are joined.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seeds = [seed for n in lengths for seed in _seeds(n)]
    shared = docs.sparkSession.sparkContext.broadcast(filter_words)

    def regions(texts: pa.Array) -> dict[str, list]:
        tokens = _tokens(texts)
        found = [(np.zeros(0, dtype=np.int64),) * 3]
        for seed in seeds:
            at, hashes = _hashes(tokens, seed)
            hit = in_filter(shared.value, hashes)
            found.append((at[hit], hashes[hit].view(np.int64), np.full(len(hit), seed.length)))
        at, hashes, length = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, hashes, length = at[order], hashes[order], length[order]
        out: dict[str, list] = {"doc": [], "start": [], "words": [], "hashes": [], "at": []}
        if not len(at):
            return out
        doc = tokens.text[at]
        begin = np.maximum(at - CONTEXT, tokens.first[doc])
        end = np.maximum.accumulate(np.minimum(at + length + CONTEXT, tokens.first[doc + 1]))
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(fresh)
        for s, e in zip(first, [*first[1:], len(at)], strict=True):
            lo, hi = begin[s], end[e - 1]
            out["doc"].append(int(doc[s]))
            out["start"].append(int(lo - tokens.first[doc[s]]))
            out["words"].append(tokens.hash[lo:hi].view(np.int64))
            out["hashes"].append(hashes[s:e])
            out["at"].append(at[s:e] - lo)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                r = regions(texts)
                ids = batch.column(0).slice(first, len(texts)).take(pa.array(r["doc"], type=pa.int64()))
                lists = [pa.array(r[c], type=pa.list_(pa.int64())) for c in ("words", "hashes", "at")]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(r["start"], type=pa.int64()), *lists], ["doc_id", "start", "words", "hashes", "at"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {_REGIONS}")


def _equal_by_shift(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words of a are equal to those of b, for each shift of b from 1 - len(b) to len(a) - 1.

    Places of a word on both sides give their differences; for words with very many, by a transform.
    """
    n, m = len(a), len(b)
    out = np.zeros(n + m - 1, dtype=np.int64)
    wide = 1 << (n + m - 2).bit_length()
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    common = np.intersect1d(a, b)
    places = [[np.searchsorted(side[order], common, where) for where in ("left", "right")] for side, order in ((a, by_a), (b, by_b))]
    for first_a, end_a, first_b, end_b in zip(*places[0], *places[1], strict=True):
        x, y = by_a[first_a:end_a], by_b[first_b:end_b]
        if len(x) * len(y) <= 40 * wide:
            np.add.at(out, (x[:, None] - y + m - 1).ravel(), 1)
        else:
            f, g = np.zeros(wide), np.zeros(wide)
            f[x], g[m - 1 - y] = 1, 1
            both = np.fft.irfft(np.fft.rfft(f) * np.fft.rfft(g), wide)
            out += np.rint(both[: n + m - 1]).astype(np.int64)
    return out


def _best_alignment(a: np.ndarray, b: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> int | None:
    """Most equal words on an alignment of text a and item b that has a passage; None if none has.

    `hashes` and `at` are the windows of the text that may be in the benchmark.
    """
    width = min(MIN_OVERLAP, len(b))
    places, windows = _windows(b.view(np.uint64))
    order = np.argsort(windows, kind="stable")
    windows, places = windows[order], places[order]
    first, end = (np.searchsorted(windows, hashes.view(np.uint64), side) for side in ("left", "right"))
    n = end - first
    if n.sum() <= MAX_PAIRS:
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        shifts = np.unique(np.repeat(at, n) - places[inside])
        if len(shifts) > 8:
            equal = _equal_by_shift(a, b)
            shifts = shifts[np.argsort(-equal[shifts + len(b) - 1], kind="stable")]
    else:
        equal = _equal_by_shift(a, b)
        shifts = np.argsort(-equal, kind="stable")
        shifts = shifts[equal[shifts] * 100 >= width * MIN_EQUAL_PCT] - len(b) + 1
    best = None
    for shift in shifts.tolist():
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        same = np.concatenate([[0], np.cumsum(a[lo + shift: hi + shift] == b[lo:hi])])
        if len(same) > width and int((same[width:] - same[:-width]).max()) * 100 >= width * MIN_EQUAL_PCT:
            best = max(best or 0, int(same[-1]))
            if len(shifts) > 8:  # by equal words, most first
                break
    return best


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs of a region and an item with an alignment on which MIN_OVERLAP words, or the whole item, are equal enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(c) for c in ("words", "item_words", "hashes", "at")]
            best = [_best_alignment(*(x.values.to_numpy() for x in row)) for row in zip(*lists, strict=True)]
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("item_id"), pa.array(best, type=pa.int64())],
                ["doc_id", "item_id", "equal_words"])
            yield out.filter(out.column(2).is_valid())

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}
    return pairs.mapInArrow(
        run, f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, equal_words bigint")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id and equal_words of each document and benchmark item that it holds a passage of.

    A passage is MIN_OVERLAP words (a whole item, if that is shorter) of which
    MIN_EQUAL_PCT percent are equal at equal distances; none is missed, wherever
    the others are. Items under MIN_EDITED words must be equal as a whole. Case,
    punctuation and white space do not count. Items under MIN_ITEM words and null
    or empty texts on either side give nothing; equal items count once, under the
    smallest id; rows that repeat an id count as one document. Other columns are
    not read.
    """
    items = stage(_items(benchmark, item_key, item_text).withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = stage(_item_seeds(items), "seeds")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(MIN_OVERLAP))).distinct().collect()]
    regions = _regions(docs, filter_words(seeds), sorted(lengths), key, text)
    regions = stage(regions.withColumn("region", F.monotonically_increasing_id()), "regions")
    hits = regions.select("region", F.explode(F.array_distinct("hashes")).alias("hash"))
    pairs = hits.join(seeds, "hash").select("region", "item").distinct()
    both = pairs.join(regions.select("region", "doc_id", "words", "hashes", "at"), "region").join(
        items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    found = _verified(both.select("doc_id", "item_id", "words", "item_words", "hashes", "at"))
    return found.groupBy("doc_id", "item_id").agg(F.max("equal_words").alias("equal_words"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that hold no benchmark passage, columns unchanged.

    Rows go by id and text: other texts under the id of a leak, or without an id
    as it, stay, and so do rows without text.
    """
    own = docs.select(F.struct("doc_id", text_id(F.col("text")).alias("text_id")).alias("row"), "text")
    with only_last(docs.sparkSession):
        leaked = stage(leaks(own, benchmark, key="row").select("doc_id.doc_id", "doc_id.text_id").distinct(), "leaked")
    return without_rows(docs, leaked)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
