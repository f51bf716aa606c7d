"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run repeats a period of q words at least REPEATS times, so each of its words
occurs that often in it. Words that are rarer in a segment split it; the pieces
are split again until no word is too rare in its piece. The pieces that survive
are scanned lag by lag: aligned blocks of q words are compared with the next
block by a prefix hash, and stretches of equal blocks are extended word by word.
Blocks of all lags together are n log n, whatever the text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, chunks, table, text_bytes, tokenize, words

REPEATS = 4
LEAST_WORDS = 6
# Splitting ends after so many rounds; a piece that could still be split is scanned as it is, with the same result.
ROUNDS = 64
PAIRS_AT_ONCE = 1 << 20
# Primes and bases of the prefix hash; products of two remainders fit in 64 bits.
_HASHES = ((2147483647, 1103515245), (2147483629, 1664525013))


# Splitting. ----------------------------------------------------------------

def surviving(ids: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begins and ends of the pieces in which no word is too rare. `bounds`: where each text begins, and the end."""
    starts, ends = bounds[:-1], bounds[1:]
    done = []
    for _ in range(ROUNDS):
        long = ends - starts >= LEAST_WORDS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return done
        sizes = ends - starts
        owner = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        _, inverse, counts = np.unique(owner * (ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        keeps = counts[inverse] >= REPEATS
        whole = np.ones(len(starts), dtype=bool)
        whole[owner[~keeps]] = False
        done.append((starts[whole], ends[whole]))
        keeps &= ~whole[owner]
        # Maximal stretches of frequent words inside a piece.
        begins, stops = keeps.copy(), keeps.copy()
        same = owner[1:] == owner[:-1]
        begins[1:] &= ~(keeps[:-1] & same)
        stops[:-1] &= ~(keeps[1:] & same)
        starts, ends = at[begins], at[stops] + 1
    done.append((starts, ends))
    return done


# Lag scan. -----------------------------------------------------------------

class _Prefix:
    """Prefix hashes of a word sequence; tells whether two stretches are equal."""

    def __init__(self, ids: np.ndarray):
        self.parts = []
        for prime, base in _HASHES:
            powers = np.ones(len(ids) + 1, dtype=np.int64)
            done = 1
            while done < len(powers):
                step = powers[done - 1] * base % prime
                powers[done: 2 * done] = powers[: len(powers[done: 2 * done])] * step % prime
                done *= 2
            sums = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum((ids + 1) * powers[:-1] % prime, out=sums[1:])
            self.parts.append((prime, powers, sums % prime))

    def same(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Are `length` words from `at` on equal to those `lag` words further?"""
        out = np.ones(len(at), dtype=bool)
        for prime, powers, sums in self.parts:
            one = (sums[at + length] - sums[at]) % prime * powers[lag] % prime
            out &= one == (sums[at + lag + length] - sums[at + lag]) % prime
        return out

    def reach(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Most words next to `at`, ahead or back, that are equal to those `lag` words further."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self.same(at - middle if back else at, lag, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low


def scan(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs in the pieces, by start and period."""
    lags_each = (ends - starts) // REPEATS
    piece = np.repeat(np.arange(len(starts)), lags_each)
    lag = np.arange(len(piece)) - np.repeat(np.cumsum(lags_each) - lags_each, lags_each) + 1
    first, end = starts[piece], ends[piece]
    blocks = (end - first) // lag - 1
    total = np.cumsum(blocks)
    prefix = _Prefix(ids)
    found = [np.zeros((0, 3), dtype=np.int64)]
    at = 0
    while at < len(lag):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        n = blocks[at:stop]
        row = np.repeat(np.arange(at, stop), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        q = lag[row]
        hit = np.flatnonzero(prefix.same(first[row] + k * q, q, q))
        at = stop
        if not len(hit):
            continue
        # Equal blocks in a row; a run has two at least.
        new = np.ones(len(hit), dtype=bool)
        new[1:] = (np.diff(hit) != 1) | (row[hit[1:]] != row[hit[:-1]])
        one, last = hit[new], hit[np.append(new[1:], True)]
        one, last = one[last > one], last[last > one]
        q, r = lag[row[one]], row[one]
        left, right = first[r] + k[one] * q, first[r] + (k[last] + 1) * q
        start = left - prefix.reach(left, q, np.minimum(q - 1, left - first[r]), back=True)
        stop_ = right + prefix.reach(right, q, np.minimum(q - 1, end[r] - q - right), back=False) + q
        long = stop_ - start >= np.maximum(LEAST_WORDS, REPEATS * q)
        found.append(np.column_stack([start, stop_, q])[long])
    runs = np.concatenate(found)
    # A stretch that has a multiple of its period as another one is one run.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs of the texts in a row; none crosses from one text to the next."""
    pieces = surviving(ids, bounds)
    starts = np.concatenate([p[0] for p in pieces] or [bounds[:0]])
    ends = np.concatenate([p[1] for p in pieces] or [bounds[:0]])
    return scan(ids, starts, ends) if len(starts) else np.zeros((0, 3), dtype=np.int64)


# Texts. --------------------------------------------------------------------

def _joined(tokens, kept: np.ndarray, n_texts: int) -> pa.Array:
    """The kept words of each text joined by one space."""
    start, size, owner = tokens.start[kept], (tokens.end - tokens.start)[kept], tokens.text[kept]
    last = np.ones(len(owner), dtype=bool)
    last[:-1] = owner[1:] != owner[:-1]
    wide = size + ~last
    place = np.cumsum(wide) - wide
    index = np.arange(wide.sum()) + np.repeat(start - place, wide)
    # The place behind a word is its separator, whatever the text has there.
    out = tokens.data[np.minimum(index, len(tokens.data) - 1)] if len(index) else np.zeros(0, dtype=np.uint8)
    out[(place + size)[~last]] = 32
    offsets = np.zeros(n_texts + 1, dtype=np.int64)
    np.add.at(offsets, owner + 1, wide)
    return pa.LargeStringArray.from_buffers(
        n_texts, pa.py_buffer(np.cumsum(offsets).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def _found(texts: pa.Array) -> list[pa.Array]:
    """n_words, runs and collapsed text of each text."""
    data, offsets = text_bytes(texts)
    tokens = tokenize(data, offsets, WORD)
    n = len(texts)
    if len(tokens.hash):
        _, ids = np.unique(tokens.hash, return_inverse=True)
        runs = runs_of(ids.astype(np.int64), tokens.first)
    else:
        runs = np.zeros((0, 3), dtype=np.int64)
    edges = np.zeros(len(tokens.hash) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 1], -1)
    kept = np.cumsum(edges)[:-1] == 0
    owner = np.searchsorted(tokens.first, runs[:, 0], side="right") - 1
    row = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - tokens.first[owner]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
        ["start", "length", "period"])
    places = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return [pa.array(np.diff(tokens.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(places), row),
            _joined(tokens, kept, n)]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs and collapsed of each row.

    A run is a longest stretch of words that repeats its smallest period at
    least REPEATS times and has LEAST_WORDS words; runs are (start, length,
    period) in words, by start and period. `collapsed` has the words outside
    of runs and one period of each, joined by one space. Null, empty and blank
    texts have no words, no runs and an empty collapsed text. Rows are worked on
    by themselves: repeated rows and null keys stay as they are, and other
    columns are not read. No shuffle.
    """
    rows = docs.select(F.col(key), F.col(text))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *_found(texts)], [key, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(
        run, f"`{key}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


# The query. ----------------------------------------------------------------

def planted_text(doc_id: Column, text: Column) -> Column:
    """The text; where crc32 of the id is a multiple of ten, with its words periodic from some word on.

    A null id plants nothing.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    w = words(text)
    n = F.size(w).cast("long")
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)) + 1
    # The words from a on are the first p of them again and again.
    block = F.slice(w, (a + 1).cast("int"), p.cast("int"))
    again = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    periodic = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(again, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(periodic, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n"))))
    return periodic_runs(docs).withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
