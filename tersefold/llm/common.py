"""Helpers of the operators here: expressions, texts as bytes, distributed prefix sums."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import llm
from ..session import collected, remove, stage

# Functions that run on executors are sent whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(llm)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def only_last(spark: SparkSession) -> Iterator[None]:
    """Of the tables staged inside the block, only the last one stays."""
    with collected() as paths:
        yield
    remove(spark, paths[:-1])


def free_name(taken: list[str], name: str) -> str:
    """The name, with underscores ahead until no column has it, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """Stretches of characters other than space and U+0009 to U+000D; none of a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_id(text: Column) -> Column:
    """128 bits that tell texts apart; null of a null text."""
    return F.unhex(F.md5(text))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def prefix_sums(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Adds `_before` and `_index`: sum of `value` and number of rows ahead of each row in its group.

    Rows are range-partitioned by group and order, so a group of any size is
    spread over many tasks, and so are ties. Each range gets its own running
    sum; one row per range and group carries the sums of the ranges ahead.
    The ranges are written once, so a lost task cannot draw them anew.
    `group` columns must not be null.
    """
    ranged = stage(
        rows.withColumn("_tie", F.rand(7)).repartitionByRange(*group, *order, "_tie")
        .withColumn("_range", F.spark_partition_id()), "ranges")
    by_range = ranged.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and group; written, so that the join below is planned by its true size.
    bases = stage(by_range.select(
        *group, "_range",
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_sum_ahead"),
        F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows_ahead")), "bases")
    inside = Window.partitionBy(*group, "_range").orderBy(*order, "_tie")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # Range partitions satisfy the window, whose keys they are part of: no further shuffle.
    placed = ranged.repartitionByRange("_range").select(
        "*", (F.sum(value).over(upto) - F.col(value)).alias("_in_sum"),
        (F.row_number().over(inside) - 1).alias("_in_rows"))
    return placed.join(bases, [*group, "_range"]).select(
        *rows.columns,
        (F.col("_sum_ahead") + F.col("_in_sum")).alias("_before"),
        (F.col("_rows_ahead") + F.col("_in_rows")).alias("_index"))


# Rows that go, by id and text. ---------------------------------------------

# A bitmap of hashes has this many 64-bit words at most, however many hashes there are.
FILTER_WORD_BITS = 20
# So many keys, of about 50 bytes each, are sent to all tasks; more are looked up by a shuffle.
BROADCAST_KEYS = 300_000


def filter_words(hashes: DataFrame) -> np.ndarray:
    """Bitmap with two bits per `hash`. Made by bit_or per word, so at most 2^20 words reach the driver."""
    bits = hashes.select(F.explode(F.array(
        F.shiftrightunsigned("hash", 64 - FILTER_WORD_BITS - 6),
        F.col("hash").bitwiseAND((1 << (FILTER_WORD_BITS + 6)) - 1))).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    out = np.zeros(1 << FILTER_WORD_BITS, dtype=np.int64)
    got = words.toArrow()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out.view(np.uint64)


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that may be in the bitmap."""
    def bit(b: np.ndarray) -> np.ndarray:
        return (words[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1

    some = np.flatnonzero(bit(hashes >> np.uint64(64 - FILTER_WORD_BITS - 6)))
    return some[bit(hashes[some] & np.uint64((1 << (FILTER_WORD_BITS + 6)) - 1))]


def without_rows(docs: DataFrame, gone: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of `docs` whose (doc_id, text_id) is not in the written table `gone`; null equals null. Columns unchanged.

    Beyond broadcast_keys keys only rows that a bitmap of the keys lets pass are shuffled.
    """
    id_, text_, hash_, maybe = (free_name(docs.columns, f"_{c}") for c in ("gone_id", "gone_text", "hash", "maybe"))
    keys = gone.select(F.col("doc_id").alias(id_), F.col("text_id").alias(text_))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & text_id(F.col("text")).eqNullSafe(F.col(text_))
    if gone.count() <= broadcast_keys:
        return docs.join(F.broadcast(keys), same, "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(filter_words(gone.select(F.xxhash64("doc_id", "text_id").alias("hash"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark = np.zeros(batch.num_rows, dtype=bool)
            mark[in_filter(shared.value, batch.columns[-1].to_numpy().view(np.uint64))] = True
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(mark)], [*batch.schema.names[:-1], maybe])

    schema = T.StructType([*docs.schema.fields, T.StructField(maybe, T.BooleanType())])
    marked = docs.withColumn(hash_, F.xxhash64("doc_id", text_id(F.col("text")))).mapInArrow(run, schema)
    return marked.filter(~F.col(maybe)).unionByName(
        marked.filter(maybe).join(keys, same, "left_anti")).drop(maybe)


# Texts as bytes, for work on Arrow batches in numpy. -----------------------

CHUNK_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, dtype=bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Kept(dict):
    """Tables that every task builds for itself; they are not sent along."""

    def __reduce__(self):
        return _Kept, ()


_powers = _Kept()


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; the table of one chunk is kept, a longer text's is not."""
    size = max(n + 1, CHUNK_BYTES * 2)
    if size in _powers:
        return _powers[size]
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    if size == CHUNK_BYTES * 2:
        _powers[size] = (out[0], out[1])
    return out[0], out[1]


@dataclass
class Tokens:
    """Tokens of a run of texts: hash, byte range, text number, and for each text its first token."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def runs(self, n: int) -> np.ndarray:
        """Token numbers at which n tokens of one text begin."""
        if len(self.text) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.text[: len(self.text) - n + 1] == self.text[n - 1:])

    def run_hash(self, at: np.ndarray, offsets: list[int]) -> np.ndarray:
        """Hash of the tokens at `at` + each offset, in this order."""
        out = np.full(len(at), len(offsets), dtype=np.uint64)
        for k in offsets:
            out = (out + self.hash[at + k]) * np.uint64(_BASE)
            out ^= out >> np.uint64(29)
        return mix(out)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts in a row and where each begins; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]: offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def tokenize(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Tokens:
    """Maximal runs of bytes of `kind` inside each text, with a 64-bit hash."""
    n = len(data)
    word = kind[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers_to(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    return Tokens(data, offsets, start, end, text, first, hashes)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole texts of about `limit` bytes, with the number of their first text."""
    if len(texts) == 0:
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield at, texts.slice(at, stop - at)
        at = stop
