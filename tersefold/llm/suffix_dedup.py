"""Removal of byte strings that other documents start before: prefix doubling over sampled positions.

Two positions are equal up to some length if their ranks for shorter prefixes
are equal, at the position and at an offset; ranks of unique positions need no
further look. Sorting every byte position so would shuffle many times the
texts, so positions are sampled by content: of every window of `match` bytes the
gram with the least hash, the same one wherever the window occurs.

Round one ranks sampled positions by their gram, and in the same sort by the
pair of that and the string at a negative offset, which holds all windows that chose
this gram (`match` to 2 * match - gram bytes). Grams that occur once end here. Strings that a smaller document has are
covered whole. What is left, strings that differ but share their gram, is cut into groups of
windows that hold the gram at nearly the same place. Round two ranks these in the same way, by the
bytes that all windows of a group have; that is nearly the threshold, so few that differ remain
alike, however many grams occur by chance in large inputs. Round three goes past the threshold: the windows
of the groups that are left are ranked each by itself.

Texts are written once in blocks that Spark finds again without a shuffle (a table
bucketed by block). A block ends where its bytes reach a bound, so what a task holds does not
grow with the input or its splits. What is ranked is sent in rows of many keys, one row for each block
and bucket of hashes, and answered by one byte a key. There are as many buckets as the keys of the round need.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import new_dir, stage
from .common import chunks, mix, table, text_bytes

_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
NO_ID = np.iinfo(np.int64).max
# Texts are worked on in slices of about this many bytes, so what is computed of them stays near the processor.
SLICE_BYTES = 1 << 17
UNIQUE, SHARED, MATCHED = 0, 1, 2


@dataclass(frozen=True)
class RepeatPlan:
    """Length of strings that are removed, length of the grams that sample them, and keys that one task ranks.

    Blocks are what one task holds of the input, block_bytes and one text at most; beyond max_blocks of them
    several share a number. span: windows of a group, in the round between grams and windows.
    """

    match: int = 50
    gram: int = 20
    bucket_keys: int = 1_000_000
    max_blocks: int = 50_000
    block_bytes: int = 8 << 20
    span: int = 8

    def spans(self) -> list[int]:
        """Windows of a group in the rounds behind the first."""
        return [self.span, 1] if 1 < self.span < self.match - self.gram + 1 else [1]


# Hashes of byte strings. ---------------------------------------------------

class _Kept(dict):
    """Tables that every task builds for itself; they are not sent along."""

    def __reduce__(self):
        return _Kept, ()


_kept_powers = _Kept()


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base * base and so on; those of a slice of texts are kept, a longer text's are not."""
    size = max(n + 1, SLICE_BYTES * 2)
    if (base, size) in _kept_powers:
        return _kept_powers[base, size]
    p = np.full(size, base, dtype=np.uint64)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    if size == SLICE_BYTES * 2:
        _kept_powers[base, size] = p
    return p


class _Hashes:
    """A hash of any stretch of the bytes; `k` tells independent ones apart."""

    def __init__(self, data: np.ndarray, k: int):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * _powers(_BASES[k], n)[:n], out=self.sums[1:])
        self.down = _powers(pow(_BASES[k], -1, 1 << 64), n)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def all_of(self, length: int) -> np.ndarray:
        """Of every stretch of that length, not finished: good high bits, which is all that an order needs."""
        out = self.sums[length:] - self.sums[:-length]
        out *= self.down[: len(out)]
        return out


def _id48(hashes: np.ndarray) -> np.ndarray:
    return hashes & np.uint64((1 << 48) - 1)


def sampled(data: np.ndarray, offsets: np.ndarray, plan: RepeatPlan) -> tuple[np.ndarray, ...]:
    """First and last window of each sampled position, hash of its gram, hash of the string from first to last window.

    Offsets: where each text begins, and the end; no window crosses from one to the next.
    """
    first, last, _, gram, string = _sampled(data, offsets, plan)
    return first, last, gram, string


def _sampled(data: np.ndarray, offsets: np.ndarray, plan: RepeatPlan) -> tuple[np.ndarray, ...]:
    """Like sampled, with the place of the gram behind first and last."""
    n, match = len(data), plan.match
    if n < match:
        return tuple(np.zeros(0, dtype=kind) for kind in (*(np.int64,) * 3, np.uint64, np.uint64))
    hashes = _Hashes(data, 0)
    # The least hash, and of equal ones the first; positions take the low bits.
    least = hashes.all_of(plan.gram)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    have, wide = 1, match - plan.gram + 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = least.astype(np.uint32)
    # Windows that begin less than their length before the end of a text belong to none.
    inside = np.ones(n, dtype=bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(begin, end - match + 1): end] = False
    inside = inside[: len(chosen)]
    differ = np.ones(len(chosen) + 1, dtype=bool)
    np.not_equal(chosen[1:], chosen[:-1], out=differ[1:-1])
    outer = np.ones(len(chosen) + 1, dtype=bool)
    outer[1:-1] = ~inside[1:] | ~inside[:-1]
    edge = differ | outer
    first, last = np.flatnonzero(edge[:-1] & inside), np.flatnonzero(edge[1:] & inside)
    at = chosen[first].astype(np.int64)
    return first, last, at, hashes.of(at, at + plan.gram), _id48(_Hashes(data, 1).of(first, last + match))


# Blocks. -------------------------------------------------------------------

def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts: number of the first, of the one behind the last, bytes, offsets."""
    for at, some in chunks(texts, SLICE_BYTES):
        yield at, at + len(some), *text_bytes(some)


@dataclass
class _Positions:
    """Stretches of a block, by text: number of the text, first and last window and gram inside it, class, string of the windows."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray
    cls: np.ndarray
    string: np.ndarray

    def windows(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Text, first and last window of the chosen stretches."""
        return [x[chosen] for x in (self.text, self.first, self.last)]


def _joined(found: list[tuple[np.ndarray, ...]]) -> _Positions:
    none = tuple(np.zeros(0, dtype=k) for k in (np.int64,) * 4 + (np.uint64,) * 2)
    return _Positions(*(np.concatenate(x) for x in zip(*(found or [none]), strict=True)))


def _positions(texts: pa.Array, plan: RepeatPlan) -> _Positions:
    """Sampled positions; their class is the gram."""
    found = []
    for begin, _, data, offsets in _parts(texts):
        first, last, at, gram, string = _sampled(data, offsets, plan)
        text = np.searchsorted(offsets, first, side="right") - 1
        found.append((text + begin, first - offsets[text], last - offsets[text], at - offsets[text], gram, string))
    return _joined(found)


def _narrowed(texts: pa.Array, p: _Positions, chosen: np.ndarray, span: int, plan: RepeatPlan) -> _Positions:
    """The windows of the chosen stretches in groups; the class is what all windows that can be in a group have in common.

    A group is `span` places in a row of the gram in the window. A window that occurs twice chooses its
    gram at the same place, and so is in groups of one class.
    """
    found = []
    owner, *ours = (x[chosen] for x in (p.text, p.first, p.last, p.at))
    for begin, end, data, offsets in _parts(texts):
        a, b = np.searchsorted(owner, [begin, end])
        if a == b:
            continue
        base = offsets[owner[a:b] - begin]
        first, last, at = (x[a:b] + base for x in ours)
        low = (at - last) // span
        n = (at - first) // span - low + 1
        of = np.repeat(np.arange(b - a), n)
        # Where the group's first place puts the window; the other places lie before.
        latest = at[of] - (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]) * span
        group_first, group_last = np.maximum(first[of], latest - span + 1), np.minimum(last[of], latest)
        found.append((owner[a:b][of], group_first - base[of], group_last - base[of], at[of] - base[of],
                      _Hashes(data, 0).of(latest, latest - span + 1 + plan.match),
                      _id48(_Hashes(data, 1).of(group_first, group_last + plan.match))))
    return _joined(found)


# Questions and answers. ----------------------------------------------------

class _Asked:
    """Distinct keys (class, string) of a block, each with its smallest document, in the order they are sent."""

    def __init__(self, cls: np.ndarray, string: np.ndarray, doc: np.ndarray, n_buckets: int):
        # One number for both, as good as the two; which of equal ones leads does not depend on the sort.
        both = cls * np.uint64(_BASES[1]) ^ string * np.uint64(_BASES[0])
        order = np.argsort(both)
        new = np.ones(len(order), dtype=bool)
        new[1:] = both[order][1:] != both[order][:-1]
        starts = np.flatnonzero(new)
        self.key = np.empty(len(order), dtype=np.int64)
        self.key[order] = np.cumsum(new) - 1
        lead = np.minimum.reduceat(order, starts) if len(starts) else starts
        least = np.minimum.reduceat(doc[order], starts) if len(starts) else starts
        self.least = doc == least[self.key]
        bucket = ((cls[lead] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        self.sent = np.argsort(bucket * len(cls) + lead)
        lead, bucket = lead[self.sent], bucket[self.sent]
        self.cls, self.string, self.doc, self.bucket = cls[lead], string[lead], least[self.sent], bucket

    def rows(self, block: int) -> pa.Table:
        """A row for each bucket; keys are 4 and 6 bytes, documents 4 if they are near enough to each other."""
        buckets, begins = np.unique(self.bucket, return_index=True)
        bounds = np.append(begins, len(self.bucket))
        base = int(self.doc.min()) if len(self.doc) else 0
        wide = 4 if len(self.doc) == 0 or int(self.doc.max()) - base < 1 << 32 else 8
        docs = (self.doc - base).astype("<u4") if wide == 4 else self.doc

        def packed(values: np.ndarray, size: int) -> pa.Array:
            return pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(buckets),
                [None, pa.py_buffer((bounds * size).astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())

        strings = np.ascontiguousarray(self.string).view(np.uint8).reshape(-1, 8)[:, :6]
        return pa.table({
            "block": pa.array(np.full(len(buckets), block, dtype=np.int64)), "bucket": pa.array(buckets.astype(np.int64)),
            "base": pa.array(np.full(len(buckets), base if wide == 4 else -1, dtype=np.int64)),
            "classes": packed((self.cls & np.uint64(0xFFFFFFFF)).astype("<u4"), 4), "strings": packed(strings, 6),
            "docs": packed(docs, wide)})

    def told(self, answers: pa.Table) -> np.ndarray:
        """What was answered, for each position; one that its own block has in a smaller document is matched."""
        states = np.frombuffer(b"".join(answers.sort_by("bucket").column("states").to_pylist()), dtype=np.uint8)
        by_key = np.empty(len(self.sent), dtype=np.uint8)
        by_key[self.sent] = states
        return np.where(self.least, by_key[self.key], MATCHED).astype(np.uint8)


_ASKED = "block bigint, bucket bigint, base bigint, classes binary, strings binary, docs binary"


def _answer(rows: pa.Table) -> pa.Table:
    """The state of every key of a bucket: ranks of (class, string) pairs, by one sort."""
    classes, strings, docs = (rows.column(k).to_pylist() for k in ("classes", "strings", "docs"))
    cls = np.frombuffer(b"".join(classes), dtype="<u4")
    raw = np.zeros((len(cls), 8), dtype=np.uint8)
    raw[:, :6] = np.frombuffer(b"".join(strings), dtype=np.uint8).reshape(-1, 6)
    string = raw.view("<u8").ravel()
    doc = np.concatenate([np.frombuffer(d, dtype="<u4").astype(np.int64) + base if len(d) == len(c) else np.frombuffer(d, dtype="<i8")
                          for d, c, base in zip(docs, classes, rows.column("base").to_pylist(), strict=True)])
    order = np.lexsort((string, cls))
    cls, string, doc = cls[order], string[order], doc[order]
    new_class = np.ones(len(cls), dtype=bool)
    new_class[1:] = cls[1:] != cls[:-1]
    new = new_class.copy()
    new[1:] |= string[1:] != string[:-1]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    # Of the strings of a class: the smallest and the largest of their smallest documents.
    starts = np.flatnonzero(new_class)
    low, high = np.minimum.reduceat(least, starts), np.maximum.reduceat(least, starts)
    group = np.cumsum(new_class) - 1
    state = np.where(doc > least, MATCHED, np.where(low[group] != high[group], SHARED, UNIQUE)).astype(np.uint8)
    out = np.empty(len(state), dtype=np.uint8)
    out[order] = state
    bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in classes])])
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"),
                     "states": pa.array([out[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], type=pa.binary()),
                     "shared": pa.array(np.diff(np.concatenate([[0], np.cumsum(out == SHARED)])[bounds]).astype(np.int64))})


# The passes over a block. --------------------------------------------------

def _read(rows: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
    rows = rows.sort_by("row")
    ids = rows.column("doc_id").combine_chunks()
    texts = rows.column("text").combine_chunks()
    return ids, ids.fill_null(NO_ID).to_numpy(), texts


def _level(answers: pa.Table, level: int) -> pa.Table:
    return answers.filter(pc.equal(answers.column("level"), level))


def _removed(texts: pa.Array, plan: RepeatPlan, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    """n_bytes, spans (begin, end) and kept bytes of each text; start and end are stretches to remove, by text."""
    sizes, spans, n_spans, kept, n_kept = [], [], [], [], []
    for at, stop, data, offsets in _parts(texts):
        a, b = np.searchsorted(text, [at, stop])
        base = offsets[text[a:b] - at]
        edges = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edges, base + start[a:b], 1)
        np.add.at(edges, base + end[a:b], -1)
        gone = np.cumsum(edges[:-1]) > 0
        begins, ends = gone.copy(), gone.copy()
        begins[1:] &= ~gone[:-1]
        ends[:-1] &= ~gone[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = gone[inner]
        ends[inner - 1] = gone[inner - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        owner = np.searchsorted(offsets, first, side="right") - 1
        spans.append(np.column_stack([first, last]) - offsets[owner][:, None])
        n_spans.append(np.bincount(owner, minlength=stop - at))
        stay = np.concatenate([[0], np.cumsum(~gone)])
        n_kept.append(np.diff(stay[offsets]))
        kept.append(data[~gone])
        sizes.append(np.diff(offsets))
    spans = np.concatenate(spans) if spans else np.zeros((0, 2), dtype=np.int64)

    def bounds(parts: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.concatenate(parts))]) if parts else np.zeros(1, dtype=np.int64)

    pairs = pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["begin", "end"])
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [
        None, pa.py_buffer(bounds(n_kept).astype(np.int64).tobytes()),
        pa.py_buffer((np.concatenate(kept) if kept else np.zeros(0, dtype=np.uint8)).tobytes())])
    return [pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, dtype=np.int64)),
            pa.ListArray.from_arrays(pa.array(bounds(n_spans).astype(np.int32)), pairs), whole.cast(pa.binary())]


def _in_blocks(docs: DataFrame, key: str, text: str, plan: RepeatPlan) -> DataFrame:
    """The texts in a table bucketed by block, each block in a bucket and file of its own: block, row, doc_id, text, n_bytes.

    A block is rows of one task, cut where their bytes reach the bound; sizes alone tell where, so no text is moved. (If the
    rows are dealt to tasks otherwise when they are read again, blocks are less even, no more.) Its number
    is one that Spark puts into its bucket, so a bucket is later read by one task, and grouping by block needs no shuffle.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), whole.alias("text"),
                       F.octet_length(whole).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
                       F.spark_partition_id().alias("_part"))
    before = F.sum("n_bytes").over(W.partitionBy("_part").orderBy("row").rowsBetween(W.unboundedPreceding, -1))
    sizes = rows.select("_part", "row", "n_bytes").withColumn("_before", F.coalesce(before, F.lit(0)))
    begins = sizes.groupBy("_part", F.expr(f"_before div {plan.block_bytes}")).agg(F.min("row").alias("begin"))
    parts: dict[int, list[int]] = {}
    for r in begins.orderBy("_part", "begin").collect():
        parts.setdefault(r["_part"], []).append(r["begin"])
    firsts = np.cumsum([0, *map(len, parts.values())]).tolist()
    n = max(1, min(plan.max_blocks, firsts[-1]))
    cuts = spark.createDataFrame([(k, first, begin) for (k, begin), first in zip(parts.items(), firsts, strict=False)],
                                 "_part int, _first long, _begins array<long>")
    tries = spark.range(0, 64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("_bucket")).agg(F.min("id").alias("block"))
    # Rows that were not there when sizes were read belong to some block, too.
    number = F.coalesce(F.col("_first") + F.size(F.filter("_begins", lambda x: x <= F.col("row"))) - 1, F.col("_part"))
    rows = rows.join(F.broadcast(cuts), "_part", "left").withColumn("_bucket", F.pmod(number, F.lit(n)).cast("int"))
    rows = rows.join(F.broadcast(tries), "_bucket", "left").select(
        F.coalesce("block", F.col("_bucket").cast("long")).alias("block"), "row", "doc_id", "text", "n_bytes")
    name = f"tersefold_texts_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "block").option("compression", "zstd").format("parquet").saveAsTable(
        name, path=new_dir(spark, "texts"))
    written = spark.table(name)
    # The rows stay where they are; only the name goes.
    spark.sql(f"DROP TABLE {name}")
    return written


def without_repeats(docs: DataFrame, plan: RepeatPlan = RepeatPlan(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans and kept bytes of each row: every byte that a string of plan.match bytes covers which also
    starts in a row with a smaller key is removed.

    Texts are UTF-8 bytes; strings never cross from one text to the next, may
    overlap, and are judged on the input. `spans` are the longest removed
    stretches (begin, end); `kept` is binary, as characters may be cut. Null
    texts are empty. Rows of one key do not count as smaller than each other; a null
    key counts as larger than all others. Keys are integers. Other columns are not read.
    """
    texts = _in_blocks(docs, key, text, plan)
    size = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select("block", "row", "doc_id", "text")
    spans, places = plan.spans(), plan.match - plan.gram + 1

    def n_buckets(n_keys: int) -> int:
        return max(least, -(-n_keys // plan.bucket_keys))

    def told(rows: pa.Table, answers: pa.Table | None, buckets: list[int]) -> tuple:
        """Ids, texts, the stretches matched so far, and those of the last round with their keys. buckets: of the rounds so far."""
        ids, order, texts = _read(rows)
        p, matched = _positions(texts, plan), []
        asked = _Asked(p.cls, p.string, order[p.text], buckets[0])
        for level, (span, n) in enumerate(zip(spans, buckets[1:], strict=False), 1):
            state = asked.told(_level(answers, level))
            matched.append(p.windows(state == MATCHED))
            p = _narrowed(texts, p, state == SHARED, span, plan)
            asked = _Asked(p.cls, p.string, order[p.text], n)
        return ids, texts, matched, p, asked

    def ask(rows: DataFrame, answers: DataFrame | None, buckets: list[int]) -> DataFrame:
        def first(block: tuple, rows: pa.Table) -> pa.Table:
            return told(rows, None, buckets)[-1].rows(block[0].as_py())

        def later(block: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
            return told(rows, answers, buckets)[-1].rows(block[0].as_py())

        grouped = rows.groupBy("block")
        return grouped.applyInArrow(first, _ASKED) if answers is None else grouped.cogroup(answers.groupBy("block")).applyInArrow(later, _ASKED)

    def remove(block: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        ids, texts, matched, p, asked = told(rows, answers, buckets)
        matched.append(p.windows(asked.told(_level(answers, len(buckets))) == MATCHED))
        text, start, last = (np.concatenate(x) for x in zip(*matched, strict=True))
        by_text = np.argsort(text, kind="stable")
        return pa.Table.from_arrays([ids, *_removed(texts, plan, text[by_text], start[by_text], last[by_text] + plan.match)],
                                    ["doc_id", "n_bytes", "spans", "kept"])

    answers, buckets, n_keys, wide = None, [], size // ((places + 1) // 2), places
    for level, span in enumerate([*spans, 0], 1):
        buckets = [*buckets, n_buckets(n_keys)]
        asked = ask(rows, answers, buckets)
        new = stage(asked.groupBy("bucket").applyInArrow(_answer, "block bigint, bucket bigint, states binary, shared bigint"), f"answers-{level}")
        if span:
            # Each shared stretch is cut into so many groups at most.
            n_keys, wide = new.agg(F.coalesce(F.sum("shared"), F.lit(0))).first()[0] * -(-wide // span), span
        new = new.select("block", F.lit(level).alias("level"), "bucket", "states")
        answers = new if answers is None else answers.unionByName(new)
    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        remove, "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")
    return out.select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
