"""Line tables of large text files, cut at every line end.

Spark's own reader cuts at one separator or at LF and CR without saying which,
so files are read here in ranges of bytes. A line belongs to the range it begins
in: each range looks a few bytes back to see whether a line ends at its border,
and reads on until its last line ends. Ranges are rows of a DataFrame, read twice:
once to count their lines, and again when sums over the ranges tell where each begins.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT_BYTES = 32 << 20
# The line ends of `with_lines` as UTF-8; the longest has three bytes.
_END = re.compile(rb"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e]|\xc2\x85|\xe2\x80[\xa8\xa9]")
_BACK = 3
_STEP = 1 << 16
MAX_TASKS = 20_000
# The functions below are sent whole, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _opened(path: str) -> pa.NativeFile:
    """The file for random access; a path without scheme or with `file:` is local."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return files.LocalFileSystem().open_input_file(path.removeprefix("file:").replace("///", "/", 1))
    system, inside = files.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def _line_starts(file, start: int, end: int, size: int) -> tuple[bytes, list[int]]:
    """Bytes from some place on, and where in them the lines begin that begin in [start, end), with the end of the last."""
    base = max(0, start - _BACK)
    file.seek(base)
    data = file.read(min(end, size) - base)
    # Places in `data`; a line end that touches the end of the bytes may go on behind it.
    starts, at, step = [0] if start == 0 and size else [], 0, _STEP
    while True:
        whole = base + len(data) >= size
        for m in _END.finditer(data, at):
            if m.end() == len(data) and not whole:
                break
            at = m.end()
            if base + at >= start:
                if base + at >= end:
                    return data, [*starts, at] if starts else []
                starts.append(at)
        if whole:
            if starts and starts[-1] < len(data):
                starts.append(len(data))
            return data, starts
        if not starts and base + len(data) >= end + _BACK:
            return data, []
        # A long line is read on in growing steps and searched once.
        at = max(at, len(data) - _BACK)
        data += file.read(step if starts else 2 * _BACK)
        step *= 2


def _texts(data: bytes, bounds: np.ndarray) -> pa.Array:
    """The lines between the bounds; bytes that are no UTF-8 become the replacement character."""
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], type=pa.string())


def read_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Line table of text files: path, pos from 0 on, and line with its end, cut as `with_lines` cuts.

    Empty files have no lines. A file may be one line or many; what one row
    holds is a line, whatever its file holds. Paths are found by Spark and read
    by Arrow: local and shared folders, and the stores that Arrow knows.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    n = listed.agg(F.coalesce(F.sum(F.expr(f"(length - 1) div {split_bytes} + 1")), F.lit(1))).first()[0]
    ranges = listed.select("path", "length", F.explode(F.expr(
        f"sequence(0L, length - 1, {split_bytes}L)")).alias("block")).repartition(min(n, MAX_TASKS), "path", "block")

    def bounds_of(path: str, size: int, start: int) -> tuple[bytes, list[int]]:
        with _opened(path) as file:
            return _line_starts(file, start, min(size, start + split_bytes), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            counts = [max(0, len(bounds_of(*row)[1]) - 1) for row in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, type=pa.int64())], ["path", "length", "block", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, bounds = bounds_of(path, size, start)
                for at in range(0, max(0, len(bounds) - 1), 1 << 16):
                    texts = _texts(data, np.array(bounds[at: at + (1 << 16) + 1]))
                    n = len(texts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * n, type=pa.string()), pa.array(np.arange(before + at, before + at + n)), texts],
                        ["path", "pos", "line"])

    # Only ranges are numbered and moved, one row each; their lines are read twice instead.
    counted = ranges.mapInArrow(count, "path string, length bigint, block bigint, n bigint").filter("n > 0")
    before = F.coalesce(F.sum("n").over(
        W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    placed = counted.select("path", "length", "block", before.alias("before")).repartition(min(n, MAX_TASKS), "path", "block")
    return placed.mapInArrow(run, "path string, pos bigint, line string")
