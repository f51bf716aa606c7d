"""Secrets in whole texts: keyword automaton, anchored expressions at its hits, checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, table

# Keywords and expressions of each kind, and the base-62 digits of token checksums.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
           "npm": re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_FOLD = bytes(48 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_LOWER = LOWER.tobytes()


def base62_crc(payload: bytes) -> str:
    """crc32 of the payload in six base-62 digits, as issued tokens carry it."""
    value, digits = zlib.crc32(payload), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def _automaton(words: dict[str, tuple[str, int]]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for word, value in words.items():
        out.add_word(word, value)
    out.make_automaton()
    return out


class Scanner:
    """Built once per task. Works on UTF-8 bytes: every expression is ASCII, so offsets carry over."""

    def __init__(self) -> None:
        self.keywords = _automaton({w: (kind, len(w)) for kind, ws in KEYWORDS.items() for w in ws})
        self.hex_runs = _automaton({"0" * MIN_HEX: ("hex", MIN_HEX)})

    def spans(self, text: bytes) -> list[tuple[int, str, int]]:
        """(start, kind, end) in bytes, by start and then kind."""
        found, done = [], dict.fromkeys(KINDS, 0)
        for last, (kind, length) in self.keywords.iter(text.translate(_LOWER).decode("latin-1")):
            start = last - length + 1
            if start >= done[kind]:
                end, good = self._match(kind, text, start)
                if end:
                    done[kind] = end
                if good:
                    found.append((start, kind, end))
        for last, (kind, length) in self.hex_runs.iter(text.translate(_HEX_FOLD).decode("latin-1")):
            if last >= done["hex"]:
                # The first hit in a run of hex digits ends `length` digits after the run's start.
                start = last - length + 1
                done["hex"] = HEX.match(text, start).end()
                found.append((start, "hex", done["hex"]))
        return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))

    def _match(self, kind: str, text: bytes, start: int) -> tuple[int, bool]:
        if kind == "assign":
            m = ASSIGN.match(text, start)
            return (m.end(), m.end() - m.start(2) >= MIN_ASSIGN) if m else (0, False)
        if kind == "access":
            m = ACCESS.match(text, start)
            return (m.end(), m.end() - start >= MIN_ACCESS) if m else (0, False)
        m = CHECKED[kind].match(text, start)
        if not m:
            return 0, False
        return m.end(), base62_crc(m[1][:30]) == m[1][30:].decode()


def code_points(text: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), kind, int(before[e])) for s, kind, e in spans]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `spans` (kind, start, end in code points, end exclusive), row by row.

    Base kinds are the leftmost non-overlapping matches of each expression, less
    those that are too short; `github` and `npm` tokens count only if their
    checksum holds. Null and empty texts have no spans; repeated rows are
    scanned alike; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            out = []
            for value in batch.column(1):
                raw = value.as_py().encode()
                out.append([{"kind": k, "start": s, "end": e} for s, k, e in code_points(raw, scanner.spans(raw))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, type=pa.list_(_SPAN))], ["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))
