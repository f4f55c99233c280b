"""Removal of byte strings that occur earlier, by suffix arrays and their common-prefix intervals.

Method.  Texts are cut in overlapping segments by content-defined anchors (``repeats``), so that all occurrences of
any 100-byte string lie in segments of one anchor.  Of segments that are equal as a whole, one string with several
occurrences, the earliest stays and the others go.  The different strings of an anchor are sorted into a sparse suffix
array of their window starts, with its array of common prefixes; a stack scan over it yields the tree of common-prefix
intervals.  An interval whose suffixes are preceded by different bytes, or start a string, can't be extended to the left:
it is a maximal repeat, given with all its occurrences, and all but the earliest are removed.  Intervals that can be
extended are left to those that hold them.  ``groups`` returns the groups of a corpus with all occurrences.

Scale.  See ``repeats``: only anchored segments are shuffled, in streaming passes; suffix arrays are built over whole
anchors, about half a megabyte at a time.  The suffixes of an anchor with more than ``HOT_SEGMENTS`` strings are first
dealt by their first 100 bytes, so that each bucket is one interval.  Texts are shuffled once, for both joins.

Defined cases.  A null text is empty.  Texts under 100 bytes lose nothing.  Removal is judged on the input: what
covers a byte may itself be removed elsewhere.  Rows that share a doc_id, or have none, are ordered by text, equal
ones in any order; so of equal rows one counts as the earlier.  Repeats never cross rows.  An empty table gives an empty
result.  Extra columns, whatever their names, do not matter.  A very long text is cut in segments like any other; it is
held whole by the one task that reads it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm import repeats, staging
from veilmark.llm.sequences import BYTE_VALUES, segments

WINDOW = 100
GRAM = 24


class SuffixArray:
    """Suffixes that start at given places of given strings, sorted; with common prefixes of neighbours."""

    def __init__(self, strings: list[bytes], counts: list[int]) -> None:
        width = max(map(len, strings))
        room = np.array([len(s) for s in strings])
        buffer = np.frombuffer(b"".join(s + bytes(width) for s in strings) + bytes(width), np.uint8)
        base = np.cumsum(np.r_[0, room[:-1] + width])
        n = np.array(counts)
        self.string = np.repeat(np.arange(len(strings)), n)
        self.offset = np.arange(len(self.string)) - np.repeat(np.cumsum(n) - n, n)
        at = base[self.string] + self.offset
        rows = np.lib.stride_tricks.sliding_window_view(buffer, width)[at]
        order = np.argsort(rows.view(f"S{width}").ravel(), kind="stable")
        self.string, self.offset = self.string[order], self.offset[order]
        rows = rows[order]
        left = room[self.string] - self.offset
        differ = rows[1:] != rows[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        #: common[i]: what suffixes i and i + 1 share.
        self.common = np.minimum(same, np.minimum(left[1:], left[:-1]))
        #: before[i]: the byte before suffix i, -1 at its string's start.
        self.before = np.where(self.offset > 0, buffer[at[order] - 1].astype(np.int64), -1)


def intervals(common: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int, bool]]:
    """(length, first, last, maximal) of the common-prefix intervals of length ``least`` or more.

    The stack holds the open intervals, each with the byte that all its suffixes so far are preceded by, or None
    once two differ.  A suffix at its string's start (-1) is preceded by nothing, which differs from anything.
    """
    starts = np.flatnonzero((common >= least) & np.r_[True, common[:-1] < least]) if len(common) else []
    for start in starts:
        stack: list[list] = []  # [length, first, byte or None]
        i = int(start)
        byte: int | None = int(before[i]) if before[i] >= 0 else None
        while True:
            length = int(common[i]) if i < len(common) else 0
            if length < least:
                length = 0
            first, held = i, byte
            while stack and stack[-1][0] > length:
                size, low, own = stack.pop()
                own = own if own == held else None
                yield size, low, i, own is None
                first, held = low, own
            if not length:
                break
            if stack and stack[-1][0] == length:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == held else None
            else:
                stack.append([length, first, held])
            i += 1
            byte = int(before[i]) if before[i] >= 0 else None


def maximal_repeats(strings: list[bytes], least: int, counts: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, sorted occurrences (string, offset)) of every maximal repeat of ``least`` bytes or more within the strings.

    ``counts``: how many suffixes of each string take part.  An interval whose suffixes are all preceded by one byte is
    no group of its own: the interval of the suffixes that start one byte earlier holds it.
    """
    kept = [s for s in strings if len(s) >= least]
    names = [i for i, s in enumerate(strings) if len(s) >= least]
    if not kept:
        return []
    array = SuffixArray(kept, [counts[i] for i in names] if counts else [len(s) - least + 1 for s in kept])
    place = np.stack([np.array(names)[array.string], array.offset], 1)
    return [(length, sorted(map(tuple, place[low : high + 1].tolist()))) for length, low, high, maximal in intervals(array.common, array.before, least) if maximal]


def _resolve(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (uid, start, end) of all occurrences but the earliest of each maximal repeat in ``repeats.contents``' rows."""
    yield from ((uid, start, start + window) for _, uid, start, _, content in rows if not content)
    rows = [r for r in rows if r[4]]
    for length, found in maximal_repeats([r[4] for r in rows], window, [r[3] for r in rows]):
        at = sorted((rows[i][1], rows[i][2] + offset) for i, offset in found)
        yield from ((uid, start, start + length) for uid, start in at[1:])


def _segmenter(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    return segments(BYTE_VALUES[data], offsets, WINDOW, GRAM, bytes(data), 1)


def _extract(data: bytes):  # noqa: ANN202
    return lambda start, end: data[start:end]


def repeated(docs: DataFrame) -> DataFrame:
    """uid, start, size of byte intervals of docs (uid, text) that are covered by earlier strings; they may overlap."""
    settled = staging.stage(repeats.settle(repeats.scan(docs, _segmenter, WINDOW), WINDOW), "settled")
    found = repeats.contents(docs, settled.filter("not repeat").drop("repeat"), _extract, WINDOW)
    resolved = repeats.grouped(found, _resolve, WINDOW)
    return settled.filter("repeat").selectExpr("uid", "start", "cast(count as long) as size").unionByName(resolved)


def groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per occurrence of each maximal repeat: group, length, doc_id, start.

    Maximal within anchored segments: a passage longer than a segment (at most 176 bytes) comes as a chain of groups
    that overlap by 99 bytes.  A string that occurs in several segments of one content occurs in each of them.
    """
    own = repeats.identified(docs, text, id_col)
    every = staging.stage(repeats.scan(own, _segmenter, WINDOW, combine=False).drop("repeat"), "every")
    name = ["anchor", "whole", "tail"]
    strings = every.groupBy(*name).agg(F.min(F.struct("uid", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = strings.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    strings = staging.stage(strings.join(repeated, "anchor").select(*name, "first.uid", "first.start", "n"), "strings")
    open_strings = strings.select("anchor", "uid", "start", F.expr(f"cast(tail & {(1 << repeats.COUNT_BITS) - 1} as int)").alias("count"))
    found = repeats.contents(own, open_strings, _extract, WINDOW, hot_segments=1 << 60)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in repeats.whole_keys(batches, 1 << 19):
            rows = [r for r in held if r[4]]
            out = []
            for length, at in maximal_repeats([r[4] for r in rows], WINDOW, [r[3] for r in rows]):
                uid, start = min((rows[i][1], rows[i][2] + offset) for i, offset in at)
                out += [(uid, start, length, rows[i][1], rows[i][2], offset) for i, offset in at]
            out += [(r[1], r[2], len(r[4]), r[1], r[2], 0) for r in rows]  # a string alone: a group if it has several occurrences
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, ["g_uid", "g_start", "length", "uid", "start", "offset"])

    dealt = found.repartition(staging.tasks(docs.sparkSession), "key").sortWithinPartitions("key", "uid", "start")
    pieces = dealt.mapInArrow(run, "g_uid long, g_start long, length long, uid long, start long, offset long").distinct()
    named = pieces.join(strings, ["uid", "start"]).select(*name, "g_uid", "g_start", "length", "offset")
    places = named.join(every, name).select("g_uid", "g_start", "length", "uid", (F.col("start") + F.col("offset")).alias("start")).distinct()
    group = F.xxhash64("g_uid", "g_start", "length")
    many = places.groupBy("g_uid", "g_start", "length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return places.join(many, ["g_uid", "g_start", "length"]).join(own.select("uid", "doc_id"), "uid").select(group.alias("group"), "length", "doc_id", "start")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode()
            removed, spans, digest, at = 0, 0, hashlib.sha256(), 0
            if found:
                start = np.array([f["start"] for f in found], np.int64)
                size = np.array([f["size"] for f in found], np.int64)
                _, begin, end = repeats.merged(np.zeros(len(found), np.int64), start, start + size)
                for a, b in zip(begin.tolist(), end.tolist()):
                    digest.update(data[at:a])
                    at, removed = b, removed + b - a
                spans = len(begin)
            digest.update(data[at:])
            rows.append((len(data), removed, spans, digest.hexdigest()))
        n, removed, spans, digests = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    own = repeats.shared(repeats.identified(docs, text, id_col))
    kind = own.schema["doc_id"].dataType.simpleString()
    return repeats.with_repeats(own, repeated(own)).mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)
