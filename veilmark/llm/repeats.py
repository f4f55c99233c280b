"""Which windows of fixed length occur earlier in the corpus: the parts that byte and word deduplication share.

A window occurs earlier if an equal one starts at a smaller (doc, position).  Windows are grouped in segments by
their anchors (see ``sequences.segments``), about one for each 35 bytes or 9 words, and only segments are shuffled:

1. ``scan``: segments of every text; of segments equal in all windows only a task's earliest goes on, the others are
   repeats already.  So a passage held by a third of all rows leaves each task once.
2. ``settle``: by anchor, in one streaming pass over sorted rows that holds one row at a time: segments equal to an
   earlier one are repeats; those whose anchor has no other segment are unique; what is left, a few hundredths, is
   open and needs its content.  Two segments count as equal if 96 bits of the BLAKE2b digests of their contents are;
   among 10^12 segments some two clash with a chance of about one in 150 000.
3. ``contents``: the open segments' contents; an anchor with more than ``HOT_SEGMENTS`` open ones is split by window
   content, which bounds the groups that an operator then holds in memory.

Documents are known by ``uid``, a unique long whose order is that of doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm import staging
from veilmark.llm.sequences import COUNT_BITS, runs

#: Segments buffered in a task before its repeats are combined.
COMBINE_SEGMENTS = 1_000_000
HOT_SEGMENTS = 1_000

#: tail holds the size of a covered interval, or a segment's number of windows below the rest of its digest.
SCANNED = "repeat boolean, anchor long, whole long, tail long, uid long, start long"
SETTLED = "anchor long, uid long, start long, count int, repeat boolean"
Segmenter = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def own_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids are whole numbers (within 2**61 of zero), unique and not null, so that they name rows."""
    ids = docs.select(docs[id_col].alias("doc_id"))
    if ids.schema["doc_id"].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return not ids.groupBy("doc_id").count().filter(f"count > 1 or doc_id is null or abs(cast(doc_id as decimal(20,0))) >= {1 << 61}").limit(1).count()


def numbered(docs: DataFrame, text: str, id_col: str, uid: str) -> DataFrame:
    """A staged copy of docs with rows numbered as uid, in the order of the id (null last), then text."""
    ordered = docs.orderBy(docs[id_col].isNull(), docs[id_col], docs[text])
    return staging.stage(ordered.withColumn(uid, F.monotonically_increasing_id()), "numbered")


def identified(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """uid, doc_id, text.  uid is doc_id itself where ids are whole numbers, unique and not null.

    Else rows are numbered in the order of doc_id (null last), then text, in a staged copy.
    """
    own = docs.select(docs[id_col].alias("doc_id"), docs[text].alias("text"))
    if own_ids(own, "doc_id"):
        return own.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text")
    return numbered(own, "text", "doc_id", "uid").select("uid", "doc_id", "text")


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of documents, sorted and joined where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    offset = (np.cumsum(np.r_[0, doc[1:] != doc[:-1]])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + offset)
    new = np.r_[True, (start + offset)[1:] > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - offset[last]


def counts(tail: np.ndarray) -> np.ndarray:
    """Segments' numbers of windows."""
    return tail & ((1 << COUNT_BITS) - 1)


def combined(rows: dict[str, np.ndarray], window: int) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The earliest of equal segments, and the merged intervals that the others cover."""
    order = np.lexsort((rows["start"], rows["uid"], rows["tail"], rows["anchor"], rows["whole"]))
    first = np.ones(len(order), bool)
    first[1:] = False
    for name in ("whole", "anchor", "tail"):
        value = rows[name][order]
        first[1:] |= value[1:] != value[:-1]
    again, kept = order[~first], np.sort(order[first])
    start = rows["start"][again]
    covered = merged(rows["uid"][again], start, start + counts(rows["tail"][again]) + window - 1)
    return {k: v[kept] for k, v in rows.items()}, covered


def scan(docs: DataFrame, segmenter: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], window: int, combine: bool = True) -> DataFrame:
    """Segments (repeat false) and covered intervals (repeat true: start, tail values) of docs (uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        schema = pa.schema([("repeat", pa.bool_()), *((c, pa.int64()) for c in ("anchor", "whole", "tail", "uid", "start"))])

        def flushed() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            rows, (doc, start, end) = {k: np.concatenate([h[k] for h in held]) for k in held[0]}, (np.zeros(0, np.int64),) * 3
            held.clear()
            if combine:
                rows, (doc, start, end) = combined(rows, window)
            for at in range(0, len(rows["uid"]), 50_000):
                part = {k: v[at : at + 50_000] for k, v in rows.items()}
                n = len(part["uid"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), *(part[c] for c in schema.names[1:])], schema=schema)
            if len(doc):
                spread = (doc * 0x9E3779B97F4A7C1) ^ start
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(doc), bool)), spread, spread, end - start, doc, start], schema=schema)

        for batch in batches:
            uid = batch.column(0).to_numpy()
            for at, data, offsets in runs(batch.column(1)):
                found = segmenter(data, offsets)
                if len(found["text"]):
                    found["uid"] = uid[at + found.pop("text")].astype(np.int64)
                    held.append(found)
                if sum(len(h["uid"]) for h in held) >= COMBINE_SEGMENTS:
                    yield from flushed()
        yield from flushed()

    return docs.select("uid", "text").mapInArrow(run, SCANNED)


def _settled(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("repeat", pa.bool_())])
        pending: dict[str, np.ndarray] | None = None  # the first segment of the last anchor, while it is the only one
        last: tuple | None = None  # anchor, whole, tail of the last segment
        several = False  # the last anchor's first segments have been given out

        def out(anchor: np.ndarray, uid: np.ndarray, start: np.ndarray, count: np.ndarray, repeat: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([anchor, uid, start, count.astype(np.int32), pa.array(np.full(len(uid), repeat))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("repeat", "anchor", "whole", "tail", "uid", "start")}
            known = rows.pop("repeat")
            if known.any():
                yield out(*(rows[k][known] for k in ("anchor", "uid", "start", "tail")), True)
                rows = {k: v[~known] for k, v in rows.items()}
                if not len(rows["uid"]):
                    continue
            same = [rows[k] for k in ("anchor", "whole", "tail")]
            new = np.ones(len(rows["uid"]), bool)
            new[1:] = np.any([v[1:] != v[:-1] for v in same], axis=0)
            new[0] = tuple(v[0] for v in same) != last
            end = tuple(v[-1] for v in same)
            again = {k: v[~new] for k, v in rows.items()}
            if len(again["uid"]):
                doc, begin, stop = merged(again["uid"], again["start"], again["start"] + counts(again["tail"]) + window - 1)
                yield out(doc, doc, begin, stop - begin, True)
            rows = {k: v[new] for k, v in rows.items()}
            if pending is not None:
                rows = {k: np.concatenate([pending[k], v]) for k, v in rows.items()}
            carried = several
            pending, several = None, several and last is not None and end[0] == last[0]
            if len(rows["uid"]):
                a = rows["anchor"]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                size = np.diff(np.append(first, len(a)))
                give = np.repeat(size > 1, size)
                if carried and a[0] == last[0]:
                    give[: size[0]] = True
                if a[-1] == end[0] and not give[-1]:
                    pending = {k: v[-1:] for k, v in rows.items()}
                elif a[-1] == end[0]:
                    several = True
                if give.any():
                    yield out(*(rows[k][give] for k in ("anchor", "uid", "start")), counts(rows["tail"][give]), False)
            last = end

    return run


def settle(scanned: DataFrame, window: int) -> DataFrame:
    """From ``scan``'s rows: repeats (intervals) and open segments."""
    dealt = scanned.repartition(staging.tasks(scanned.sparkSession), "anchor").sortWithinPartitions("anchor", "whole", "tail", "uid", "start")
    return dealt.mapInArrow(_settled(window), SETTLED)


def contents(docs: DataFrame, open_segments: DataFrame, extract: Callable[[bytes], Callable[[int, int], bytes]], window: int, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """key, uid, start, count, content of each open segment; hot anchors' ones in single windows, keyed by content.

    Empty content marks a window with an equal earlier one in the same batch; its key only spreads it.
    ``extract(data)`` gives, for a text's bytes, a function from (start, end) to the content.
    """
    load = open_segments.groupBy("anchor").count().filter(F.col("count") > hot_segments).select("anchor", F.lit(True).alias("hot"))
    flagged = open_segments.join(load, "anchor", "left").groupBy("uid").agg(F.collect_list(F.struct("anchor", "start", "count", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("segments"))
    with_text = docs.join(flagged.hint("shuffle_hash"), "uid").select(*docs.columns, "segments")  # all columns: see ``shared``
    schema = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("start", pa.int64()), ("count", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows: list[tuple] = []
            single: dict[bytes, list[tuple]] = {}
            for uid, text, segments in zip(whole.column("uid").to_pylist(), whole.column("text"), whole.column("segments").to_pylist()):
                content = extract(text.as_py().encode())
                for s in segments:
                    at, n = s["start"], s["count"]
                    if not s["hot"]:
                        rows.append((s["anchor"], uid, at, n, content(at, at + n - 1 + window)))
                        continue
                    for i in range(at, at + n):
                        single.setdefault(content(i, i + window), []).append((uid, i))
            for piece, found in single.items():  # only the batch's earliest of equal windows goes by its content
                found.sort()
                rows.append((hash_key(piece), *found[0], 1, piece))
                rows += [((uid * 0x9E3779B1 ^ at) & ((1 << 63) - 1), uid, at, 1, b"") for uid, at in found[1:]]
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 20_000]), schema)], schema=schema)

    return with_text.mapInArrow(run, "key long, uid long, start long, count int, content binary")


def shared(docs: DataFrame) -> DataFrame:
    """docs (uid, doc_id, text) such that ``contents`` and ``with_repeats`` read one shuffle of the texts, not one each.

    Spark shuffles once what two joins by uid read alike: all columns, and no null test that just one of them needs.
    """
    return docs.withColumn("uid", F.coalesce("uid", F.lit(0).cast("long")))


def hash_key(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def whole_keys(batches: Iterator[pa.RecordBatch], group_bytes: int) -> Iterator[list[tuple]]:
    """Rows of ``contents`` sorted by key, whole keys together, about ``group_bytes`` at a time.

    A key of single equal windows, which may have any number, comes in parts that each begin with its earliest.
    """
    held: list[tuple] = []
    size, first, alike = 0, 0, True  # first: where the last key begins; alike: its rows so far are one window
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[0] != held[-1][0]:
                if size >= group_bytes:
                    yield held
                    held, size = [], 0
                first, alike = len(held), True
            elif held:
                alike = alike and row[3] == 1 and row[4] == held[first][4]
                if alike and size >= group_bytes:
                    yield held
                    held, first = [held[first]], 0
                    size = len(held[0][4]) + 40
            held.append(row)
            size += len(row[4]) + 40
    if held:
        yield held


def grouped(found: DataFrame, resolve: Callable[[list[tuple], int], Iterator[tuple[int, int, int]]], window: int, group_bytes: int = 1 << 19) -> DataFrame:
    """uid, start, size of what ``resolve`` finds in rows (key, uid, start, count, content) of ``contents``.

    ``resolve`` gets whole keys, sorted by key, uid and start, about ``group_bytes`` at a time.
    """
    dealt = found.repartition(staging.tasks(found.sparkSession), "key").sortWithinPartitions("key", "uid", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_keys(batches, group_bytes):
            done = list(resolve(held, window))
            uid, start, end = (np.array(x, np.int64) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 3
            uid, start, end = merged(uid, start, end)
            yield pa.RecordBatch.from_arrays([uid, start, end - start], ["uid", "start", "size"])

    return dealt.mapInArrow(run, "uid long, start long, size long")


def with_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs (uid, doc_id, text) with ``repeats``: an array of (start, size), null where there are none."""
    lists = repeats.groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("repeats"))
    return docs.join(lists.hint("shuffle_hash"), "uid", "left").select("doc_id", "text", "repeats")
