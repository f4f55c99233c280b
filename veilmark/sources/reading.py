"""Reading documents: which extractor a file takes, its limits, and its text's encoding.

Extractors are plain functions from bytes to segments; they run in Arrow batches, a row for each file, so that a file
is parsed where its bytes are.  Only formats that no built-in expression can parse come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilmark.functions.detect import SEGMENT

#: Every reason for which reading can be refused.
REFUSALS = (
    "not_regular_file", "file_too_large", "too_many_entries", "part_too_large", "total_too_large", "too_many_elements", "doctype_not_allowed",
    "unsupported_encoding", "duplicate_part", "encrypted", "malformed_xml", "main_part_missing", "unsupported_namespace",
)
#: A table smaller than this (half of what Spark gives a task of a scan) is spread over all cores before costly work.
SPREAD_BYTES = 64 << 20
#: So many rows of an Arrow batch are worked on together.
SLICE_ROWS = 64
#: Files that a directory scan takes.
EXTENSIONS = (".txt", ".md", ".html", ".htm", ".docx", ".pdf", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tif", ".tiff", ".webp")


class Refused(Exception):
    """Reading is refused for one of REFUSALS."""

    def __init__(self, code: str) -> None:
        if code not in REFUSALS:
            raise ValueError(f"unknown refusal {code!r}")
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Limits:
    file_bytes: int = 64 << 20
    entries: int = 10_000
    part_bytes: int = 32 << 20
    total_bytes: int = 128 << 20
    elements: int = 1_000_000

    def __post_init__(self) -> None:
        for name, value in vars(self).items():
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError(f"{name} must be a positive whole number")


@dataclass
class Segment:
    text: str
    visible: bool
    kind: str
    location: str | None = None
    concealment: str | None = None


class Found(list):
    """A list of segments that also carries counts of the file."""

    def __init__(self, *segments: Segment) -> None:
        super().__init__(segments)
        self.counts: dict[str, int] = {}


Extractor = Callable[[bytes, Limits], list[Segment]]
_EXTRACTORS: dict[str, Extractor] = {}


def register(extensions: str | list[str], extractor: Extractor) -> None:
    """Take these extensions with this extractor from now on; the dot may be left out."""
    for e in [extensions] if isinstance(extensions, str) else extensions:
        _EXTRACTORS["." + e.lower().lstrip(".")] = extractor


def registered(extension: str) -> Extractor | None:
    return _EXTRACTORS.get("." + extension.lower().lstrip("."))


def decode(data: bytes) -> tuple[str, str | None]:
    """(text, name of an encoding that isn't UTF-8): strict UTF-8, else strict CP932, else refused; line ends are \\n."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff") or data[:4] in (b"\x00\x00\xfe\xff", b"\xff\xfe\x00\x00"):
        raise Refused("unsupported_encoding")
    for name in ("utf-8-sig" if data.startswith(b"\xef\xbb\xbf") else "utf-8", "cp932"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        return text.replace("\r\n", "\n").replace("\r", "\n"), "cp932" if name == "cp932" else None
    raise Refused("unsupported_encoding")


def plain(data: bytes, limits: Limits) -> list[Segment]:
    return [Segment(decode(data)[0].removeprefix("﻿"), True, "body")]


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, if they are so few that they may lie in one row group, which one task reads.

    Larger tables have tasks enough and are not shuffled.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if int(str(size)) < SPREAD_BYTES else rows


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, at most SLICE_ROWS at a time: what is made of them takes no more room in larger batches."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            yield whole.slice(at, SLICE_ROWS)


def suffix(name: Column) -> Column:
    """What follows the last dot of a file name, with the dot; empty if nothing does, or nothing stands before it."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True, file_bytes: int = Limits.file_bytes) -> DataFrame:
    """source, extension, length, content of the folder's files of these extensions, in either case.

    Files of more than ``file_bytes`` are listed with null content, which is not read: the limit is a predicate of the
    scan, and the larger ones' content no column of theirs.  ``ordered`` sorts them by path, where an order is needed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)

    def own(content: Column) -> list[Column]:
        return [F.col("path").alias("source"), F.lower(suffix(name)).alias("extension"), F.col("length"), content.alias("content")]

    every = files.filter(F.col("length") <= file_bytes).select(*own(F.col("content")))
    every = every.unionByName(files.filter(F.col("length") > file_bytes).select(*own(F.lit(None).cast("binary"))))
    return every.filter(F.col("extension").isin(*extensions))


def ordered(rows: DataFrame) -> DataFrame:
    """rows by source, as code points compare."""
    return rows.orderBy(F.col("source").cast("binary"))


def extract(files: DataFrame, limits: Limits = Limits(), write: Callable[[Any], bytes] | None = None, extractors: dict[str, Extractor] | None = None) -> DataFrame:  # noqa: B008  frozen
    """files (any columns, with extension, length, content) with status, encoding, counts and segments instead of content.

    status is ok, ``Unsupported format: ...``, ``Extraction refused: ...`` or ``Extraction failed: ...``.  What is too
    large is refused by its length alone.  With ``write``, content is of any type, and a file's bytes are what ``write``
    makes of it: each file is written where it is read, and then gone, instead of a table of files.  ``extractors`` go
    before those that are registered.
    """
    known = _EXTRACTORS | (extractors or {})
    bounded = files if write else files.withColumn("content", F.when(F.col("length") <= limits.file_bytes, F.col("content")))
    names = bounded.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bounded.schema if f.name != "content") + f", status string, encoding string, counts map<string,bigint>, segments array<{SEGMENT}>"
    kind = pa.list_(pa.struct([("text", pa.string()), ("visible", pa.bool_()), ("kind", pa.string()), ("location", pa.string()), ("concealment", pa.string())]))

    def one(extension: str, content: bytes | None) -> tuple[str, str | None, dict, list]:
        if extension not in known:
            return f"Unsupported format: {extension}", None, {}, []
        if content is None:
            return "Extraction refused: file_too_large", None, {}, []
        try:
            encoding = decode(content)[1] if extension in (".txt", ".md", ".html", ".htm") else None
            found = known[extension](content, limits)
            return "ok", encoding, getattr(found, "counts", {}), [vars(s) for s in found]
        except Refused as e:
            return f"Extraction refused: {e.code}", None, {}, []
        except Exception as e:  # noqa: BLE001  any fault of a file is that file's status
            return f"Extraction failed: {type(e).__name__}", None, {}, []

    def own(value: Any) -> bytes | None:
        content = write(value) if write else value
        return content if content is None or len(content) <= limits.file_bytes else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            done = [one(e, own(c.as_py())) for e, c in zip(batch.column(names.index("extension")).to_pylist(), batch.column(names.index("content")))]
            rest = [batch.column(i) for i, n in enumerate(names) if n != "content"]
            status, encoding, counts, segments = zip(*done) if done else ((), (), (), ())
            made = [pa.array(status, pa.string()), pa.array(encoding, pa.string()), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64())), pa.array(segments, kind)]
            yield pa.RecordBatch.from_arrays([*rest, *made], [*(n for n in names if n != "content"), "status", "encoding", "counts", "segments"])

    return bounded.mapInArrow(run, schema)


register([".txt", ".md"], plain)
