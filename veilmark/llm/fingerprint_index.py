"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Method.  Documents come in batches.  A batch's window fingerprints (the anchored segments of ``repeats``: an anchor and
a BLAKE2b digest of the hashes, 128 bits, of all the segment's words) are written once, as an immutable run, bucketed by anchor and sorted.
Each earlier run is merge-joined with it: buckets are aligned and sorted, so neither side is shuffled again.  Segments
of one digest (96 bits of it are kept) are equal; what else shares an anchor is compared on the words themselves.  When
there are more than ``fanout`` runs they are compacted into one, which keeps the earliest locator of each fingerprint.

An index is a folder: its runs, and numbered manifests that name them.  A change writes the next manifest whole and moves it to
its place; only then do older manifests and runs go.  Who opens a folder reads the highest one, so at every moment, also after
a crash between two steps, there is one index to be found.  Another session opens it by its folder and goes on.

Scale.  A batch costs its own size and sequential reads, of the runs and, if anything matched, of earlier texts; the index holds
about 22 bytes for each nine words.  What is shuffled are the batch, fingerprints that matched, segments left open, and
those earlier texts alone that one of them stands in: while their ids are at most ``BROADCAST_IDS`` these are found by a
broadcast of ids.  See ``repeats`` for how hot fingerprints are combined and split.

Defined cases.  A null text has no words.  Texts of fewer than 20 words lose nothing.  Windows are judged on the
input.  All of an earlier batch counts as earlier, whatever its ids; within a batch ids decide.  Rows that share a
doc_id, or have none, are ordered by text.  Windows never cross rows.  An empty table gives an empty result.  Extra columns,
whatever their names, do not matter.  A very long text is split in words as a whole, by the one task that has it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilmark.llm import repeats, staging
from veilmark.llm.sequences import Words, segments

WINDOW = 20
GRAM = 6
#: The query's batches and runs: three runs are compacted to one before the last batch comes.
BATCHES = 4
FANOUT = 2
#: Up to this many ids (8 bytes each) of earlier texts are sent to all tasks.
BROADCAST_IDS = 1_000_000
#: Earlier batches' uids are moved below all others, so that they come first in every order.
EARLIER = 1 << 62
_SORTED = ("anchor", "whole", "tail", "uid", "start")


def _segmenter(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    words = Words(data, offsets)
    both = np.stack([words.hash, words.other], 1)  # a word is known by both its hashes
    return segments(words.hash, words.offsets, WINDOW, GRAM, both.tobytes(), 16)


def _extract(data: bytes):  # noqa: ANN202
    words = data.split()  # of bytes: at blanks, and tab to carriage return
    return lambda start, end: b" ".join(words[start:end])


def _verify(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """Windows whose words were seen earlier under the same key; rows come by key, uid and start."""
    key, seen = None, set()
    for own, uid, start, count, content in rows:
        if not content:
            yield uid, start, start + window
            continue
        if own != key:
            key, seen = own, set()
        words = content.split(b" ")
        for i in range(count):
            piece = b" ".join(words[i : i + window])
            if piece in seen:
                yield uid, start + i, start + i + window
            else:
                seen.add(piece)


class FingerprintIndex:
    """Runs of fingerprints of all documents added so far, in a shared folder that a later session can open again.

    uids are whole numbers within 2**61 of zero, each of one document of all batches.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = folder or staging.folder(spark, "fingerprints")
        known = self._manifest()
        self.buckets = known["buckets"] if known else buckets or staging.tasks(spark)
        self.runs: list[str] = known["runs"] if known else []
        for run in self.runs:
            self._register(run)

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        """Names of the manifests, in order."""
        path, fs = self._path("")
        names = [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if re.fullmatch(r"manifest-\d{12}\.json", n))

    def _manifest(self) -> dict | None:
        names = self._manifests()
        return json.loads(self.spark.read.text(f"{self.folder}/{names[-1]}", wholetext=True).first()[0]) if names else None

    def _save(self) -> None:
        """The next manifest, written beside and moved to its place; then the older ones go."""
        before = self._manifests()
        number = int(before[-1][9:21]) + 1 if before else 1
        new, fs = self._path(f"next-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps({"runs": self.runs, "buckets": self.buckets}).encode()))
        out.close()
        path, _ = self._path(f"manifest-{number:012}.json")
        if not fs.rename(new, path):
            raise RuntimeError(f"another writer has made {path}")
        for name in before:
            fs.delete(self._path(name)[0], False)

    def _register(self, run: str) -> None:
        """Name a run's files in this session's catalog, so that they are read as buckets."""
        columns = ", ".join(f"{c} {t}" for c, t in (x.split() for x in repeats.SCANNED.split(", ")))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({columns}) USING parquet CLUSTERED BY (anchor) SORTED BY ({', '.join(_SORTED)}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{run}'")

    def _write(self, rows: DataFrame) -> str:
        run = f"veilmark_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "anchor")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy(*_SORTED).option("compression", "zstd").option("path", f"{self.folder}/{run}").saveAsTable(run)
        return run

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("not repeat")

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        path, fs = self._path(run)
        fs.delete(path, True)

    def drop(self) -> None:
        """Delete the index, its tables and its files."""
        for run in self.runs:
            self._forget(run)
        self.runs = []
        path, fs = self._path("")
        fs.delete(path, True)

    def add(self, batch: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Index a batch (uid, text) and return its repeats: uid, start, size in words.

        ``earlier`` holds (uid, text) of the documents added before, to compare matches on; only those with any are
        shuffled.
        """
        name = self._write(repeats.scan(batch, _segmenter, WINDOW))
        own = self._run(name)
        candidates = own.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("anchor")) > 1)
        history = []
        for i, run in enumerate(self.runs):
            past = self._run(run)
            history.append(past.join(own.select("anchor"), "anchor", "left_semi").select(*own.columns).withColumn("uid", F.col("uid") - EARLIER))
            known = past.select("anchor").distinct().withColumn(f"in{i}", F.lit(True))
            candidates = candidates.join(known, "anchor", "left")
        matched = reduce(lambda a, b: a | b, (F.col(f"in{i}").isNotNull() for i in range(len(self.runs))), F.col("many"))
        candidates = candidates.filter(matched).select(*own.columns)
        together = reduce(DataFrame.unionByName, [candidates, self.spark.table(name).filter("repeat"), *history])
        settled = staging.stage(repeats.settle(together, WINDOW), "settled")
        docs = batch.select("uid", "text")
        if self.runs and earlier is not None:
            wanted = staging.stage(settled.filter(f"not repeat and uid < {-(EARLIER >> 1)}").select("uid").distinct(), "wanted")
            n = wanted.count()
            if n:
                past = earlier.select((F.col("uid") - EARLIER).alias("uid"), "text")
                docs = docs.unionByName(past.join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, "uid", "left_semi"))
        found = repeats.contents(docs, settled.filter("not repeat").drop("repeat"), _extract, WINDOW)
        resolved = repeats.grouped(found, _verify, WINDOW)
        self.runs.append(name)
        if len(self.runs) > self.fanout:
            self.compact()
        self._save()
        every = settled.filter("repeat").selectExpr("uid", "start", "cast(count as long) as size").unionByName(resolved)
        return every.filter(F.col("uid") >= -(EARLIER >> 1))

    def compact(self) -> None:
        """Merge all runs into one, with the earliest locator of each fingerprint."""
        every = reduce(DataFrame.unionByName, map(self._run, self.runs))
        first = every.groupBy("anchor", "whole", "tail").agg(F.min(F.struct("uid", "start")).alias("at"))
        merged = self._write(first.select(F.lit(False).alias("repeat"), "anchor", "whole", "tail", "at.uid", "at.start"))
        old, self.runs = self.runs, [merged]
        self._save()
        for run in old:
            self._forget(run)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(batch.column(1), batch.column(2).to_pylist()):
            words = (text.as_py() or "").encode().split()
            n, kept = len(words), words
            if found:
                start = np.array([f["start"] for f in found], np.int64)
                size = np.array([f["size"] for f in found], np.int64)
                _, begin, end = repeats.merged(np.zeros(len(found), np.int64), start, start + size)
                kept, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist()):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, digests = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def deduplicate(docs: DataFrame, text: str = "text", id_col: str = "doc_id", batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256; docs are added in ``batches`` by id."""
    own = repeats.identified(docs, text, id_col)
    kind = own.schema["doc_id"].dataType.simpleString()
    index = FingerprintIndex(docs.sparkSession, fanout=fanout)
    cuts = own.approxQuantile("uid", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    found = []
    for low, high in zip(edges, edges[1:]):
        below = own if high is None else own.filter(F.col("uid") < high)
        batch = below if low is None else below.filter(F.col("uid") >= low)
        part = index.add(batch, None if low is None else own.filter(F.col("uid") < low))
        found.append(staging.stage(part, "repeats") if high is not None else part)
    index.drop()  # what is left to compute hangs on staged tables only
    every = reduce(DataFrame.unionByName, found)
    return repeats.with_repeats(own, every).mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def report(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)
