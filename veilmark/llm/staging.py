"""Tables written to the folder that all executors share, to cut lineage or to read a costly result twice.

Staged tables are Parquet below ``spark.checkpoint.dir``; a lost executor costs only the tasks it held.  Where
the setting is absent a folder below the session's temp directory is chosen and set, if the session runs in one process
(local tests); a cluster without the setting is refused, since each executor would write to its own disk.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

Folders = list[tuple[SparkSession, str]]
_lock = Lock()
_lists: list[Folders] = [[]]
_owner: ContextVar[Folders] = ContextVar("folders", default=_lists[0])


def root(spark: SparkSession) -> str:
    """The shared folder; set here only where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilmark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes with ``release``, at the latest when the driver ends."""
    path = f"{root(spark)}/veilmark-{uuid.uuid4().hex}/{label}"
    _owner.get().append((spark, path))
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned(folders: Folders) -> Iterator[Folders]:
    """Folders made in this context (of this thread) are noted here, so that others' work can't release them."""
    with _lock:
        _lists.append(folders)
    before = _owner.set(folders)
    try:
        yield folders
    finally:
        _owner.reset(before)


def release(folders: Folders) -> None:
    """Delete these folders; only once what was derived from them has been written."""
    while folders:
        spark, path = folders.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def _at_exit() -> None:
    for folders in _lists:
        release(folders)


atexit.register(_at_exit)


@contextmanager
def batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in what is executed meanwhile; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(columns: list[str], *names: str) -> list[str]:
    """These names, or longer ones, such that a table of these columns has none of them (in either case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tasks(spark: SparkSession) -> int:
    """The number of partitions that explicit repartitions use: what the session sets for its shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
