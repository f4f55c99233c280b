"""One file a document: a data source that executors write to, with a commit at the end.

``write`` takes rows of a name and a body and makes of each a file of that name below a folder.  A task writes below a folder
of its own job that no reader looks at, then moves each file to its place, which replaces what was there at once; so a reader
finds a file whole or not at all, a task that runs twice leaves the same files, and a job that runs again over the same folder
replaces its files.  When all tasks are done the driver removes the job's folder and writes ``_SUCCESS`` with how many files and
bytes there are; without it a folder is not finished.  The driver learns two numbers a task, no names.

Folders are those that Arrow's file systems reach: local and mounted ones, and addresses of object stores and HDFS.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SOURCE = "veilmark-files"
DONE = "_SUCCESS"
WAITING = "_temporary"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if "://" not in folder:
        if folder.startswith("file:"):
            folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FilesWriter(DataSourceArrowWriter):
    """Rows of (name, body) to files of these names."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.job = uuid.uuid4().hex
        where, path = file_system(self.folder)
        where.create_dir(path, recursive=True)
        if where.get_file_info(f"{path}/{DONE}").type != fs.FileType.NotFound:
            where.delete_file(f"{path}/{DONE}")  # not finished from here on

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = file_system(self.folder)
        waiting = f"{path}/{WAITING}/{self.job}/{uuid.uuid4().hex}"
        where.create_dir(waiting, recursive=True)
        files, size, made = 0, 0, {path}
        for batch in iterator:
            names, bodies = batch.column("name").to_pylist(), batch.column("body").to_pylist()
            for name, body in zip(names, bodies):
                data = body.encode() if isinstance(body, str) else body or b""
                with where.open_output_stream(f"{waiting}/now") as out:
                    out.write(data)
                parent = f"{path}/{name}".rpartition("/")[0]
                if parent not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                    if len(made) > 100_000:
                        made = {path}
                where.move(f"{waiting}/now", f"{path}/{name}")
                files, size = files + 1, size + len(data)
        return Written(files, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()
        where, path = file_system(self.folder)
        told = [m for m in messages if isinstance(m, Written)]
        with where.open_output_stream(f"{path}/{DONE}") as out:
            out.write((json.dumps({"files": sum(m.files for m in told), "bytes": sum(m.size for m in told)}) + "\n").encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        where, path = file_system(self.folder)
        own = f"{path}/{WAITING}/{self.job}"
        if where.get_file_info(own).type != fs.FileType.NotFound:
            where.delete_dir(own)
        if not where.get_file_info(fs.FileSelector(f"{path}/{WAITING}", allow_not_found=True)) and where.get_file_info(f"{path}/{WAITING}").type != fs.FileType.NotFound:
            where.delete_dir(f"{path}/{WAITING}")


class Files(DataSource):
    """The data source by the name ``SOURCE``: option ``path`` names the folder."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def writer(self, schema: object, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def name_of(source: Column, base: str | None = None, ending: str = "") -> Column:
    """The name of a document's file: its path below the folder ``base``; elsewhere its own name and a digest of the path.

    What could lead out of a folder or is none (``..``, ``.``, nothing) becomes ``_``; so do control characters.
    """
    other = F.concat(F.regexp_extract(source, r"([^/]*)$", 1), F.lit("-"), F.substring(F.sha2(source, 256), 1, 16))
    inside = other
    if base is not None:
        start = base.rstrip("/") + "/"
        inside = F.when(F.startswith(source, F.lit(start)), F.substring(source, len(start) + 1, 1 << 30)).otherwise(other)
    plain = F.transform(F.split(F.regexp_replace(inside, r"[\x00-\x1f\x7f\\]", "_"), "/"), lambda p: F.when(p.isin("", ".", ".."), "_").otherwise(p))
    return F.concat(F.array_join(plain, "/"), F.lit(ending))


def write(rows: DataFrame, folder: str) -> None:
    """rows (name, body: text or bytes) as files below folder; of rows of one name the last one written stays."""
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", "body").write.format(SOURCE).mode("append").save(folder)
