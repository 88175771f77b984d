"""Folders of small files as a Python data source: every file is a row, in both directions.

Spark's own file sources list no files of zero bytes and cannot write one file per row. This source

* lists all files below ``path`` with a given ``suffix``, empty, unreadable and undecodable ones included, packs
  them into partitions of bounded bytes, and reads them as text mode does (newlines become ``\\n``);
* writes the rows of a task into a folder of its own below a hidden job folder. Committing moves one
  folder for each task, so a task that ran twice or failed leaves nothing behind, nor does a failed job.

Paths are local or of a file system that Arrow knows (``file:``, ``hdfs:``, ``s3:``); tasks open them
themselves, so a cluster needs them mounted or reachable on every executor.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "file_tree"
COLUMNS = "path string, status string, bytes long, text string"
PARTITION_BYTES = 64 << 20
PARTITION_FILES = 10_000
_BATCH_BYTES = 8 << 20
_JOB = "_job-"


def opened(path: str) -> tuple[pfs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        return pfs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        return pfs.FileSystem.from_uri(path)
    return pfs.LocalFileSystem(), posixpath.abspath(path)


def as_text(raw: bytes) -> tuple[str, str | None]:
    """Status and text of a file's bytes; the text of one that is no UTF-8 is null."""
    if not raw:
        return "empty", ""
    try:
        return "ok", raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        return "not_text", None


@dataclass
class Files(InputPartition):
    """Some of the files: paths and sizes."""

    files: Sequence[tuple[str, int]]

    def __init__(self, files: Sequence[tuple[str, int]]):
        super().__init__(None)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, most: int):
        self.root, self.suffix, self.most = root, suffix, most

    def partitions(self) -> Sequence[Files]:
        system, root = opened(self.root)
        found = system.get_file_info(pfs.FileSelector(root, recursive=True, allow_not_found=False))
        files = sorted((f.path, f.size or 0) for f in found if f.type == pfs.FileType.File and f.path.endswith(self.suffix))
        out, held, size = [], [], 0
        for path, n in files:
            inside = path[len(root) :].split("/")
            if any(part.startswith(_JOB) for part in inside):
                continue  # of a job that has not ended
            if held and (size + n > self.most or len(held) >= PARTITION_FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append((path, n))
            size += n
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.root)
        rows, size = [], 0
        for path, n in partition.files:
            try:
                with system.open_input_stream(path) as stream:
                    raw = stream.read()
                status, text = as_text(raw)
                n = len(raw)
            except OSError:
                status, text = "unreadable", None
            rows.append((path, status, n, text))
            size += n
            if size >= _BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "status", "bytes", "text"])


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Rows of ``path`` (inside the tree) and ``text`` or ``content`` (bytes); a null is an empty file."""

    def __init__(self, root: str, columns: Sequence[str], overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex
        self.body = next((c for c in ("content", "text") if c in columns), None)
        if "path" not in columns or self.body is None:
            raise ValueError("a file tree is written from the columns path and text, or path and content")

    def _staging(self, root: str) -> str:
        return f"{root}/{_JOB}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.root)
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, uuid.uuid4().hex)
        folder, seen, made = f"{self._staging(root)}/{part}-{attempt}", set(), set()
        for batch in iterator:
            for name, body in zip(batch.column("path").to_pylist(), batch.column(self.body), strict=True):
                inside = self._inside(name)
                if inside in seen:
                    raise ValueError(f"two rows for the file {name}")
                seen.add(inside)
                place = posixpath.dirname(f"{folder}/{inside}")
                if place not in made:
                    system.create_dir(place, recursive=True)
                    made.add(place)
                value = body.as_py()
                raw = b"" if value is None else value.encode() if isinstance(value, str) else value
                with system.open_output_stream(f"{folder}/{inside}") as stream:
                    stream.write(raw)
        return Written(f"{part}-{attempt}" if seen else "", len(seen))

    @staticmethod
    def _inside(name: str | None) -> str:
        parts = [p for p in (name or "").split("/") if p not in ("", ".")]
        if not parts or ".." in parts:
            raise ValueError(f"not a file inside the tree: {name}")
        return "/".join(parts)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        staging = self._staging(root)
        system.create_dir(root, recursive=True)
        old = [] if not self.overwrite else [f for f in system.get_file_info(pfs.FileSelector(root)) if not f.base_name.startswith(_JOB)]
        for info in old:
            system.delete_dir(info.path) if info.type == pfs.FileType.Directory else system.delete_file(info.path)
        for message in messages:  # one move a task
            if message is not None and message.files:
                system.move(f"{staging}/{message.folder}", f"{root}/part-{self.job[:8]}-{message.folder}")
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._clean(system, staging)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.root)
        self._clean(system, self._staging(root))

    @staticmethod
    def _clean(system: pfs.FileSystem, staging: str) -> None:
        if system.get_file_info(staging).type == pfs.FileType.Directory:
            system.delete_dir(staging)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("suffix", ""), int(self.options.get("partitionbytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], schema.names, overwrite)


def read_tree(spark: SparkSession, root: str, suffix: str = ".py", partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``path, status, bytes, text`` of all files below ``root`` whose names end with ``suffix``.

    ``status`` is ``ok``, ``empty`` (empty text), ``not_text`` (no UTF-8, null text) or ``unreadable`` (null text).
    """
    spark.dataSource.register(FileTree)
    return spark.read.format(FORMAT).option("suffix", suffix).option("partitionBytes", partition_bytes).load(root)


def write_tree(files: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One file for each row of ``files`` (``path`` and ``text`` or ``content``) below ``root``, in a folder for each task.

    A name that a task is given twice, or that leads out of the tree, fails the job and leaves the tree as it was.
    """
    files.sparkSession.dataSource.register(FileTree)
    files.write.format(FORMAT).mode(mode).option("path", root).save()
