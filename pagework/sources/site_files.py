"""Saved sites as folders of files, one file for each row: the data source ``site_files``.

Written rows are ``(site, path, start, size, body)``. A row without ``start`` is a whole file. Rows with
``start`` are pieces of one file of ``size`` bytes, each written by whatever task has it at its own place, so
that a file may be larger than any task. A writing task puts its files into a staging folder and moves them to
their places one by one when all of them are there; a move replaces a file as a whole, and an attempt that runs
again moves the same files. Files made of pieces are moved after the job, when all pieces are there. Rows whose
path cannot be a file of their site are not written but listed with a reason.

Read rows are ``(site, path, length, content)``. The driver lists the upper folders only; the tasks list what
lies below them, and read bodies only if asked.

The folder must be seen by all executors. Pieces need a folder that is mounted (``file:``); whole files go to
any store that the tasks can open.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

FORMAT = "site_files"
WRITTEN = "site string, path string, start bigint, size bigint, body binary"
READ = "site string, path string, length bigint, content binary"
REJECTED = "site string, path string, reason string"
STAGING, REJECTS = "_staging", "_rejected"
#: Bytes of a name that common file systems take.
NAME_BYTES = 255
#: Folders that the driver lists until it has as many as this to deal to tasks, and how deep it goes at most.
PREFIXES, DEPTH = 256, 3
_BATCH_BYTES = 8 << 20


def why_refused(site: str | None, path: str | None) -> str | None:
    """Why a path cannot be a file inside its site, if it cannot."""
    if path is None or site is None:
        return "no site" if site is None else "no path"
    steps = [*(site.split("/") if site else []), *path.split("/")]
    if any(s in ("", ".", "..") for s in steps):
        return "not a path inside the site"
    if "\0" in site or "\0" in path:
        return "a name with a zero byte"
    if any(len(s.encode()) > NAME_BYTES for s in steps):
        return "a name that is too long"
    if steps[0] in (STAGING, REJECTS):
        return "a name that is used by the writer"
    return None


@dataclass
class Attempt(WriterCommitMessage):
    name: str
    files: int
    rejected: int


class SiteFilesWriter(DataSourceArrowWriter):
    def __init__(self, root: str, run: str):
        self.root, self.run = root, run

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        from pyarrow import fs

        store, base = self._open()
        name = uuid.uuid4().hex
        staged = f"{base}/{STAGING}/{self.run}/{name}"
        places: list[str] = []
        refused: list[tuple] = []
        for batch in iterator:
            for i in range(batch.num_rows):
                site, path, start, size, body = (batch.column(c)[i].as_py() for c in range(5))
                reason = why_refused(site, path) or ("no body" if body is None else None)
                if reason:
                    refused.append((site, path, reason))
                    continue
                place = f"{site}/{path}" if site else path
                if start is None:
                    if not places:
                        store.create_dir(staged, recursive=True)
                    with store.open_output_stream(f"{staged}/{len(places)}") as out:
                        out.write(body)
                    places.append(place)
                elif not isinstance(store, fs.LocalFileSystem):
                    raise ValueError("pieces of files need a mounted folder")
                else:
                    _write_piece(f"{base}/{STAGING}/{self.run}/pieces/{place}", start, size, body)
        moved = 0
        for i, place in enumerate(places):
            reason = _move(store, f"{staged}/{i}", f"{base}/{place}")
            moved += reason is None
            if reason:
                site, _, path = place.partition("/")
                refused.append((site, path, reason))
        if refused:
            _write_rejected(store, f"{base}/{REJECTS}/{self.run}", name, refused)
        return Attempt(name, moved, len(refused))

    def commit(self, messages: list[Attempt | None]) -> None:
        """Lists of refused rows that attempts without success have left go away."""
        store, base = self._open()
        good = {m.name for m in messages if m is not None}
        for left in _children(store, f"{base}/{REJECTS}/{self.run}"):
            if left.base_name.split(".")[0] not in good:
                store.delete_file(left.path)
        for left in _children(store, f"{base}/{STAGING}/{self.run}"):
            if left.base_name != "pieces":
                store.delete_dir(left.path)

    def abort(self, messages: list[Attempt | None]) -> None:
        store, base = self._open()
        for folder in (f"{base}/{STAGING}/{self.run}", f"{base}/{REJECTS}/{self.run}"):
            if _children(store, folder):
                store.delete_dir(folder)


def _children(store, folder: str) -> list:
    from pyarrow import fs

    return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))


def _write_piece(target: str, start: int, size: int, body: bytes) -> None:
    """Bytes at their place of a file of the given size. Writing a piece again changes nothing."""
    os.makedirs(os.path.dirname(target), exist_ok=True)
    file = os.open(target, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        os.ftruncate(file, size)
        view = memoryview(body)
        while view:
            done = os.pwrite(file, view, start)
            start, view = start + done, view[done:]
    finally:
        os.close(file)


def _move(store, source: str, target: str) -> str | None:
    """Put a file in its place, and say why that is not one, if a file and a folder would have one name."""
    from pyarrow import fs

    folder = target.rsplit("/", 1)[0]
    try:
        store.create_dir(folder, recursive=True)
        store.move(source, target)
    except OSError:
        # Other troubles concern the store and not this path: the task fails and runs again.
        kinds = {i.type for i in store.get_file_info([target, folder])}
        above = [folder]
        while "/" in above[-1].strip("/"):
            above.append(above[-1].rsplit("/", 1)[0])
        blocked = any(i.type == fs.FileType.File for i in store.get_file_info(above))
        if store.get_file_info(target).type == fs.FileType.Directory or blocked:
            return "a file and a folder of one name"
        if fs.FileType.File in kinds and store.get_file_info(source).type == fs.FileType.NotFound:
            return None  # another attempt has moved it
        raise
    return None


def _write_rejected(store, folder: str, name: str, rows: list[tuple]) -> None:
    import pyarrow.parquet as pq

    store.create_dir(folder, recursive=True)
    columns = [pa.array(c, pa.string()) for c in zip(*rows)]
    with store.open_output_stream(f"{folder}/{name}.parquet") as out:
        pq.write_table(pa.table(columns, names=["site", "path", "reason"]), out)


@dataclass
class Prefixes(InputPartition):
    paths: list[tuple[str, bool]]  # and whether it is a folder


class SiteFilesReader(DataSourceReader):
    def __init__(self, root: str, content: bool, suffixes: tuple[str, ...]):
        self.root, self.content, self.suffixes = root, content, suffixes

    def partitions(self) -> list[Prefixes]:
        """The upper folders, dealt out. What grows with the site stays unlisted here."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        level, files = [base], []
        for depth in range(DEPTH):
            inner = []
            for folder in level:
                for child in _children(store, folder):
                    if depth == 0 and child.base_name in (STAGING, REJECTS):
                        continue
                    (inner if child.type == fs.FileType.Directory else files).append(child.path)
            level = inner
            if len(level) >= PREFIXES:
                break
        found = [(p, True) for p in sorted(level)] + [(p, False) for p in sorted(files)]
        return [Prefixes(found[i::PREFIXES]) for i in range(min(PREFIXES, len(found)))] or [Prefixes([])]

    def read(self, partition: Prefixes) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        rows, held = [], 0
        folders = [p for p, is_folder in partition.paths if is_folder]
        files = iter([p for p, is_folder in partition.paths if not is_folder])
        while True:
            for info in store.get_file_info(list(files)):
                if self.suffixes and not info.path.endswith(self.suffixes):
                    continue
                body = None
                if self.content:
                    with store.open_input_stream(info.path) as file:
                        body = file.read()
                inside = info.path[len(base) :].lstrip("/")
                site, _, path = inside.partition("/") if "/" in inside else ("", "", inside)
                rows.append((site, path, info.size, body))
                held += len(body or b"") + 100
                if held >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if not folders:
                break
            children = _children(store, folders.pop())
            folders += [c.path for c in children if c.type == fs.FileType.Directory]
            files = iter([c.path for c in children if c.type == fs.FileType.File])
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["site", "path", "length", "content"])


class SiteFiles(DataSource):
    """Options: ``path``; for reading ``content`` (default true) and ``suffixes``, separated by commas; for
    writing ``run``, a name for the staged files of the job."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> SiteFilesReader:
        suffixes = tuple(s for s in self.options.get("suffixes", "").split(",") if s)
        return SiteFilesReader(self.options["path"], self.options.get("content", "true") == "true", suffixes)

    def writer(self, schema, overwrite: bool) -> SiteFilesWriter:
        return SiteFilesWriter(self.options["path"], self.options.get("run") or uuid.uuid4().hex)


def _as_uri(root: str) -> str:
    if "://" in root:
        return root
    return f"file://{os.path.abspath(root.removeprefix('file:'))}"


def save_files(rows: DataFrame, root: str) -> DataFrame:
    """Write ``(site, path, body)`` or ``(site, path, start, size, body)`` below ``root`` and return the refused
    rows as ``(site, path, reason)``. All rows of a path are pieces of one file, or the path has one row. A null
    site, path or body is refused. Nothing that an earlier run has left is removed; a path that comes again is
    replaced."""
    spark, run, root = rows.sparkSession, uuid.uuid4().hex, _as_uri(root)
    spark.dataSource.register(SiteFiles)
    whole = "start" not in rows.columns
    if whole:
        rows = rows.withColumns({"start": F.lit(None).cast("long"), "size": F.lit(None).cast("long")})
    rows = rows.select("site", "path", "start", "size", F.col("body").cast("binary").alias("body"))
    rows.write.format(FORMAT).option("path", root).option("run", run).mode("append").save()
    if not whole:
        _place_pieces(rows.filter("start is not null").select("site", "path").distinct(), root, run)
    return _rejected(spark, root, run)


def _place_pieces(files: DataFrame, root: str, run: str) -> None:
    """Move the files that pieces have made."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            refused = []
            for site, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if why_refused(site, path):
                    continue  # was listed when it was not written
                place = f"{site}/{path}" if site else path
                reason = _move(store, f"{base}/{STAGING}/{run}/pieces/{place}", f"{base}/{place}")
                if reason:
                    refused.append((site, path, reason))
            if refused:
                _write_rejected(store, f"{base}/{REJECTS}/{run}", f"pieces-{uuid.uuid4().hex}", refused)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    files.mapInArrow(move, "n long").agg(F.sum("n")).collect()


def _rejected(spark: SparkSession, root: str, run: str) -> DataFrame:
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    if not _children(store, f"{base}/{REJECTS}/{run}"):
        return spark.createDataFrame([], REJECTED)
    return spark.read.schema(REJECTED).parquet(f"{root.rstrip('/')}/{REJECTS}/{run}").distinct()


def read_files(spark: SparkSession, root: str, content: bool = True, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """``(site, path, length, content)`` of all files below ``root``; the first folder is the site. ``content``
    is null if bodies are not asked for."""
    spark.dataSource.register(SiteFiles)
    reader = spark.read.format(FORMAT).option("path", _as_uri(root)).option("suffixes", ",".join(suffixes))
    return reader.option("content", str(content).lower()).load()
