"""A sink that makes a file of each row, under the row's own name.

Tasks write into a folder beside the target, each attempt under its own name, and move what they have made to
its place when all of it is there; the job puts the whole folder in the target's place by one rename.  What was
broken off is never seen and leaves nothing.  Paths are any that Arrow's file systems know and all executors share.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import spread, staged, tasks_for

_TWICE = "several rows have one name: "


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a plain path is a local one."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def _parent(path: str) -> str:
    return path.rsplit("/", 1)[0]


def _remove(store: fs.FileSystem, path: str) -> None:
    for again in range(20, -1, -1):
        if store.get_file_info(path).type != fs.FileType.Directory:
            return
        try:
            return store.delete_dir(path)
        except OSError:  # a task that is being stopped has made a file meanwhile
            if not again:
                raise
            time.sleep(0.1)


@dataclass
class Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, beside: str):
        self.path, self.overwrite, self.beside = path.rstrip("/"), overwrite, beside

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, root = opened(self.beside)
        own = f"{root}/_attempts/{context.partitionId()}-{context.taskAttemptId()}"
        store.create_dir(own, recursive=False)
        names, made = {}, {root}  # while they are made files have numbers, so an attempt has no folders of its own

        def make(folder: str) -> None:
            """Step by step below what is there: a task that outlives its job mustn't bring the job's folder back."""
            if folder not in made:
                make(_parent(folder))
                store.create_dir(folder, recursive=False)
                made.add(folder)

        for batch in iterator:
            for name, value in zip(batch.column("name"), batch.column("content"), strict=True):
                name = name.as_py()
                if not name or name.startswith(("/", "_", ".")) or any(part in ("", ".", "..") for part in name.split("/")):
                    raise ValueError(f"no name for a file: {name!r}")
                if name in names:
                    raise ValueError(f"{_TWICE}{name!r}")
                names[name] = f"{own}/{len(names)}"
                with store.open_output_stream(names[name], compression=None) as out:
                    if value.is_valid:
                        out.write(value.as_buffer())
        for name, there in names.items():
            make(_parent(f"{root}/{name}"))
            store.move(there, f"{root}/{name}")
        return Written(len(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.beside)
        target = opened(self.path)[1]
        store.create_dir(root, recursive=True)
        _remove(store, f"{root}/_attempts")
        with store.open_output_stream(f"{root}/_SUCCESS", compression=None) as out:
            out.write(b"")
        old = None
        if store.get_file_info(target).type != fs.FileType.NotFound:
            if not self.overwrite:
                _remove(store, root)
                raise ValueError(f"{self.path} is there already")
            old = f"{root}-old"
            store.move(target, old)
        store.move(root, target)
        if old:
            _remove(store, old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = opened(self.beside)
        _remove(store, root)


class NamedFiles(DataSource):
    """Format ``named_files``: rows of name (with its folders) and content; option ``beside`` is the folder, with _attempts in it, that tasks write to."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, self.options["beside"])


def write_files(rows: DataFrame, path: str, name: str = "file_name", content: str = "text", folder: str | None = None) -> None:
    """A file of each row of ``rows`` in ``path``, which is replaced: ``content`` (a string in UTF-8, or bytes; null is empty) under ``name``, with ``folder`` below the folder of that value.

    Two rows of one name, or a name that is null, empty, hidden or leads out of ``path``, are an error and nothing is written.
    """
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    whole = F.concat_ws("/", F.col(folder).cast("string"), F.col(name)) if folder else F.col(name)
    files = rows.select(F.when(F.col(name).isNotNull(), whole).alias("name"), F.col(content).cast("binary").alias("content"))
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    store, root = opened(beside)
    store.create_dir(f"{root}/_attempts", recursive=True)
    try:
        spread(files, "name").write.format("named_files").option("beside", beside).mode("overwrite").save(path)  # rows of one name meet in one task
    except Exception as error:
        _remove(store, root)
        if _TWICE in str(error):
            raise ValueError(str(error)) from error
        raise


def _hidden(name: str) -> bool:
    """What Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """name, whether it is a folder, and bytes of what lies in ``folder``; a local one isn't held whole."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for x in found:
                if not _hidden(x.name):
                    yield x.name, x.is_dir(), 0 if x.is_dir() else x.stat().st_size
        return
    for x in store.get_file_info(fs.FileSelector(folder)):
        if not _hidden(x.base_name):
            yield x.base_name, x.type == fs.FileType.Directory, max(x.size or 0, 0)


_LISTED = "name string, folder boolean, bytes bigint"


def _listed(folders: DataFrame, path: str) -> DataFrame:
    """What lies in ``folders`` (name, below ``path``), a folder read by one task."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path.rstrip("/"))
        for batch in batches:
            for above in batch.column("name").to_pylist():
                found = _entries(store, f"{root}/{above}" if above else root)
                while rows := list(islice(found, 10_000)):
                    names = [f"{above}/{n}" if above else n for n, _, _ in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f for _, f, _ in rows]), pa.array([b for _, _, b in rows], pa.int64())], names=["name", "folder", "bytes"])

    return staged(folders.select("name").mapInArrow(walk, _LISTED), "listed")


#: Files and bytes that a task reads, about, where there are more than several tasks a core would get.
FILES_A_TASK, BYTES_A_TASK = 50_000, 1 << 28
#: Bytes of files that are handed on at once, and files.
_AT_ONCE, _FILES_AT_ONCE = 1 << 24, 2000


def small_files(spark: SparkSession, path: str, deep: bool = False, unpacked: bool = False) -> DataFrame:
    """name (below ``path``) and content of the files in the folder ``path``, with ``deep`` in all folders below it too.

    Spark's own file sources count each file as 4 MB, list the folder on the driver and so make a task of every 32 small files;
    here a task lists a folder and the files are dealt out evenly.  Empty and hidden files are passed over, as Spark does.  A path that is no folder, or of a
    store that Arrow doesn't know, goes to Spark's source.  With ``unpacked`` what ends in .gz or the like is decompressed.
    Spark takes the contents to be about as large as the listed names, so without the hint a join would broadcast them through the driver;
    a hint to broadcast the join's other side comes before it.
    """
    try:
        store, root = opened(path.rstrip("/"))
        known = store.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        known = False
    if not known:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(path).where("length > 0")
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    levels = [_listed(spark.createDataFrame([("",)], "name string"), path)]
    while deep and not (below := levels[-1].where("folder")).isEmpty():
        levels.append(_listed(spread(below, "name"), path))
    files = reduce(DataFrame.unionByName, levels).where("not folder and bytes > 0")
    n, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(min(n, tasks_for(spark)), n // FILES_A_TASK, size // BYTES_A_TASK, 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path.rstrip("/"))

        def made(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], names=["name", "content"])

        names, contents, held = [], [], 0
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression="detect" if unpacked else None) as file:
                    contents.append(file.read())
                names.append(name)
                held += len(contents[-1])
                if held > _AT_ONCE or len(names) >= _FILES_AT_ONCE:
                    yield made(names, contents)
                    names, contents, held = [], [], 0
        if names:
            yield made(names, contents)

    return files.select("name").repartition(tasks, "name").mapInArrow(read, "name string, content binary").hint("merge")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """name (with its folders) and text of the files that write_files has made in ``path``; empty ones are passed over."""
    return small_files(spark, path, deep=True).select("name", F.decode("content", "UTF-8").alias("text"))
