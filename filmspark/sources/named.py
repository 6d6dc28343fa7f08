"""Small text files with names of their own, and files read in pieces: what Spark's file sources, which name their files themselves and read a file as one value, can't do."""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql import types as T


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark prints it (a plain one, or with a scheme; blanks and the like as they are), and the path in it."""
    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", uri)
    store, rest = re.match("([^:]+://[^/]*)/?(.*)", uri).groups()
    found, base = fs.FileSystem.from_uri(store + "/")
    return found, posixpath.join(base, rest)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _NamedTextWriter(DataSourceWriter):
    def __init__(self, root: str, names: list[str]) -> None:
        self.root, self.names = root, names

    def write(self, iterator: Iterator[Row]) -> _Written:
        """Each file is written beside its place under a name that no other attempt has, and then moved there: readers see the old file or the whole new one, and a task that runs again writes the same."""
        store, root = located(self.root)
        made: set[str] = set()
        n = 0
        for row in iterator:
            name, text = row[self.names.index("path")], row[self.names.index("text")]
            if name is None or text is None:
                continue
            path = posixpath.normpath(posixpath.join(root, name))
            if not path.startswith(root.rstrip("/") + "/"):
                raise ValueError(f"{name} is not below {self.root}")
            folder, base = posixpath.split(path)
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            early = f"{folder}/.{base}.{uuid.uuid4().hex}.tmp"
            try:
                with store.open_output_stream(early) as out:
                    out.write(text.encode())
                store.move(early, path)
            except BaseException:
                if store.get_file_info(early).type == fs.FileType.File:
                    store.delete_file(early)
                raise
            n += 1
        return _Written(n)

    def commit(self, messages: list[_Written]) -> None:
        """Nothing is left to do: files are in their places."""

    def abort(self, messages: list[_Written]) -> None:
        """Files that were moved already stay; running the job again writes the same ones."""


class NamedText(DataSource):
    """Rows (path, text) as UTF-8 files at their paths below the folder that is saved to; a file that is there is replaced, others aren't touched."""

    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedTextWriter(self.options["path"], schema.fieldNames())


def write_named(files: DataFrame, root: str) -> None:
    """files: path (relative to `root`), text. Rows without either are no files. Of rows with one path, one of them wins; paths that leave `root` are an error."""
    files.sparkSession.dataSource.register(NamedText)
    files.select("path", "text").write.format("named_text").mode("append").save(root)


def indented(text: str) -> str:
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False) + "\n"


def file_sha256(uri: str, piece: int = 1 << 20) -> tuple[str, int]:
    """SHA-256 of a file, and its time in nanoseconds; `piece` bytes are in memory at once."""
    store, path = located(uri)
    digest = hashlib.sha256()
    with store.open_input_stream(path, buffer_size=0) as stream:
        while block := stream.read(piece):
            digest.update(block)
    return digest.hexdigest(), store.get_file_info(path).mtime_ns


def hashed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, mtime, mtime_ns, sha256 of each file. Spark lists the files and deals them to tasks, which read them in pieces, so a file's size isn't bound by memory or by what a row can hold. Empty files are passed over, as Spark's
    file sources do."""
    listed = spark.read.format("binaryFile").load(paths).selectExpr("path", "length as size", "modificationTime as mtime")
    # many small files are many small tasks: some of them go together, where there are far more than cores
    listed = listed.coalesce(64 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # a batch holds paths and digests, never contents
            done = [file_sha256(path) for path in pdf.path]
            yield pdf.assign(mtime_ns=[ns for _, ns in done], sha256=[digest for digest, _ in done])

    return listed.mapInPandas(run, "path string, size long, mtime timestamp, mtime_ns long, sha256 string")
