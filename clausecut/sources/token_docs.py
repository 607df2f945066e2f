"""Token documents in binary files: doc, tokens and the places where sentences start, written and read as the format token_docs.

A file is an Arrow stream whose tokens are numbers into a table of strings, compressed. Writing has two phases. A task writes
one file of a name of its own into a staging folder and tells it to the driver. The driver's commit moves the files told to
it and then puts a manifest that lists all files of the table in place of the one before, by a rename; so a reader sees all
of a write or nothing. A failed or repeated task's file is in no manifest, and abort, like commit, drops the staging folder.

Paths are those of pyarrow.fs: a folder that driver and executors share, or an address that pyarrow can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "doc string, tokens array<string>, starts array<int>"
STORED = pa.schema([("doc", pa.string()), ("tokens", pa.list_(pa.dictionary(pa.int32(), pa.string()))), ("starts", pa.list_(pa.int32()))])
MANIFEST = "_manifest.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    found, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///", 1))
    return found, inner.rstrip("/")


def listed(store: fs.FileSystem, root: str) -> list[str]:
    """Files of the table, as its manifest has them."""
    if store.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class TokenDocs(DataSource):
    """Options: path. Mode append adds files, overwrite puts the new ones in place of all."""

    @classmethod
    def name(cls) -> str:
        return "token_docs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TokenDocsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TokenDocsWriter(self.options["path"], overwrite)


class TokenDocsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.staging = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = opened(self.path)
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        name, rows = f"docs-{uuid.uuid4().hex}.arrow", 0
        options = ipc.IpcWriteOptions(compression="zstd", emit_dictionary_deltas=False)
        with store.open_output_stream(f"{root}/{self.staging}/{name}") as f, ipc.new_stream(f, STORED, options=options) as out:
            for b in iterator:
                tokens = b.column("tokens")
                coded = pa.ListArray.from_arrays(tokens.offsets, tokens.values.cast(pa.string()).dictionary_encode(), mask=tokens.is_null() if tokens.null_count else None)
                out.write_batch(pa.RecordBatch.from_arrays([b.column("doc").cast(pa.string()), coded, b.column("starts").cast(pa.list_(pa.int32()))], schema=STORED))
                rows += b.num_rows
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        store.create_dir(root, recursive=True)
        before = listed(store, root)
        new = [m.name for m in messages if m is not None and m.rows]
        for name in new:
            store.move(f"{root}/{self.staging}/{name}", f"{root}/{name}")
        files = new if self.overwrite else [*before, *new]
        draft = f"{root}/_draft-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"files": files}).encode())
        store.move(draft, f"{root}/{MANIFEST}")
        for name in set(before) - set(files):
            store.delete_file(f"{root}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


class TokenFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class TokenDocsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[TokenFile]:
        return [TokenFile(n) for n in listed(*opened(self.path))] or [TokenFile("")]

    def read(self, partition: TokenFile) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        store, root = opened(self.path)
        with store.open_input_stream(f"{root}/{partition.name}") as f, ipc.open_stream(f) as batches:
            for b in batches:
                tokens = b.column("tokens")
                plain = pa.ListArray.from_arrays(tokens.offsets, tokens.values.dictionary_decode(), mask=tokens.is_null() if tokens.null_count else None)
                yield pa.RecordBatch.from_arrays([b.column("doc"), plain, b.column("starts")], names=["doc", "tokens", "starts"])


def write(docs: DataFrame, path: str, mode: str = "append", doc: str = "doc", tokens: str = "tokens", starts: str = "starts") -> None:
    """docs' columns of these names as token documents."""
    docs.sparkSession.dataSource.register(TokenDocs)
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.col(tokens).cast("array<string>").alias("tokens"), F.col(starts).cast("array<int>").alias("starts"))
    rows.write.format("token_docs").mode(mode).option("path", path).save()


def read(spark, path: str) -> DataFrame:
    spark.dataSource.register(TokenDocs)
    return spark.read.format("token_docs").option("path", path).load()
