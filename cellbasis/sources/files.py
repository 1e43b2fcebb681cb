"""Whole files written by tasks into a folder that all executors reach."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder's URI, and the folder's path in it."""
    scheme, found, rest = folder.partition("://")
    if found and scheme in ("s3a", "s3n"):  # Hadoop's names of what Arrow calls s3
        folder = "s3://" + rest
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a file as Spark names it, and the file's path in it."""
    if path.startswith("file:"):  # Spark does not escape what a URI would
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return file_system(path)


def readable(path: str) -> bool:
    """Whether Arrow opens the file; there are folders that only Spark's readers reach."""
    try:
        fs, at = located(path)
        fs.open_input_file(at).close()
        return True
    except (pa.ArrowException, OSError, ImportError):
        return False


def opened(path: str, content: bytes | None = None) -> pa.NativeFile:
    """The file, or its content where Spark has read it, for reading by ranges."""
    if content is not None:
        return pa.BufferReader(content)
    fs, at = located(path)
    return fs.open_input_file(at)


def blocks(file: pa.NativeFile, size: int = 1 << 23) -> Iterator[bytes]:
    """What is left of a file, a block at a time."""
    return iter(lambda: file.read(size), b"")


def put(folder: str, name: str, content: bytes | Iterable[bytes]) -> None:
    """Write one file, given whole or in pieces, under a name that no reader takes for it, then rename: a lost attempt leaves no half
    file behind."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    half = f"{path}/{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(half, compression=None) as out:
        for piece in [content] if isinstance(content, bytes | bytearray) else content:
            out.write(piece)
    fs.move(half, f"{path}/{name}")


def write_files(contents: DataFrame, folder: str) -> DataFrame:
    """Write each row (name, content) as a file: (name, bytes), once the frame is run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for name, content in part.itertuples(index=False):
                put(folder, name, content)
            yield pd.DataFrame({"name": part["name"], "bytes": part["content"].map(len)})

    return contents.select("name", "content").mapInPandas(run, "name string, bytes long")
