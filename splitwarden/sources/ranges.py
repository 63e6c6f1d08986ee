"""Parts of files, read in tasks: first bytes, and single members of archives by the archive's directory.

Spark lists the files (its binaryFile source opens none of them without the content column); tasks open them by their
address and seek, so that no file is a row and none is read whole for a part of it.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

#: Schemes that tasks can open by themselves; addresses of others go through Spark's source, whole.
SCHEMES = ("", "file", "s3", "s3a", "s3n", "gs", "hdfs")
#: Bytes that a reading task hands on at once, or one longer member.
BATCH = 8 << 20


def reachable(root: str) -> bool:
    return root.partition("://")[0].partition(":")[0] in SCHEMES if ":" in root else True


def opened(path: str) -> BinaryIO:
    """The file at an address, for reading and seeking."""
    scheme, _, rest = path.partition(":")
    if not rest:
        return fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, at = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")
    return system.open_input_file(at)


def first_bytes(listed: DataFrame, n: int, open_: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """path, start: the first n bytes of each file, fewer if it has fewer, null if it cannot be read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, starts = batch.column(0), []
            for path in paths.to_pylist():
                try:
                    with open_(path) as f:
                        starts.append(bytes(f.read(n)))
                except OSError:
                    starts.append(None)
            yield pa.RecordBatch.from_arrays([paths, pa.array(starts, pa.binary())], names=["path", "start"])

    return listed.select("path").mapInArrow(read, "path string, start binary")


def parts_of(path: str, wanted: tuple[str, ...], open_: Callable[[str], BinaryIO]) -> Iterator[tuple]:
    """(archive, member, content) of one file: an archive's members, or the file itself."""
    with open_(path) as f:
        if not path.lower().endswith(".zip"):
            yield None, path, bytes(f.read())
            return
        with zipfile.ZipFile(f) as archive:
            for name in archive.namelist():
                if name.lower().endswith(wanted):
                    yield path, name, archive.read(name)


def members(listed: DataFrame, wanted: tuple[str, ...], open_: Callable[[str], BinaryIO] = opened) -> DataFrame:
    """archive, member, content of the listed files whose names, or whose members' names, end as wanted.

    A task holds an archive's directory and some members at a time.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple]) -> pa.RecordBatch:
            archive, member, content = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(archive, pa.string()), pa.array(member, pa.string()), pa.array(content, pa.binary())], names=["archive", "member", "content"])

        held, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path.lower().endswith((*wanted, ".zip")):
                    for row in parts_of(path, wanted, open_):
                        held.append(row)
                        size += len(row[2])
                        if size >= BATCH:
                            yield told(held)
                            held, size = [], 0
        if held:
            yield told(held)

    return listed.select("path").mapInArrow(read, "archive string, member string, content binary")
