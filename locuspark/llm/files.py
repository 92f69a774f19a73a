"""Files in the shared folder, written by tasks and read by others.

Spark has no sink for binary records, so tasks write them through pyarrow's
file systems: the shared folder's URI decides which.  A file is written under
a temporary name and moved into place, and its name and content follow from
the task's input alone, so a task that runs again replaces it with itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


@contextmanager
def writing(uri: str) -> Iterator[pa.NativeFile]:
    """A stream that becomes ``uri`` when it ends well."""
    where, path = _open(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    unfinished = f"{path}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(unfinished, compression=None) as out:
        yield out
    where.move(unfinished, path)


@contextmanager
def reading(uri: str) -> Iterator[pa.NativeFile]:
    where, path = _open(uri)
    with where.open_input_stream(path, compression=None) as stream:
        yield stream


@contextmanager
def seeking(uri: str) -> Iterator[pa.NativeFile]:
    where, path = _open(uri)
    with where.open_input_file(path) as stream:
        yield stream


def size_of(uri: str) -> int | None:
    """Bytes of a file, or None where there is none."""
    where, path = _open(uri)
    info = where.get_file_info(path)
    return info.size if info.type == pafs.FileType.File else None


def write_block(uri: str, block: pa.Table) -> None:
    with writing(uri) as out, pa.ipc.new_file(out, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_table(block)


def read_block(uri: str) -> pa.Table:
    with seeking(uri) as stream:
        return pa.ipc.open_file(stream).read_all()
