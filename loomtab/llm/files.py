"""Raw files in the shared folder, from tasks: created under unique names, read by range.

Spark has no writer for raw bytes, so tasks use Arrow's file systems on the folder's URI
(``file:``, ``hdfs:``, ``s3:`` and others); nothing goes to a folder of one machine.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


def create(folder: str, stem: str):
    """A new file that no other attempt writes to: its URI and an output stream."""
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_at(uri: str, at: int, size: int) -> bytes:
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        return f.read_at(size, at)


def open_stream(uri: str):
    system, path = _at(uri)
    return system.open_input_stream(path, compression=None)


def remove(uri: str) -> None:
    """Drop a file that a later stage has replaced; it may be gone already."""
    system, path = _at(uri)
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass
