"""Binary files written by tasks into the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder's URI (a bare path is the file system all executors share)."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri.removeprefix("file:")
    return pafs.LocalFileSystem(), uri


class WholeFile:
    """A file that appears under its name only when it is complete.

    A task that is tried again, or twice at once, writes its own temporary file and then puts it in
    place; as tasks are deterministic, whichever comes last leaves the same bytes.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.final = f"{root.rstrip('/')}/{name}"
        self.temporary = f"{root.rstrip('/')}/_{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(root, recursive=True)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.final)
