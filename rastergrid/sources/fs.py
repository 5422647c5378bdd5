"""Byte access to files from tasks, on any filesystem the path names."""

from __future__ import annotations

import os
import posixpath
import uuid

from pyarrow import fs


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and bare path of a URI; paths without a scheme are local or mounted."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def list_sized(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or of the file itself, in name order."""
    path = path.rstrip("/")
    system, bare = open_fs(path)
    info = system.get_file_info(bare)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(bare, recursive=True))
    else:
        raise FileNotFoundError(path)
    head = path[:len(path) - len(bare)] if "://" in path and path.endswith(bare) else ""
    files = [(head + f.path, f.size) for f in found
             if f.type == fs.FileType.File and f.path.endswith(suffixes)]
    return sorted(files, key=lambda f: (posixpath.basename(f[0]), f[0]))


class RangeReader:
    """Random reads of one file."""

    def __init__(self, path: str):
        system, bare = open_fs(path)
        self.file = system.open_input_file(bare)

    def read(self, offset: int, length: int) -> bytes:
        return self.file.read_at(length, offset)

    def close(self):
        self.file.close()

    def __enter__(self):
        return self

    def __exit__(self, *exc):
        self.close()


class BytesReader:
    """The same interface over bytes already in memory."""

    def __init__(self, content: bytes):
        self.content = content

    def read(self, offset: int, length: int) -> bytes:
        return self.content[offset:offset + length]

    def close(self):
        pass


def write_atomic(path: str, content: bytes) -> None:
    """Write under a temporary name, then rename, so a retried task never leaves half a file."""
    system, bare = open_fs(path)
    folder, name = posixpath.split(bare)
    system.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f"_{uuid.uuid4().hex}.{name}.part")
    with system.open_output_stream(draft) as out:
        out.write(content)
    system.move(draft, bare)


def write_at(path: str, pieces: list[tuple[int, bytes]], size: int | None = None) -> None:
    """Write pieces at their places in one file, which other tasks may write at the same time.

    With ``size`` the file is made, or keeps its content, at that length. Writing the same again changes
    nothing, so a retried task is harmless. Only for local and mounted folders: others raise, since
    object stores and HDFS take no writes in the middle of a file.
    """
    system, bare = open_fs(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: one file of many tasks needs a mounted folder; write one file for each block instead")
    if size is not None:
        os.makedirs(posixpath.dirname(bare), exist_ok=True)
    handle = os.open(bare, os.O_RDWR | (os.O_CREAT if size is not None else 0), 0o644)
    try:
        if size is not None:
            os.ftruncate(handle, size)
        for at, content in pieces:
            view = memoryview(content)
            while view:
                written = os.pwrite(handle, view, at)
                view, at = view[written:], at + written
    finally:
        os.close(handle)
