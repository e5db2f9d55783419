"""Files by path or URI, opened where the code runs: on a mount, or in a store that pyarrow knows (hdfs, s3, gs)."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    local = re.sub(r"^file:/+", "/", path)
    if "://" in local:
        return pafs.FileSystem.from_uri(local)
    return pafs.LocalFileSystem(), local.rstrip("/") or "/"


def kind(path: str) -> str | None:
    """``file``, ``folder``, or None if there is nothing."""
    fs, p = place(path)
    return {pafs.FileType.File: "file", pafs.FileType.Directory: "folder"}.get(fs.get_file_info(p).type)


def size(path: str) -> int:
    fs, p = place(path)
    return fs.get_file_info(p).size


def read(path: str) -> bytes:
    fs, p = place(path)
    with fs.open_input_stream(p) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    fs, p = place(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def move(path: str, to: str) -> None:
    fs, p = place(path)
    fs.move(p, place(to)[1])


def delete(path: str) -> None:
    """Delete a file or a folder with all that is in it, if it is there."""
    fs, p = place(path)
    what = fs.get_file_info(p).type
    if what == pafs.FileType.Directory:
        fs.delete_dir(p)
    elif what == pafs.FileType.File:
        fs.delete_file(p)
