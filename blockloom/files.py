"""Byte streams of files that Python code reads or writes itself, on any file system that pyarrow knows."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyarrow import fs


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and the path on it; paths without a scheme and ``file:`` ones are local."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def list_files(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """``(path, size)`` of a file, or of the files below a folder by name; hidden and unfinished ones are left out."""
    store, name = resolve(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    base = path.rstrip("/")
    found = []
    for x in store.get_file_info(fs.FileSelector(name, recursive=True)):
        if x.type == fs.FileType.File and x.base_name[0] not in "._" and (not suffixes or x.base_name.endswith(suffixes)):
            found.append((f"{base}/{os.path.relpath(x.path, name)}", x.size))
    return sorted(found)


def open_read(path: str):
    store, name = resolve(path)
    return store.open_input_file(name)


def open_write(path: str):
    store, name = resolve(path)
    store.create_dir(os.path.dirname(name), recursive=True)
    return store.open_output_stream(name, compression=None)


def move(path: str, to: str) -> None:
    store, name = resolve(path)
    store.move(name, resolve(to)[1])


def remove(path: str) -> None:
    store, name = resolve(path)
    if store.get_file_info(name).type == fs.FileType.File:
        store.delete_file(name)
