"""Files of the shared folders, opened from tasks and the driver alike by their URI."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyarrow import fs

#: Hadoop's names of stores that Arrow knows under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI; a plain path is a local or mounted folder."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path) if scheme else uri
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + uri[len(scheme) :])


def exists(uri: str) -> bool:
    store, path = opened(uri)
    return store.get_file_info(path).type != fs.FileType.NotFound


def size(uri: str) -> int | None:
    """Bytes of a file; None if there is none."""
    store, path = opened(uri)
    found = store.get_file_info(path)
    return found.size if found.type == fs.FileType.File else None


def move(source: str, target: str) -> None:
    store, path = opened(source)
    store.move(path, opened(target)[1])


def make(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def drop(uri: str) -> None:
    """Remove a folder and what it holds, or a file; nothing if there is none."""
    store, path = opened(uri)
    kind = store.get_file_info(path).type
    if kind == fs.FileType.Directory:
        store.delete_dir(path)
    elif kind == fs.FileType.File:
        store.delete_file(path)


def write(uri: str, content: bytes) -> None:
    """A small file, whole or not at all: written beside its place and moved there."""
    store, path = opened(uri)
    with store.open_output_stream(f"{path}.new", compression=None) as out:
        out.write(content)
    store.move(f"{path}.new", path)


def read(uri: str) -> bytes:
    store, path = opened(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
