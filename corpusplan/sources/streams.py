"""Byte streams on any file system Arrow knows, for use inside tasks."""

import posixpath
import re
import uuid
from contextlib import contextmanager

from pyarrow import fs

_PIECE = 4 << 20


_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_ALIASES = {"s3a": "s3", "s3n": "s3"}
_systems: dict[str, tuple] = {}


def locate(path: str):
    """(file system, path on it) of a path or URI as Spark prints it: nothing in it is escaped.

    One client per scheme and authority is kept for the task. An address Arrow has no file
    system for raises.
    """
    scheme = _SCHEME.match(path)
    if not scheme:
        return fs.LocalFileSystem(), path
    if scheme[1] == "file":
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    rest = path[scheme.end():]
    if not rest.startswith("//"):
        raise ValueError(f"no file system for {path}")
    authority, _, name = rest[2:].partition("/")
    base = f"{_ALIASES.get(scheme[1], scheme[1])}://{authority}"
    if base not in _systems:
        _systems[base] = fs.FileSystem.from_uri(f"{base}/" if not base.startswith("s3:") else base)
    system, root = _systems[base]
    return system, f"{root.rstrip('/')}/{name}"


def info_of(path: str) -> tuple[int, int] | None:
    """(size, modification time in seconds) of a file, size -1 for a folder, None for nothing."""
    system, name = locate(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        return None
    return info.size if info.type == fs.FileType.File else -1, int((info.mtime_ns or 0) // 1_000_000_000)


def open_read(path: str):
    system, name = locate(path)
    return system.open_input_stream(name, compression=None)


@contextmanager
def _attempt(path: str):
    """(stream, attempt) to write under a name of this attempt's own beside the real one; nothing is left if that fails."""
    system, name = locate(path)
    folder, last = posixpath.split(name)
    system.create_dir(folder, recursive=True)
    attempt = f"{folder}/.{last}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(attempt, compression=None) as stream:
            yield stream, attempt
    except BaseException:
        _remove(system, attempt)
        raise


def _remove(system, name: str) -> None:
    if system.get_file_info(name).type != fs.FileType.NotFound:
        system.delete_file(name)


@contextmanager
def open_write(path: str):
    """Write a file that takes its real name when it is whole.

    A lost executor, a failed write or a second attempt leaves no half-written file
    under the real name.
    """
    with _attempt(path) as (stream, attempt):
        yield stream
    publish(attempt, path)


def stage(source: str, target: str, length: int | None = None) -> tuple[str, int]:
    """Copy in pieces to a name beside the target; returns that name (on the target's file system) and the
    number of bytes. Other than `length` bytes raise, and nothing is left."""
    total = 0
    with _attempt(target) as (dst, attempt), open_read(source) as src:
        while data := src.read(_PIECE):
            dst.write(data)
            total += len(data)
        if length is not None and total != length:
            raise OSError(f"{total} of {length} bytes of {source}")
    return attempt, total


def publish(attempt: str, target: str) -> None:
    """Give a staged file its real name."""
    system, name = locate(target)
    try:
        system.move(attempt, name)
    except BaseException:
        _remove(system, attempt)
        raise


def discard(attempt: str, target: str) -> None:
    """Remove a staged file."""
    _remove(locate(target)[0], attempt)


def remove(path: str) -> None:
    """Remove a file, if it is there."""
    _remove(*locate(path))
