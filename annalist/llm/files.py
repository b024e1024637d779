"""Files that executors write to and read from the shared folder, through whatever file system its URI names."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def attempt_name(stem: str, suffix: str) -> str:
    """A name of this attempt's own: a task that is run again leaves the first attempt's file alone, and only the names
    that successful attempts return are ever read."""
    return f"{stem}-{uuid.uuid4().hex}{suffix}"


def open_new(folder: str, name: str):
    fs, path = resolve(folder)
    fs.create_dir(path, recursive=True)
    return fs.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"
