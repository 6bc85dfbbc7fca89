"""Files on any storage that Arrow reaches, for readers and writers that run in tasks."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def written_whole(path: str, data: bytes) -> None:
    """Write ``data`` beside ``path`` and move it there, so that no half-written file is ever seen under that name."""
    where, name = opened(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    at = f"{name.rsplit('/', 1)[0]}/_writing-{uuid.uuid4().hex}"
    with where.open_output_stream(at) as f:
        f.write(data)
    where.move(at, name)
