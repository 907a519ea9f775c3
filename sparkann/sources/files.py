"""Ranges of bytes of files, read and written by tasks through Arrow's file systems; a path is what Spark lists."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; ValueError or another error if Arrow doesn't know it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path if ":" in path else f"file://{path}"))


def readable(path: str) -> bool:
    """Whether tasks can read ranges of a path; else files are read whole through Spark."""
    try:
        opened(path)
    except Exception:  # Arrow raises many kinds for schemes and hosts that it can't use
        return False
    return True


def read(path: str, offset: int, size: int) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        f.seek(offset)
        return f.read(size)


def write(path: str, parts: Iterator[bytes]) -> None:
    """A file of parts, under another name until it is whole, so that a task that is run again replaces its own."""
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    own = f"{at}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as f:
        for p in parts:
            f.write(p)
    system.move(own, at)
