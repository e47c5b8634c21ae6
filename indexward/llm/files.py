"""Binary files that Python tasks write into and read from a shared folder.

A task gives each file a new name and reports it in its rows. Only rows of tasks
that Spark commits are read later, so a file of a lost or repeated attempt is
never used.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path inside it, of a URI or a local path."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def new_file(folder: str, prefix: str, suffix: str):
    """An open new file in ``folder`` and its path."""
    system, place = file_system(folder)
    system.create_dir(place, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    return system.open_output_stream(f"{place}/{name}", compression=None), f"{folder.rstrip('/')}/{name}"


def open_file(path: str):
    """A file for reading at any position."""
    system, place = file_system(path)
    return system.open_input_file(place)
