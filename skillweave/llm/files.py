"""Binary files in the shared store, from tasks as from the driver, over any file system that pyarrow knows."""

from __future__ import annotations

import os

import pyarrow.fs as pafs


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of file:, hdfs:, s3: and other addresses; a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri if ":" in uri else "file://" + os.path.abspath(uri))
