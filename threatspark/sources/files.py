"""Files for the data sources written in Python: listing and reading by byte range.

Paths are local or of any store that pyarrow opens by URI (file, s3, gs, hdfs).
"""

from __future__ import annotations

import os

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder; names that begin with . or _ are hidden."""
    store, root = opened(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    out = []
    for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
        inner = os.path.relpath(f.path, root).split(os.sep)
        if f.type == fs.FileType.File and not any(n[0] in "._" for n in inner) and f.path.endswith(suffix):
            out.append((f.path, f.size))
    return sorted(out)


def ranges(files: list[tuple[str, int]], most: int) -> list[tuple[str, int, int]]:
    """(path, start, end) pieces of at most ``most`` bytes."""
    return [(p, a, min(a + most, n)) for p, n in files for a in range(0, n, most)]
