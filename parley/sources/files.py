"""Files that Python tasks open themselves: by path, or by a URI of a store that pyarrow knows."""

from __future__ import annotations

import fnmatch


def file_system(path: str):
    """(file system, path in it)."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path else (LocalFileSystem(), path.removeprefix("file:"))


def matching(path: str) -> list[tuple[str, int]]:
    """(path with its scheme, size) of a file, of a folder's files, or of those that a pattern in the last part matches, by name."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = file_system(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in fs.get_file_info(FileSelector(folder)) if fnmatch.fnmatch(f.base_name, last)]
    else:
        info = fs.get_file_info(at)
        if info.type == FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at))
    return sorted((scheme + f.path, f.size) for f in found if f.type == FileType.File and not f.base_name.startswith(("_", ".")))
