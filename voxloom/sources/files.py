"""Files wherever Arrow reaches them, by a plain path or a URI of a store, as partitions of a data source."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import NativeFile, fs
from pyspark.sql.datasource import EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of a file, or of the files of a folder in order of their names; opens none of them.
    Names that begin with a dot or an underscore are left out.  A folder that is not there is empty."""
    system, inner = at(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    head = path[: len(path) - len(inner)]
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def opened(path: str) -> NativeFile:
    """A file to read at any place."""
    system, inner = at(path)
    return system.open_input_file(inner)


@dataclass
class Part(InputPartition):
    """A file, of which scans up to byte `had` were taken before."""

    path: str
    size: int
    had: int = 0


class Times:
    """What options and pushed filters leave of time."""

    def __init__(self, options: dict):
        self.lo, self.hi = int(options.get("fromns", -(2**63))), int(options.get("tons", 2**63 - 1))

    def take(self, f: Filter) -> bool:
        """Narrow by a filter on t_ns; False for any other."""
        if getattr(f, "attribute", None) != ("t_ns",) or not isinstance(getattr(f, "value", None), int):
            return False
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.hi = min(self.hi, f.value - isinstance(f, LessThan))
        return isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual)
