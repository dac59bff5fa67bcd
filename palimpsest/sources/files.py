"""Whole files by path or URI, on any file system Arrow knows, from driver or tasks."""

from __future__ import annotations

import uuid
from urllib.parse import quote

import numpy as np
from pyarrow import fs as pafs

#: Hadoop's names of file systems that Arrow has under another.
_ALIASES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}


def of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it.  A plain path is local; so is Hadoop's ``file:/a``."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, mark, rest = path.partition("://")
    if not mark:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(f"{_ALIASES.get(scheme, scheme)}://{quote(rest, safe='/:@?&=%')}")


def name(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def exists(path: str) -> bool:
    fs, inner = of(path)
    return fs.get_file_info(inner).type != pafs.FileType.NotFound


def read(path: str) -> bytes:
    fs, inner = of(path)
    with fs.open_input_file(inner) as f:
        return f.read()


def write(path: str, data: bytes) -> None:
    fs, inner = of(path)
    with fs.open_output_stream(inner) as f:
        f.write(data)


def read_range(path: str, at: int, size: int) -> bytes:
    """Up to ``size`` bytes from ``at`` on."""
    fs, inner = of(path)
    with fs.open_input_file(inner) as f:
        f.seek(min(at, f.size()))
        return f.read(size)


class Blocks:
    """A file, or a part of it, that is read a block at a time as its slices are asked for; one block is kept, or a few."""

    def __init__(self, path: str, begin: int = 0, end: int | None = None, block: int = 1 << 16, keep: int = 8):
        self.path, self.begin, self.block, self.keep = path, begin, block, keep
        self.end = size(path) if end is None else end
        self.held: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.end - self.begin

    def _get(self, number: int) -> bytes:
        found = self.held.get(number)
        if found is None:
            if len(self.held) >= self.keep:
                self.held.pop(next(iter(self.held)))
            at = self.begin + number * self.block
            found = self.held[number] = read_range(self.path, at, min(self.block, self.end - at))
        return found

    def __getitem__(self, part: slice) -> bytes:
        lo, hi, _ = part.indices(len(self))
        first = lo // self.block
        if hi <= (first + 1) * self.block:
            return self._get(first)[lo - first * self.block : hi - first * self.block] if hi > lo else b""
        whole = b"".join(self._get(n) for n in range(first, (hi - 1) // self.block + 1))
        return whole[lo - first * self.block : hi - first * self.block]

    def at(self, places: np.ndarray) -> np.ndarray:
        """The bytes at many places, each block read once."""
        order = np.argsort(places)
        numbers, begins = np.unique(places[order] // self.block, return_index=True)
        out = np.empty(len(places), np.uint8)
        for number, own in zip(numbers.tolist(), np.split(order, begins[1:])):
            out[own] = np.frombuffer(self._get(number), np.uint8)[places[own] - number * self.block]
        return out


def size(path: str) -> int:
    fs, inner = of(path)
    return fs.get_file_info(inner).size


def publish(path: str, data: bytes) -> None:
    """Writes a file whole under its name or not at all; attempts of one task may do so at once, with equal data."""
    fs, inner = of(path)
    fs.create_dir(inner.rpartition("/")[0], recursive=True)
    temporary = f"{inner}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temporary) as f:
        f.write(data)
    try:
        fs.move(temporary, inner)
    except OSError:
        # Some file systems do not move onto a file; then another attempt was first.
        if fs.get_file_info(inner).type != pafs.FileType.File:
            raise
        fs.delete_file(temporary)


def names(folder: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    fs, inner = of(folder)
    return [f.base_name for f in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if f.type == pafs.FileType.File]


def children(folder: str) -> list[tuple[str, int, bool]]:
    """(path, bytes, whether a folder) of what is in a folder, hidden things left out; none where there is no such folder."""
    fs, inner = of(folder)
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    told = [(f"{folder.rstrip('/')}/{f.base_name}", f.size or 0, f.type == pafs.FileType.Directory) for f in found]
    return sorted(t for t in told if not name(t[0]).startswith(("_", ".")))


def make_folder(path: str) -> None:
    fs, inner = of(path)
    fs.create_dir(inner, recursive=True)


def move(path: str, to: str) -> None:
    fs, inner = of(path)
    fs.move(inner, of(to)[1])


def remove(path: str) -> None:
    fs, inner = of(path)
    fs.delete_file(inner)


def with_ending(path: str, ending: str) -> list[str]:
    """The files of a folder that end so, by name, hidden ones left out; of a file, itself."""
    fs, inner = of(path)
    if fs.get_file_info(inner).type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(inner))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.File and f.base_name.endswith(ending) and not f.base_name.startswith("."))
    return [f"{path.rstrip('/')}/{n}" for n in names]
