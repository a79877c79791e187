"""The part of HDF5 that annotated matrices need, read by ranges of rows: only the chunks of the rows asked for leave the disk.

Groups by symbol tables or compact links; contiguous, compact and chunked data sets (B-trees of version 1) with deflate, shuffle
and checksum filters; numbers, fixed and variable strings; attributes in object headers. Anything else is an error that names it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np

# Fixed values of the format: the signature and where it may stand, an address that isn't there, messages of object headers, filters.
SIGNATURE, PLACES, NOWHERE = b"\x89HDF\r\n\x1a\n", (0, 512, 1024, 2048, 4096), 0xFFFFFFFFFFFFFFFF
SPACE, LINKS, TYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUED, TABLE = 1, 2, 3, 6, 8, 11, 12, 16, 17
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3
INTEGER, FLOAT, STRING, ENUM, VARIABLE = 0, 1, 3, 8, 9


def padded(n: int, to: int = 8) -> int:
    return -(-n // to) * to


class File:
    """An open file; file["a/b"] is a group or a data set."""

    def __init__(self, source: BinaryIO):
        self.source = source
        self.heap: tuple[int, dict[int, bytes]] = NOWHERE, {}
        base = next((p for p in PLACES if self.at(p, 8) == SIGNATURE), None)
        if base is None:
            raise ValueError("this is no HDF5 file")
        version = self.at(base + 8, 1)[0]
        if version > 3:
            raise ValueError(f"superblocks of version {version} can't be read")
        widths = self.at(base + (13 if version < 2 else 9), 2)
        if widths != b"\x08\x08":
            raise ValueError("only addresses and lengths of eight bytes can be read")
        #: Addresses count from the superblock's base address.
        self.base, root = 0, base + (24 + 4 * version if version < 2 else 12)
        self.base = self.number(root)
        self.root = Group(self, self.number(root + (40 if version < 2 else 24) - self.base))

    @classmethod
    def opened(cls, path: str) -> File:
        return cls(open(path.removeprefix("file://"), "rb"))

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def __getitem__(self, path: str):
        return self.root[path]

    def at(self, address: int, size: int) -> bytes:
        self.source.seek(getattr(self, "base", 0) + address)
        data = self.source.read(size)
        if len(data) < size:
            raise ValueError(f"the file ends before byte {address + size}")
        return data

    def number(self, address: int, width: int = 8) -> int:
        return int.from_bytes(self.at(address, width), "little")

    def messages(self, address: int) -> Iterator[tuple[int, bytes]]:
        """(type, content) of the messages of an object header."""
        if self.at(address, 4) != b"OHDR":
            count, size = struct.unpack("<xxHxxxxI", self.at(address, 12))
            blocks, begin = [(address + 16, size)], "<HHBxxx"
        else:
            flags = self.at(address + 5, 1)[0]
            at = address + 6 + (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            width = 1 << (flags & 3)
            blocks, begin, count = [(at + width, self.number(at, width))], "<BHBxx" if flags & 4 else "<BHB", None
        head = struct.calcsize(begin)
        while blocks:
            start, size = blocks.pop(0)
            block, at = self.at(start, size), 0
            while at + head <= len(block) and count != 0:
                kind, length, flags = struct.unpack_from(begin, block, at)
                content = block[at + head : at + head + length]
                if flags & 2 and kind in (SPACE, TYPE, LAYOUT, FILTERS, ATTRIBUTE):
                    raise ValueError("shared messages can't be read")
                if kind == CONTINUED:
                    where, length_ = struct.unpack("<QQ", content[:16])
                    # Blocks of the newer kind stand between a mark and a checksum.
                    blocks.append((where, length_) if count is not None else (where + 4, length_ - 8))
                else:
                    yield kind, content
                count = None if count is None else count - 1
                at += head + length

    def heap_object(self, collection: int, index: int) -> bytes:
        """An object of a global heap, as variable strings name them; the heap read last is kept."""
        if self.heap[0] != collection:
            if self.at(collection, 4) != b"GCOL":
                raise ValueError("a variable string lies in no heap")
            block, at, objects = self.at(collection, self.number(collection + 8)), 16, {}
            while at + 16 <= len(block):
                found, size = struct.unpack_from("<HxxxxxxQ", block, at)
                if not found:
                    break
                objects[found] = block[at + 16 : at + 16 + size]
                at += 16 + padded(size)
            self.heap = collection, objects
        return self.heap[1][index]


class Object:
    """What groups and data sets share: messages and attributes."""

    def __init__(self, file: File, address: int):
        self.file, self.parts = file, list(file.messages(address))

    def part(self, kind: int) -> bytes | None:
        return next((c for k, c in self.parts if k == kind), None)

    @property
    def attrs(self) -> dict:
        return dict(attribute(self.file, c) for k, c in self.parts if k == ATTRIBUTE)


class Group(Object):
    def members(self) -> dict[str, int]:
        """The names in the group and where their headers lie."""
        table = self.part(TABLE)
        if table is not None:
            tree, heap = struct.unpack("<QQ", table[:16])
            names = self.file.number(heap + 24)
            return dict(self._symbols(tree, self.file.at(names, self.file.number(heap + 8))))
        info = self.part(LINKS)
        if info is not None and int.from_bytes(info[-8 * (2 + (info[1] >> 1 & 1)) :][:8], "little") != NOWHERE:
            raise ValueError("groups with very many links can't be read")
        return dict(link(c) for k, c in self.parts if k == LINK)

    def _symbols(self, address: int, names: bytes) -> Iterator[tuple[str, int]]:
        mark, level, used = struct.unpack("<4sxBH", self.file.at(address, 8))
        if mark == b"TREE":
            for k in range(used):
                yield from self._symbols(self.file.number(address + 32 + 16 * k), names)
            return
        used = self.file.number(address + 6, 2)
        for k in range(used):
            name, where = struct.unpack("<QQ", self.file.at(address + 8 + 40 * k, 16))
            yield names[name : names.index(b"\0", name)].decode(), where

    def __contains__(self, name: str) -> bool:
        return name in self.members()

    def __getitem__(self, path: str):
        name, _, rest = path.strip("/").partition("/")
        found = self.members()
        if name not in found:
            raise KeyError(f"the group has no {name}")
        parts = list(self.file.messages(found[name]))
        own = (Dataset if any(k == LAYOUT for k, _ in parts) else Group)(self.file, found[name])
        return own[rest] if rest else own


def link(content: bytes) -> tuple[str, int]:
    """Name and target of a hard link."""
    flags, at = content[1], 2
    if flags & 8:
        if content[at]:
            raise ValueError("only hard links can be read")
        at += 1
    at += (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
    width = 1 << (flags & 3)
    size = int.from_bytes(content[at : at + width], "little")
    at += width
    return content[at : at + size].decode(), int.from_bytes(content[at + size : at + size + 8], "little")


def dimensions(content: bytes) -> tuple[int, ...]:
    version, rank = content[0], content[1]
    at = 8 if version == 1 else 4
    return struct.unpack_from(f"<{rank}Q", content, at)


class Kind:
    """An element type: how many bytes, which numbers, or which kind of string."""

    def __init__(self, content: bytes):
        self.kind, bits, self.size = content[0] & 15, content[1], int.from_bytes(content[4:8], "little")
        order = ">" if bits & 1 else "<"
        if self.kind == INTEGER:
            self.numbers = np.dtype(f"{order}{'i' if bits & 8 else 'u'}{self.size}")
        elif self.kind == FLOAT:
            self.numbers = np.dtype(f"{order}f{self.size}")
        elif self.kind == ENUM:
            self.numbers = Kind(content[8:]).numbers
        elif self.kind == STRING or (self.kind == VARIABLE and bits & 15 == 1):
            self.numbers = np.dtype((np.void, self.size))
        else:
            raise ValueError(f"elements of type {self.kind} can't be read")

    def values(self, file: File, raw: np.ndarray) -> np.ndarray | list[str]:
        """Numbers as they are; strings as Python strings."""
        if self.kind == STRING:
            return [bytes(x).split(b"\0")[0].decode() for x in raw.ravel()]
        if self.kind == VARIABLE:
            told = (struct.unpack("<IQI", bytes(x)) for x in raw.ravel())
            return [file.heap_object(where, index)[:size].decode() if size else "" for size, where, index in told]
        return raw


def attribute(file: File, content: bytes):
    """Name and value of an attribute; a value of one element stands for itself."""
    version = content[0]
    sizes = struct.unpack_from("<HHH", content, 2)
    at, parts = 9 if version == 3 else 8, []
    for size in sizes:
        parts.append(content[at : at + size])
        at += padded(size) if version == 1 else size
    shape, kind = dimensions(parts[2]), Kind(parts[1])
    n = int(np.prod(shape, dtype=np.int64))
    values = kind.values(file, np.frombuffer(content, kind.numbers, n, at))
    return parts[0].split(b"\0")[0].decode(), (values[0] if not shape else values)


class Dataset(Object):
    def __init__(self, file: File, address: int):
        super().__init__(file, address)
        self.shape, self.kind = dimensions(self.part(SPACE)), Kind(self.part(TYPE))
        self.filters = filters_of(self.part(FILTERS) or b"\x02\0")
        layout = self.part(LAYOUT)
        if layout[0] not in (3, 4) or (layout[0] == 4 and layout[1] == 2):
            raise ValueError(f"data layouts of version {layout[0]} can't be read")
        self.layout, self.rest = layout[1], layout[2:]

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, rows: slice):
        """Rows first to end, as an array of numbers or a list of strings."""
        first, end, _ = rows.indices(self.shape[0])
        end = max(first, end)
        out = np.zeros((end - first, *self.shape[1:]), self.kind.numbers)
        wide = int(np.prod(self.shape[1:], dtype=np.int64)) * self.kind.size
        if self.layout == 0:
            out = np.frombuffer(self.rest[2:], self.kind.numbers, int(np.prod(self.shape))).reshape(self.shape)[first:end]
        elif self.layout == 1:
            where = int.from_bytes(self.rest[:8], "little")
            if where != NOWHERE and end > first:
                out = np.frombuffer(self.file.at(where + first * wide, (end - first) * wide), self.kind.numbers).reshape(out.shape)
        else:
            rank = len(self.shape)
            tree, *sides = struct.unpack_from(f"<Q{rank}I", self.rest, 1)
            if tree != NOWHERE and end > first:
                for size, mask, offsets, where in self._chunks(tree, first, end, sides[0]):
                    chunk = np.frombuffer(unfiltered(self.file.at(where, size), self.filters, mask), self.kind.numbers).reshape(sides)
                    target = tuple(slice(max(o - lead, 0), min(o - lead + s, n)) for o, s, n, lead in zip(offsets, sides, out.shape, (first, *[0] * rank), strict=False))
                    inside = tuple(slice(t.start - o + lead, t.stop - o + lead) for t, o, lead in zip(target, offsets, (first, *[0] * rank), strict=False))
                    out[target] = chunk[inside]
        return self.kind.values(self.file, out)

    def _chunks(self, address: int, first: int, end: int, side: int) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
        """Bytes, mask of filters, offsets and place of the chunks with some of the rows; branches without any aren't read."""
        rank = len(self.shape)
        level, used = struct.unpack("<xxxxxBH", self.file.at(address, 8))
        entry = struct.Struct(f"<II{rank + 1}QQ")
        block = self.file.at(address + 24, used * entry.size + entry.size - 8)
        told = [entry.unpack_from(block, k * entry.size) for k in range(used)]
        after = [*(t[2] for t in told[1:]), struct.unpack_from("<Q", block, used * entry.size + 8)[0]]
        for (size, mask, *offsets, _, where), following in zip(told, after, strict=True):
            if level and offsets[0] < end and following + side > first:
                yield from self._chunks(where, first, end, side)
            elif not level and offsets[0] < end and offsets[0] + side > first:
                yield size, mask, tuple(offsets), where


def filters_of(content: bytes) -> list[tuple[int, tuple[int, ...]]]:
    """(filter, its values) in the order in which they were applied."""
    version, count = content[0], content[1]
    at, out = 8 if version == 1 else 2, []
    for _ in range(count):
        which = int.from_bytes(content[at : at + 2], "little")
        named = version == 1 or which >= 256
        name, _, n = struct.unpack_from("<HHH", content, at + 2) if named else (0, *struct.unpack_from("<HH", content, at + 2))
        at += (8 if named else 6) + (padded(name) if version == 1 else name)
        out.append((which, struct.unpack_from(f"<{n}I", content, at)))
        at += 4 * n + (4 if version == 1 and n % 2 else 0)
    return out


def unfiltered(data: bytes, filters: list[tuple[int, tuple[int, ...]]], mask: int) -> bytes:
    for k, (which, values) in reversed(list(enumerate(filters))):
        if mask >> k & 1:
            continue
        if which == DEFLATE:
            data = zlib.decompress(data)
        elif which == SHUFFLE:
            whole = len(data) // values[0] * values[0]
            data = np.frombuffer(data, np.uint8, whole).reshape(values[0], -1).T.tobytes() + data[whole:]
        elif which == CHECKSUM:
            data = data[:-4]
        else:
            raise ValueError(f"filter {which} can't be undone")
    return data
