"""Lays down the few parts of HDF5 that a sparse annotated matrix has, one after another, so that a task keeps a chunk at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Mapping, Sequence
from typing import BinaryIO

import numpy as np

from .hdf5 import ATTRIBUTE, DEFLATE, FILTERS, LAYOUT, NOWHERE, SHUFFLE, SIGNATURE, SPACE, TABLE, TYPE, padded

# Fixed values of the format: most members of a group's one node and children of nodes, by which nodes have their sizes; the message of fill values.
MEMBERS, GROUP_CHILDREN, CHUNK_CHILDREN, FILL = 8, 32, 64, 5
VARIABLE_STRING = struct.pack("<BBBBI", 0x19, 1, 1, 0, 16) + struct.pack("<BBBBIHH", 0x10, 0, 0, 0, 1, 0, 8)


def filled(data: bytes, size: int) -> bytes:
    return data + bytes(size - len(data))


def even(data: bytes) -> bytes:
    return filled(data, padded(len(data)))


def type_of(kind: np.dtype) -> bytes:
    """The message of an element type: signed integers, floats, or UTF-8 strings of fixed size."""
    if kind.kind == "i":
        return struct.pack("<BBBBIHH", 0x10, 8, 0, 0, kind.itemsize, 0, 8 * kind.itemsize)
    if kind.kind == "f":
        sign, *fields = {4: (31, 0, 32, 23, 8, 0, 23, 127), 8: (63, 0, 64, 52, 11, 0, 52, 1023)}[kind.itemsize]
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20, sign, 0, kind.itemsize, *fields)
    return struct.pack("<BBBBI", 0x13, 0x11, 0, 0, kind.itemsize)


def space_of(shape: Sequence[int]) -> bytes:
    return struct.pack(f"<BBBxxxxx{len(shape)}Q", 1, len(shape), 0, *shape)


class Parts:
    """A file under way. Parts are appended; each method returns the address of what it wrote, and ``close`` names the root."""

    def __init__(self, sink: BinaryIO):
        self.sink, self.end = sink, 0
        self.put(bytes(96))  # the superblock's place

    def put(self, data: bytes) -> int:
        at = self.end
        self.sink.write(even(data))
        self.end += padded(len(data))
        return at

    def header(self, messages: Sequence[tuple[int, bytes]]) -> int:
        body = b"".join(struct.pack("<HHBxxx", kind, padded(len(c)), 0) + even(c) for kind, c in messages)
        return self.put(struct.pack("<BxHIIxxxx", 1, len(messages), 1, len(body)) + body)

    def attributes(self, values: Mapping[str, str | np.ndarray]) -> list[tuple[int, bytes]]:
        """Messages of attributes: strings of variable size, of which there is a heap, or arrays of numbers."""
        texts = [v.encode() for v in values.values() if isinstance(v, str)]
        objects = b"".join(struct.pack("<HHxxxxQ", k, 1, len(t)) + even(t) for k, t in enumerate(texts, 1))
        size = max(4096, 16 + len(objects) + 16)
        left = size - 16 - len(objects)
        heap = self.put(filled(b"GCOL" + struct.pack("<BxxxQ", 1, size) + objects + struct.pack("<HHxxxxQ", 0, 0, left), size)) if texts else NOWHERE
        out, k = [], 0
        for name, value in values.items():
            if isinstance(value, str):
                k += 1
                kind, space, data = VARIABLE_STRING, space_of(()), struct.pack("<IQI", len(value.encode()), heap, k)
            else:
                kind, space, data = type_of(value.dtype), space_of(value.shape), value.tobytes()
            label = name.encode() + b"\0"
            out.append((ATTRIBUTE, struct.pack("<BxHHH", 1, len(label), len(kind), len(space)) + even(label) + even(kind) + even(space) + data))
        return out

    def chunk(self, values: np.ndarray) -> tuple[int, int]:
        """Bytes and address of a chunk, shuffled and deflated."""
        raw = np.ascontiguousarray(values)
        data = zlib.compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes() if raw.size else b"", 4)
        return len(data), self.put(data)

    def chunk_tree(self, chunks: list[tuple[int, int]], side: int) -> int:
        """The index of a column's chunks, level by level."""
        if not chunks:
            return NOWHERE
        keys = [(size, k * side) for k, (size, _) in enumerate(chunks)]
        children, last, level = [where for _, where in chunks], len(chunks) * side, 0
        while True:
            nodes = range(0, len(children), CHUNK_CHILDREN)
            size = 24 + 8 * CHUNK_CHILDREN + 24 * (CHUNK_CHILDREN + 1)
            first = self.end
            for n in nodes:
                own = list(zip(keys, children, strict=True))[n : n + CHUNK_CHILDREN]
                beside = [first + size * (n // CHUNK_CHILDREN + d) if 0 <= n + d * CHUNK_CHILDREN < len(children) else NOWHERE for d in (-1, 1)]
                following = keys[n + CHUNK_CHILDREN] if n + CHUNK_CHILDREN < len(keys) else (0, last)
                body = b"".join(struct.pack("<IIQQQ", s, 0, o, 0, where) for (s, o), where in own)
                self.put(filled(struct.pack("<4sBBHQQ", b"TREE", 1, level, len(own), *beside) + body + struct.pack("<IIQQ", following[0], 0, following[1], 0), size))
            if len(nodes) == 1:
                return first
            keys, children, level = [keys[n] for n in nodes], [first + size * i for i in range(len(nodes))], level + 1

    def column(self, kind: np.dtype, length: int, chunks: list[tuple[int, int]], side: int, attributes: Mapping[str, str] = {}) -> int:
        """A data set of one dimension from its chunks of ``side`` elements each; the last one is filled up."""
        filters = struct.pack("<BBxxxxxx", 1, 2) + struct.pack("<HHHHIxxxx", SHUFFLE, 0, 0, 1, kind.itemsize) + struct.pack("<HHHHIxxxx", DEFLATE, 0, 0, 1, 4)
        layout = struct.pack("<BBBQII", 3, 2, 2, self.chunk_tree(chunks, side), side, kind.itemsize)
        told = self.attributes(attributes)
        return self.header([(SPACE, space_of((length,))), (TYPE, type_of(kind)), (FILL, struct.pack("<BBBB", 2, 3, 2, 0)), (LAYOUT, layout), (FILTERS, filters), *told])

    def group(self, members: Mapping[str, int], attributes: Mapping[str, str | np.ndarray]) -> int:
        """A group of up to MEMBERS members (name and address of the header)."""
        names, at = b"\0" * 8, {}
        for name in sorted(members):
            at[name] = len(names)
            names += even(name.encode() + b"\0")
        heap = self.put(struct.pack("<4sBxxxQQQ", b"HEAP", 0, len(names), 1, self.end + 32) + names)
        entries = b"".join(struct.pack("<QQ24x", at[n], members[n]) for n in at)
        leaf = self.put(filled(struct.pack("<4sBxH", b"SNOD", 1, len(at)) + entries, 8 + 40 * MEMBERS))
        tree = struct.pack("<4sBBHQQQQQ", b"TREE", 0, 0, 1, NOWHERE, NOWHERE, 0, leaf, max(at.values(), default=0))
        root = self.put(filled(tree, 24 + 8 * GROUP_CHILDREN + 8 * (GROUP_CHILDREN + 1)))
        return self.header([(TABLE, struct.pack("<QQ", root, heap)), *self.attributes(attributes)])

    def close(self, root: int) -> None:
        """Write the superblock; the file is whole then."""
        self.sink.seek(0)
        self.sink.write(SIGNATURE + struct.pack("<8BHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, MEMBERS // 2, GROUP_CHILDREN // 2, 0, 0, NOWHERE, self.end, NOWHERE) + struct.pack("<QQ24x", 0, root))
