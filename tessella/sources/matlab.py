"""Numeric matrices from MATLAB files of version 5 to 7.2; the later format is HDF5."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the format: numeric types of data elements, the types of a matrix and of a compressed element, the flag of complex values.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED, COMPLEX, NUMERIC = 14, 15, 0x0800, range(6, 16)
HEADER = 128


def elements(data: bytes, order: str):
    """(type, content) of the data elements one after another; content up to four bytes long may stand in the tag itself."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (0 if kind == COMPRESSED else -size % 8)


def matrix(content: bytes, order: str) -> tuple[str, np.ndarray | None]:
    """Name and values of a matrix element; None if it is no plain numeric matrix."""
    parts = list(elements(content, order))
    flags = struct.unpack_from(order + "I", parts[0][1])[0]
    shape = np.frombuffer(parts[1][1], order + "i4")
    name = parts[2][1].decode("ascii")
    if flags & 0xFF not in NUMERIC or flags & COMPLEX or len(parts) != 4:
        return name, None
    kind, raw = parts[3]
    return name, np.frombuffer(raw, order + TYPES[kind]).astype(np.float64).reshape(shape, order="F")


def read_mat(path: str, name: str | None = None) -> np.ndarray:
    """A numeric matrix of a MATLAB file by its name, or the first one. It is a model's file, read by the driver."""
    with open(path, "rb") as file:
        data = file.read()
    if data[:4] == b"\x89HDF" or data[512:516] == b"\x89HDF":
        raise ValueError(f"{path} is HDF5; read it with h5py")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, content in elements(data[HEADER:], order):
        if kind == COMPRESSED:
            kind, content = next(elements(zlib.decompress(content), order))
        if kind == MATRIX:
            found, values = matrix(content, order)
            if values is not None and name in (None, found):
                return values
    raise KeyError(f"{path} has no numeric matrix {name or ''}")
