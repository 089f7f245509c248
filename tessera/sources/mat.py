"""Level-5 MAT files: real numeric matrices, stored plainly or compressed, of either byte order.

A file is a header of 128 bytes and data elements. An element has a tag (type and length) and its data, padded to 8 bytes; one of
at most 4 bytes may stand in its tag. A matrix element holds elements of its own: flags with the class, dimensions, name, values.
Values may be stored in a smaller type than the class; matrices are column-major.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Fixed values of the format: numeric storage types, classes of matrices, and the types of a matrix and a compressed element.
STORED = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
CLASSES = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
MATRIX, COMPRESSED, COMPLEX, LOGICAL = 14, 15, 0x0800, 0x0200


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # length and type share the first word, the data are the second
            size, kind = kind >> 16, kind & 0xFFFF
            if size > 4:
                raise ValueError("a short element of more than 4 bytes")
            yield kind, data[at + 4 : at + 4 + size]
            at += 8
            continue
        if at + 8 + size > len(data):
            raise ValueError("an element goes beyond its end")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def _matrix(data: bytes, order: str) -> tuple[str, np.ndarray | None]:
    """(name, values); None for what is no real numeric matrix."""
    parts = list(_elements(data, order))
    if len(parts) < 3 or len(parts[0][1]) < 4:
        return "", None
    flags = struct.unpack_from(f"{order}I", parts[0][1])[0]
    name = parts[2][1].decode("latin-1")
    if flags & 0xFF not in CLASSES or flags & COMPLEX or len(parts) < 4:
        return name, None
    shape = np.frombuffer(parts[1][1], f"{order}i4")
    kind, raw = parts[3]
    if kind not in STORED:
        raise ValueError(f"{name} is stored in type {kind}")
    values = np.frombuffer(raw, f"{order}{STORED[kind]}")
    if values.size != int(np.prod(shape)):
        raise ValueError(f"{name} holds {values.size} values for shape {shape.tolist()}")
    return name, values.astype("?" if flags & LOGICAL else CLASSES[flags & 0xFF]).reshape(tuple(shape.tolist()), order="F")


def variables(data: bytes) -> dict[str, np.ndarray]:
    """The real numeric matrices of a file by name; ValueError for what is no level-5 file."""
    data = bytes(data)
    mark = data[126:128]
    if len(data) < 128 or mark not in (b"IM", b"MI"):
        raise ValueError("no level-5 MAT file")
    order, out = "<" if mark == b"IM" else ">", {}
    for kind, body in _elements(data[128:], order):
        if kind == COMPRESSED:
            try:
                body = zlib.decompress(body)
            except zlib.error as e:
                raise ValueError("a compressed element cannot be read") from e
            inner = next(_elements(body, order), None)
            if inner is None:
                continue
            kind, body = inner
        if kind == MATRIX:
            name, values = _matrix(body, order)
            if values is not None:
                out[name] = values
    return out


def encoded(matrices: dict[str, np.ndarray], compressed: bool = True, order: str = "<") -> bytes:
    """A level-5 file of the matrices; whole numbers are stored in the smallest unsigned type that holds them."""

    def element(kind: int, body: bytes) -> bytes:
        if 0 < len(body) <= 4 and kind != MATRIX:
            return struct.pack(f"{order}I", len(body) << 16 | kind) + body.ljust(4, b"\0")
        return struct.pack(f"{order}II", kind, len(body)) + body.ljust(-(-len(body) // 8) * 8, b"\0")

    out = [b"MATLAB 5.0 MAT-file".ljust(124) + (b"\0\1IM" if order == "<" else b"\1\0MI")]
    for name, m in matrices.items():
        m = np.atleast_2d(np.asarray(m))
        wanted = "u1" if m.dtype == bool else m.dtype.str[1:]
        cls = next(k for k, v in CLASSES.items() if v == wanted)
        small = next((t for t in ("u1", "u2", "u4") if m.size and m.dtype.kind in "iuf" and (m == np.floor(m)).all() and m.min() >= 0 and m.max() <= np.iinfo(t).max), wanted)
        stored = "u1" if m.dtype == bool else small if np.dtype(small).itemsize < m.dtype.itemsize else wanted
        body = element(6, struct.pack(f"{order}II", cls | (LOGICAL if m.dtype == bool else 0), 0)) + element(5, np.array(m.shape, f"{order}i4").tobytes())
        body += element(1, name.encode("latin-1")) + element(next(k for k, v in STORED.items() if v == stored), m.astype(f"{order}{stored}").tobytes(order="F"))
        whole = element(MATRIX, body)
        if compressed:
            packed = zlib.compress(whole)
            whole = struct.pack(f"{order}II", COMPRESSED, len(packed)) + packed
        out.append(whole)
    return b"".join(out)
