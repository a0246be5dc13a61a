"""MAT-file level 5: reading and writing of numeric, text and struct arrays.

Bytes in, NumPy arrays out; the format is public.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

# Fixed values of the format: data type codes and array class codes.
_DATA = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "utf8", 17: "utf16", 18: "utf32"}
_CLASS = {6: "f8", 7: "f4", 8: "i1", 9: "u1", 10: "i2", 11: "u2", 12: "i4", 13: "u4", 14: "i8", 15: "u8"}
_MATRIX, _COMPRESSED, _CELL, _STRUCT, _CHAR = 14, 15, 1, 2, 4


class _Reader:
    def __init__(self, data: bytes, order: str, at: int = 0) -> None:
        self.data, self.order, self.at = data, order, at

    def element(self) -> tuple[int, bytes]:
        head, size = struct.unpack_from(self.order + "II", self.data, self.at)
        if head >> 16:  # small element: 4 bytes of data in the tag
            kind, size = head & 0xFFFF, head >> 16
            body = self.data[self.at + 4 : self.at + 4 + size]
            self.at += 8
            return kind, body
        body = self.data[self.at + 8 : self.at + 8 + size]
        if len(body) < size:
            raise ValueError("MAT file ends early")
        self.at += 8 + size + (-size % 8 if head != _COMPRESSED else 0)
        return head, body

    def numbers(self) -> np.ndarray:
        kind, body = self.element()
        if kind not in _DATA or kind > 13:
            raise ValueError(f"unexpected MAT data type {kind}")
        return np.frombuffer(body, np.dtype(_DATA[kind]).newbyteorder(self.order))

    def text(self) -> str:
        kind, body = self.element()
        if kind in (16, 17, 18):
            return body.decode({16: "utf-8", 17: "utf-16-le" if self.order == "<" else "utf-16-be", 18: "utf-32"}[kind])
        values = np.frombuffer(body, np.dtype(_DATA[kind]).newbyteorder(self.order))
        return "".join(map(chr, values.tolist()))

    def matrix(self):
        flags = self.numbers()
        kind, dims, name = int(flags[0]) & 0xFF, self.numbers().astype(int), self.text()
        if kind in _CLASS:
            values = self.numbers().astype(_CLASS[kind])
            return name, values.reshape(dims, order="F")
        if kind == _CHAR:
            return name, self.text() if dims.prod() else ""
        if kind == _CELL:
            return name, [self.nested() for _ in range(int(dims.prod()))]
        if kind == _STRUCT:
            width = int(self.numbers()[0])
            raw = self.element()[1]
            fields = [raw[i : i + width].split(b"\0")[0].decode() for i in range(0, len(raw), width)]
            rows = [{f: self.nested() for f in fields} for _ in range(int(dims.prod()))]
            return name, rows[0] if len(rows) == 1 else rows
        raise ValueError(f"unsupported MAT array class {kind}")

    def nested(self):
        kind, body = self.element()
        return _Reader(body, self.order).matrix()[1] if kind == _MATRIX and body else np.zeros((0, 0))


def read(data: bytes) -> dict[str, object]:
    """The variables of a file."""
    if len(data) < 128:
        raise ValueError("not a MAT file")
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a level-5 MAT file")
    reader, out = _Reader(data, "<" if mark == b"IM" else ">", 128), {}
    while reader.at + 8 <= len(data):
        kind, body = reader.element()
        if kind == _COMPRESSED:
            kind, body = _Reader(zlib.decompress(body), reader.order).element()
        if kind == _MATRIX:
            name, value = _Reader(body, reader.order).matrix()
            out[name] = value
    return out


def shapes(fetch: Callable[[int, int], bytes], size: int, head: int = 4096) -> dict[str, tuple[int, ...]]:
    """The dimensions of each variable, from its first bytes.

    ``fetch(at, n)`` reads ``n`` bytes of the file, which has ``size``.
    """
    start = fetch(0, 128)
    if len(start) < 128 or start[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level-5 MAT file")
    order, at, out = "<" if start[126:128] == b"IM" else ">", 128, {}
    while at + 8 <= size:
        kind, length = struct.unpack(order + "II", fetch(at, 8))
        if at + 8 + length > size:
            raise ValueError("MAT file ends early")
        body = fetch(at + 8, min(length, head))
        if kind == _COMPRESSED:
            body = zlib.decompressobj().decompress(body, head)[8:]
        if kind in (_MATRIX, _COMPRESSED):
            reader = _Reader(body, order)
            reader.numbers()
            dims = tuple(int(d) for d in reader.numbers())
            out[reader.text()] = dims
        at += 8 + length + (-length % 8 if kind != _COMPRESSED else 0)
    return out


def _tagged(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def _array(name: str, value: object) -> bytes:
    if isinstance(value, dict):
        fields = list(value)
        body = _tagged(6, struct.pack("<II", _STRUCT, 0)) + _tagged(5, struct.pack("<ii", 1, 1)) + _tagged(1, name.encode())
        body += _tagged(5, struct.pack("<i", 32)) + _tagged(1, b"".join(f.encode().ljust(32, b"\0") for f in fields))
        return _tagged(_MATRIX, body + b"".join(_array("", value[f]) for f in fields))
    if isinstance(value, list):
        body = _tagged(6, struct.pack("<II", _STRUCT, 0)) + _tagged(5, struct.pack("<ii", 1, len(value))) + _tagged(1, name.encode())
        fields = list(value[0])
        body += _tagged(5, struct.pack("<i", 32)) + _tagged(1, b"".join(f.encode().ljust(32, b"\0") for f in fields))
        return _tagged(_MATRIX, body + b"".join(_array("", row[f]) for row in value for f in fields))
    if isinstance(value, str):
        body = _tagged(6, struct.pack("<II", _CHAR, 0)) + _tagged(5, struct.pack("<ii", 1, len(value))) + _tagged(1, name.encode())
        return _tagged(_MATRIX, body + _tagged(4, np.array([ord(c) for c in value], "<u2").tobytes()))
    array = np.atleast_2d(np.asarray(value))
    code = {v: k for k, v in _CLASS.items()}[array.dtype.str[1:]]
    data = {v: k for k, v in _DATA.items()}[array.dtype.str[1:]]
    body = _tagged(6, struct.pack("<II", code, 0)) + _tagged(5, np.array(array.shape, "<i4").tobytes()) + _tagged(1, name.encode())
    return _tagged(_MATRIX, body + _tagged(data, array.tobytes(order="F")))


def write(variables: dict[str, object], compress: bool = True) -> bytes:
    """A file of numeric arrays, texts, dicts (structs) and lists of dicts."""
    out = [b"MATLAB 5.0 MAT-file".ljust(124) + b"\x00\x01IM"]
    for name, value in variables.items():
        raw = _array(name, value)
        if compress:
            raw = zlib.compress(raw)
            raw = struct.pack("<II", _COMPRESSED, len(raw)) + raw
        out.append(raw)
    return b"".join(out)
