"""ZIP packages of stored members: a writer, and a reader that fetches byte ranges only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

_LIMIT32, _LIMIT16 = 0xFFFFFFFF, 0xFFFF


class ZipWriter:
    """Writes stored members to ``write``; ZIP64 records are added where sizes need them, or always on demand."""

    def __init__(self, write: Callable[[bytes], object], zip64: bool = False) -> None:
        self._write, self._zip64, self._at, self._members = write, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self._write(data)
        self._at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, big = name.encode(), zlib.crc32(data), self._zip64 or len(data) >= _LIMIT32
        self._members.append((raw, crc, len(data), self._at))
        size = _LIMIT32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)

    def close(self) -> None:
        begin = self._at
        for raw, crc, size, at in self._members:
            big = self._zip64 or size >= _LIMIT32 or at >= _LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
            shown, where = (_LIMIT32, _LIMIT32) if big else (size, at)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        length, n = self._at - begin, len(self._members)
        big = self._zip64 or n >= _LIMIT16 or begin >= _LIMIT32 or length >= _LIMIT32
        if big:
            end = self._at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, begin))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        short = (_LIMIT16, _LIMIT16, _LIMIT32, _LIMIT32) if big else (n, n, length, begin)
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, *short, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header_at: int
    crc: int


def read_directory(read_at: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The members that the central directory lists; ZIP64 records and fields are followed.

    ``read_at(offset, n)`` returns the bytes of a range. What precedes the
    archive in the file (a stub) shifts all offsets and is allowed for.
    """
    tail_at = max(0, size - 22 - _LIMIT16)
    tail = read_at(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] > len(tail)):
        k = tail.rfind(b"PK\x05\x06", 0, k)
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, _, n, length, begin, _ = struct.unpack_from("<4sHHHHIIH", tail, k)
    end = tail_at + k
    if (n == _LIMIT16 or length == _LIMIT32 or begin == _LIMIT32) and end >= 20:
        locator = read_at(end - 20, 20)
        if locator[:4] == b"PK\x06\x07":
            record_at = struct.unpack("<4sIQI", locator)[2]
            record = read_at(record_at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 locator leads to no end record")
            n, length, begin = struct.unpack_from("<QQQ", record, 32)
            end = record_at
    shift = end - length - begin
    data, at, members = read_at(begin + shift, length), 0, []
    for _ in range(n):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, crc, stored, full, name_n, extra_n, note_n, where = struct.unpack_from("<10xH4xIIIHHH8xI", data, at)
        name, extra = data[at + 46 : at + 46 + name_n], data[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == _LIMIT32 and wide else full
                stored = wide.pop(0) if stored == _LIMIT32 and wide else stored
                where = wide.pop(0) if where == _LIMIT32 and wide else where
            extra = extra[4 + width :]
        members.append(Member(name.decode(), method, full, stored, where + shift, crc))
        at += 46 + name_n + extra_n + note_n
    return members


def data_offset(read_at: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin; ranges of them can then be read without extraction."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, not stored")
    header = read_at(member.header_at, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.header_at + 30 + sum(struct.unpack_from("<HH", header, 26))
