"""Reading ZIP archives by ranges: directory, ZIP64 fields and stored members.

``read(offset, length)`` is all that is asked of a file, so an archive in any
store is opened with a few small reads and its members are never extracted.
Field layouts are those of the public ZIP specification.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

Read = Callable[[int, int], bytes]

# Fixed values of the format: signatures and sizes of fixed parts.
END, END_SIZE = b"PK\x05\x06", 22
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
ZIP64_TAG, STORED = 0x0001, 0
MAX_COMMENT = 65_535


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int  # where the member's local header stands


def directory_place(read: Read, length: int) -> tuple[int, int, int]:
    """(offset, size, entries) of the central directory."""
    tail_size = min(length, END_SIZE + MAX_COMMENT + LOCATOR_SIZE)
    tail_at = length - tail_size
    tail = read(tail_at, tail_size)
    at = tail.rfind(END)
    while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if at >= LOCATOR_SIZE and tail[at - LOCATOR_SIZE : at].startswith(LOCATOR):
        (place,) = struct.unpack_from("<Q", tail, at - LOCATOR_SIZE + 8)
        end = read(place, END64_SIZE)
        if not end.startswith(END64):
            raise ValueError("ZIP64 locator points at no directory end")
        entries, size, offset = struct.unpack_from("<QQQ", end, 32)
    return offset, size, entries


def members(read: Read, length: int) -> list[Member]:
    """All entries of the central directory, in its order."""
    offset, size, entries = directory_place(read, length)
    raw, at, out = read(offset, size), 0, []
    for _ in range(entries):
        if raw[at : at + 4] != ENTRY:
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, at + 8)
        packed, whole, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", raw, at + 20)
        (header,) = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + ENTRY_SIZE : at + ENTRY_SIZE + name_n]
        extra = raw[at + ENTRY_SIZE + name_n : at + ENTRY_SIZE + name_n + extra_n]
        wide, k = {}, 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == ZIP64_TAG:
                # 64-bit values stand here only for fields that overflowed, in this order
                full = [f for f, v in (("whole", whole), ("packed", packed), ("header", header)) if v == 0xFFFFFFFF]
                wide = dict(zip(full, struct.unpack_from(f"<{min(len(full), n // 8)}Q", extra, k + 4), strict=False))
            k += 4 + n
        out.append(
            Member(
                name.decode("utf-8" if flags & 0x800 else "cp437"),
                method,
                wide.get("whole", whole),
                wide.get("packed", packed),
                wide.get("header", header),
            )
        )
        at += ENTRY_SIZE + name_n + extra_n + comment_n
    return out


def data_place(read: Read, member: Member) -> int:
    """Where a stored member's bytes begin.  Members that ZIP itself compresses can't be read by ranges."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed, not stored")
    head = read(member.header, LOCAL_SIZE)
    if not head.startswith(LOCAL):
        raise ValueError(f"no local header for {member.name}")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + name_n + extra_n
