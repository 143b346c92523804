"""The chunks of PNG, WebP, animated cursor, GIF and JPEG 2000 files, and the chain of TIFF directories: what points from place to place.

A file is walked in Arrow batches, from one header to the next; of what lies between, only the PNG chunks' checks are read.
Columns and joins take it from there. A walk always moves ahead and ends, whatever the file says: a chunk that reaches beyond
its container is told as an error and ends it, and a chain of directories ends where it would come back.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = "struct<depth: int, parent: int, kind: string, start: bigint, size: bigint, crc_ok: boolean, error: string>"
TAG = "struct<tag: int, type: int, count: bigint, value: bigint, values: array<bigint>, error: string>"
DIRECTORY = f"struct<start: bigint, tags: array<{TAG}>, error: string>"
#: A PNG file's first bytes; the chunks of RIFF files that hold others, with the bytes before these; the boxes of
#: JPEG 2000 files that do.
PNG, HOLDERS, SUPERBOXES = b"\x89PNG\r\n\x1a\n", {b"RIFF": 4, b"LIST": 4, b"ANMF": 16}, (b"jp2h", b"res ", b"uinf")


#: Numbers of a long's size or more are null.
LONG = 1 << 63


def png_chunks(data: bytes) -> list[tuple]:
    out, at, size = [], len(PNG), len(data)
    while at < size:
        if size - at < 8:
            return [*out, (0, None, None, at, size - at, None, "cut header")]
        length, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        end = at + 8 + length
        row = (0, None, kind.decode("latin-1"), at + 8, length)
        if end + 4 > size:
            return [*out, (*row, None, "cut")]
        first = not out and (kind != b"IHDR" or length != 13)
        out.append((*row, zlib.crc32(memoryview(data)[at + 4 : end]) == int.from_bytes(data[end : end + 4], "big"), "not a header" if first else None))
        if kind == b"IEND":
            return out
        at = end + 4
    return [*out, (0, None, None, size, 0, None, "no end")]


def riff_chunks(data: bytes) -> list[tuple]:
    """Chunks in the order of the file, those of a container after it. Kinds of containers have their form: LIST/fram."""
    out: list[tuple] = []
    holders, at = [(len(data), None)], 0
    while holders:
        stop, parent = holders[-1]
        if stop - at < 8:
            if stop > at and len(holders) > 1:
                out.append((len(holders) - 1, parent, None, at, stop - at, None, "cut header"))
            holders.pop()
            at = stop + (stop & 1)
            continue
        kind, length = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        start, end = at + 8, at + 8 + length
        before = HOLDERS.get(kind, 0)
        name = kind.decode("latin-1") + ("/" + data[start : start + 4].decode("latin-1") if before == 4 and length >= 4 else "")
        before = before if length >= before and start + before <= stop else 0
        error = "cut" if end > stop else "short" if kind in HOLDERS and not before else None
        out.append((len(holders) - 1, parent, name, start + before, length - before, None, error))
        if before:
            holders.append((min(end, stop), len(out) - 1))
            at = start + before
        else:
            at = min(end + (end & 1), stop)
        if len(holders) == 1:  # what follows the file's one container is not its own
            break
    return out


def boxes(data: bytes | None) -> list[tuple]:
    """Boxes of JPEG 2000 files in their order, those in a box after it. A length of 0 reaches to the container's end, and after one
    of 1 stands a length of eight bytes."""
    out: list[tuple] = []
    data = data or b""
    holders, at = [(len(data), None)], 0
    while holders:
        stop, parent = holders[-1]
        if stop - at < 8:
            if stop > at:
                out.append((len(holders) - 1, parent, None, at, stop - at, None, "cut header"))
            holders.pop()
            at = stop
            continue
        length, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if length == 1:
            length, head = int.from_bytes(data[at + 8 : min(at + 16, stop)], "big"), 16
        elif length == 0:
            length = stop - at
        error = "short" if length < head or head == 16 and at + 16 > stop else "cut" if at + length > stop else None
        out.append((len(holders) - 1, parent, kind.decode("latin-1"), min(at + head, stop), min(max(length - head, 0), LONG - 1), None, error))
        if error:
            holders.pop()
            at = stop
        elif kind in SUPERBOXES:
            holders.append((at + length, len(out) - 1))
            at += head
        else:
            at += length
    return out


def gif_chunks(data: bytes) -> list[tuple]:
    """Images, and extensions by their label (ext/F9), from what follows the label to the last block's end."""
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 128 else 0
    out: list[tuple] = []
    if len(data) < 13:
        return [(0, None, None, 0, len(data), None, "cut header")]
    at = 13 + table(data[10])
    while at < len(data):
        mark = data[at]
        if mark == 0x3B:
            return [*out, (0, None, "end", at, 1, None, None)]
        if mark not in (0x21, 0x2C) or at + 2 > len(data):
            return [*out, (0, None, None, at, len(data) - at, None, "no block")]
        kind, start = ("image", at + 1) if mark == 0x2C else (f"ext/{data[at + 1]:02X}", at + 2)
        at = start
        if mark == 0x2C:
            at += 10 + (table(data[start + 8]) if start + 8 < len(data) else 0)
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
        cut = at > len(data)
        out.append((0, None, kind, start, min(at, len(data)) - start, None, "cut" if cut else None))
    return out if out and out[-1][-1] == "cut" else [*out, (0, None, None, len(data), 0, None, "no end")]


def chunks(data: bytes | None) -> list[tuple]:
    if data is None:
        return []
    if data[:8] == PNG:
        return png_chunks(data)
    if data[:4] == b"RIFF" and data[8:12] in (b"WEBP", b"ACON"):
        return riff_chunks(data)
    if data[4:8] == b"jP  ":
        return boxes(data)
    return gif_chunks(data) if data[:6] in (b"GIF87a", b"GIF89a") else []


#: Bytes of a TIFF value by its type, and the letters that struct has for whole numbers without a sign.
SIZES = {**dict.fromkeys((1, 2, 6, 7), 1), **dict.fromkeys((3, 8), 2), **dict.fromkeys((4, 9, 11, 13), 4), **dict.fromkeys((5, 10, 12, 16, 17, 18), 8)}
WHOLE = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q", 18: "Q"}
def tags(data: bytes, order: str, big: bool, at: int, n: int) -> list[dict]:
    """The entries of a directory that begin at a place within the file."""
    out = []
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), data, at + k * (20 if big else 12))
        if kind not in SIZES:
            continue
        field, room, pointer = at + k * (20 if big else 12) + (12 if big else 8), 8 if big else 4, "Q" if big else "I"
        size, value = SIZES[kind] * count, struct.unpack_from(order + pointer, data, field)[0]
        place = field if size <= room else value
        fits = place + size <= len(data)
        values = list(struct.unpack_from(f"{order}{count}{WHOLE[kind]}", data, place)) if fits and kind in WHOLE else None
        if values and count == 1 and size <= room:
            value = values[0]
        values = None if values is None else [v if v < LONG else None for v in values]
        out.append({"tag": tag, "type": kind, "count": min(count, LONG - 1), "value": value if value < LONG else None, "values": values, "error": None if fits else "beyond the file"})
    return out


def directories(data: bytes | None) -> list[tuple]:
    """(start, tags, error) of each directory of a TIFF file, old or big."""
    order = {b"II": "<", b"MM": ">"}.get((data or b"")[:2])
    if order is None or len(data) < 8:
        return []
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        return []
    big = magic == 43
    if big and (len(data) < 16 or struct.unpack_from(order + "HH", data, 4) != (8, 0)):
        return [(None, [], "bad header")]
    count, pointer, entry, room = ("Q", "Q", 20, 8) if big else ("H", "I", 12, 4)
    at = struct.unpack_from(order + pointer, data, 8 if big else 4)[0]
    out, seen = [], set()
    while at:
        width = struct.calcsize(order + count)
        n = struct.unpack_from(order + count, data, at)[0] if at + width <= len(data) else None
        place = min(at, LONG - 1)
        if at in seen:
            return [*out, (place, [], "loop")]
        if n is None or at + width + n * entry + room > len(data):
            return [*out, (place, [], "cut")]
        seen.add(at)
        out.append((place, tags(data, order, big, at + width, n), None))
        at = struct.unpack_from(order + pointer, data, at + width + n * entry)[0]
    return out or [(None, [], "no directory")]


ARROW_TAG = pa.struct([("tag", pa.int32()), ("type", pa.int32()), ("count", pa.int64()), ("value", pa.int64()), ("values", pa.list_(pa.int64())), ("error", pa.string())])
ARROW_CHUNK = {"depth": pa.int32(), "parent": pa.int32(), "kind": pa.string(), "start": pa.int64(), "size": pa.int64(), "crc_ok": pa.bool_(), "error": pa.string()}
ARROW_DIRECTORY = {"start": pa.int64(), "tags": pa.list_(ARROW_TAG), "error": pa.string()}


def walked(walk, kind: str, arrow: dict):
    """A column function of contents: walk's rows as an array of structs."""

    def run(contents: pa.Array) -> pa.Array:
        rows = [walk(c.as_py()) for c in contents]
        flat = [r for own in rows for r in own]
        columns = [pa.array([r[i] for r in flat], t) for i, t in enumerate(arrow.values())]
        ends = [0]
        for own in rows:
            ends.append(ends[-1] + len(own))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(arrow)))

    return F.arrow_udf(run, f"array<{kind}>")


def chunks_of(content: Column) -> Column:
    """An array of a file's chunks, in its order: depth and parent (the container's place in the array), kind, start and size of
    its data, crc_ok (PNG only), and error. The last one of a bad file says what is wrong: 'cut' (it reaches beyond its
    container, or the file), 'cut header', 'no end', 'no block', 'short' or 'not a header'. Null and other files: empty."""
    return walked(chunks, CHUNK, ARROW_CHUNK)(content)


def boxes_of(content: Column) -> Column:
    """Like chunks_of, of any content taken as the boxes of a JPEG 2000 file."""
    return walked(boxes, CHUNK, ARROW_CHUNK)(content)


def directories_of(content: Column) -> Column:
    """An array of a TIFF file's directories: start, tags (an array of tag, type, count, value, values and error) and error ('bad
    header', 'cut', 'loop', 'no directory'). Null and other files: empty."""
    return walked(directories, DIRECTORY, ARROW_DIRECTORY)(content)
