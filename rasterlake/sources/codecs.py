"""Small lossless codecs between file bytes and (height, width, 4) arrays, from the formats' specifications.

decode(format, bytes) gives one array for each frame that the format's plain form holds; encode(format, array) gives bytes.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: Fixed value: the end of a TGA file.
TGA_FOOTER = bytes(8) + b"TRUEVISION-XFILE.\0"


def opaque(rgb: np.ndarray) -> np.ndarray:
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255, dtype=np.uint8)], axis=2)


def sized(width: int, height: int) -> tuple[int, int]:
    if width <= 0 or height <= 0 or width * height > 1 << 28:
        raise ValueError(f"bad size {width} x {height}")
    return width, height


def decode_pnm(data: bytes) -> np.ndarray:
    kind, header, at = data[1] - 48, [], 2
    while len(header) < (2 if kind in (1, 4) else 3):
        m = re.compile(rb"(?:\s|#[^\n\r]*)*(\d+)").match(data, at)
        if m is None:
            raise ValueError("bad Netpbm header")
        header.append(int(m[1]))
        at = m.end()
    (width, height), most, channels = sized(*header[:2]), (header + [1])[2], 3 if kind in (3, 6) else 1
    if kind < 4:
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        v = np.array(list(body.translate(None, b" \t\r\n")) if kind == 1 else body.split(), dtype=np.int64) - (48 if kind == 1 else 0)
    elif kind == 4:
        v = np.unpackbits(np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1).reshape(height, -1), axis=1)[:, :width].ravel()
    else:
        v = np.frombuffer(data, np.uint8 if most < 256 else ">u2", width * height * channels, at + 1)
    v = v.astype(np.int64)[: width * height * channels].reshape(height, width, channels)
    v = (1 - v) * 255 if kind in (1, 4) else (v * 255 + most // 2) // most
    return opaque(np.repeat(v, 3 // channels, axis=2).astype(np.uint8))


def gray_levels(px: np.ndarray) -> np.ndarray:
    return (px[..., :3].astype(np.int64) @ [299, 587, 114] + 500) // 1000


def encode_pnm(kind: str, px: np.ndarray) -> bytes:
    head = f"{px.shape[1]} {px.shape[0]}\n"
    if kind == "pbm":
        return f"P4\n{head}".encode() + np.packbits(gray_levels(px) < 128, axis=1).tobytes()
    if kind == "pgm":
        return f"P5\n{head}255\n".encode() + gray_levels(px).astype(np.uint8).tobytes()
    return f"P6\n{head}255\n".encode() + px[..., :3].tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    width, rows = sized(width, abs(height))
    if depth not in (24, 32) or packing not in (0, 3):
        raise ValueError(f"BMP of {depth} bits, packing {packing}")
    stride = (width * depth + 31) // 32 * 4
    px = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)[:, : width * depth // 8].reshape(rows, width, -1)
    px = px[::-1] if height > 0 else px
    return opaque(px[..., 2::-1]) if depth == 24 or packing == 0 else px[..., [2, 1, 0, 3]]


def encode_bmp(px: np.ndarray) -> bytes:
    height, width = px.shape[:2]
    alpha = bool((px[..., 3] != 255).any())
    body = px[::-1, :, [2, 1, 0, 3][: 3 + alpha]].reshape(height, -1)
    body = np.pad(body, ((0, 0), (0, -body.shape[1] % 4))).tobytes()
    info = struct.pack("<IiiHHIIiiII", 108 if alpha else 40, width, height, 1, 24 + 8 * alpha, 3 * alpha, len(body), 2835, 2835, 0, 0)
    if alpha:
        info += struct.pack("<IIII4s", 0xFF0000, 0xFF00, 0xFF, 0xFF000000, b"BGRs") + bytes(48)
    return struct.pack("<2sIII", b"BM", 14 + len(info) + len(body), 0, 14 + len(info)) + info + body


def decode_tga(data: bytes) -> np.ndarray:
    skip, _, kind, *_, width, height, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    width, height = sized(width, height)
    if kind not in (2, 3, 10, 11) or depth not in (8, 24, 32):
        raise ValueError(f"TGA of type {kind}, {depth} bits")
    size, at, n = depth // 8, 18 + skip, width * height
    if kind < 8:
        flat = np.frombuffer(data, np.uint8, n * size, at)
    else:
        out = bytearray()
        while len(out) < n * size:
            count = (data[at] & 127) + 1
            step = size if data[at] & 128 else size * count
            out += data[at + 1 : at + 1 + step] * (count if data[at] & 128 else 1)
            at += 1 + step
        flat = np.frombuffer(bytes(out[: n * size]), np.uint8)
    px = flat.reshape(height, width, size)
    px = px[:: 1 if flags & 32 else -1, :: -1 if flags & 16 else 1]
    return opaque(np.repeat(px, 3, axis=2)) if size == 1 else opaque(px[..., ::-1]) if size == 3 else px[..., [2, 1, 0, 3]]


def encode_tga(px: np.ndarray) -> bytes:
    height, width = px.shape[:2]
    alpha = bool((px[..., 3] != 255).any())
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, width, height, 24 + 8 * alpha, 32 | 8 * alpha)
    return head + px[..., [2, 1, 0, 3][: 3 + alpha]].tobytes() + TGA_FOOTER


def decode_qoi(data: bytes) -> np.ndarray:
    width, height = sized(*struct.unpack_from(">II", data, 4))
    out, n, at = bytearray(), width * height, 14
    seen, now = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255)
    while len(out) < 4 * n:
        op, run = data[at], 1
        at += 1
        if op >= 254:
            size = 3 + (op & 1)
            now = (*data[at : at + size], *now[size:])
            at += size
        elif op >> 6 == 3:
            run = (op & 63) + 1
        elif op >> 6 == 0:
            now = seen[op]
        else:
            if op >> 6 == 1:
                step = (op >> 4 & 3) - 2, (op >> 2 & 3) - 2, (op & 3) - 2
            else:
                green = (op & 63) - 32
                step = green - 8 + (data[at] >> 4), green, green - 8 + (data[at] & 15)
                at += 1
            now = (*((c + d) & 255 for c, d in zip(now, step, strict=False)), now[3])
        seen[(now[0] * 3 + now[1] * 5 + now[2] * 7 + now[3] * 11) & 63] = now
        out += bytes(now) * run
    return np.frombuffer(bytes(out[: 4 * n]), np.uint8).reshape(height, width, 4)


def encode_qoi(px: np.ndarray) -> bytes:
    out = bytearray(struct.pack(">4sIIBB", b"qoif", px.shape[1], px.shape[0], 4, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for now in map(tuple, px.reshape(-1, 4).tolist()):
        if now == last:
            run += 1
            if run == 62:
                out.append(192 + run - 1)
                run = 0
            continue
        if run:
            out.append(192 + run - 1)
            run = 0
        slot = (now[0] * 3 + now[1] * 5 + now[2] * 7 + now[3] * 11) & 63
        r, g, b = ((n - p + 128 & 255) - 128 for n, p in zip(now[:3], last[:3], strict=True))
        if seen[slot] == now:
            out.append(slot)
        elif now[3] != last[3]:
            out += bytes((255, *now))
        elif -2 <= r < 2 and -2 <= g < 2 and -2 <= b < 2:
            out.append(64 | r + 2 << 4 | g + 2 << 2 | b + 2)
        elif -32 <= g < 32 and -8 <= r - g < 8 and -8 <= b - g < 8:
            out += bytes((128 | g + 32, r - g + 8 << 4 | b - g + 8))
        else:
            out += bytes((254, *now[:3]))
        seen[slot], last = now, now
    return bytes(out + (bytes([192 + run - 1]) if run else b"") + bytes(7) + b"\1")


def unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One PNG row without its filter; row and above are bytes, step the bytes of a pixel."""
    if kind in (0, 2):
        return row + above if kind else row
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = bytearray(row.tobytes())
    up = above.tobytes()
    for i in range(len(out)):
        a, b, c = (out[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = out[i] + guess & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    at, body, palette, clear = 8, [], None, b""
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + chunk) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("bad PNG checksum")
        at += 12 + size
        if name == b"IHDR":
            width, height, depth, color, *_, laced = struct.unpack(">IIBBBBB", chunk)
            sized(width, height)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = chunk
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
    if laced or color not in (0, 2, 3, 4, 6):
        raise ValueError("interlaced PNG" if laced else f"PNG colour type {color}")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step, stride = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, stride + 1)
    rows, above = [], np.zeros(stride, np.uint8)
    for line in raw:
        above = unfilter(int(line[0]), line[1:], above, step)
        rows.append(above)
    px = np.stack(rows)
    if depth < 8:
        bits = np.unpackbits(px, axis=1).reshape(height, -1, depth)
        px = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :width]
        px = px if color == 3 else (px.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    elif depth == 16:
        wide = px.reshape(height, -1, 2)
        px = np.rint((wide[..., 0] * 256.0 + wide[..., 1]) * 255 / 65535).astype(np.uint8) if channels < 3 else wide[..., 0]
    px = px.reshape(height, width, channels)
    if color == 3:
        table = np.full((256, 4), 255, np.uint8)
        table[: len(palette), :3] = palette
        table[: len(clear), 3] = np.frombuffer(clear, np.uint8)
        return table[px[..., 0]]
    if channels < 3:
        grey = np.repeat(px[..., :1], 3, axis=2)
        return opaque(grey) if channels == 1 else np.concatenate([grey, px[..., 1:]], axis=2)
    return px if channels == 4 else opaque(px)


def encode_png(px: np.ndarray) -> bytes:
    alpha = bool((px[..., 3] != 255).any())
    raw = px[..., : 3 + alpha].reshape(px.shape[0], -1)
    raw = np.concatenate([np.zeros((len(raw), 1), np.uint8), raw], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    head = struct.pack(">IIBBBBB", px.shape[1], px.shape[0], 8, 6 if alpha else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


DECODERS = {"png": decode_png, "bmp": decode_bmp, "tga": decode_tga, "qoi": decode_qoi, "pbm": decode_pnm, "pgm": decode_pnm, "ppm": decode_pnm}
ENCODERS = {"png": encode_png, "bmp": encode_bmp, "tga": encode_tga, "qoi": encode_qoi, **{k: (lambda px, k=k: encode_pnm(k, px)) for k in ("pbm", "pgm", "ppm")}}


def decode(kind: str | None, data: bytes) -> np.ndarray:
    if kind not in DECODERS:
        raise ValueError(f"no decoder for {kind}")
    return np.ascontiguousarray(DECODERS[kind](data))
