import struct

import numpy as np
import pytest

from rasterlake.operators import bitmaps

RNG = np.random.default_rng(5)


def info(kind, w, h, depth, code=0, used=0, masks=(0, 0, 0, 0), space=0, intent=0, profile=(0, 0)):
    if kind == 12:
        return struct.pack("<IHHHH", 12, w, h, 1, depth)
    head = struct.pack("<IiiHH", kind, w, h, 1, depth)
    if kind > 16:
        head += struct.pack("<iiiiii", code, 7, 2835, -1, used, 3)
    if kind in (52, 56, 108, 124):
        head += struct.pack("<4I", *masks)[: 16 if kind != 52 else 12]
    if kind in (108, 124):
        head += struct.pack("<I", space) + bytes(48)
    if kind == 124:
        head += struct.pack("<IiiI", intent, *profile, 0)
    return head.ljust(kind, b"\0")


def bmp(head, more=b"", data=b"", after=b"", base=b""):
    start = len(base) + 14 + len(head) + len(more)
    return base + b"BM" + struct.pack("<IHHI", start + len(data), 0, 0, start) + head + more + data + after


def masked(word, mask):
    """A channel, read bit by bit."""
    if not mask:
        return 255
    low = next(k for k in range(32) if mask >> k & 1)
    n = bin(mask).count("1")
    return min((word & mask) // 2**low * (256 // 2**n if n < 8 else 1), 255)


def bmp_rows(w, h, depth, flipped):
    """(data, samples by y and x from the top): samples are whole words of a pixel's bits."""
    top = [[int(RNG.integers(0, 1 << min(depth, 32))) for _ in range(w)] for _ in range(h)]
    data = b""
    for y in range(h) if flipped else reversed(range(h)):
        if depth >= 8:
            row = b"".join(v.to_bytes(depth // 8, "little") for v in top[y])
        else:
            bits = "".join(f"{v:0{depth}b}" for v in top[y])
            row = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
        data += row + bytes(-len(row) % 4)
    return data, top


def read(df, spark):
    out = {}
    for r in df.collect():
        assert (r.y, r.x) not in out.setdefault(r.id, {})
        out[r.id][r.y, r.x] = (r.r, r.g, r.b, r.a)
    return out


def test_bmp_pixels(spark):
    files, want = [], {}
    for kind in (12, 16, 40, 64, 52, 56, 108, 124, 48):
        for depth in (1, 2, 4, 8, 16, 24, 32):
            for w, h, used in ((1, 1, 0), (5, 3, 0), (9, 2, 3)):
                flipped = kind != 12 and w == 5
                masks = (0xF800, 0x07E0, 0x001F, 0) if depth == 16 else (0x3FF00000, 0x000FFC00, 0x000003F0, 0x0000000F)
                data, top = bmp_rows(w, h, depth, flipped)
                n, size = used if used and kind > 16 and depth < 16 else 1 << depth if depth <= 8 else 0, 3 if kind == 12 else 4
                palette = RNG.integers(0, 256, (n, size), dtype=np.uint8)
                i = len(files)
                files.append((i, bmp(info(kind, w, -h if flipped else h, depth, used=used, masks=masks), palette.tobytes(), data), kind))
                if kind in (12, 16):
                    masks = (0, 0, 0, 0)
                elif kind in (40, 48, 64):
                    masks = (0x7C00, 0x03E0, 0x001F, 0) if depth == 16 else (0xFF0000, 0xFF00, 0xFF, 0xFF000000)
                elif kind == 52:
                    masks = (*masks[:3], 0 if depth == 16 else 0xFF000000)
                color = lambda v: tuple(map(int, palette[v][[2, 1, 0]])) + (255,) if v < len(palette) else (0, 0, 0, 255)  # noqa: B023, E731
                one = lambda v: color(v) if depth <= 8 else (v >> 16, v >> 8 & 255, v & 255, 255) if depth == 24 else tuple(masked(v, m) for m in masks)  # noqa: B023, E731
                want[i] = {(y, x): one(v) for y, row in enumerate(top) for x, v in enumerate(row)}
    # Masks after a v3 header, a bitmap array, and 64 bits of linear light.
    data, top = bmp_rows(3, 2, 32, False)
    for code, masks in ((3, (0xFF, 0xFF00, 0xFF0000)), (6, (0xFF, 0xFF00, 0xFF0000, 0xFF000000)), (6, (0xFF, 0, 0xFF0000, 0x80000000))):
        files.append((len(files), bmp(info(40, 3, 2, 32, code), struct.pack(f"<{len(masks)}I", *masks), data), 40))
        four = (*masks, 0xFF000000)[:4]
        want[len(files) - 1] = {(y, x): tuple(masked(v, m) for m in four) for y, row in enumerate(top) for x, v in enumerate(row)}
    files.append((len(files), bmp(info(40, 3, 2, 32), b"", data, base=b"BA" + bytes(12)), 40))
    want[len(files) - 1] = {(y, x): (v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24) for y, row in enumerate(top) for x, v in enumerate(row)}
    files.append((len(files), bmp(info(40, 2, 1, 64), b"", struct.pack("<8H", 0, 8192, 4096, 4096, 0xFFFF, 9000, 0, 8192)), 40))
    want[len(files) - 1] = {(0, 0): (188, 255, 0, 128), (0, 1): (0, 255, 0, 255)}
    df = spark.createDataFrame(files, "id int, content binary, source int")
    out = bitmaps.bmp_pixels(df)
    assert out.columns == ["id", "source", "y", "x", "r", "g", "b", "a"]
    assert read(out, spark) == want


def test_bmp_headers(spark):
    rgb = bytes(64)
    profile = bmp(info(124, 2, 2, 24, space=bitmaps.EMBEDDED, intent=4, profile=(124 + 16, 5)), b"", bytes(16), b"12345")
    cases = [
        (profile, None), (bmp(info(40, 2, 2, 8, used=2), bytes(8), rgb), None), (bmp(info(40, 2, 2, 8, 1), bytes(1024), b"x"), "compressed"), (bmp(info(64, 2, 2, 24, 4), b"", b"x"), "compressed"), (bmp(info(40, 2, 2, 24, 4), b"", b"x"), "compression"), (bmp(info(108, 2, 2, 24, 4), b"", b"x"), "compressed"),
        (bmp(info(40, 2, 2, 4, 1), bytes(64), rgb), "compression"), (bmp(info(40, 2, 2, 24, 101), b"", rgb), "compression"), (bmp(info(64, 2, 2, 8, 3), b"", rgb), "compression"), (bmp(info(40, 0, 2, 24), b"", rgb), "no size"), (bmp(info(40, -2, 2, 24), b"", rgb), "no size"), (bmp(info(40, 2, -(2**31), 24), b"", rgb), "no size"),
        (bmp(info(40, 2, 2, 3), b"", rgb), "depth"), (bmp(info(40, 2, 2, 8, used=2**31 - 1), b"", rgb), "cut"), (bmp(info(40, 2**31 - 1, 2**31 - 1, 32), b"", rgb), "short"), (bmp(info(40, 2, 2, 24), b"", bytes(15)), "short"), (bmp(struct.pack("<I", 20) + bytes(60)), "header size"), (bmp(struct.pack("<i", -5) + bytes(60)), "header size"), (bmp(struct.pack("<I", 4000) + bytes(60)), "cut"),
        (bmp(info(40, 2, 2, 32, 3), b"", b"123"), "cut"), (b"BM", "cut"), (b"", "no bitmap"), (None, "no bitmap"), (b"GIF89a", "no bitmap"), (b"BA" + bytes(12) + b"CI", "icon"), (b"PT" + bytes(40), "icon"), (b"BA", "no bitmap"), (bytes(3), "no bitmap"),
    ]
    df = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(cases)], "id int, content binary")
    rows = {r.id: r for r in bitmaps.bmp_images(df).collect()}
    assert {k: r.error for k, r in rows.items()} == {k: e for k, (_, e) in enumerate(cases)}
    assert (rows[0].kind, rows[0].intent, rows[0].profile_start, rows[0].profile_size, rows[0].palette_colors) == ("v5", 4, len(profile) - 5, 5, 0)
    assert (rows[1].kind, rows[1].image_size, rows[1].x_per_meter, rows[1].y_per_meter, rows[1].colors_used, rows[1].colors_important, rows[1].palette_start, rows[1].profile_start) == ("v3", 7, 2835, -1, 2, 3, 54, None)
    assert {r.id: r["count"] for r in bitmaps.bmp_palettes(df).groupBy("id").count().collect()} == {1: 2, 2: 256}
    assert {r.id for r in bitmaps.bmp_pixels(df).select("id").distinct().collect()} == {0, 1}
    assert bitmaps.bmp_pixels(df.limit(0)).count() == 0


@pytest.mark.parametrize("length", [0, 5, 13, 14, 17, 18, 25, 26, 40, 53])
def test_cut_bitmaps_are_errors(spark, length):
    data = b"".join(bmp(info(kind, 2, 2, 24), b"", bytes(16))[:length] for kind in (40,))
    row = bitmaps.bmp_images(spark.createDataFrame([(data,)], "content binary")).first()
    assert row.error in ("no bitmap", "cut")


def tga(kind, w, h, depth, flags=0, name=b"", colors=b"", origin=0, n=0, map_depth=0, data=b"", map_type=None):
    return struct.pack("<BBBHHBHHHHBB", len(name), int(n > 0) if map_type is None else map_type, kind, origin, n, map_depth, 1, 2, w, h, depth, flags) + name + colors + data


def of_16(v, lucid):
    up = lambda x: x << 3 | x >> 2
    return up(v >> 10 & 31), up(v >> 5 & 31), up(v & 31), (255 if v >> 15 else 0) if lucid else 255


def test_tga_pixels(spark):
    files, want = [], {}
    w, h = 3, 2
    for kind, depth, map_depth in [(2, 16, 0), (2, 24, 0), (2, 32, 0), (3, 8, 0), (3, 16, 0), (0, 24, 0), *[(1, d, m) for d in (8, 16) for m in (16, 24, 32)]]:
        for flags in range(0, 64, 8):
            size, n, origin = depth // 8, 6 if map_depth else 0, 2 if map_depth and flags & 16 else 0
            top = RNG.integers(0, 8 if map_depth and depth == 8 else 256, (h, w, size)).astype(np.uint8)
            if map_depth:
                top[0, :, 0] = [0, 5, 7]
            held = RNG.integers(0, 256, (n, map_depth // 8), dtype=np.uint8)
            seen = top[::-1] if not flags & 32 else top
            seen = seen[:, ::-1] if flags & 16 else seen
            i = len(files)
            files.append((i, tga(kind, w, h, depth, flags, b"name"[: flags % 3], held.tobytes(), origin, n, map_depth, b"" if kind == 0 else seen.tobytes())))

            def word(b):
                return int.from_bytes(bytes(b), "little")

            def color(p):
                if kind == 0:  # noqa: B023
                    return 0, 0, 0, 0
                if kind == 3:  # noqa: B023
                    return (int(p[0]),) * 3 + (int(p[1]) if depth == 16 else 255,)  # noqa: B023
                if kind == 1:  # noqa: B023
                    if p[0] >= n:  # noqa: B023
                        return 0, 0, 0, 255
                    p = [*held[origin:].tolist(), *[[0] * (map_depth // 8)] * origin][p[0]]  # noqa: B023
                lucid = flags % 16 > 0 and depth == 16  # noqa: B023
                return of_16(word(p), lucid) if len(p) == 2 else (int(p[2]), int(p[1]), int(p[0]), int(p[3]) if len(p) == 4 else 255)

            want[i] = {(y, x): color(top[y, x]) for y in range(h) for x in range(w)}
    df = spark.createDataFrame(files, "id int, content binary")
    assert read(bitmaps.tga_pixels(df), spark) == want


def test_tga_headers(spark):
    six = bytes(18)
    cases = [
        (tga(2, 2, 3, 24, data=six), None), (tga(10, 2, 3, 24, data=six), "compressed"), (tga(2, 2, 3, 24, data=six[1:]), "short"), (tga(4, 2, 3, 24, data=six), "image type"), (tga(2, 0, 3, 24), "no size"), (tga(2, 2, 3, 15, data=six), "depth"), (tga(3, 2, 3, 24, data=six), "depth"), (tga(1, 2, 3, 24, n=1, map_depth=24, colors=bytes(3), data=six), "depth"),
        (tga(1, 2, 3, 8, data=six), "no map"), (tga(1, 2, 3, 8, n=2, map_depth=15, colors=bytes(4), data=six), "map"), (tga(1, 2, 3, 8, n=2, origin=3, map_depth=24, colors=bytes(9), data=six), "map"), (tga(1, 2, 3, 8, n=60000, map_depth=24, data=six), "cut"), (tga(2, 65535, 65535, 32, data=six), "short"), (tga(2, 2, 3, 24, n=2, map_depth=24, colors=bytes(6), data=six), None),
        (six[:17], "cut"), (b"", "cut"), (None, "cut"), (tga(0, 1, 1, 24), None),
    ]
    df = spark.createDataFrame([(k, d) for k, (d, _) in enumerate(cases)], "id int, content binary")
    rows = {r.id: r for r in bitmaps.tga_images(df).collect()}
    assert {k: r.error for k, r in rows.items()} == {k: e for k, (_, e) in enumerate(cases)}
    assert (rows[13].data_start, rows[0].x_origin, rows[0].y_origin, rows[0].bottom_up, rows[0].right_to_left, rows[0].alpha_bits) == (24, 1, 2, True, False, 0)
    assert {r.id: r["count"] for r in bitmaps.tga_pixels(df).groupBy("id").count().collect()} == {0: 6, 13: 6, 17: 1}
    assert bitmaps.tga_pixels(df.limit(0)).count() == 0
