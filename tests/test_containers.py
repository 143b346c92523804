import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import chunks, headers
from rasterlake.operators import containers, tiff
from rasterlake.plans.containers import cursor_files, tiff_frame, tiled_places, webp_files


def png(*parts):
    return chunks.PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def riff(kind, data):
    return kind + struct.pack("<I", len(data)) + data + bytes(len(data) & 1)


FRAME = struct.pack("<HBHBHBHBHBB", 1, 0, 2, 0, 9, 0, 4, 0, 70, 0, 3)
WEBP = riff(b"RIFF", b"WEBP" + riff(b"VP8X", bytes([2]) + bytes(9)) + riff(b"ANIM", b"bgra" + struct.pack("<H", 5)) + riff(b"ANMF", FRAME + riff(b"ALPH", b"abc") + riff(b"VP8 ", b"dd")) + riff(b"ANMF", FRAME + riff(b"VP8L", b"e")) + riff(b"EXIF", b"x"))
GIF = b"GIF89a" + b"\1\0\1\0\x80\0\0abcdef" + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x07\x01\x00" + b"\x21\xf9\x04abcd\x00" + b"\x2c" + bytes(9) + b"\x02\x02ab\x00;"
HEAD = struct.pack("<9I", 36, 2, 2, 0, 0, 0, 0, 11, 1)
ANI = riff(b"RIFF", b"ACON" + riff(b"LIST", b"INFO" + riff(b"INAM", b"name\0")) + riff(b"anih", HEAD) + riff(b"LIST", b"fram" + riff(b"icon", b"one") + riff(b"icon", b"four")) + riff(b"icon", b"stray"))
PNG = png((b"IHDR", bytes(13)), (b"tEXt", b"hello"), (b"IEND", b""))


def told(data):
    return [(kind, parent, size, error) for _, parent, kind, _, size, _, error in chunks.chunks(data)]


def test_walks():
    assert told(PNG) == [("IHDR", None, 13, None), ("tEXt", None, 5, None), ("IEND", None, 0, None)] == told(PNG + b"more")
    assert told(WEBP) == [("RIFF/WEBP", None, len(WEBP) - 12, None), ("VP8X", 0, 10, None), ("ANIM", 0, 6, None), ("ANMF", 0, 22, None), ("ALPH", 3, 3, None), ("VP8 ", 3, 2, None), ("ANMF", 0, 10, None), ("VP8L", 6, 1, None), ("EXIF", 0, 1, None)]
    assert told(GIF) == [("ext/FF", None, 17, None), ("ext/F9", None, 6, None), ("image", None, 14, None), ("end", None, 1, None)]
    assert [t[0] for t in told(ANI)] == ["RIFF/ACON", "LIST/INFO", "INAM", "anih", "LIST/fram", "icon", "icon", "icon"] and told(ANI)[-1][1] == 0
    assert told(png((b"IDAT", b""), (b"IEND", b"")))[0][3] == "not a header"
    assert told(chunks.PNG + b"\xff\xff\xff\xffIHDR" + bytes(30)) == [("IHDR", None, (1 << 32) - 1, "cut")]
    wrong = bytearray(PNG)
    wrong[45] ^= 1
    assert [c[5] for c in chunks.chunks(bytes(wrong))] == [True, False, True]
    assert told(riff(b"RIFF", b"WEBP" + riff(b"ANMF", b"short")))[1] == ("ANMF", 0, 5, "short")
    deep = b"RIFF" + struct.pack("<I", 4 + 12 * 50_000) + b"WEBP" + b"".join(b"LIST" + struct.pack("<I", 4 + 12 * (49_999 - k)) + b"abcd" for k in range(50_000))
    assert len(chunks.chunks(deep)) == 50_001 and chunks.chunks(deep)[-1][:2] == (50_000, 49_999)


@pytest.mark.parametrize("data", [PNG, WEBP, GIF, ANI])
def test_cut_and_changed_files_end(data):
    rng = np.random.default_rng(0)
    for k in range(len(data)):
        for own in (data[:k], data[:k] + bytes([int(rng.integers(256))]) + data[k + 1 :]):
            rows = chunks.chunks(own)
            assert len(rows) <= len(own) and all(0 <= r[3] <= len(own) for r in rows)
            if own is not data and len(own) < len(data) and rows:
                assert any(r[6] for r in rows)  # no cut file passes for a whole one


def test_frames_steps_and_loops(spark):
    zero = PNG[:8]
    files = spark.createDataFrame([(k, d) for k, d in enumerate([PNG, WEBP, GIF, ANI, None, b"", zero, WEBP[:-20], ANI.replace(b"anih", b"anix"), WEBP.replace(b"VP8 ", b"XXXX")])], "id long, content binary")
    table = containers.chunk_table(files)
    assert table.columns == ["id", "chunk", "depth", "parent", "kind", "start", "size", "crc_ok", "error"]
    assert {r.id: r["count"] for r in table.groupBy("id").count().collect()} == {0: 3, 1: 9, 2: 4, 3: 8, 6: 1, 7: len(told(WEBP[:-20])), 8: 8, 9: 9}
    at = WEBP.index(b"dd")
    frames = [tuple(r) for r in containers.webp_frames(files).orderBy("id", "frame_idx").collect()]
    assert frames[0] == (1, 0, 2, 4, 10, 5, 70, False, True, True, at, 2, WEBP.index(b"abc"), 3)
    assert frames[1][:3] == (1, 1, 2) and frames[1][9:] == (False, WEBP.index(b"VP8L") + 8, 1, None, None)
    assert [f[0] for f in frames] == [1, 1, 7, 9, 9]  # what follows an alpha plane is the data, of whatever kind
    steps = [tuple(r) for r in containers.cursor_steps(files).orderBy("id", "step").collect()]
    assert steps == [(3, 0, 0, 11, ANI.index(b"one"), 3), (3, 1, 1, 11, ANI.index(b"four"), 4)]
    loops = files.select("id", headers.loop_count(F.col("content")).alias("n")).collect()
    assert {r.id: r.n for r in loops if r.n is not None} == {1: 5, 2: 263, 7: 5, 9: 5}


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_cursor_files_are_made_once_and_by_all_tasks(spark, sf_dir):
    files = cursor_files(spark, sf_dir)
    assert plan(files).count("repeat(EF") == 4  # once for each of up to four icons
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_webp_files_are_made_once_and_by_all_tasks(spark, sf_dir):
    files = webp_files(spark, sf_dir)
    assert plan(files).count("repeat(AB") == 4  # once for each of up to four frames
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_webp_frames_walks_files_once(spark):
    files = spark.createDataFrame([(1, WEBP), (2, WEBP.replace(b"VP8X\x0a\0\0\0\2", b"VP8X\x0a\0\0\0\0")), (3, None)], "id long, content binary")
    frames = containers.webp_frames(files)
    assert plan(frames).count("ArrowEvalPython") == 1
    assert [(r.id, r.frame_idx) for r in frames.orderBy("id", "frame_idx").collect()] == [(1, 0), (1, 1)]


def picture(h, w, samples, bits, seed=0):
    return np.random.default_rng(seed).integers(0, 1 << bits, (h, w, samples), dtype=np.uint64)


def stored(px, bits, order, tile=None, rows=3, planar=False):
    """(data, the lengths of its strips or tiles)."""
    h, w, samples = px.shape
    parts = []
    for plane in [px[:, :, k : k + 1] for k in range(samples)] if planar else [px]:
        flat = plane.reshape(h * w, -1)
        places = [np.array(p).reshape(-1, tile[0]) for p in tiled_places(w, h, tile)] if tile else [np.arange(h * w).reshape(h, w)[k : k + rows] for k in range(0, h, rows)]
        for p in places:
            values = np.where((p >= 0)[..., None], flat[np.maximum(p, 0)], 0)
            if bits == 1:
                parts.append(np.packbits(values[..., 0].astype(np.uint8), axis=1).tobytes())
            else:
                parts.append(values.astype(f"{order}u{bits // 8}").tobytes())
    return b"".join(parts), [len(p) for p in parts]


def file_of(px, bits, order="<", big=False, tile=None, rows=3, planar=False, **tags):
    data, sizes = stored(px, bits, order, tile, rows, planar)
    at = 16 if big else 8
    own = {tiff.WIDTH: ("H", [px.shape[1]]), tiff.HEIGHT: ("I", [px.shape[0]]), tiff.BITS: ("H", [bits] * px.shape[2]), tiff.SAMPLES: ("H", [px.shape[2]]), tiff.PLANAR: ("H", [1 + planar])}
    places, counts = ("Q" if big else "I", [at + sum(sizes[:k]) for k in range(len(sizes))]), ("I", sizes)
    own |= {tiff.TILE_WIDTH: ("H", [tile[0]]), tiff.TILE_HEIGHT: ("H", [tile[1]]), tiff.TILE_OFFSETS: places, tiff.TILE_COUNTS: counts} if tile else {tiff.STRIP_ROWS: ("I", [rows]), tiff.STRIP_OFFSETS: places, tiff.STRIP_COUNTS: counts}
    own |= {getattr(tiff, k): v for k, v in tags.items()}
    head, tail = tiff_frame(order, big, len(data), {k: v for k, v in own.items() if v})
    return head + data + tail


def seen(px, bits, kind, extra=None, colors=None, order="<"):
    """RGBA as this format's reader takes it: the last byte of a sample."""
    if bits == 1:
        s = px.astype(int) * (1 if kind == 3 else 255)
    else:
        s = px.astype(f"{order}u{bits // 8}").view(np.uint8).reshape(*px.shape, -1)[..., -1].astype(int)
    alpha = np.full(px.shape[:2], 255)
    if kind in (0, 1):
        rgb = np.repeat(s[..., :1] if kind else 255 - s[..., :1], 3, axis=2)
        alpha = s[..., 1] if extra in (1, 2) else alpha
    elif kind == 2:
        rgb, alpha = s[..., :3], s[..., 3] if px.shape[2] > 3 else alpha
    elif kind == 3:
        n = 1 << bits
        rgb = np.stack([np.array(colors)[k * n + s[..., 0]] >> 8 for k in range(3)], axis=2)
    else:
        rgb = (255 - s[..., :3]) * (255 - s[..., 3:4]) // 255
        alpha = s[..., 4] if px.shape[2] > 4 else alpha
    return np.concatenate([rgb, alpha[..., None]], axis=2)


def test_tiff_pixels(spark):
    cases, want = [], {}
    kinds = [(1, 1, 0), (1, 8, 1), (1, 16, 0), (1, 32, 1), (1, 64, 1), (2, 8, 1), (3, 8, 2), (4, 16, 2), (5, 8, 2), (3, 32, 2), (1, 8, 3), (1, 1, 3), (4, 8, 5), (5, 16, 5)]
    for n, (samples, bits, kind) in enumerate(kinds):
        for order, big, tile, planar in (("<", False, None, False), (">", True, None, True), ("<", True, (5, 4), True), (">", False, (8, 16), False), (">", False, (16, 2), True)):
            if bits == 1 and tile and tile[0] % 8:
                tile = (8, 4)
            px = picture(7, 11, samples, bits, n)
            colors = np.random.default_rng(n).integers(0, 65536, 3 << min(bits, 8)).tolist() if kind == 3 else None
            tags = {"PHOTOMETRIC": ("H", [kind]), "COLOR_MAP": ("H", colors) if colors else None, "EXTRA": ("H", [2]) if kind == 1 and samples == 2 else None}
            want[len(cases)] = seen(px, bits, kind, 2 if tags["EXTRA"] else None, colors, order)
            cases.append(file_of(px, bits, order, big, tile, 3, planar, **tags))
    files = spark.createDataFrame(list(enumerate(cases)), "id long, content binary").repartition(4)
    errors = [r for r in tiff.tiff_images(files).collect() if r.error]
    assert not errors, errors[:2]
    got = {k: np.full(w.shape, -1) for k, w in want.items()}
    n = 0
    for r in tiff.tiff_pixels(files).collect():
        got[r.id][r.y, r.x] = r.r, r.g, r.b, r.a
        n += 1
    assert n == 77 * len(cases)
    for k, w in want.items():
        assert np.array_equal(got[k], w), k


def test_tiff_luma(spark):
    px = picture(3, 4, 3, 8)
    file = file_of(px, 8, PHOTOMETRIC=("H", [6]), SUBSAMPLING=("H", [1, 1]))
    files = spark.createDataFrame([(1, file), (2, file_of(px, 8, PHOTOMETRIC=("H", [6])))], "id long, content binary")
    rows = tiff.tiff_pixels(files).collect()
    assert len(rows) == 12 and {r.id for r in rows} == {1}
    y, cb, cr = (px[..., k].astype(np.float32) for k in range(3))
    assert np.array_equal(np.array([r.r for r in sorted(rows, key=lambda r: (r.y, r.x))]), np.clip(y + np.float32(2) * (np.float32(1) - np.float32(0.299)) * (cr - 128), 0, 255).astype(int).ravel())
    assert cb.shape == y.shape


def test_bad_tiff_files_are_rows(spark):
    px = picture(7, 5, 1, 8)
    good = file_of(px, 8, ">")
    tail = len(good) - 4 if good.endswith(bytes(4)) else len(good)
    cases = {
        "": good,
        "no size": file_of(px, 8, WIDTH=("H", [0])),
        "no strips or tiles": file_of(px, 8, STRIP_OFFSETS=None),
        "unsupported": file_of(px, 8, COMPRESSION=("H", [5])),
        "short": file_of(px, 8, STRIP_COUNTS=("I", [15, 15, 4])),
        "no color map": file_of(px, 8, PHOTOMETRIC=("H", [3])),
        "cut": good[:60],
        "bad header": b"II" + struct.pack("<HHHQ", 43, 4, 0, 16) + bytes(20),
        "no directory": b"MM\0*" + bytes(8),
    }
    assert tail
    many = dict(cases)
    many["values"] = file_of(px, 8, STRIP_OFFSETS=("I", [4_000_000_000] * 3))
    huge = bytearray(good)
    at = good.index(struct.pack(">HHI", tiff.STRIP_OFFSETS, 4, 3))
    huge[at + 4 : at + 8] = struct.pack(">I", 4_000_000_000)
    many["count"] = bytes(huge)
    files = spark.createDataFrame([(k, v) for k, v in many.items()] + [("null", None), ("other", b"hello world")], "id string, content binary")
    found = {r.id: r.error for r in tiff.tiff_images(files).collect()}
    assert found == {**{k: k or None for k in cases}, "values": "short", "count": "no strips or tiles"}
    assert {(r.id, r.tag) for r in tiff.tiff_entries(files).where("error = 'beyond the file'").collect()} == {("count", tiff.STRIP_OFFSETS)}
    assert {r.id for r in tiff.tiff_pixels(files).select("id").distinct().collect()} == {""}
    rng = np.random.default_rng(0)
    noisy = []
    for k in range(0, len(good), 2):
        other = bytearray(good)
        other[k] = int(rng.integers(256))
        noisy += [(k, good[:k]), (k, bytes(other))]
    df = spark.createDataFrame(noisy, "id long, content binary")
    assert tiff.tiff_entries(df).count() > 0 and tiff.tiff_images(df).count() > 0


def test_two_directories(spark):
    px, other = picture(4, 4, 1, 8, 1), picture(2, 3, 1, 8, 2)
    a, b = file_of(px, 8), file_of(other, 8)
    at = struct.unpack_from("<I", a, 4)[0]
    end = at + 2 + 12 * struct.unpack_from("<H", a, at)[0]
    moved = len(a)
    second = bytearray(b)
    start = struct.unpack_from("<I", b, 4)[0]
    n = struct.unpack_from("<H", b, start)[0]
    for k in range(n):  # where values are is counted from the file's start
        tag, kind, count, value = struct.unpack_from("<HHII", b, start + 2 + 12 * k)
        if tag == tiff.STRIP_OFFSETS or count * (2 if kind == 3 else 4) > 4:
            struct.pack_into("<I", second, start + 2 + 12 * k + 8, value + moved)
    whole = bytearray(a + second)
    struct.pack_into("<I", whole, end, moved + start)
    rows = tiff.tiff_pixels(spark.createDataFrame([(1, bytes(whole))], "id long, content binary")).collect()
    for directory, want in ((0, px), (1, other)):
        got = {(r.y, r.x): r.r for r in rows if r.directory == directory}
        assert got == {(y, x): int(want[y, x, 0]) for y in range(want.shape[0]) for x in range(want.shape[1])}


def box(kind, data=b"", length=None):
    return struct.pack(">I", 8 + len(data) if length is None else length) + kind + data


def jp2(**parts):
    """A sound file, but for the parts that are given; None leaves one out."""
    profile = struct.pack(">I", 132) + bytes(32) + b"acsp" + bytes(92)
    own = {"signature": box(b"jP  ", b"\r\n\x87\n"), "type": box(b"ftyp", b"jp2 " + bytes(4) + b"jp2 "), "early": b""}
    own |= {"ihdr": box(b"ihdr", bytes(10) + b"\x07" + bytes(3)), "colr": box(b"colr", b"\x02\0\0" + profile), "more": b"", "stream": box(b"jp2c", b"\xff\x4f\xff\x51 data \xff\xd9")}
    own = {k: v or b"" for k, v in (own | parts).items()}
    header = box(b"jp2h", own["ihdr"] + own["colr"] + own["more"]) if parts.get("header", True) else b""
    return own["signature"] + own["type"] + own["early"] + header + own["stream"]


def test_jp2_findings(spark):
    sound = jp2()
    header = box(b"jp2h", box(b"ihdr", bytes(14)) + box(b"colr", b"\1"))
    cases = {
        "": [sound, jp2(more=box(b"pclr") + box(b"cmap")), sound + box(b"xml ", b"<a/>"), jp2(stream=struct.pack(">I4sQ", 1, b"jp2c", 22) + b"\xff\x4f\xff\x51\xff\xd9"), jp2(stream=box(b"jp2c", b"\xff\x4f\xff\x51\xff\xd9", 0))],
        "no signature box": [sound[12:]],
        "signature box is not first": [box(b"free") + sound],
        "signature box is not of 12 bytes": [jp2(signature=box(b"jP  ", b"12345"))],
        "no file type box": [jp2(type=None)],
        "brand is not jp2": [jp2(type=box(b"ftyp", b"jpx " + bytes(4) + b"jp2 "))],
        "jp2 is not in the compatibility list": [jp2(type=box(b"ftyp", b"jp2 " + bytes(4) + b"jpx abc"))],
        "file type box is under 20 bytes": [jp2(type=box(b"ftyp", b"jp2 " + bytes(4)))],
        "minor version is negative": [jp2(type=box(b"ftyp", b"jp2 \xff\xff\xff\xffjp2 "))],
        "no header box": [jp2(header=False)],
        "no image header box": [jp2(ihdr=None)],
        "image header box is not first": [jp2(ihdr=None, more=box(b"ihdr", bytes(14)))],
        "no colour box": [jp2(colr=None)],
        "palette box is after the component mapping box": [jp2(more=box(b"cmap") + box(b"pclr"))],
        "no bits per component box": [jp2(ihdr=box(b"ihdr", bytes(10) + b"\xff" + bytes(3)))],
        "several header boxes": [jp2(early=header)],
        "no codestream box": [jp2(stream=None), sound[:-3]],
        "codestream box is before the header box": [jp2(early=box(b"jp2c", b"\xff\x4f\xff\x51\xff\xd9"))],
        "codestream is too short": [jp2(stream=box(b"jp2c", b"\xff"))],
        "codestream does not begin with SOC": [jp2(stream=box(b"jp2c", b"data\xff\xd9"))],
        "file type box does not follow the signature box": [jp2(signature=box(b"jP  ", b"\r\n\x87\n") + box(b"free"))],
        "component mapping box without a palette box": [jp2(more=box(b"cmap"))],
        "bit depth is not known": [jp2(ihdr=box(b"ihdr", bytes(4)))],
        "boxes are not in order": [jp2(type=None, early=b"", stream=box(b"ftyp", b"jp2 " + bytes(4) + b"jp2 ") + box(b"jp2c", b"\xff\x4f\xff\x51\xff\xd9"))],
        "metadata is before the header box": [jp2(early=box(b"uuid"))],
        "codestream does not end with EOC": [jp2(stream=box(b"jp2c", b"\xff\x4f\xff\x51 data"))],
        "SIZ does not follow SOC": [jp2(stream=box(b"jp2c", b"\xff\x4f\xff\x52\xff\xd9"))],
        "profile is under 128 bytes": [jp2(colr=box(b"colr", b"\2\0\0" + bytes(100)))],
        "profile has another size than it says": [jp2(colr=box(b"colr", b"\2\0\0" + bytes(130)))],
        "profile has no signature": [jp2(colr=box(b"colr", b"\2\0\0" + struct.pack(">I", 130) + bytes(126)))],
    }
    more = {
        "signature box is not first": ["file type box does not follow the signature box"], "signature box is not of 12 bytes": ["file type box does not follow the signature box"],
        "no file type box": ["boxes are not in order"], "no signature box": ["boxes are not in order"], "several header boxes": ["boxes are not in order"],
        "file type box is under 20 bytes": ["jp2 is not in the compatibility list"], "no header box": ["boxes are not in order"], "no image header box": ["bit depth is not known"],
        "no bits per component box": ["bit depth is not known"], "codestream box is before the header box": ["boxes are not in order"], "boxes are not in order": ["file type box does not follow the signature box"],
    }
    rows = [(f"{rule}|{k}", data) for rule, files in cases.items() for k, data in enumerate(files)]
    df = spark.createDataFrame([*rows, ("null", None), ("empty", b""), ("other", b"no such file at all")], "id string, content binary")
    found = {r.id: r.findings for r in containers.jp2_findings(df).collect()}
    assert found["null"] is None and [f.rule for f in found["empty"]] == [f.rule for f in found["other"]] == ["no signature box", "no file type box", "no header box", "no codestream box"]
    for rule, files in cases.items():
        for k in range(len(files)):
            own = found[f"{rule}|{k}"]
            assert sorted(f.rule for f in own) == sorted([rule, *more.get(rule, [])] if rule else []), (rule, k)
            assert [f.severity for f in own] == sorted(f.severity for f in own)
    rng = np.random.default_rng(0)
    noisy = [(str(k), sound[:k] + bytes([int(rng.integers(256))]) + sound[k + 1 :]) for k in range(len(sound))] + [(str(k), sound[:k]) for k in range(len(sound))]
    assert containers.jp2_findings(spark.createDataFrame(noisy, "id string, content binary")).select(F.explode("findings")).count() > 0
