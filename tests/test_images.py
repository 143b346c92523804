import duckdb
import numpy as np
import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from rasterlake.functions import formats, rgba
from rasterlake.operators import animation, frames, palette, prediction, transforms
from rasterlake.operators.resize import resize, resize_array
from rasterlake.plans.oracles import SQL
from rasterlake.plans.queries import QUERIES
from rasterlake.sources import codecs, files
from rasterlake.streaming import images as stream


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_more_headers_of_keys_beyond_two_bytes(spark, sf_dir, tmp_path):
    """Sides of two bytes hold the low bytes of a key, as its SQL says."""
    keys = F.col("p_partkey") % 50 + F.when(F.col("p_partkey") % 2 == 0, 65_500).otherwise(1_000_000)
    spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_partkey", keys).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    same_rows(QUERIES["more_headers"](spark, str(tmp_path)), con, SQL["more_headers"])


def picture(height, width, alpha=True, seed=0):
    px = np.random.default_rng(seed).integers(0, 256, (height, width, 4), dtype=np.uint8)
    px[: height // 2, :, :] = px[0, 0]  # runs
    if not alpha:
        px[..., 3] = 255
    return px


@pytest.mark.parametrize("kind", ["png", "bmp", "tga", "qoi"])
@pytest.mark.parametrize("alpha", [True, False])
@pytest.mark.parametrize("size", [(1, 1), (10, 10), (50, 100), (3, 129)])
def test_lossless_round_trip(kind, alpha, size):
    px = picture(*size, alpha)
    if not alpha:
        px[..., :3] //= 8
    data = codecs.ENCODERS[kind](px)
    assert np.array_equal(codecs.decode(kind, data), px)


def test_netpbm():
    px = picture(5, 9, False)
    assert np.array_equal(codecs.decode("ppm", codecs.ENCODERS["ppm"](px)), px)
    gray = codecs.decode("pgm", codecs.ENCODERS["pgm"](px))
    assert np.array_equal(gray[..., 0], codecs.gray_levels(px))
    black = codecs.decode("pbm", codecs.ENCODERS["pbm"](px))
    assert np.array_equal(black[..., 0] == 0, codecs.gray_levels(px) < 128)
    assert codecs.decode("pgm", b"P2 # a comment\n2 1\n# more\n15\n0 15\n")[0, :, 0].tolist() == [0, 255]
    assert codecs.decode("pbm", b"P1\n3 1\n1 01\n")[0, :, 0].tolist() == [0, 255, 0]
    assert codecs.decode("pgm", b"P5 1 1 65535\n\x80\x00")[0, 0, 0] == 128


def test_tga_runs_and_png_filters():
    import struct
    import zlib

    body = bytes([0x82, 1, 2, 3, 0x00, 4, 5, 6])  # a run of three pixels and one more
    data = struct.pack("<BBBHHBHHHHBB", 0, 0, 10, 0, 0, 0, 0, 0, 4, 1, 24, 32) + body
    assert codecs.decode("tga", data)[0].tolist() == [[3, 2, 1, 255]] * 3 + [[6, 5, 4, 255]]
    px = picture(5, 7, False)
    rows, above, raw = px[..., :3].reshape(5, -1).astype(int), np.zeros(21, int), b""
    for kind, row in enumerate(rows):
        left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        raw += bytes([kind]) + (row - [0 * row, left, above, (left + above) // 2, paeth][kind]).astype(np.uint8).tobytes()
        above = row
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.array_equal(codecs.decode("png", png), px)


def test_resize_fixtures():
    quad = np.array([[[255, 0, 0, 255], [0, 255, 0, 255]], [[0, 0, 255, 255], [255, 255, 255, 255]]], dtype=np.uint8)[None]
    assert np.array_equal(resize_array(quad, 4, 4, "nearest"), quad.repeat(2, 1).repeat(2, 2))
    bars = np.array([[[0, 0, 0, 255], [255, 255, 255, 255]]] * 2, dtype=np.uint8)[None]
    assert resize_array(bars, 3, 3, "bilinear")[0, 1, 1].tolist() == [128, 128, 128, 255]
    for mode in ("nearest", "bilinear", "bicubic"):
        same = picture(10, 10)[None]
        assert np.array_equal(resize_array(same, 10, 10, mode), same)
        assert resize_array(same, 5, 20, mode).shape == (1, 5, 20, 4)
    flat = np.full((1, 7, 5, 4), 77, np.uint8)
    assert (resize_array(flat, 3, 2, "bicubic") == 77).all()


def test_resize_keeps_nulls_and_other_columns(spark):
    px = picture(2, 2)
    rows = [(1, 0, 2, 2, 5, px.tobytes(), "a"), (2, 0, None, None, 6, None, "b")]
    out = resize(spark.createDataFrame(rows, "image_id long, frame_idx int, width int, height int, duration_us long, rgba binary, note string"), 4, 3, "nearest").orderBy("image_id").collect()
    assert len(out[0].rgba) == 48 and out[0].note == "a" and out[0].duration_us == 5 and out[1].rgba is None
    with pytest.raises(ValueError):
        resize(spark.range(1), 0, 5)


def test_pixels_and_frames(spark):
    px = picture(3, 2)
    f = spark.createDataFrame([(7, 0, 2, 3, 0, px.tobytes())], "image_id long, frame_idx int, width int, height int, duration_us long, rgba binary")
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in frames.pixels_of(f).collect()}
    assert got == {(y, x): tuple(map(int, px[y, x])) for y in range(3) for x in range(2)}
    back = frames.frames_from_pixels(frames.pixels_of(f), F.lit(2), F.lit(3)).first()
    assert bytes(back.rgba) == px.tobytes()
    images = frames.images_of(f.unionByName(f.withColumn("frame_idx", F.lit(1))))
    assert frames.frames_of(images).count() == 2
    with pytest.raises(Exception, match="out of bounds"):
        f.select(rgba.get_pixel(F.col("rgba"), F.col("width"), F.col("height"), F.lit(2), F.lit(0))).collect()
    with pytest.raises(Exception, match="needs a frame"):
        images.select(frames.remove_frame(frames.keep_root(F.col("frames")), F.lit(0))).collect()


def test_places_of_frames_and_repeated_pixels(spark):
    px = picture(3, 2)
    f = spark.createDataFrame([(7, 0, 2, 3, 0, px.tobytes())], "image_id long, frame_idx int, width int, height int, duration_us long, rgba binary")
    images = frames.images_of(f.unionByName(f.withColumn("frame_idx", F.lit(1))))
    for at in (-1, 2):
        with pytest.raises(Exception, match="no such place"):
            images.select(frames.remove_frame(F.col("frames"), F.lit(at))).collect()
    pixels = frames.pixels_of(f)
    twice = pixels.unionByName(pixels.withColumns({c: F.lit(0) for c in "rgba"}))
    assert bytes(frames.frames_from_pixels(twice, F.lit(2), F.lit(3)).first().rgba) == px.tobytes()


def test_blend_against_whole_numbers(spark):
    rnd = np.random.default_rng(1).integers(0, 256, (3000, 8))
    rnd[:300, 3], rnd[300:600, 7], rnd[600:700, [3, 7]], rnd[700:800, 3] = 0, 0, 0, 255
    df = spark.createDataFrame([tuple(map(int, r)) for r in rnd], "r int, g int, b int, a int, r2 int, g2 int, b2 int, a2 int")
    got = df.select("*", F.struct(*animation.blend({c: F.col(c) for c in "rgba"}, {c: F.col(f"{c}2") for c in "rgba"})).alias("o")).collect()
    for row in got:
        s, d = row[:4], row[4:8]
        alpha = s[3] + d[3] * (255 - s[3]) // 255
        want = s if s[3] == 255 else d if alpha == 0 else tuple((s[k] * s[3] + d[k] * d[3] * (255 - s[3]) // 255) // alpha % 256 for k in range(3)) + (alpha,)
        assert tuple(row.o) == tuple(want)
        assert animation.over_canvas(np.array([[d]], dtype=np.uint8), np.array([[s]], dtype=np.uint8))[0, 0].tolist() == list(want)


def test_color_counts_up_to_the_limit(spark):
    px = lambda i, n, last: [(i, 0, y, x, v % 256, v // 256, 7, 255) for k in range(n + last) for v in [min(k, n - 1)] for y, x in [divmod(k, 100_000)]]
    rows = [*px(1, 256, 5), *px(2, 257, 0), *px(3, 257, 1), *px(4, 258, 0)]
    df = spark.createDataFrame(rows, "image_id long, frame_idx int, y int, x int, r int, g int, b int, a int")
    assert {r.image_id: (r.n_colors, r.depth) for r in palette.icon_depth(df).collect()} == {1: (256, 8), 2: (257, 24), 3: (None, 24), 4: (None, 24)}


def test_files_are_replaced_or_left(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = lambda *r: spark.createDataFrame([*r], "name string, content binary")
    files.write_files(rows(("a/x.bin", b"1"), ("b/x.bin", b"2")), folder)
    files.write_files(rows(("c.bin", b"3")), folder)
    found = lambda: {str(p.relative_to(folder)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found() == {"a/x.bin": b"1", "b/x.bin": b"2", "c.bin": b"3"}
    for bad in ([("d", b"4"), ("d", b"5")], [("../d", b"4")]):
        with pytest.raises(Exception, match="same name|within the folder"):
            files.write_files(rows(*bad), folder)
    assert len(found()) == 3 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".staging")]
    files.write_files(rows(("only", b"6")), folder, "overwrite")
    assert found() == {"only": b"6"}


def test_levels_of_wavelets_of_any_size(spark):
    for h, w in ((1, 1), (5, 7), (6, 1), (9, 12)):
        px = np.random.default_rng(h).integers(0, 256, (h, w))
        df = spark.createDataFrame([(1, 0, y, x, int(px[y, x])) for y in range(h) for x in range(w)], "image_id long, frame_idx int, y int, x int, r int")
        back = transforms.compose53(transforms.decompose53(df, "r", 2), 2)
        assert {(r.y, r.x): r.v for r in back.collect()} == {(y, x): int(px[y, x]) for y in range(h) for x in range(w)}


def test_long_runs_are_split(spark):
    row = spark.range(300).select(F.lit(1).alias("image_id"), F.lit(0).alias("frame_idx"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"), *[F.lit(9).alias(c) for c in "rgba"])
    assert sorted((r.x, r.n) for r in prediction.runs(row).collect()) == [(0, 128), (128, 128), (256, 44)]


def test_files_sink_source_and_stream(spark, tmp_path):
    px = picture(6, 4)
    f = spark.createDataFrame([(i, 4, 6, px.tobytes()) for i in range(5)], "image_id long, width int, height int, rgba binary")
    folder = str(tmp_path / "images")
    encoded = files.encode_frames(f, "qoi").withColumn("name", F.concat(F.lit("i"), F.col("image_id").cast("string"), F.lit(".qoi")))
    files.write_files(encoded, folder)
    (tmp_path / "images" / "bad.png").write_bytes(b"not an image")
    for by in ("extension", "content"):
        out = files.decode_frames(files.read_files(spark, folder, by)).collect()
        assert sum(r.rgba is not None and bytes(r.rgba) == px.tobytes() for r in out) == 5
        assert [bool(r.error) for r in out if r.path.endswith("bad.png")] == [True]
    query = stream.stream_frames(spark, folder).writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("decoded").where("rgba is not null").count() == 5
    assert {r.format: r.n_files for r in stream.arrivals(files.read_files(spark, folder).withColumn("modificationTime", F.current_timestamp())).groupBy("format").agg(F.sum("n_files").alias("n_files")).collect()} == {"qoi": 5, "png": 1}


def test_unknown_formats(spark):
    d = spark.createDataFrame([(b"",), (b"P6",), (b"MM\0+\0\0\0\0",), (None,)], "b binary")
    assert [r[0] for r in d.select(formats.format_of_bytes(F.col("b"))).collect()] == [None] * 4


def test_resized_images_keep_every_row(spark):
    frame = lambda w, h: (w, h, 5, bytes(range(w * h * 4)))
    rows = [(1, [], [(1, 2)]), (2, [frame(2, 2), frame(1, 1)], [(2, 0)]), (2, [frame(2, 1)], None), (None, None, []), (3, [(1, 1, None, None)], [(0, 0)])]
    df = spark.createDataFrame(rows, f"image_id long, frames array<{frames.FRAME}>, hotspots array<struct<x:int,y:int>>")
    out = frames.resized_images(df, 4, 2, "nearest").collect()
    assert [(r.image_id, None if r.frames is None else [(f.width, f.height, f.duration_us) for f in r.frames]) for r in out] == [(1, []), (2, [(4, 2, 5)] * 2), (2, [(4, 2, 5)]), (None, None), (3, [(4, 2, None)])]
    assert [r.hotspots and [tuple(h) for h in r.hotspots] for r in out] == [[(1, 2)], [(4, 0)], None, [], [(0, 0)]]
    assert out[2].frames[0].rgba == bytes([*range(4)] * 2 + [*range(4, 8)] * 2) * 2 and out[4].frames[0].rgba is None


def test_qoi_operations_at_both_ends_of_a_byte(spark):
    def ops(*words):
        rows = [(1, 0, 0, x, *w) for x, w in enumerate(words)]
        df = spark.createDataFrame(rows, "image_id long, frame_idx int, y int, x int, r int, g int, b int, a int")
        return [r.op for r in prediction.qoi_operations(df).orderBy("x").collect()]

    black, other = (0, 0, 0, 255), (90, 80, 70, 255)
    assert ops((255, 10, 9, 255), (0, 10, 9, 255)) == ["rgb", "rgb"]  # no difference wraps around
    assert ops(black, other, black) == ["run", "rgb", "rgb"]  # a run does not enter its slot
    assert ops(other, black, other, other, black) == ["rgb", "rgb", "index", "run", "index"]
    assert ops((0, 0, 0, 0), (1, 0, 0, 0), (1, 0, 0, 1)) == ["index", "diff", "rgba"]


@pytest.mark.parametrize("kind", ["sub", "up", "average", "paeth"])
def test_filters_of_frames(spark, kind):
    px = [picture(h, w, seed=h) for h, w in ((1, 1), (1, 9), (9, 1), (5, 7), (6, 7), (40, 33))]
    df = spark.createDataFrame([(i, 0, p.shape[1], p.shape[0], 0, p.tobytes()) for i, p in enumerate(px)] + [(9, 0, 1, 1, 0, None)], "image_id long, frame_idx int, width int, height int, duration_us long, rgba binary")
    there = prediction.filtered_frames(df, kind)
    back = {r.image_id: r.rgba for r in prediction.unfiltered_frames(there, kind).collect()}
    assert back == {**{i: p.tobytes() for i, p in enumerate(px)}, 9: None}
    one = frames.pixels_of(df.where("image_id < 9"))
    rows = prediction.predicted(one) if kind == "sub" else prediction.filtered(one, kind)
    key = ["image_id", "y", "x", "r", "g", "b", "a"]
    assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, frames.pixels_of(there.where("image_id < 9")).select(*key).collect()))


def test_irreversible_wavelet_back(spark):
    rows = [(1, 0, y, x, (x * 37 + y * 11) % 256) for y in range(4) for x in range(1 + y * 3)]
    df = spark.createDataFrame(rows, "image_id int, frame_idx int, y int, x int, v int")
    for along in "xy":
        out = transforms.inverse_wavelet97(transforms.wavelet97(df, "v", along=along), "coefficient", "back", along)
        assert all(abs(r.v - r.back) < 1e-3 for r in out.collect())


def test_rows_of_a_width(spark):
    from rasterlake.functions import samples

    df = spark.createDataFrame([(1, 0, 0, 0, 1, 20), (1, 0, 0, 9, 1, 20), (1, 0, 0, 25, 1, 20), (1, 0, 1, 3, 1, 8), (1, 0, 2, 0, 0, 1)], "image_id int, frame_idx int, y int, x int, v int, w int")
    assert {r.y: r.content.hex() for r in samples.packed_rows(df, 1, F.col("w")).collect()} == {0: "804000", 1: "10", 2: "00"}
    assert {r.y: r.content.hex() for r in samples.packed_rows(df, 1).collect()} == {0: "80400040", 1: "10", 2: "00"}


def test_frames_of_few_pixels(spark):
    rows = [(1, 0, 1, 2, 1, 2, 3, 4), (1, 0, 1, 2, 1, 2, 3, 3), (1, 0, 5, 0, 9, 9, 9, 9), (1, 0, -1, 0, 9, 9, 9, 9), (1, 0, 0, 3, 9, 9, 9, 9), (2, 1, 0, 0, 7, 7, 7, 7), (3, 0, 9, 9, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "image_id int, frame_idx int, y int, x int, r int, g int, b int, a int")
    got = {r.image_id: (r.width, r.height, r.rgba.hex()) for r in frames.frames_from_pixels(df, F.lit(3), F.lit(2)).collect()}
    assert got == {1: (3, 2, "00" * 20 + "01020304"), 2: (3, 2, "07070707" + "00" * 20), 3: (3, 2, "00" * 24)}


def test_durations_over_pages(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for i in (1, 2, None):
        idx = np.sort(rng.choice(200, 60, replace=False)).tolist()
        at = np.cumsum(rng.integers(0, 50_000, 60)).tolist()
        rows += [(i, k, t) for k, t in zip(idx, at, strict=True)]
        want |= {(i, k): (b - a) // 10_000 * 10_000 for k, a, b in zip(idx, at, [*at[1:], at[-1]], strict=True)}
    df = spark.createDataFrame(rows, "image_id int, frame_idx int, at_us long").repartition(3)
    for page in (1, 7, 4096):
        out = animation.durations(df, page)
        assert out.columns == ["image_id", "frame_idx", "at_us", "duration_us"]
        assert {(r.image_id, r.frame_idx): r.duration_us for r in out.collect()} == want


def test_files_are_moved_by_tasks(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("a/1.bin", b"one"), ("2.bin", b"two"), ("a/b/3.bin", b"")], "name string, content binary").repartition(3)
    files.write_files(df, folder)
    files.write_files(df.where("name = '2.bin'").withColumn("name", F.lit("4.bin")), folder)
    found = {str(p.relative_to(folder)): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert found == {"a/1.bin": b"one", "2.bin": b"two", "a/b/3.bin": b"", "4.bin": b"two"}
    for bad in (df.union(df), df.withColumn("name", F.lit("../x"))):
        with pytest.raises(Exception, match="same name|within the folder"):
            files.write_files(bad, folder)
    files.write_files(df.limit(0), folder, "overwrite")
    assert not any(p.is_file() for p in (tmp_path / "out").rglob("*")) and [p.name for p in (tmp_path / "out").iterdir()] == []


def test_late_files_are_left_out(spark, tmp_path):
    import os

    folder, out = tmp_path / "in", tmp_path / "counts"
    folder.mkdir()

    def arrive(name, minute, size):
        (folder / name).write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(size))
        os.utime(folder / name, (1_700_000_000 + 60 * minute,) * 2)

    def run():
        seen = stream.arrivals(stream.stream_files(spark, str(folder), "content"), "10 minutes", "30 minutes").select("window.start", "format", "n_files", "n_bytes")
        query = seen.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        schema = "start timestamp, format string, n_files long, n_bytes long"
        return sorted((r.n_files, r.n_bytes) for r in spark.read.schema(schema).parquet(str(out)).collect())

    arrive("a.png", 0, 2)
    arrive("b.png", 1, 2)
    run()
    arrive("c.png", 100, 5)  # closes the first window
    assert run() == [(2, 20)]
    arrive("late.png", 2, 50)  # of a window that is closed
    arrive("d.png", 101, 5)
    arrive("e.png", 300, 1)
    assert run() == [(2, 20), (2, 26)]
