"""One query for each image operator, over the whole of a derived table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions import color, formats, headers, rgba, samples, sql
from rasterlake.functions.rgba import made
from rasterlake.operators import animation, frames, palette, prediction, tiff, transforms
from rasterlake.operators.resize import resize
from rasterlake.plans import bitmaps, coding, containers, jpeg2000
from rasterlake.plans.tables import emb_frames, emb_rgba, event_pixels, line_pixels, order_pixels, parts, table
from rasterlake.sources.files import decode_frames, encode_frames, read_files, write_files
from rasterlake.streaming.images import stream_frames

PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 128), (128, 64, 32), (32, 64, 128)]
KEY = ["image_id", "frame_idx", "y", "x"]


def gray_pixels(df: DataFrame) -> DataFrame:
    return frames.pixels_of(df).select("image_id", "y", "x", F.col("r").alias("g"))


def resized(width: int, height: int, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gray_pixels(resize(emb_frames(spark, sf_dir), width, height, mode))

    return run


def over_lines(cols):
    """A projection of the pixels of line_pixels: cols gives columns for r, g, b and a."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return line_pixels(spark, sf_dir).select("image_id", "x", *cols(*map(F.col, "rgba")))

    return run


def per_image(operator):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(line_pixels(spark, sf_dir))

    return run


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's comment behind a header that its key picks, and a file name likewise, detected both ways."""
    heads = F.array(*[F.lit(h) for h in HEADERS])
    names = F.array(*[F.lit(n) for n in NAMES])
    parts = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(F.element_at(heads, (F.col("p_partkey") % len(HEADERS) + 1).cast("int")), F.hex(F.encode("p_name", "utf-8")))).alias("content"), F.concat(F.lit("/a.b/"), F.element_at(names, (F.col("p_partkey") % len(NAMES) + 1).cast("int"))).alias("path"))
    return parts.select("p_partkey", formats.format_of_bytes(F.col("content")).alias("by_content"), formats.format_of_path(F.col("path")).alias("by_name"))


HEADERS = ["89504E470D0A1A0A", "FFD8FFE0", "474946383961", "474946383761", "0000000C6A5020200D0A870A", "FF4FFF51", "424D", "5036", "5034", "5035", "524946460000000057454250", "52494646000000004143 4F4E".replace(" ", ""), "49492A00", "4D4D002A", "716F6966", "00000100", "00000200", "00", "4D4D002B"]
NAMES = ["x.PNG", "x.jpeg", "x.gif", "x.j2k", "x.bmp", "x.pnm", "x.webp", "x.tiff", "x.tga", "x.qoi", "x.ico", "x.cur", "x.ani", "x.txt", "png", "x.tar.pgm"]


def pixel_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_pixels(emb_frames(spark, sf_dir))


def get_set_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel at (id % 8, 3) of each frame, and after it is set to half-clear red, with that of its row before."""
    f = emb_frames(spark, sf_dir).withColumn("px", (F.col("image_id") % 8).cast("int"))
    at = (F.col("width"), F.col("height"), F.col("px"), F.lit(3))
    new = f.withColumn("new", rgba.set_pixel(F.col("rgba"), *at, F.lit(0xFF000080)))
    return new.select("image_id", rgba.get_pixel(F.col("rgba"), *at).alias("before"), rgba.get_pixel(F.col("new"), *at).alias("after"), F.length(rgba.row_bytes(F.col("new"), F.col("width"), F.lit(3))).cast("long").alias("row_size"))


def frame_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one frame, with a blank one added, one inserted before it and the first removed."""
    own = F.struct("width", "height", "duration_us", "rgba")
    blank = F.struct(F.lit(2).alias("width"), F.lit(1).alias("height"), F.lit(100_000).cast("long").alias("duration_us"), rgba.blank(F.lit(2), F.lit(1)).alias("rgba"))
    images = emb_frames(spark, sf_dir).select("image_id", F.array(own).alias("frames"))
    two = images.withColumn("frames", frames.add_frame(F.col("frames"), blank))
    three = two.withColumn("frames", frames.insert_frame(F.col("frames"), F.lit(1), blank))
    left = three.withColumn("frames", frames.remove_frame(F.col("frames"), F.lit(0)))
    return frames.frames_of(left).select("image_id", "frame_idx", "width", "height", "duration_us", F.hex("rgba").alias("rgba_hex"))


def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' pixels as frames of seven pixels, missing ones clear."""
    out = frames.frames_from_pixels(order_pixels(spark, sf_dir), F.lit(7), F.lit(1))
    return out.select("image_id", "width", "height", F.hex("rgba").alias("rgba_hex"))


def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames.pixels_of(emb_frames(spark, sf_dir))
    return prediction.flipped(px, F.lit(8), F.lit(8)).select("image_id", "y", "x", F.col("r").alias("g"))


def predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.predicted(order_pixels(spark, sf_dir)).select("image_id", "x", *"rgba")


def predictor_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of the predictor: the pixels as they were."""
    return prediction.unpredicted(prediction.predicted(order_pixels(spark, sf_dir))).select("image_id", "x", *"rgba")


def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal alpha in each order's row."""
    same = order_pixels(spark, sf_dir).withColumns({c: F.lit(0) for c in "rgb"})
    return prediction.runs(same).select("image_id", "x", "n")


def composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return animation.composite_keep(event_pixels(spark, sf_dir)).select("image_id", "frame_idx", *"rgba")


def webp_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel of an order over a fixed colour."""
    under = {c: F.lit(v) for c, v in zip("rgba", (10, 200, 90, 100), strict=True)}
    return line_pixels(spark, sf_dir).select("image_id", "x", *animation.blend({c: F.col(c) for c in "rgba"}, under))


def frame_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("frame_idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return animation.durations(e).select("image_id", "frame_idx", "duration_us")


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes as hotspots, scaled from 48 to 20 pixels; rates of steps from a short list."""
    rates = F.array(F.lit(6), F.lit(12), F.lit(9))
    step = F.col("p_partkey") % 5
    return table(spark, sf_dir, "part").select("p_partkey", frames.scale_hotspot(F.col("p_size"), F.lit(48), F.lit(20)).alias("hotspot"), frames.step_rate(rates, step, F.lit(10)).cast("long").alias("rate"), frames.milliseconds(frames.step_rate(rates, step, F.lit(10))).alias("ms"), frames.jiffies(F.col("p_size") * F.lit(7.25)).alias("jiffies"), frames.step_frame(F.array(F.lit(2), F.lit(0)), step, F.lit(3)).cast("int").alias("frame"))


def codec_round_trip(kind: str):
    """Frames encoded, detected by their bytes and decoded: every pixel must come back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = encode_frames(emb_frames(spark, sf_dir), kind).select("image_id", "frame_idx", "content")
        # Targa files have no signature at their start.
        found = files.withColumn("format", F.lit("tga") if kind == "tga" else formats.format_of_bytes(F.col("content")))
        return gray_pixels(decode_frames(found))

    return run


def header_fields(kind: str):
    """Frames encoded, and their headers read without decoding them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = encode_frames(resize(emb_frames(spark, sf_dir), 5, 9, "nearest"), kind)
        return files.select("image_id", headers.header(F.col("content"), F.lit("tga") if kind == "tga" else None).alias("h")).select("image_id", "h.*")

    return run


def icon_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor files of a part's size in entries, whose hotspots follow from its key."""
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    key, n = F.col("p_partkey"), (F.col("p_size") % 4 + 1).cast("int")
    entry = lambda k: F.concat(byte(k), byte(k * 2), F.lit("0000"), byte(key % 200 + k), F.lit("00"), byte(key % 100), F.lit("00"), byte(k), F.lit("010000"), byte(n * 16 + 6), F.lit("000000"))
    files = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(F.lit("00000200"), byte(n), F.lit("00"), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), entry), ""))).alias("content"))
    return headers.icon_entries(files).drop("content")


def tiff_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two TIFF directories, in either byte order by the part's key: of width from its key and height from its size, and of three
    shorts that stand behind it, and two that fit in the entry."""
    key, size = F.col("p_partkey"), F.col("p_size")
    be = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    le = lambda v, n: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(be(v, n), i * 2 + 1, F.lit(2)))), "")
    body = lambda w: F.concat(w(F.lit(8), 4), w(F.lit(2), 2), w(F.lit(256), 2), w(F.lit(4), 2), w(F.lit(1), 4), w(key, 4), w(F.lit(257), 2), w(F.lit(3), 2), w(F.lit(1), 4), w(size, 2), F.lit("0000"), w(F.lit(38), 4), w(F.lit(2), 2), w(F.lit(258), 2), w(F.lit(3), 2), w(F.lit(3), 4), w(F.lit(68), 4), w(F.lit(259), 2), w(F.lit(3), 2), w(F.lit(2), 4), w(size, 2), w(key % 999, 2), w(F.lit(0), 4), w(key % 1000, 2), w(size, 2), w(F.lit(7), 2))
    hexed = F.when(key % 2 == 0, F.concat(F.lit("49492A00"), body(le))).otherwise(F.concat(F.lit("4D4D002A"), body(be)))
    return tiff.tiff_entries(table(spark, sf_dir, "part").select("p_partkey", made(content=F.unhex(hexed)))).withColumn("values", F.array_join(F.transform("values", lambda v: v.cast("string")), ","))


def reversible_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reversible colour transform and its inverse: the pixels as they were."""
    there = line_pixels(spark, sf_dir).select("image_id", "x", *transforms.reversible_color(*map(F.col, "rgb")))
    return there.select("image_id", "x", *transforms.color_of_reversible(*map(F.col, "yuv")))


def wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.wavelet53(frames.pixels_of(emb_frames(spark, sf_dir)), "r").select("image_id", "y", "x", "coefficient")


def wavelet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wavelet of orders' rows, which have gaps and odd lengths, and its inverse."""
    dense = order_pixels(spark, sf_dir).withColumn("x", F.row_number().over(prediction.row()) - 1)
    return transforms.inverse_wavelet53(transforms.wavelet53(dense, "r"), "coefficient", "back").select("image_id", "x", F.col("back").alias("r"))


def sending_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interlace passes, zig-zag places and scaled steps of each pixel."""
    px, x, y = frames.pixels_of(emb_frames(spark, sf_dir)), F.col("x"), F.col("y")
    return px.select("image_id", "y", "x", transforms.adam7_pass(x, y).alias("adam7"), transforms.gif_pass(y).alias("gif_pass"), transforms.zigzag(x, y).alias("zigzag"), transforms.scaled_quantum(F.col("r"), 90).alias("q90"), transforms.scaled_quantum(F.col("r"), 20).alias("q20"))


def srgb_light(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear light of red in ten-thousandths, and back."""
    light = color.linear_of_srgb(F.col("r") / F.lit(255.0))
    back = F.floor(color.srgb_of_linear(light) * 255 + F.lit(0.5)).cast("int")
    return line_pixels(spark, sf_dir).select("image_id", "x", F.floor(light * 10_000 + F.lit(0.5)).cast("int").alias("light"), back.alias("r"))


def channels(df: DataFrame) -> DataFrame:
    """Each channel of frames' pixels as an image of its own, numbered 4 * image_id + channel."""
    each = frames.pixels_of(df).select("image_id", "y", "x", F.posexplode(F.array(*"rgba")).alias("c", "g"))
    return each.select((F.col("image_id") * 4 + F.col("c")).alias("image_id"), "y", "x", "g")


def resized_rgba(width: int, height: int, mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return channels(resize(emb_rgba(spark, sf_dir), width, height, mode))

    return run


def rgba_round_trip(kind: str):
    """Frames of four differing channels encoded and decoded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = encode_frames(emb_rgba(spark, sf_dir), kind).select("image_id", "frame_idx", "content", F.lit(kind).alias("format"))
        return channels(decode_frames(files))

    return run


def over_pixels(operator):
    """An operator over the pixels of the four-channel frames."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(frames.pixels_of(emb_rgba(spark, sf_dir)))

    return run


def upsampled(fancy: bool):
    """The frames' chroma sampled by 2 x 2 and brought back, with red as luma."""

    def run(px: DataFrame) -> DataFrame:
        luma = px.select("image_id", "frame_idx", "y", "x", F.col("r").alias("l"))
        return transforms.rgb_of_420(luma, transforms.chroma_420(px), fancy).select("image_id", "y", "x", *"rgba")

    return over_pixels(run)


def filter_frames(kind: str, back: bool = False):
    """A filter over whole frames, or it and its inverse."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        there = prediction.filtered_frames(emb_rgba(spark, sf_dir), kind)
        return frames.pixels_of(prediction.unfiltered_frames(there, kind) if back else there).drop("frame_idx")

    return run


def qoi_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of full bytes, of few colours, and of colours at both ends of a byte, by the image's number; opaque black first and
    at two other places."""
    px = frames.pixels_of(emb_rgba(spark, sf_dir))
    kind, black = F.col("image_id") % 3, (F.col("y") * 8 + F.col("x")).isin(0, 9, 20)
    value = lambda c: F.when(kind == 0, F.col(c)).when(kind == 1, F.floor(F.col(c) / 64)).otherwise((F.floor(F.col(c) / 32) + 252) % 256)
    alpha = F.when(kind == 2, 255).otherwise(F.floor(F.col("a") / 128) * 255)
    own = {c: F.when(black, 255 if c == "a" else 0).otherwise(alpha if c == "a" else value(c)).cast("int") for c in "rgba"}
    return prediction.qoi_operations(px.withColumns(own)).select("image_id", "y", "x", "op")


def gif_frames(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as animations on a canvas of 4 x 2: a frame for each line, with its place, size and disposal from its colour."""
    px = order_pixels(spark, sf_dir).select("image_id", F.col("x").alias("frame_idx"), *"rgba")
    own = px.select("image_id", "frame_idx", *"rgba", (F.col("r") % 3).alias("left"), (F.col("g") % 2).alias("top"), (F.col("r") % 2 + 1).alias("width"), F.lit(1).alias("height"), (F.col("b") % 4).alias("disposal"), F.lit(4).alias("canvas_width"), F.lit(2).alias("canvas_height"), F.lit(0x0AC85AFF).cast("long").alias("background"))
    pixels = own.select("image_id", "frame_idx", F.lit(0).alias("y"), F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"), *"rgba")
    word = rgba.pack((F.col("r") + F.col("x") * 40) % 256, F.col("g"), F.col("b"), F.col("a"))
    return own.drop(*"rgba"), pixels.select("image_id", "frame_idx", "y", "x", word.alias("word"))


def gif_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return animation.gif_canvas(*gif_frames(spark, sf_dir))


def webp_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same animations, blended where the disposal is 0 or 1, and cleared after where it is odd."""
    own, pixels = gif_frames(spark, sf_dir)
    content = pixels.groupBy("image_id", "frame_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word"))), lambda p: F.lpad(F.hex(p["word"]), 8, "0")), "").alias("hex"))
    one = F.struct("frame_idx", "left", "top", "width", "height", (F.col("disposal") < 2).alias("blend"), (F.col("disposal") % 2 == 1).alias("dispose"), F.unhex("hex").alias("rgba"))
    images = own.join(content, ["image_id", "frame_idx"]).groupBy("image_id").agg(F.array_sort(F.collect_list(one)).alias("frames"))
    drawn = animation.webp_canvases(images.select("image_id", F.lit(4).alias("width"), F.lit(2).alias("height"), F.lit(0x0AC85A80).cast("long").alias("background"), "frames"))
    return drawn.select("image_id", F.posexplode("frames").alias("n", "c")).select("image_id", "n", F.hex("c").alias("canvas"))


def palette_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' numbers as indexes into the colours of the nations; some are beyond them."""
    n = F.col("n_nationkey").cast("int")
    colors = table(spark, sf_dir, "nation").select(n.alias("idx"), (n * 10).alias("r"), (255 - n).alias("g"), (n * n % 256).alias("b"), F.lit(255).alias("a"))
    return palette.apply_palette(line_pixels(spark, sf_dir).select("image_id", "x", (F.col("r") % 30).alias("idx")), colors)


def pbm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmap rows of the grey frames."""
    black = frames.pixels_of(emb_frames(spark, sf_dir)).select("image_id", "frame_idx", "y", "x", color.bit(F.col("r")).alias("v"))
    return samples.packed_rows(black, 1).select("image_id", "y", F.hex("content").alias("row"))


def bits_round_trip(bits: int):
    """Orders' rows in samples of 2 or 4 bits, packed and unpacked; places without a sample are 0."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = order_pixels(spark, sf_dir).select("image_id", "frame_idx", "y", "x", (F.col("r") % (1 << bits)).alias("v"))
        back = samples.unpacked_rows(samples.packed_rows(v, bits), bits, (F.floor(F.length("content") * 8 / bits)).cast("int"))
        return back.where("v > 0").select("image_id", "x", "v")

    return run


def chunky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names, and shorter and reversed forms of them, as planes of one and of two bytes."""
    name = F.col("p_name")
    planes = F.array(*[F.encode(c, "utf-8") for c in (name, F.reverse(name), F.substring(name, 1, 9))])
    n = F.length(name)
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(samples.chunky(planes, n)).alias("one"), F.hex(samples.chunky(planes, F.floor(n / 2).cast("int"), 2)).alias("two"))


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.encode("p_name", "utf-8")
    return table(spark, sf_dir, "part").select("p_partkey", F.crc32(name).alias("crc32"), samples.adler32(name).alias("adler32"))


def jpeg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables at a quality from a part's key, what they add up to, and the quality estimated from them in thousandths."""
    q = (F.col("p_partkey") % 100 + 1).cast("int")
    t = table(spark, sf_dir, "part").select("p_partkey", samples.scaled_table(samples.LUMINANCE, q).alias("l"), samples.scaled_table(samples.CHROMINANCE, q).alias("c"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, v: s + v).cast("long")
    return t.select("p_partkey", total("l").alias("sum_l"), total("c").alias("sum_c"), F.floor(samples.estimated_quality(F.col("l"), F.col("c")) * 1000 + 0.5).cast("long").alias("quality"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of a part's size, in tiles of its key."""
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 7).cast("int").alias("width"), (F.col("p_size") + 3).cast("int").alias("height"))
    return transforms.tile_grid(images, F.col("p_partkey") % 50 + 20, F.col("p_partkey") % 7 + 5).drop("width", "height")


def packet_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as packets of the tiles that their suppliers stand for."""
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), (F.col("l_suppkey") % 3).cast("int").alias("tile"), F.col("l_quantity").cast("long").alias("length"))
    return palette.length_statistics(parts)


def more_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old BMP, extended WebP and commented Netpbm headers with a part's key and size as sides, and loop counts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    low = containers.little_hex
    bmp = F.concat(F.lit("424D00000000000000000000" + "0000" + "0C000000"), low(key, 2), low(size, 2), F.lit("01001800"))
    webp = F.concat(F.lit("52494646240000005745425056503858" + "0A00000000000000"), low(key, 3), low(size - 1, 3), F.lit("414E494D06000000FFFFFFFF"), low(key % 1000, 2))
    gif = F.concat(F.lit("474946383961"), low(key, 2), low(size, 2), F.lit("00000021FF" + headers.NETSCAPE), low(key % 777, 2), F.lit("00"))
    pnm = F.concat(F.lit("P5 # it is "), F.col("p_name"), F.lit("\n"), key.cast("string"), F.lit(" #\n "), size.cast("string"), F.lit("\n255\n"))
    t = parts(spark, sf_dir, "p_name", "p_size").select("p_partkey", made(bmp=F.unhex(bmp), webp=F.unhex(webp), gif=F.unhex(gif), pnm=F.encode(pnm, "utf-8")))
    t = t.select("p_partkey", headers.header(F.col("bmp")).alias("b"), headers.header(F.col("webp")).alias("w"), headers.pnm_header(F.col("pnm")).alias("n"), headers.loop_count(F.col("gif")).alias("gif_loops"), headers.loop_count(F.col("webp")).alias("webp_loops"), headers.loop_count(F.col("bmp")).alias("no_loops"))
    return t.select("p_partkey", F.col("b.width").alias("bmp_width"), F.col("b.height").alias("bmp_height"), F.col("b.depth").alias("bmp_depth"), F.col("w.width").alias("webp_width"), F.col("w.height").alias("webp_height"), F.col("n.format").alias("pnm_format"), F.col("n.width").alias("pnm_width"), F.col("n.height").alias("pnm_height"), F.col("n.most").alias("pnm_most"), "gif_loops", "webp_loops", "no_loops")


def metadata_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of metadata that a part's key and name go into and partly come out of."""
    odd = F.col("p_partkey") % 2 == 1
    start = F.when(odd, F.create_map(F.lit("ico"), F.col("p_name"))).otherwise(F.lit(None).cast("map<string,string>"))
    put = frames.set_metadata(frames.set_metadata(start, "ani", F.col("p_partkey").cast("string")), "ico", F.lit("new"))
    t = table(spark, sf_dir, "part").select("p_partkey", start.alias("m0"), put.alias("m1"), frames.remove_metadata(put, "ani").alias("m2"))
    return t.select("p_partkey", frames.get_metadata(F.col("m0"), "ico").alias("ico_before"), frames.has_metadata(F.col("m0"), "ico").alias("had_ico"), frames.get_metadata(F.col("m1"), "ani").alias("ani"), frames.get_metadata(F.col("m1"), "ico").alias("ico"), frames.has_metadata(F.col("m2"), "ani").alias("has_ani"), F.size("m2").cast("long").alias("n_left"))


def hotspot_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotspots and rates set at places beyond the arrays' ends."""
    at = (F.col("p_partkey") % 4).cast("int")
    spots = frames.set_hotspot(F.lit(None).cast("array<struct<x:int,y:int>>"), at, F.col("p_size"), F.lit(7))
    spots = frames.set_hotspot(spots, F.lit(1), F.lit(3), F.lit(4))
    rates = frames.set_step_rate(F.array(F.lit(5)), at, F.col("p_size").cast("int"), F.lit(10))
    as_text = lambda a: F.array_join(a, ",")
    return table(spark, sf_dir, "part").select("p_partkey", as_text(F.transform(spots, lambda s: F.concat_ws(":", s["x"], s["y"]))).alias("spots"), as_text(F.transform(rates, lambda r: r.cast("string"))).alias("rates"))


def images_resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of two frames with hotspots and other columns, resized; the second frame is of another size."""
    own = F.struct("width", "height", F.lit(70_000).cast("long").alias("duration_us"), "rgba")
    small = F.struct(F.lit(1).alias("width"), F.lit(2).alias("height"), F.lit(90_000).cast("long").alias("duration_us"), F.unhex(F.lit("0102030405060708")).alias("rgba"))
    spot = F.struct((F.col("image_id") % 8).cast("int").alias("x"), F.lit(5).alias("y"))
    images = emb_rgba(spark, sf_dir).select("image_id", (F.col("image_id") % 5).alias("loop_count"), F.array(own, small).alias("frames"), F.array(spot).alias("hotspots"))
    out = frames.resized_images(images, 3, 5, "nearest")
    each = frames.frames_of(out.drop("hotspots"))
    sizes = each.select("image_id", "loop_count", "frame_idx", "width", "height", "duration_us", F.hex(F.substring("rgba", 1, 4)).alias("first"))
    spots = out.select(F.col("image_id"), F.col("hotspots")[0]["x"].alias("spot_x"), F.col("hotspots")[0]["y"].alias("spot_y"))
    return sizes.join(spots, "image_id")


def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main diagonal of each frame set to a colour."""
    px = frames.pixels_of(emb_frames(spark, sf_dir))
    patch = px.where("x = y").select("image_id", "frame_idx", "y", "x", F.lit(1).alias("r"), F.col("x").alias("g"), F.lit(3).alias("b"), F.lit(4).alias("a"))
    return frames.patched(px, patch).select("image_id", "y", "x", *"rgba")


def keep_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of three frames without all but the first."""
    own = F.struct("width", "height", "duration_us", "rgba")
    images = emb_frames(spark, sf_dir).select("image_id", frames.keep_root(F.array(own, own, own)).alias("frames"))
    return frames.frames_of(images).select("image_id", "frame_idx", F.hex("rgba").alias("rgba_hex"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered functions in one SQL statement: frames encoded, detected, decoded, resized and taken apart."""
    sql.register(spark)
    images = emb_rgba(spark, sf_dir).select("image_id", F.array(F.struct("width", "height", "duration_us", "rgba")).alias("frames"))
    return spark.sql(
        """WITH coded AS (SELECT image_id, image_encode(f.rgba, f.width, f.height, 'qoi') AS content FROM {images}, LATERAL image_frames(frames) AS f),
        decoded AS (SELECT image_id, image_info(content) AS info, image_decode(content, image_detect(content)) AS d FROM coded),
        small AS (SELECT image_id, info, image_resize(d.rgba, d.width, d.height, 3, 2, 'nearest') AS rgba FROM decoded)
        SELECT image_id, info.format, info.width, info.height, p.y, p.x, p.r, p.g, p.b, p.a FROM small, LATERAL image_pixels(rgba, 3, 2) AS p""",
        images=images,
    )


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that the driver and the executors share; a local one only where none is set and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='rasterlake-')}/files-{uuid.uuid4().hex}"


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder into which each frame is written as a file of one of three formats, in folders by format."""
    f, folder = emb_frames(spark, sf_dir), scratch_folder(spark)
    kinds = ["png", "bmp", "qoi"]
    for k, kind in enumerate(kinds):
        some = encode_frames(f.where(F.col("image_id") % 3 == k), kind)
        write_files(some.select(F.concat(F.lit(f"{kind}/"), F.col("image_id").cast("string"), F.lit(f".{kind}")).alias("name"), "content"), folder)
    return folder


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written, and read back by their names: every pixel must come back."""
    files = decode_frames(read_files(spark, written_files(spark, sf_dir)))
    key = F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long")
    return gray_pixels(files.select(key.alias("image_id"), F.lit(0).alias("frame_idx"), "width", "height", "rgba"))


def streamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream that runs until all are read, counted by what their bytes show."""
    folder, out = written_files(spark, sf_dir), scratch_folder(spark)
    found = stream_frames(spark, folder, "content").select("format", "width", "height", "error")
    query = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{out}/rows")
    return rows.groupBy("format", "width", "height").agg(F.count(F.lit(1)).alias("n_files"), F.count("error").alias("n_errors"))


def word(r, g, b):
    """A 16-bit word of a pixel."""
    return r * 128 + g * 2 + F.floor(b / 64)


#: Masks of ten bits, of the highest byte, of eight bits, of bits apart, and none.
WIDE = (0x3FF00000, 0xFF000000, 0x0000FF00, 0x00000F0F, 0)

QUERIES = {
    "detect_format": detect_format,
    "pixel_explode": pixel_explode,
    "get_set_pixel": get_set_pixel,
    "frame_edits": frame_edits,
    "assemble_frames": assemble,
    "pack_rgba": over_lines(lambda r, g, b, a: [rgba.pack(r, g, b, a).alias("word")]),
    "resize_nearest": resized(5, 5, "nearest"),
    "resize_nearest_up": resized(11, 13, "nearest"),
    "resize_area": resized(5, 3, "bilinear"),
    "resize_bilinear_up": resized(11, 13, "bilinear"),
    "resize_bicubic_up": resized(11, 13, "bicubic"),
    "grayscale": over_lines(lambda r, g, b, a: [color.gray(r, g, b).alias("gray")]),
    "threshold_pbm": over_lines(lambda r, g, b, a: [color.bit(color.gray(r, g, b)).alias("black")]),
    "ycbcr_forward": over_lines(lambda r, g, b, a: [*color.ycbcr(r, g, b)]),
    "ycbcr_inverse": over_lines(lambda r, g, b, a: [*color.rgb_of_ycbcr(r, g, b)]),
    "cmyk_to_rgb": over_lines(lambda r, g, b, a: [*color.rgb_of_cmyk(r, g, b, a)]),
    "studio_yuv": over_lines(lambda r, g, b, a: [*color.studio_yuv(r, g, b)]),
    "srgb_light": srgb_light,
    "mask_565": over_lines(lambda r, g, b, a: [color.masked(word(r, g, b), m).cast("long").alias(n) for n, m in zip("rgb", (0xF800, 0x07E0, 0x001F), strict=True)]),
    "mask_wide": over_lines(lambda r, g, b, a: [color.masked(((r.cast("long") * 256 + g) * 256 + b) * 256 + a, m).alias(n) for n, m in zip(("ten", "high", "byte", "gaps", "none"), WIDE, strict=True)]),
    "expand_555": over_lines(lambda r, g, b, a: [color.five_to_eight(F.floor(r / 8).cast("int")).cast("long").alias("r"), color.word_555(r, g, b).cast("long").alias("word")]),
    "gray_16_to_8": over_lines(lambda r, g, b, a: [color.gray_of_16(r * 256 + g).alias("gray")]),
    "scale_sample": over_lines(lambda r, g, b, a: [color.scale_sample(r, F.lit(255) - b % 100).alias("scaled")]),
    "fixed_point": over_lines(lambda r, g, b, a: [color.fixed_of_double((r - 100) / F.lit(20.0)).alias("fixed"), color.double_of_fixed(r.cast("long") * 256 + g).alias("double")]),
    "subtract_green": over_lines(lambda r, g, b, a: [*[c.cast("int").alias(n) for c, n in zip(color.subtract_green(r, g, b), "rgb", strict=True)]]),
    "color_slot": over_lines(lambda r, g, b, a: [prediction.color_slot(r, g, b, a).alias("slot")]),
    "nearest_palette": lambda s, d: palette.nearest_color(line_pixels(s, d), PALETTE).select("image_id", "x", "idx"),
    "alpha_stats": per_image(palette.alpha_stats),
    "icon_depth": per_image(palette.icon_depth),
    "pnm_class": lambda s, d: palette.pnm_class(frames.pixels_of(emb_frames(s, d)).unionByName(line_pixels(s, d).withColumn("image_id", -F.col("image_id") - 1))),
    "palette_first_n": lambda s, d: palette.first_colors(order_pixels(s, d), 3),
    "image_means": per_image(palette.image_means),
    "histogram": lambda s, d: palette.histogram(line_pixels(s, d)),
    "flips": flips,
    "predictor_forward": predictor,
    "predictor_round_trip": predictor_round_trip,
    "rle_runs": rle_runs,
    "composite_keep": composite,
    "webp_blend": webp_blend,
    "frame_durations": frame_durations,
    "hotspots_and_rates": hotspots,
    **{f"header_{k}": header_fields(k) for k in ("png", "bmp", "tga", "qoi")},
    "icon_directory": icon_directory,
    "tiff_tags": tiff_tags,
    "reversible_color": over_lines(lambda r, g, b, a: transforms.reversible_color(r, g, b)),
    "reversible_round_trip": reversible_round_trip,
    "wavelet53": wavelet,
    "wavelet_round_trip": wavelet_round_trip,
    "sending_order": sending_order,
    "fixed_pixels": over_lines(lambda r, g, b, a: [c.alias(f"{c0}8") for c0, c in zip("rgba", color.rgba_of_fixed(r * 40, g * 40, 65536 - b, a * 64), strict=True)] + [c.alias(f"{c0}16") for c0, c in zip("rgba", color.fixed_of_rgba(r, g, b, a), strict=True)]),
    "sample_forms": over_lines(lambda r, g, b, a: [color.white_is_zero(r).alias("black_is_zero"), color.high_byte(r * 256 + g).alias("high")]),
    "tiff_luma": over_lines(lambda r, g, b, a: color.rgb_of_luma_ycbcr(r, g, b, (0.2126, 0.7152, 0.0722))),
    "yuv_inverse": over_lines(lambda r, g, b, a: color.rgb_of_studio_yuv(r, g, b)),
    "chroma_420": over_pixels(lambda px: transforms.chroma_420(px).drop("frame_idx")),
    "upsample_simple": upsampled(False),
    "upsample_fancy": upsampled(True),
    "add_green": over_lines(lambda r, g, b, a: [c.cast("int").alias(n) for n, c in zip("rgb", color.add_green(r, g, b), strict=True)]),
    "color_transform": over_lines(lambda r, g, b, a: color.add_color_transform(r, g, b, F.lit(200), F.lit(17), F.lit(130))),
    **{f"filter_{k}": over_pixels(lambda px, k=k: prediction.filtered(px, k).drop("frame_idx")) for k in ("up", "average", "paeth")},
    **{f"filter_frames_{k}": filter_frames(k) for k in ("up", "average", "paeth")},
    **{f"filter_{k}_frames_round_trip": filter_frames(k, True) for k in ("sub", "average", "paeth")},
    "wavelet97_round_trip": over_pixels(lambda px: transforms.inverse_wavelet97(transforms.wavelet97(px, "g"), "coefficient", "back").select("image_id", "y", "x", F.floor(F.col("back") + 0.5).cast("int").alias("g"))),
    "filter_up_round_trip": over_pixels(lambda px: prediction.unfiltered_up(prediction.filtered(px, "up")).drop("frame_idx")),
    "rle_packets": lambda s, d: prediction.packets(order_pixels(s, d).withColumns({c: F.lit(0) for c in "rgb"})).select("image_id", "x", "n", "raw"),
    "qoi_operations": qoi_operations,
    "gif_canvas": gif_canvas,
    "webp_canvas": webp_canvas,
    "palette_apply": palette_apply,
    "palette_padded": lambda s, d: palette.first_colors(order_pixels(s, d), 4, padded=True),
    "channel_histogram": lambda s, d: palette.channel_histogram(line_pixels(s, d)),
    "packet_lengths": packet_lengths,
    "pbm_rows": pbm_rows,
    "bits_2_round_trip": bits_round_trip(2),
    "bits_4_round_trip": bits_round_trip(4),
    "chunky": chunky,
    "checksums": checksums,
    "png_legal": lambda s, d: table(s, d, "part").select("p_partkey", samples.png_is_legal(F.col("p_partkey") % 17, F.col("p_size") % 8).alias("legal")),
    "jpeg_quality": jpeg_quality,
    "wavelet_2d": over_pixels(lambda px: transforms.decompose53(px, "r", 1).drop("frame_idx", "level")),
    "wavelet_levels_round_trip": over_pixels(lambda px: transforms.compose53(transforms.decompose53(px, "b", 3), 3).drop("frame_idx")),
    "wavelet97": over_pixels(lambda px: transforms.wavelet97(px, "g").select("image_id", "y", "x", F.floor(F.col("coefficient").cast("double") * 100).cast("long").alias("c"))),
    "irreversible_color": over_lines(lambda r, g, b, a: [F.floor(c.cast("double") * 100).cast("long").alias(n) for n, c in zip("yuv", transforms.irreversible_color(r, g, b), strict=True)]),
    "irreversible_inverse": over_lines(lambda r, g, b, a: transforms.color_of_irreversible(*[c.cast("float") for c in (r, g - 128, b - 128)])),
    "dead_zone": over_lines(lambda r, g, b, a: [transforms.dead_zone(r - 128, 7.5).alias("q"), transforms.of_dead_zone(transforms.dead_zone(r - 128, 7.5), 7.5).alias("c")]),
    "dequantized": over_lines(lambda r, g, b, a: [transforms.dequantized(r - 128, g % 9 + 1).alias("d"), transforms.level_shifted((r - 128) * F.lit(1.25)).alias("s")]),
    "tile_grid": tile_grid,
    "more_headers": more_headers,
    "metadata_edits": metadata_edits,
    "hotspot_edits": hotspot_edits,
    "images_resized": images_resized,
    "patched": patched,
    "keep_root": keep_root,
    "sql_functions": sql_functions,
    "files_round_trip": files_round_trip,
    "streamed_files": streamed_files,
    **{f"rgba_{n}": resized_rgba(*size, mode) for n, *size, mode in (("nearest", 5, 3, "nearest"), ("area", 5, 3, "bilinear"), ("bilinear", 11, 13, "bilinear"), ("bicubic", 11, 13, "bicubic"))},
    **{f"rgba_{k}": rgba_round_trip(k) for k in ("png", "bmp", "tga", "qoi")},
    **{f"codec_{k}": codec_round_trip(k) for k in ("png", "bmp", "tga", "qoi", "pgm", "ppm")},
    **containers.QUERIES,
    **bitmaps.QUERIES,
    **coding.QUERIES,
    **jpeg2000.QUERIES,
}
