"""Queries over files made from the tables: chunks of PNG, WebP and cursor files, and the images, tags and pixels of TIFF files.
Files of some keys are cut, or have a wrong check or a false offset. Each query has its SQL, which knows the files by formula."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made
from rasterlake.operators import containers, tiff
from rasterlake.plans.tables import SIDE, emb_rgba, parts, table


def big_hex(v: Column, size: int) -> Column:
    """The low bytes of a number that is not negative."""
    return F.substring(F.lpad(F.hex(v.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)


def once(v: Column, use) -> Column:
    """What use makes of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(v), use), F.lit(0))


def little_hex(v: Column | int, size: int) -> Column:
    if isinstance(v, int):
        return F.lit(v.to_bytes(size, "little").hex().upper())
    return once(big_hex(v, size), lambda digits: F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def riff_chunk(kind: str, data: Column) -> Column:
    """A RIFF chunk of data in hexadecimal digits. The data is computed once: named four times in each of some chunks that hold one
    another, it would be computed as often as the power of four by their depth."""
    head, pad = F.lit(kind.encode().hex().upper()), lambda d: F.when(F.length(d) % 4 == 2, F.lit("00")).otherwise(F.lit(""))
    return once(data, lambda d: F.concat(head, little_hex(F.length(d) / 2, 4), d, pad(d)))


def up_to_four(count: Column, piece) -> Column:
    """The pieces of 1, 2, ... up to a count of at most four."""
    return F.concat(*[F.when(count >= k, piece(k)).otherwise(F.lit("")) for k in range(1, 5)])


def png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files of a part: a header, its name, its brand as data, an end. The data of every fifth has a wrong check, every seventh
    file is cut within its end, and every eleventh within its data's check."""
    key = F.col("p_partkey")

    def chunk(kind: str, data: Column, off: Column | int = 0) -> Column:
        named = F.concat(F.lit(kind.encode().hex().upper()), data)
        return F.concat(big_hex(F.length(data) / 2, 4), named, big_hex((F.crc32(F.unhex(named)) + off) % (1 << 32), 4))

    head = F.concat(big_hex(key, 4), big_hex(F.col("p_size"), 4), F.lit("0802000000"))
    whole = F.concat(F.lit("89504E470D0A1A0A"), chunk("IHDR", head), chunk("tEXt", F.hex(F.encode("p_name", "utf-8"))), chunk("IDAT", F.hex(F.encode("p_brand", "utf-8")), (key % 5 == 0).cast("int")), chunk("IEND", F.lit("")))
    gone = F.when(key % 7 == 0, 6).when(key % 11 == 0, 14).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", made(whole=F.unhex(whole))).select("p_partkey", F.substring("whole", F.lit(1), F.length("whole") - gone).alias("content"))


def webp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animated WebP files of a part: 1 to 4 frames, of which the odd ones have an alpha plane before their data; the last frame of
    every fifth is cut, and every seventh file does not say that it is animated."""
    key, n = F.col("p_partkey"), F.col("p_size") % 4 + 1
    place = F.concat(little_hex(key % 50, 3), little_hex(key, 3))  # a frame's row and its width
    alpha = lambda k: riff_chunk("ALPH", F.lit("CD" * k)) if k % 2 else F.lit("")
    image = lambda k: riff_chunk("VP8 " if k % 4 else "VP8L", F.repeat(F.lit("AB"), (key % 7 + k).cast("int")))
    fields = lambda k: F.concat(little_hex(k, 3), F.col("place"), little_hex(k * 3, 3), little_hex(k * 10, 3), little_hex(k % 4, 1))
    frame = lambda k: riff_chunk("ANMF", F.concat(fields(k), alpha(k), image(k)))
    head = riff_chunk("VP8X", F.concat(F.when(key % 7 == 0, little_hex(16, 1)).otherwise(little_hex(18, 1)), F.lit("000000"), little_hex(key, 3), little_hex(F.col("p_size"), 3)))
    body = F.concat(F.lit(b"WEBP".hex().upper()), head, riff_chunk("ANIM", F.concat(F.lit("11223344"), little_hex(key % 1000, 2))), up_to_four(n, frame))
    files = parts(spark, sf_dir, "p_size").select("*", made(place=place)).select("p_partkey", "p_size", made(whole=F.unhex(riff_chunk("RIFF", body))))
    return files.select("p_partkey", "p_size", F.substring("whole", F.lit(1), F.length("whole") - F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("content"))


def cursor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Animated cursors of a part: a header, icons in a list, for odd keys the rates of the first two steps, and for every third key
    a sequence that begins with a frame that is not there."""
    key, n = F.col("p_partkey"), F.col("p_size") % 4 + 1
    word = lambda v: little_hex(v, 4)
    head = riff_chunk("anih", F.concat(*[word(v) for v in (36, n, n, 0, 0, 0, 0, key % 60 + 1, 1)]))
    icons = riff_chunk("LIST", F.concat(F.lit(b"fram".hex().upper()), up_to_four(n, lambda k: riff_chunk("icon", F.repeat(F.lit("EF"), (key % 3 + k).cast("int"))))))
    rate = F.when(key % 2 == 1, riff_chunk("rate", F.concat(word(7), word(8)))).otherwise(F.lit(""))
    order = F.when(key % 3 == 0, riff_chunk("seq ", F.concat(word(9), word(n - 1), word(0)))).otherwise(F.lit(""))
    body = F.concat(F.lit(b"ACON".hex().upper()), head, rate, order, icons)
    return parts(spark, sf_dir, "p_size").select("p_partkey", made(content=F.unhex(riff_chunk("RIFF", body))))


def tiff_frame(order: str, big: bool, size: int, tags: dict[int, tuple[str, list[int]]]) -> tuple[bytes, bytes]:
    """What stands before and after `size` bytes of data in a file of one directory; tags are by number, with the letter that
    struct has for their type, and their values."""
    kinds = {"B": 1, "H": 3, "I": 4, "Q": 16}
    head = struct.pack(order + ("HHHQ" if big else "HI"), *((43, 8, 0, 16 + size) if big else (42, 8 + size)))
    start, entry, inside = (16 + size, 20, 8) if big else (8 + size, 12, 4)
    extra_at, entries, extra = start + (16 if big else 6) + entry * len(tags), b"", b""
    for tag, (kind, values) in sorted(tags.items()):
        own = struct.pack(order + kind * len(values), *values)
        if len(own) > inside:
            own, extra = struct.pack(order + ("Q" if big else "I"), extra_at + len(extra)), extra + own
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, kinds[kind], len(values)) + own.ljust(inside, b"\0")
    count = struct.pack(order + ("Q" if big else "H"), len(tags))
    return (b"II" if order == "<" else b"MM") + head, count + entries + bytes(8 if big else 4) + extra


TILE = (5, 3)


def tiled_places(width: int, height: int, tile: tuple[int, int]) -> list[list[int]]:
    """The pixels of each tile by rows, -1 beyond the image."""
    across, down = -(-width // tile[0]), -(-height // tile[1])
    place = lambda y, x: y * width + x if y < height and x < width else -1
    return [[place(ty * tile[1] + r, tx * tile[0] + i) for r in range(tile[1]) for i in range(tile[0])] for ty in range(down) for tx in range(across)]


def tiff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four-channel frames as TIFF files, by the image's number modulo 7: strips of three rows, planes in strips, tiles, planes
    in tiles, 16-bit grey in which 0 is white, a file that is cut, and one whose chain of directories comes back."""
    digits = F.hex("rgba")
    pixel = lambda k: F.substring(digits, (k * 8 + 1).cast("int"), F.lit(8))
    channel = lambda k, c: F.substring(digits, (k * 8 + 2 * c + 1).cast("int"), F.lit(2))
    over = lambda places, piece, blank: F.array_join(F.transform(F.array(*map(F.lit, places)), lambda k: F.when(k < 0, F.lit(blank)).otherwise(piece(k))), "")
    rows, tiles = list(range(SIDE * SIDE)), [k for t in tiled_places(SIDE, SIDE, TILE) for k in t]
    planes = lambda places: F.concat(*[over(places, lambda k, c=c: channel(k, c), "00") for c in range(4)])
    base = {tiff.WIDTH: ("H", [SIDE]), tiff.HEIGHT: ("I", [SIDE]), tiff.BITS: ("H", [8] * 4), tiff.COMPRESSION: ("H", [1]), tiff.PHOTOMETRIC: ("H", [2]), tiff.SAMPLES: ("H", [4])}

    def strips(at: int, planar: bool, kind: str) -> dict:
        sizes = [24, 24, 16] * 4 if planar else [96, 96, 64]
        return base | {tiff.STRIP_ROWS: ("H", [3]), tiff.PLANAR: ("H", [1 + planar]), tiff.STRIP_OFFSETS: (kind, [at + sum(sizes[:k]) for k in range(len(sizes))]), tiff.STRIP_COUNTS: (kind, sizes)}

    def tile_tags(at: int, planar: bool, kind: str) -> dict:
        sizes = [15] * 24 if planar else [60] * 6
        return base | {tiff.TILE_WIDTH: ("H", [TILE[0]]), tiff.TILE_HEIGHT: ("H", [TILE[1]]), tiff.PLANAR: ("H", [1 + planar]), tiff.TILE_OFFSETS: (kind, [at + size * k for k, size in enumerate(sizes)]), tiff.TILE_COUNTS: (kind, sizes)}

    gray = {tiff.WIDTH: ("H", [SIDE]), tiff.HEIGHT: ("H", [SIDE]), tiff.BITS: ("H", [16]), tiff.PHOTOMETRIC: ("H", [0]), tiff.STRIP_OFFSETS: ("I", [8]), tiff.STRIP_COUNTS: ("I", [128])}
    variants = [
        (tiff_frame("<", False, 256, strips(8, False, "I")), over(rows, pixel, "")),
        (tiff_frame(">", False, 256, strips(8, True, "H")), planes(rows)),
        (tiff_frame("<", True, 360, tile_tags(16, False, "Q")), over(tiles, pixel, "00000000")),
        (tiff_frame(">", True, 360, tile_tags(16, True, "I")), planes(tiles)),
        (tiff_frame("<", False, 128, gray), over(rows, lambda k: F.concat(channel(k, 1), channel(k, 0)), "")),
    ]
    content = F.lit(None).cast("binary")
    for k, ((head, tail), data) in enumerate(variants):
        content = F.when(F.col("image_id") % 7 == k, F.unhex(F.concat(F.lit(head.hex()), data, F.lit(tail.hex())))).otherwise(content)
    (head, tail), _ = variants[0]
    false = dict(strips(8, False, "I"))
    false[tiff.STRIP_OFFSETS] = ("I", [8, 104, 100_000])
    content = F.when(F.col("image_id") % 7 == 5, F.unhex(F.concat(F.lit(tiff_frame("<", False, 256, false)[0].hex()), digits, F.lit(tiff_frame("<", False, 256, false)[1].hex())))).otherwise(content)
    n = len(strips(8, False, "I"))
    again = tail[: 2 + 12 * n] + struct.pack("<I", 8 + 256) + tail[6 + 12 * n :]
    content = F.when(F.col("image_id") % 7 == 6, F.unhex(F.concat(F.lit(head.hex()), digits, F.lit(again.hex())))).otherwise(content)
    return emb_rgba(spark, sf_dir).select("image_id", made(content=content))


def tiff_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.tiff_images(tiff_files(spark, sf_dir)).select("image_id", "directory", "width", "height", "bits", "tiled", "planes", "across", "down", "row_bytes", F.size("offsets").alias("n_offsets"), "error")


def tiff_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tiff.tiff_segments(tiff_files(spark, sf_dir))
    return s.select("image_id", "directory", "segment", "y0", "x0", "rows", "cols", F.size("parts").alias("n_parts"), F.length(F.col("parts")[0]).alias("n_bytes"))


def webp_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks of each kind and depth a file has, and of how many bytes."""
    chunks = containers.chunk_table(webp_files(spark, sf_dir))
    return chunks.groupBy("p_partkey", "depth", F.coalesce("kind", F.lit("-")).alias("kind"), F.coalesce("error", F.lit("-")).alias("error")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


QUERIES = {
    "png_chunks": lambda s, d: containers.chunk_table(png_files(s, d)),
    "webp_chunks": webp_loops,
    "webp_frames": lambda s, d: containers.webp_frames(webp_files(s, d)).drop("p_size"),
    "cursor_steps": lambda s, d: containers.cursor_steps(cursor_files(s, d)),
    "tiff_images": tiff_sizes,
    "tiff_segments": tiff_cuts,
    "tiff_pixels": lambda s, d: tiff.tiff_pixels(tiff_files(s, d)),
}

_WEBP = """f AS (SELECT p_partkey AS pk, p_size % 4 + 1 AS n, k, k % 2 = 1 AS alpha, CASE WHEN k % 4 = 0 THEN 'VP8L' ELSE 'VP8 ' END AS kind, pk % 7 + k AS data, p_size FROM part, range(1, 5) t(k) WHERE k <= p_size % 4 + 1),
  z AS (SELECT *, data + data % 2 + 8 + CASE WHEN alpha THEN k + k % 2 + 8 ELSE 0 END AS inner_size FROM f),
  a AS (SELECT *, 52 + 8 + coalesce(sum(inner_size + 24) OVER (PARTITION BY pk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS frame_at, k = n AND pk % 5 = 0 AS cut FROM z)"""
SQL = {
    "png_chunks": """WITH f AS (SELECT p_partkey, p_partkey AS k, octet_length(encode(p_name)) AS n, octet_length(encode(p_brand)) AS b FROM part),
      c AS (SELECT *, CASE WHEN k % 7 = 0 THEN 6 WHEN k % 11 = 0 THEN 14 ELSE 0 END AS gone FROM f),
      r AS (SELECT p_partkey, 0 AS chunk, 'IHDR' AS kind, 16 AS start, 13 AS size, true AS crc_ok, NULL AS error FROM c
        UNION ALL SELECT p_partkey, 1, 'tEXt', 41, n, true, NULL FROM c
        UNION ALL SELECT p_partkey, 2, 'IDAT', 53 + n, b, CASE WHEN gone < 14 THEN k % 5 <> 0 END, CASE WHEN gone = 14 THEN 'cut' END FROM c
        UNION ALL SELECT p_partkey, 3, CASE WHEN gone = 0 THEN 'IEND' END, CASE WHEN gone = 0 THEN 65 + n + b ELSE 57 + n + b END, CASE WHEN gone = 0 THEN 0 ELSE 6 END, CASE WHEN gone = 0 THEN true END, CASE WHEN gone = 6 THEN 'cut header' END FROM c WHERE gone < 14)
      SELECT p_partkey, chunk, 0 AS depth, NULL::INT AS parent, kind, start::BIGINT AS start, size::BIGINT AS size, crc_ok, error FROM r""",
    "webp_chunks": f"""WITH {_WEBP}, odd AS (SELECT *, pk % 5 = 0 AND (data % 2 = 0) AS loses FROM a),
      r AS (SELECT pk, 0 AS depth, 'RIFF/WEBP' AS kind, CASE WHEN pk % 5 = 0 THEN 'cut' ELSE '-' END AS error, 32 + sum(inner_size + 24) AS bytes FROM a GROUP BY pk
        UNION ALL SELECT DISTINCT pk, 1, 'VP8X', '-', 10 FROM a UNION ALL SELECT DISTINCT pk, 1, 'ANIM', '-', 6 FROM a
        UNION ALL SELECT pk, 1, 'ANMF', CASE WHEN cut THEN 'cut' ELSE '-' END, inner_size FROM a
        UNION ALL SELECT pk, 2, 'ALPH', '-', k FROM a WHERE alpha
        UNION ALL SELECT pk, 2, kind, CASE WHEN cut AND data % 2 = 0 THEN 'cut' ELSE '-' END, data FROM a)
      SELECT pk AS p_partkey, depth, kind, error, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""",
    "webp_frames": f"""WITH {_WEBP} SELECT pk AS p_partkey, (k - 1)::INT AS frame_idx, 2 * k AS x, 2 * (pk % 50) AS y, pk + 1 AS width, 3 * k + 1 AS height, 10 * k AS duration_ms, k % 4 < 2 AS blend, k % 2 = 1 AS dispose,
      alpha OR kind = 'VP8 ' AS lossy, (frame_at + 24 + CASE WHEN alpha THEN k + k % 2 + 8 ELSE 0 END - 8 + 0)::BIGINT AS start, data AS size, CASE WHEN alpha THEN (frame_at + 16)::BIGINT END AS alpha_start, CASE WHEN alpha THEN k END AS alpha_size
      FROM a WHERE pk % 7 <> 0 AND NOT cut""",
    "cursor_steps": """WITH p AS (SELECT p_partkey, p_partkey % 2 AS has_rate, p_partkey % 3 = 0 AS has_seq, p_size % 4 + 1 AS n, p_partkey % 3 AS more, 56 + 16 * (p_partkey % 2) + CASE WHEN p_partkey % 3 = 0 THEN 20 ELSE 0 END + 12 AS icons FROM part),
      i AS (SELECT p_partkey, k - 1 AS frame, k + more AS size, icons + 8 + coalesce(sum(8 + k + more + (k + more) % 2) OVER (PARTITION BY p_partkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p, range(1, 5) t(k) WHERE k <= n),
      s AS (SELECT p.*, step, CASE WHEN has_seq THEN [9, n - 1, 0][step + 1] ELSE step END AS frame FROM p, range(4) t(step) WHERE step < CASE WHEN has_seq THEN 3 ELSE n END)
      SELECT s.p_partkey, step::INT AS step, s.frame::BIGINT AS frame, (CASE WHEN has_rate = 1 AND step < 2 THEN 7 + step ELSE s.p_partkey % 60 + 1 END)::BIGINT AS jiffies, i.start::BIGINT AS start, i.size::BIGINT AS size FROM s LEFT JOIN i ON i.p_partkey = s.p_partkey AND i.frame = s.frame""",
    "tiff_images": """SELECT vec_id AS image_id, d::INT AS directory, CASE WHEN d = 0 THEN 8::BIGINT END AS width, CASE WHEN d = 0 THEN 8::BIGINT END AS height, CASE WHEN d = 1 THEN 1 WHEN v = 4 THEN 16 ELSE 8 END::BIGINT AS bits, d = 0 AND v IN (2, 3) AS tiled,
      CASE WHEN d = 0 AND v IN (1, 3) THEN 4 ELSE 1 END::BIGINT AS planes, CASE WHEN d = 0 THEN CASE WHEN v IN (2, 3) THEN 2 ELSE 1 END END::BIGINT AS across, CASE WHEN d = 0 THEN CASE v WHEN 4 THEN 1 ELSE 3 END END::BIGINT AS down,
      CASE WHEN d = 0 THEN [32, 8, 20, 5, 16, 32, 32][v + 1] END::BIGINT AS row_bytes, CASE WHEN d = 0 THEN [3, 12, 6, 24, 1, 3, 3][v + 1] END::INT AS n_offsets, CASE WHEN v = 5 THEN 'short' WHEN d = 1 THEN 'loop' END AS error
      FROM (SELECT vec_id, vec_id % 7 AS v FROM embeddings), range(2) t(d) WHERE d = 0 OR v = 6""",
    "tiff_segments": """SELECT vec_id AS image_id, 0 AS directory, s AS segment, CASE WHEN v = 4 THEN 0 WHEN v IN (2, 3) THEN s // 2 * 3 ELSE s * 3 END::BIGINT AS y0, CASE WHEN v IN (2, 3) THEN s % 2 * 5 ELSE 0 END::BIGINT AS x0, rows::BIGINT AS rows, cols::BIGINT AS cols,
      CASE WHEN v IN (1, 3) THEN 4 ELSE 1 END::INT AS n_parts, (rows * [32, 8, 20, 5, 16, 0, 32][v + 1])::INT AS n_bytes
      FROM (SELECT vec_id, v, s, CASE WHEN v = 4 THEN 8 WHEN v IN (2, 3) THEN CASE WHEN s < 4 THEN 3 ELSE 2 END WHEN s < 2 THEN 3 ELSE 2 END AS rows, CASE WHEN v IN (2, 3) THEN CASE WHEN s % 2 = 0 THEN 5 ELSE 3 END ELSE 8 END AS cols
        FROM (SELECT vec_id, vec_id % 7 AS v FROM embeddings), range(6) t(s) WHERE v <> 5 AND s < CASE WHEN v IN (2, 3) THEN 6 WHEN v = 4 THEN 1 ELSE 3 END)""",
}
