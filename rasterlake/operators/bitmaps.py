"""BMP and TGA files as rows: all that their headers say, palettes, and the pixels of those that are not compressed.

files: any columns, and content. All of this is narrow: an image's rows are cut from the file in its row and exploded, and a
palette goes with them as an array of at most 256 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.color import five_to_eight, rgba_of_fixed
from rasterlake.functions.headers import little, signed32
from rasterlake.functions.rgba import byte_at, made, pack, unpack

#: The sizes of BMP headers; the compressions that OS/2 numbers otherwise; the mark of an embedded profile, and the
#: most bytes of one that is read.
KINDS = {12: "core", 16: "os2 short", 40: "v3", 52: "adobe", 56: "adobe alpha", 64: "os2", 108: "v4", 124: "v5"}
RGB, RLE8, RLE4, BIT_FIELDS, JPEG, PNG, ALPHA_BIT_FIELDS, RLE24, HUFFMAN = 0, 1, 2, 3, 4, 5, 6, 100, 101
OS2 = {0: RGB, 1: RLE8, 2: RLE4, 4: RLE24}
EMBEDDED, LARGEST_PROFILE = 0x4D424544, 1 << 20
FIVES, EIGHTS = (0x7C00, 0x03E0, 0x001F, 0), (0x00FF0000, 0x0000FF00, 0x000000FF, 0xFF000000)
#: TGA's types of images.
TGA_TYPES, TGA_MAPPED, TGA_GRAY, TGA_RUNS = (0, 1, 2, 3, 9, 10, 11), (1, 9), (3, 11), (9, 10, 11)
BLACK = 255

c = F.col


def first_of(*cases: tuple[Column, str]) -> Column:
    """The text of the first condition that holds; null if none does."""
    out = F.lit(None).cast("string")
    for when, text in reversed(cases):
        out = F.when(when, text).otherwise(out)
    return out


def bmp_images(files: DataFrame) -> DataFrame:
    """files with what their BMP headers say: kind (core, os2 short, v3, adobe, adobe alpha, os2, v4, v5), header_size, width,
    height, bottom_up, planes, depth, compression, image_size, x_per_meter, y_per_meter, colors_used, colors_important, the masks
    red_mask to alpha_mask, color_space, intent, palette_start, palette_colors, palette_entry (bytes), data_start, row_bytes,
    profile_start, profile_size, error.

    Headers over 40 bytes of other sizes are read as v3. Compressions are those of Windows, also for OS/2. A v3 header without masks
    has those that its depth implies. What a header does not hold is null, or 0 for masks. Rows of other files stay, with an
    error: 'no bitmap', 'icon' (of OS/2), 'cut', 'header size', 'no size', 'depth', 'compression' (one that the depth or the
    header does not go with), 'short' (rows that reach beyond the file), 'compressed'; null where bmp_pixels gives pixels.
    """
    data, size = F.coalesce("content", F.lit(b"")), F.coalesce(F.length("content"), F.lit(0))
    mark = lambda at: F.decode(F.substring(data, at + 1, F.lit(2)), "ISO-8859-1")
    kept = [F.col(f"`{n}`") for n in files.columns]
    base = F.when(mark(F.lit(0)) == "BA", 14).otherwise(0)
    t = files.select("*", made(__size=size, __base=base, __mark=mark(base)))
    at = c("__base") + 14
    raw = lambda k, n: little(data, at + k, n)
    t = t.select("*", made(__header=F.when(size >= at + 4, signed32(raw(0, 4)))))
    h = c("__header")
    whole = (c("__mark") == "BM") & (size >= at + h) & ((h > 40) | h.isin(*KINDS))
    kind = F.when(whole, F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, n in KINDS.items() for x in (k, n)]), h.cast("int")), F.lit("v3")))
    t = t.select("*", made(kind=kind, header_size=h))
    core, small, has = c("kind") == "core", c("kind").isin("core", "os2 short"), c("kind").isNotNull()
    long = has & ~small
    of = lambda k, n=4: F.when(long, raw(k, n))
    words = {"width": F.when(core, raw(4, 2)).when(has, signed32(raw(4, 4))), "__height": F.when(core, raw(6, 2)).when(has, signed32(raw(8, 4)))}
    words |= {"planes": F.when(core, raw(8, 2)).when(has, raw(12, 2)), "depth": F.when(core, raw(10, 2)).when(has, raw(14, 2)), "__code": F.when(small, RGB).otherwise(signed32(of(16)))}
    words |= {n: signed32(of(20 + 4 * k)) for k, n in enumerate(("image_size", "x_per_meter", "y_per_meter", "colors_used", "colors_important"))}
    t = t.select("*", made(**words))
    os2 = F.lit(None).cast("long")
    for k, v in OS2.items():
        os2 = F.when(c("__code") == k, v).otherwise(os2)
    t = t.select("*", made(compression=F.when(c("kind") == "os2", os2).otherwise(c("__code"))))
    # A v3 header may be followed by masks; headers of Adobe and later ones hold them.
    after = (h == 40) & c("compression").isin(BIT_FIELDS, ALPHA_BIT_FIELDS)
    masks_end = at + h + F.when(~after, 0).when(c("compression") == ALPHA_BIT_FIELDS, 16).otherwise(12)
    own = c("kind").isin("adobe", "adobe alpha", "v4", "v5") | after
    own_alpha = c("kind").isin("adobe alpha", "v4", "v5") | after & (c("compression") == ALPHA_BIT_FIELDS)
    masks = {}
    for k, n in enumerate(("red_mask", "green_mask", "blue_mask", "alpha_mask")):
        implied = F.when(~long, 0).when(c("depth").isin(32, 64), EIGHTS[k]).when(c("depth") == 16, FIVES[k]).otherwise(0).cast("long")
        masks[n] = F.when((own_alpha if k == 3 else own) & (size >= masks_end), raw(40 + 4 * k, 4)).when(has, implied)
    late, v5 = c("kind").isin("v4", "v5"), c("kind") == "v5"
    colors = F.when(~has | (c("depth") > 8), 0).when(c("colors_used") > 0, c("colors_used")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least("depth", F.lit(8)).cast("int")))
    more = {"color_space": F.when(late, raw(56, 4)), "intent": F.when(v5, raw(108, 4)), "__profile": F.when(v5, signed32(raw(112, 4)) + 14), "__profile_size": F.when(v5, signed32(raw(116, 4)))}
    more |= {"palette_start": F.when(has, masks_end), "palette_colors": F.when(has, colors.cast("long")), "palette_entry": F.when(has, F.when(core, 3).otherwise(4)), "data_start": F.when(has, signed32(little(data, c("__base") + 10, 4)))}
    t = t.select("*", made(height=F.abs("__height"), bottom_up=c("__height") >= 0, **masks, **more, row_bytes=F.when(has & (c("width") > 0), F.floor((c("width") * c("depth") + 31) / 32) * 4)))
    profile = (c("color_space") == EMBEDDED) & c("__profile_size").between(1, LARGEST_PROFILE) & (c("__profile") >= 0) & (c("__profile") + c("__profile_size") <= size)
    unfit = c("compression").isNull() | c("compression").isin(JPEG, PNG) & (h < 108) | (c("compression") == HUFFMAN) & (c("depth") != 1)
    for code, depth in ((RLE24, 24), (RLE4, 4), (RLE8, 8)):
        unfit = unfit | (c("compression") == code) & (c("depth") != depth)
    error = first_of(
        (c("__mark").isin("CI", "CP", "IC", "PT"), "icon"), (c("__mark") != "BM", "no bitmap"), (h.isNull(), "cut"), (~((h > 40) | h.isin(*KINDS)), "header size"), (~has, "cut"), (c("compression").isNull(), "compression"), (size < masks_end, "cut"),
        ((c("width") <= 0) | (c("height") <= 0) | (c("height") >= 1 << 31), "no size"), (~c("depth").isin(1, 2, 4, 8, 16, 24, 32, 64), "depth"), (unfit, "compression"),
        (c("palette_start") + c("palette_colors") * c("palette_entry") > size, "cut"), (c("compression").isin(RLE8, RLE4, RLE24, JPEG, PNG, HUFFMAN), "compressed"), ((c("data_start") < 0) | (c("data_start") + c("row_bytes").cast("double") * c("height") > size), "short"),
    )
    named = ["kind", "header_size", "width", "height", "bottom_up", "planes", "depth", "compression", "image_size", "x_per_meter", "y_per_meter", "colors_used", "colors_important", *masks, "color_space", "intent", "palette_start", "palette_colors", "palette_entry", "data_start", "row_bytes"]
    return t.select(*kept, *named, F.when(profile, c("__profile")).alias("profile_start"), F.when(profile, c("__profile_size")).alias("profile_size"), error.alias("error"))


def bmp_palettes(files: DataFrame) -> DataFrame:
    """files without content, with one row for each colour of a BMP file's palette: entry, r, g, b. Files with an error before
    their palette have none."""
    other = [F.col(f"`{n}`") for n in files.columns if n != "content"]
    t = bmp_images(files).where((c("palette_colors") > 0) & (c("error").isNull() | c("error").isin("compressed", "short")))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), c("palette_colors") - 1)).alias("entry"))
    at = (c("palette_start") + c("entry") * c("palette_entry")).cast("int")
    return t.select(*other, "entry", *[byte_at(c("content"), at + k).cast("int").alias(n) for k, n in ((2, "r"), (1, "g"), (0, "b"))])


def masked_by(word: Column, mask: Column) -> Column:
    """The channel of a word that a mask takes, as color.masked gives it for a fixed mask."""
    low = mask.bitwiseAND(-mask)
    bits = F.bit_count(mask)
    value = F.floor(word.bitwiseAND(mask) / low) * F.when(bits < 8, F.call_function("shiftright", F.lit(256), bits)).otherwise(1)
    return F.when(mask == 0, 255).otherwise(F.least(value, F.lit(255))).cast("int")


def rows_of(t: DataFrame, other: list[str], more: list[str], start: Column, row_bytes: Column, height: Column, y: Column) -> DataFrame:
    """One row for each row of an image: `other` and `more` columns, y, and its bytes as __row."""
    cut = F.transform(F.sequence(F.lit(0).cast("long"), height - 1), lambda k: F.substring("content", (start + k * row_bytes + 1).cast("int"), row_bytes.cast("int")))
    t = t.select(*[F.col(f"`{n}`") for n in other + more], F.posexplode(cut).alias("__k", "__row"))
    return t.withColumn("y", y).drop("__k")


def bmp_pixels(files: DataFrame) -> DataFrame:
    """files without content, with one row for each pixel of BMP files of which bmp_images tells no error: y, x, r, g, b, a.

    An index beyond the palette is opaque black. 64 bits are four numbers of linear light (s2.13), which become sRGB.
    """
    other = [n for n in files.columns if n != "content"]
    t = bmp_images(files).where("error is null")
    at = lambda k, byte: byte_at(c("content"), (c("palette_start") + k * c("palette_entry") + byte).cast("int"))
    # An index has at most depth bits, whatever the palette's size is.
    last = F.least(c("palette_colors"), F.lit(256).cast("long")) - 1
    palette = F.when(c("palette_colors") > 0, F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: pack(at(k, 2), at(k, 1), at(k, 0))))
    t = t.withColumn("__palette", palette)
    masks = ["red_mask", "green_mask", "blue_mask", "alpha_mask"]
    t = rows_of(t, other, ["__palette", "width", "height", "bottom_up", "depth", *masks], c("data_start"), c("row_bytes"), c("height"), F.when(c("bottom_up"), c("height") - 1 - c("__k")).otherwise(c("__k").cast("long")))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), c("width") - 1)).alias("x"))
    word = lambda first, size: little(c("__row"), first, size)
    x, depth = c("x"), c("depth")
    place = x * depth
    index = F.floor(byte_at(c("__row"), F.floor(place / 8).cast("int")) / F.pow(F.lit(2), 8 - depth - place % 8)) % F.pow(F.lit(2), depth).cast("long")
    mapped = F.coalesce(F.get("__palette", index.cast("int")), F.lit(BLACK).cast("long"))
    packed = F.when(depth <= 8, mapped).when(depth == 24, word(x * 3, 3) * 256 + 255).when(depth == 16, word(x * 2, 2)).when(depth == 32, word(x * 4, 4))
    t = t.select("*", made(__word=packed))
    fixed = rgba_of_fixed(*[word(x * 8 + 2 * k, 2) for k in (2, 1, 0, 3)])
    out = [F.when(depth == 64, f).when(depth.isin(16, 32), masked_by(c("__word"), c(m))).otherwise(u).cast("int").alias(n) for n, f, m, u in zip("rgba", fixed, masks, unpack(c("__word")), strict=True)]
    return t.select(*[F.col(f"`{n}`") for n in other], "y", "x", *out)


def tga_images(files: DataFrame) -> DataFrame:
    """files with what their TGA headers say: id_length, map_type, image_type, map_origin, map_length, map_depth, x_origin,
    y_origin, width, height, depth, alpha_bits, right_to_left, bottom_up, map_start (of the first colour that is used),
    data_start, row_bytes, error.

    Errors: 'cut' for less than a header, or a map that reaches beyond the file; 'image type'; 'no size'; 'no map', 'map' (one
    that begins after its end, or has colours of other than 16, 24 and 32 bits) and 'depth' where pixels need another one;
    'compressed'; 'short'. Rows of files with an error stay.
    """
    data, size = F.coalesce("content", F.lit(b"")), F.coalesce(F.length("content"), F.lit(0))
    of = lambda k, n: F.when(size >= 18, little(data, k, n))
    kept = [F.col(f"`{n}`") for n in files.columns]
    places = {"id_length": (0, 1), "map_type": (1, 1), "image_type": (2, 1), "map_origin": (3, 2), "map_length": (5, 2), "map_depth": (7, 1), "x_origin": (8, 2), "y_origin": (10, 2), "width": (12, 2), "height": (14, 2), "depth": (16, 1), "__flags": (17, 1)}
    t = files.select("*", made(**{n: of(*p) for n, p in places.items()}))
    entry, has_map = F.floor(c("map_depth") / 8), (c("map_type") == 1) & (c("map_length") > 0)
    more = {"alpha_bits": c("__flags") % 16, "right_to_left": F.floor(c("__flags") / 16) % 2 == 1, "bottom_up": F.floor(c("__flags") / 32) % 2 == 0, "map_start": F.when(has_map, 18 + c("id_length") + c("map_origin") * entry)}
    more |= {"data_start": 18 + c("id_length") + F.when(has_map, F.greatest("map_length", "map_origin") * entry).otherwise(0), "row_bytes": c("width") * F.floor(c("depth") / 8)}
    t = t.select("*", made(**more))
    mapped, gray = c("image_type").isin(*TGA_MAPPED), c("image_type").isin(*TGA_GRAY)
    fits = F.when(c("image_type") == 0, True).when(mapped, c("depth").isin(8, 16)).when(gray, c("depth").isin(8, 16)).otherwise(c("depth").isin(16, 24, 32))
    error = first_of(
        (size < 18, "cut"), (~c("image_type").isin(*TGA_TYPES), "image type"), ((c("width") == 0) | (c("height") == 0), "no size"), (has_map & (c("map_origin") > c("map_length")), "map"),
        (has_map & (c("data_start") > size), "cut"), (mapped & ~has_map, "no map"), (mapped & ~c("map_depth").isin(16, 24, 32), "map"), (~fits, "depth"), (c("image_type").isin(*TGA_RUNS), "compressed"),
        ((c("image_type") != 0) & (c("data_start") + c("row_bytes") * c("height") > size), "short"),
    )
    return t.select(*kept, *[n for n in places if n != "__flags"], *more, error.alias("error"))


def tga_pixels(files: DataFrame) -> DataFrame:
    """files without content, with one row for each pixel of TGA files of which tga_images tells no error: y, x (from the top
    left corner, whichever the file begins at), r, g, b, a.

    Index i stands for colour map_origin + i. What a map does not hold is opaque black; indices below map_length whose
    colour would be beyond it have no bits set at all, in 24-bit maps but for alpha. An image without data is transparent black.
    """
    other = [n for n in files.columns if n != "content"]
    t = tga_images(files).where("error is null")
    at = lambda k, size: little(c("content"), (c("map_start") + k * F.floor(c("map_depth") / 8)).cast("int"), size)
    # 16-bit colours have alpha only if the pixels have some.
    lucid = (c("depth") == 16) & (c("alpha_bits") > 0)
    five = lambda w, shift: five_to_eight(F.shiftright(w, shift) % 32)
    of_16 = lambda w, lucid: pack(five(w, 10), five(w, 5), five(w, 0), F.when(lucid & (w < 32768), 0).otherwise(255))
    of_32 = lambda w: w % (1 << 24) * 256 + F.shiftright(w, 24)
    color = lambda k: F.when(c("map_depth") == 16, of_16(at(k, 2), lucid)).when(c("map_depth") == 24, at(k, 3) * 256 + 255).otherwise(of_32(at(k, 4)))
    none = F.when(c("map_depth") == 24, BLACK).when((c("map_depth") == 16) & ~lucid, BLACK).otherwise(0).cast("long")
    last = F.least(c("map_length"), F.lit(256).cast("long")) - 1
    entries = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: F.when(k < c("map_length") - c("map_origin"), color(k)).otherwise(none))
    t = t.withColumn("__map", F.when(c("image_type") == 1, entries))
    more = ["__map", "image_type", "width", "height", "depth", "alpha_bits", "right_to_left", "bottom_up"]
    t = rows_of(t, other, more, c("data_start"), c("row_bytes"), c("height"), F.when(c("bottom_up"), c("height") - 1 - c("__k")).otherwise(c("__k").cast("long")))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), c("width") - 1)).alias("__i"))
    depth, row = c("depth"), c("__row")
    raw = F.when(c("image_type") == 0, 0).otherwise(F.when(depth == 8, little(row, c("__i"), 1)).when(depth == 16, little(row, c("__i") * 2, 2)).when(depth == 24, little(row, c("__i") * 3, 3)).otherwise(little(row, c("__i") * 4, 4)))
    t = t.select("*", made(__raw=raw.cast("long")))
    w = c("__raw")
    mapped = F.coalesce(F.get("__map", (w % 256).cast("int")), F.lit(BLACK).cast("long"))
    gray = pack(w % 256, w % 256, w % 256, F.when(depth == 16, F.shiftright(w, 8)).otherwise(255))
    true = F.when(depth == 16, of_16(w, c("alpha_bits") > 0)).when(depth == 24, w * 256 + 255).otherwise(of_32(w))
    t = t.select("*", made(__word=F.when(c("image_type") == 0, 0).when(c("image_type") == 1, mapped).when(c("image_type") == 3, gray).otherwise(true).cast("long")))
    x = F.when(c("right_to_left"), c("width") - 1 - c("__i")).otherwise(c("__i"))
    return t.select(*[F.col(f"`{n}`") for n in other], "y", x.alias("x"), *unpack(c("__word")))
