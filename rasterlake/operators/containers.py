"""Chunks of image files as rows, and what animated files say in them: WebP's frames, and the steps of animated cursors.

files: any columns, and content. All of this is narrow: a file's chunks stand in its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.chunks import boxes_of, chunks_of
from rasterlake.functions.headers import big, little
from rasterlake.functions.rgba import made
from rasterlake.operators.frames import step_frame, step_rate


def chunk_table(files: DataFrame) -> DataFrame:
    """files without content, one row for each chunk (see chunks_of): chunk (its place), depth, parent, kind, start, size, crc_ok,
    error. Files of other kinds have none."""
    other = [c for c in files.columns if c != "content"]
    each = files.select("*", F.posexplode(chunks_of(F.col("content"))).alias("chunk", "__c"))
    return each.select(*other, "chunk", "__c.*")


def _numbers(content: Column, chunk: Column) -> Column:
    """The four-byte numbers of a chunk; a rest of fewer bytes is left out."""
    many = F.floor(chunk["size"] / 4)
    places = F.when(many > 0, F.sequence(F.lit(0).cast("long"), many - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(places, lambda i: little(content, chunk["start"] + i * 4, 4))


def webp_frames(files: DataFrame) -> DataFrame:
    """files without content, one row for each frame of animated WebP files: frame_idx, x, y, width, height, duration_ms, blend,
    dispose, lossy, the places of its data (start and size) and of its alpha plane (alpha_start and alpha_size, or null).

    A frame that is cut, or has no data, is left out, and those after it are numbered on; a file whose header does not say
    that it is animated has none.
    """
    other, c = [n for n in files.columns if n != "content"], F.col("content")
    known = files.withColumn("__all", chunks_of(c))
    head = F.get(F.filter("__all", lambda x: (x["kind"] == "VP8X") & (x["size"] >= 10) & x["error"].isNull()), F.lit(0))
    moves = little(c, head["start"], 1).bitwiseAND(2) > 0
    places = F.filter(F.transform("__all", lambda x, i: F.when((x["kind"] == "ANMF") & x["error"].isNull(), i)), lambda i: i.isNotNull())
    # Not a filter or a column of its own: Spark would put that below the walk, and walk all files twice.
    each = known.select("*", F.posexplode(F.when(moves, places)).alias("__idx", "__at"))
    frame, one, two = (F.get(F.col("__all"), F.col("__at") + k) for k in range(3))
    own = lambda x: (x["parent"] == F.col("__at")) & x["error"].isNull()
    alpha = own(one) & (one["kind"] == "ALPH")
    data = F.when(alpha, F.when(own(two), two)).otherwise(F.when(own(one), one))
    each = each.withColumns({"__f": frame["start"] - 16, "__alpha": F.when(alpha, one), "__data": data})
    each = each.where(F.col("__data").isNotNull())
    at = lambda k, n: little(c, F.col("__f") + k, n)
    flags, d = at(15, 1), F.col("__data")
    named = {
        "x": at(0, 3) * 2, "y": at(3, 3) * 2, "width": at(6, 3) + 1, "height": at(9, 3) + 1, "duration_ms": at(12, 3),
        "blend": flags.bitwiseAND(2) == 0, "dispose": flags.bitwiseAND(1) != 0, "lossy": F.col("__alpha").isNotNull() | (d["kind"] == "VP8 "),
        "start": d["start"], "size": d["size"], "alpha_start": F.col("__alpha.start"), "alpha_size": F.col("__alpha.size"),
    }
    return each.select(*other, F.col("__idx").alias("frame_idx"), *[v.alias(k) for k, v in named.items()])


def cursor_steps(files: DataFrame) -> DataFrame:
    """files without content, one row for each step of animated cursors: step, frame, jiffies, start and size of the frame's icon.

    Steps follow the sequence chunk, or else the icons in turn; a step's rate is the rate chunk's, or else the header's. The
    last chunk of a kind counts. start and size are null for a step whose frame has no icon; files without a whole header
    of 36 bytes have no steps.
    """
    other, c = [n for n in files.columns if n != "content"], F.col("content")
    last = lambda kind, least=0: F.try_element_at(F.filter("__all", lambda x: (x["kind"] == kind) & x["error"].isNull() & (x["size"] >= least)), F.lit(-1))
    icons = F.filter("__all", lambda x: (x["kind"] == "icon") & x["error"].isNull() & (F.get(F.col("__all"), x["parent"])["kind"] == "LIST/fram"))
    known = files.withColumn("__all", chunks_of(c)).select("*", made(__head=last("anih", 36), __rate=last("rate"), __seq=last("seq "), __icons=icons))
    known = known.select("*", made(__rates=F.when(F.col("__rate").isNotNull(), _numbers(c, F.col("__rate"))), __order=F.when(F.col("__seq").isNotNull(), _numbers(c, F.col("__seq")))))
    many = F.coalesce(F.size("__order"), F.size("__icons"))
    steps = F.when((many > 0) & F.col("__head").isNotNull(), F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    each = known.withColumn("step", F.explode(steps))
    frame = step_frame(F.col("__order"), F.col("step"), F.size("__icons"))
    rate = step_rate(F.col("__rates"), F.col("step"), little(c, F.col("__head.start") + 28, 4))
    each = each.withColumns({"frame": frame.cast("long"), "jiffies": rate})
    icon = F.when(F.col("frame") < F.size("__icons"), F.get(F.col("__icons"), F.col("frame").cast("int")))
    return each.select(*other, "step", "frame", "jiffies", icon["start"].alias("start"), icon["size"].alias("size"))


#: The boxes of a header that count for its order, and those that should not stand before it; the brand.
HEADER_BOXES, AFTER_HEADER, BRAND = ("ihdr", "colr", "bpcc", "res ", "cdef", "pclr", "cmap"), ("jp2i", "xml ", "uuid"), "6A703220"
#: The order in which the four boxes that a file must have stand.
ORDER = ("jP  ", "ftyp", "jp2h", "jp2c")


def jp2_findings(files: DataFrame) -> DataFrame:
    """files without content, with findings: an array of (severity, rule) that JPEG 2000 files break, 'error' before 'warning', each in
    the order of the rules below. Contents that are no such files break the rules of what is missing; null has null.

    A box that is cut is no box here. Of several boxes of one kind the first one counts.
    """
    c, other = F.col("content"), [n for n in files.columns if n != "content"]
    known = files.withColumn("__all", boxes_of(c))
    placed = known.select("*", made(__top=F.filter("__all", lambda b: b["parent"].isNull() & b["error"].isNull())))
    first = lambda boxes, kind: F.get(F.filter(boxes, lambda b: b["kind"] == kind), F.lit(0))
    names = {"signature": "jP  ", "type": "ftyp", "header": "jp2h", "stream": "jp2c"}
    placed = placed.select("*", made(**{f"__{n}": first("__top", kind) for n, kind in names.items()}, __at=F.array_position(F.transform("__all", lambda b: F.when(b["error"].isNull() & b["parent"].isNull(), b["kind"]).otherwise("")), F.lit("jp2h")) - 1))
    inner = F.filter("__all", lambda b: (b["parent"] == F.col("__at")) & b["error"].isNull() & b["kind"].isin(*HEADER_BOXES))
    placed = placed.select("*", made(__in=inner))
    kinds = F.transform("__in", lambda b: b["kind"])
    color = first("__in", "colr")
    of = lambda name: F.col(f"__{name}")
    digits = lambda at, n: F.hex(F.substring(c, (at + 1).cast("int"), n if isinstance(n, Column) else F.lit(n)))
    brands = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((of("type")["size"] - 8) / 4), F.lit(0).cast("long"))), lambda k: k * 4 + 12 <= of("type")["size"]), lambda k: digits(of("type")["start"] + 8 + k * 4, 4))
    image = first("__in", "ihdr")
    profile = F.when(big(c, color["start"], 1) == 2, color["start"] + 3)
    facts = {
        "__kinds": kinds, "__brands": brands, "__depth": F.when(image["size"] >= 11, big(c, image["start"] + 10, 1)), "__profile": profile, "__length": F.when(profile.isNotNull(), color["size"] - 3),
        "__order": F.filter(F.transform("__top", lambda b: b["kind"]), lambda k: k.isin(*ORDER)), "__early": F.exists("__top", lambda b: b["kind"].isin(*AFTER_HEADER) & ((b["start"] < of("header")["start"]) | of("header").isNull())),
        "__headers": F.size(F.filter("__top", lambda b: b["kind"] == "jp2h")), "__brand": digits(of("type")["start"], 4), "__minor": big(c, of("type")["start"] + 4, 4),
    }
    placed = placed.select("*", made(**facts))
    has = lambda kind: F.array_contains("__kinds", kind)
    position = lambda name: of(name)["start"] - 8
    in_header, stream = of("header").isNotNull(), of("stream")
    varies = of("depth") == 255
    expected = F.transform(F.slice(F.array(*map(F.lit, ORDER)), F.lit(1), F.size("__order")), lambda k: k)
    marked = stream.isNotNull() & (stream["size"] >= 2)
    rules = [
        ("error", "no signature box", of("signature").isNull()),
        ("error", "signature box is not first", position("signature") != 0),
        ("error", "signature box is not of 12 bytes", of("signature")["size"] != 4),
        ("error", "no file type box", of("type").isNull()),
        ("error", "brand is not jp2", of("brand") != BRAND),
        ("error", "jp2 is not in the compatibility list", of("type").isNotNull() & ~F.array_contains("__brands", BRAND)),
        ("error", "file type box is under 20 bytes", of("type")["size"] < 12),
        ("error", "minor version is negative", of("minor") >= 1 << 31),
        ("error", "no header box", ~in_header),
        ("error", "no image header box", in_header & ~has("ihdr")),
        ("error", "image header box is not first", in_header & has("ihdr") & (F.get(of("kinds"), F.lit(0)) != "ihdr")),
        ("error", "no colour box", in_header & ~has("colr")),
        ("error", "palette box is after the component mapping box", has("pclr") & (F.array_position("__kinds", F.lit("pclr")) > F.array_position("__kinds", F.lit("cmap"))) & has("cmap")),
        ("error", "no bits per component box", in_header & varies & ~has("bpcc")),
        ("error", "several header boxes", of("headers") > 1),
        ("error", "no codestream box", stream.isNull()),
        ("error", "codestream box is before the header box", position("stream") < of("header")["start"] + of("header")["size"]),
        ("error", "codestream is too short", stream["size"] < 2),
        ("error", "codestream does not begin with SOC", marked & (digits(stream["start"], 2) != "FF4F")),
        ("warning", "file type box does not follow the signature box", of("signature").isNotNull() & (position("type") != 12)),
        ("warning", "component mapping box without a palette box", has("cmap") & ~has("pclr")),
        ("warning", "bit depth is not known", in_header & (of("depth").isNull() | varies) & ~has("bpcc")),
        ("warning", "boxes are not in order", of("order") != expected),
        ("warning", "metadata is before the header box", of("early")),
        ("warning", "codestream does not end with EOC", marked & (digits(stream["start"], 2) == "FF4F") & (digits(stream["start"] + stream["size"] - 2, 2) != "FFD9")),
        ("warning", "SIZ does not follow SOC", marked & (stream["size"] >= 4) & (digits(stream["start"], 2) == "FF4F") & (digits(stream["start"] + 2, 2) != "FF51")),
        ("warning", "profile is under 128 bytes", of("length") < 128),
        ("warning", "profile has another size than it says", (of("length") >= 128) & (big(c, of("profile"), 4) != of("length"))),
        ("warning", "profile has no signature", (of("length") >= 128) & (big(c, of("profile"), 4) == of("length")) & (digits(of("profile") + 36, 4) != "61637370")),
    ]
    broken = F.filter(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.coalesce(on, F.lit(False)).alias("on")) for s, r, on in rules]), lambda r: r["on"])
    found = F.transform(broken, lambda r: F.struct(r["severity"], r["rule"]))
    return placed.select(*other, F.when(c.isNotNull(), found).alias("findings"))
