"""Which image format a file has, by its name or by its first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats by file extension.
EXTENSIONS = {
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "jfif": "jpeg", "gif": "gif", "jp2": "jpeg2000", "j2k": "jpeg2000",
    "j2c": "jpeg2000", "jpc": "jpeg2000", "jpf": "jpeg2000", "jpx": "jpeg2000", "bmp": "bmp", "dib": "bmp", "pbm": "pbm", "pgm": "pgm",
    "ppm": "ppm", "pnm": "ppm", "webp": "webp", "tif": "tiff", "tiff": "tiff", "tga": "tga", "qoi": "qoi", "ico": "ico", "cur": "cur", "ani": "ani",
}

#: Fixed values: (format, bytes of the file needed, {offset: signature in hex}), in the order in which they are tried.
SIGNATURES = [
    ("png", 8, {0: "89504E470D0A1A0A"}),
    ("jpeg", 8, {0: "FFD8FF"}),
    ("gif", 8, {0: "474946383761"}),
    ("gif", 8, {0: "474946383961"}),
    ("jpeg2000", 12, {0: "0000000C6A502020"}),
    ("jpeg2000", 8, {0: "FF4FFF51"}),
    ("bmp", 8, {0: "424D"}),
    *((f, 8, {0: f"503{d}"}) for d, f in zip("142536", ("pbm", "pbm", "pgm", "pgm", "ppm", "ppm"), strict=True)),
    ("webp", 12, {0: "52494646", 8: "57454250"}),
    ("ani", 12, {0: "52494646", 8: "41434F4E"}),
    ("tiff", 8, {0: "49492A00"}),
    ("tiff", 8, {0: "4D4D002A"}),
    ("qoi", 8, {0: "716F6966"}),
    ("ico", 8, {0: "00000100"}),
    ("cur", 8, {0: "00000200"}),
]


def format_of_path(path: Column) -> Column:
    """The format that the extension names; null if it is unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for f in sorted(set(EXTENSIONS.values())):
        out = F.when(ext.isin(*[e for e, g in EXTENSIONS.items() if g == f]), f).otherwise(out)
    return out


def format_of_bytes(content: Column) -> Column:
    """The format that the first bytes show; null if none does or there are fewer than eight."""
    head, size, out = F.hex(F.substring(content, 1, 12)), F.length(content), F.lit(None).cast("string")
    for f, need, marks in reversed(SIGNATURES):
        ok = size >= need
        for at, mark in marks.items():
            ok &= F.substring(head, 2 * at + 1, len(mark)) == mark
        out = F.when(ok, f).otherwise(out)
    return out
