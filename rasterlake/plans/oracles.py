"""The queries' SQL."""

from __future__ import annotations

from rasterlake.functions.samples import CHROMINANCE, LUMINANCE
from rasterlake.plans import bitmaps, coding, containers, jpeg2000
from rasterlake.plans.queries import HEADERS, NAMES, PALETTE, WIDE

EMB = """emb AS (SELECT vec_id AS image_id, (p - 1) // 8 AS y, (p - 1) % 8 AS x,
  greatest(0, least(255, floor((embedding[p]::DOUBLE + 0.5) * 255 + 0.5)))::INT AS g
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS p FROM embeddings))"""
LINE = """px AS (SELECT l_orderkey AS image_id, 0 AS frame_idx, 0 AS y, l_linenumber::INT - 1 AS x,
  least(floor(l_quantity::DOUBLE * 5 + 0.5)::INT, 255) AS r, least(floor(l_discount::DOUBLE * 2500 + 0.5)::INT, 255) AS g,
  least(floor(l_tax::DOUBLE * 3000 + 0.5)::INT, 255) AS b, CASE l_returnflag WHEN 'A' THEN 255 WHEN 'R' THEN 0 ELSE 128 END AS a FROM lineitem)"""
ORDER = LINE.replace("px AS", "every AS") + """, px AS (SELECT image_id, frame_idx, y, x, (w >> 24)::INT AS r, (w >> 16 & 255)::INT AS g, (w >> 8 & 255)::INT AS b, (w & 255)::INT AS a
  FROM (SELECT image_id, frame_idx, y, x, max(((r::BIGINT * 256 + g) * 256 + b) * 256 + a) AS w FROM every GROUP BY ALL))"""
EVENT = """ev AS (SELECT user_id AS image_id, event_id AS frame_idx, (v % 256)::INT AS r, (v * 7 % 256)::INT AS g, length(event_type)::INT AS b,
  CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS a FROM (SELECT *, floor(abs(coalesce(value, 0.0)))::BIGINT AS v FROM events))"""
GRAY = "((r * 299 + g * 587 + b * 114 + 500) // 1000)::INT"
CLAMP = "greatest(0, least(255, {}))"


def lines(cols: str) -> str:
    return f"WITH {LINE} SELECT image_id, x, {cols} FROM px"


def byte(v: str) -> str:
    return f"(CASE WHEN {v} < 0 THEN 0 WHEN {v} > 255 THEN 255 ELSE floor({v} + 0.5) END)::INT"


def nearest(width: int, height: int) -> str:
    return f"""WITH {EMB}, o AS (SELECT y.y, x.x, least((trunc(y.y * (8::DOUBLE / {height})))::INT, 7) AS sy, least((trunc(x.x * (8::DOUBLE / {width})))::INT, 7) AS sx
    FROM range({height}) y(y), range({width}) x(x))
    SELECT image_id, o.y, o.x, g FROM emb JOIN o ON emb.y = o.sy AND emb.x = o.sx"""


def area(width: int, height: int) -> str:
    return f"""WITH {EMB}, o AS (SELECT y.y, x.x, y.y * (8::DOUBLE / {height}) AS y0, least((y.y + 1) * (8::DOUBLE / {height}), 8) AS y1,
      x.x * (8::DOUBLE / {width}) AS x0, least((x.x + 1) * (8::DOUBLE / {width}), 8) AS x1 FROM range({height}) y(y), range({width}) x(x)),
    t AS (SELECT image_id, o.y, o.x, emb.y AS sy, emb.x AS sx, g,
      (least(emb.x + 1, x1) - greatest(emb.x, x0)) * (least(emb.y + 1, y1) - greatest(emb.y, y0)) AS w
      FROM o JOIN emb ON emb.y + 1 > y0 AND emb.y < y1 AND emb.x + 1 > x0 AND emb.x < x1),
    s AS (SELECT image_id, y, x, list_reduce(list(g * w ORDER BY sy, sx), lambda a, b: a + b) AS total, list_reduce(list(w ORDER BY sy, sx), lambda a, b: a + b) AS weight FROM t GROUP BY ALL)
    SELECT image_id, y, x, {byte("(total / weight)")} AS g FROM s"""


def taps(width: int, height: int, low: int, high: int, weight: str) -> str:
    """Interpolation with taps low..high; weight is SQL of the tap k and the fraction f."""
    wx, wy = weight.format(k="i.k", f="fx"), weight.format(k="j.k", f="fy")
    return f"""WITH {EMB}, o AS (SELECT y.y, x.x, y.y * (7::DOUBLE / {height - 1}) AS at_y, x.x * (7::DOUBLE / {width - 1}) AS at_x FROM range({height}) y(y), range({width}) x(x)),
    f AS (SELECT *, trunc(at_y)::INT AS iy, trunc(at_x)::INT AS ix, at_y - trunc(at_y) AS fy, at_x - trunc(at_x) AS fx FROM o),
    t AS (SELECT image_id, f.y, f.x, j.k AS j, i.k AS i, g * (({wx}) * ({wy})) AS v FROM f, range({low}, {high}) j(k), range({low}, {high}) i(k), emb
      WHERE emb.y = greatest(0, least(7, iy + j.k)) AND emb.x = greatest(0, least(7, ix + i.k))),
    s AS (SELECT image_id, y, x, list_reduce(list(v ORDER BY j, i), lambda a, b: a + b) AS total FROM t GROUP BY ALL)
    SELECT image_id, y, x, {byte("total")} AS g FROM s"""


LINEAR = "CASE {k} WHEN 0 THEN 1.0::DOUBLE - {f} ELSE {f} END"
CUBIC = "CASE WHEN abs({k} - {f}) < 1 THEN (1.5::DOUBLE * abs({k} - {f}) - 2.5::DOUBLE) * abs({k} - {f}) * abs({k} - {f}) + 1 WHEN abs({k} - {f}) < 2 THEN ((-0.5::DOUBLE * abs({k} - {f}) + 2.5::DOUBLE) * abs({k} - {f}) - 4) * abs({k} - {f}) + 2 ELSE 0 END"
EXPLODED = f"WITH {EMB} SELECT image_id, y, x, g FROM emb"
HEX4 = "upper(lpad(to_hex(r), 2, '0') || lpad(to_hex(g), 2, '0') || lpad(to_hex(b), 2, '0') || lpad(to_hex(a), 2, '0'))"
NEAREST = "list_min([" + ", ".join(f"((r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b})) * 256 + {i}" for i, (r, g, b) in enumerate(PALETTE)) + "]) % 256"


def strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SQL = {
    "detect_format": f"""WITH f AS (SELECT p_partkey, {strings(HEADERS)}[p_partkey % {len(HEADERS)} + 1] || hex(encode(p_name)) AS h, lower(regexp_extract({strings(NAMES)}[p_partkey % {len(NAMES)} + 1], '\\.([^./]+)$', 1)) AS e FROM part)
    SELECT p_partkey, CASE WHEN length(h) < 16 THEN NULL WHEN h LIKE '89504E470D0A1A0A%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '474946383961%' OR h LIKE '474946383761%' THEN 'gif'
      WHEN h LIKE '0000000C6A502020%' AND length(h) >= 24 OR h LIKE 'FF4FFF51%' THEN 'jpeg2000' WHEN h LIKE '424D%' THEN 'bmp' WHEN h LIKE '5031%' OR h LIKE '5034%' THEN 'pbm' WHEN h LIKE '5032%' OR h LIKE '5035%' THEN 'pgm'
      WHEN h LIKE '5033%' OR h LIKE '5036%' THEN 'ppm' WHEN h LIKE '52494646________57454250%' THEN 'webp' WHEN h LIKE '52494646________41434F4E%' THEN 'ani' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'tiff'
      WHEN h LIKE '716F6966%' THEN 'qoi' WHEN h LIKE '00000100%' THEN 'ico' WHEN h LIKE '00000200%' THEN 'cur' END AS by_content,
      CASE e WHEN 'png' THEN 'png' WHEN 'jpeg' THEN 'jpeg' WHEN 'gif' THEN 'gif' WHEN 'j2k' THEN 'jpeg2000' WHEN 'bmp' THEN 'bmp' WHEN 'pnm' THEN 'ppm' WHEN 'webp' THEN 'webp' WHEN 'tiff' THEN 'tiff' WHEN 'tga' THEN 'tga'
      WHEN 'qoi' THEN 'qoi' WHEN 'ico' THEN 'ico' WHEN 'cur' THEN 'cur' WHEN 'ani' THEN 'ani' WHEN 'pgm' THEN 'pgm' END AS by_name FROM f""",
    "pixel_explode": EXPLODED,
    "get_set_pixel": f"WITH {EMB} SELECT image_id, g * 16843008::BIGINT + 255 AS before, 4278190208 AS after, 32::BIGINT AS row_size FROM emb WHERE y = 3 AND x = image_id % 8",
    "frame_edits": "SELECT vec_id AS image_id, k::INT AS frame_idx, 2 AS width, 1 AS height, 100000::BIGINT AS duration_us, '0000000000000000' AS rgba_hex FROM embeddings, range(2) t(k)",
    "assemble_frames": f"WITH {ORDER}, k AS (SELECT DISTINCT image_id FROM px) SELECT k.image_id, 7 AS width, 1 AS height, string_agg(coalesce({HEX4}, '00000000'), '' ORDER BY s.x) AS rgba_hex FROM k CROSS JOIN range(7) s(x) LEFT JOIN px ON px.image_id = k.image_id AND px.x = s.x GROUP BY k.image_id",
    "pack_rgba": lines("((r::BIGINT * 256 + g) * 256 + b) * 256 + a AS word"),
    "resize_nearest": nearest(5, 5),
    "resize_nearest_up": nearest(11, 13),
    "resize_area": area(5, 3),
    "resize_bilinear_up": taps(11, 13, 0, 2, LINEAR),
    "resize_bicubic_up": taps(11, 13, -1, 3, CUBIC),
    "grayscale": lines(f"{GRAY} AS gray"),
    "threshold_pbm": lines(f"({GRAY} < 128)::INT AS black"),
    "ycbcr_forward": lines(", ".join(f"trunc(greatest(0, least(255, {e})))::INT AS {n}" for n, e in (("y", "0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b"), ("cb", "128 - 0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b"), ("cr", "128 + 0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b")))),
    "ycbcr_inverse": lines(", ".join(CLAMP.format(e) + f"::INT AS {n}" for n, e in (("r", "r + trunc(1.402::DOUBLE * (b - 128))::INT"), ("g", "r - trunc(0.344136::DOUBLE * (g - 128))::INT - trunc(0.714136::DOUBLE * (b - 128))::INT"), ("b", "r + trunc(1.772::DOUBLE * (g - 128))::INT")))),
    "cmyk_to_rgb": lines(", ".join(f"((255 - {s}) * (255 - a) // 255)::INT AS {n}" for n, s in zip("rgb", "rgb", strict=True))),
    "studio_yuv": lines("((66 * r + 129 * g + 25 * b + 128) // 256 + 16)::INT AS y, (floor((-38 * r - 74 * g + 112 * b + 128) / 256.0) + 128)::INT AS u, (floor((112 * r - 94 * g - 18 * b + 128) / 256.0) + 128)::INT AS v"),
    "srgb_light": lines("floor((CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((r / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END) * 10000 + 0.5)::INT AS light, r"),
    "expand_555": lines("((r // 8) * 8 + (r // 32))::BIGINT AS r, ((r // 8) * 1024 + (g // 8) * 32 + b // 8)::BIGINT AS word"),
    "gray_16_to_8": lines("round_even((r * 256 + g) * 255 / 65535.0::DOUBLE, 0)::INT AS gray"),
    "scale_sample": lines("((r * 255 + (255 - b % 100) // 2) // (255 - b % 100))::INT AS scaled"),
    "subtract_green": lines("((r - g + 256) % 256)::INT AS r, g, ((b - g + 256) % 256)::INT AS b"),
    "color_slot": lines("(r * 3 + g * 5 + b * 7 + a * 11) % 64 AS slot"),
    "nearest_palette": lines(f"({NEAREST})::INT AS idx"),
    "alpha_stats": f"WITH {LINE} SELECT image_id, bool_or(a <> 255) AS has_alpha, bool_or(a NOT IN (0, 255)) AS soft_alpha, count(*) AS n_pixels, (sum(a) * 1000 // count(*))::BIGINT AS mean_alpha_milli FROM px GROUP BY image_id",
    "icon_depth": f"WITH {LINE}, c AS (SELECT image_id, count(DISTINCT (r, g, b)) AS n, bool_or(a NOT IN (0, 255)) AS soft FROM px GROUP BY image_id) SELECT image_id, CASE WHEN n <= 256 THEN n END AS n_colors, CASE WHEN soft THEN 32 WHEN n > 256 THEN 24 WHEN n <= 2 THEN 1 WHEN n <= 16 THEN 4 ELSE 8 END AS depth FROM c",
    "pnm_class": f"WITH {LINE}, {EMB}, u AS (SELECT -image_id - 1 AS image_id, r, g, b FROM px UNION ALL SELECT image_id, g, g, g FROM emb) SELECT image_id, CASE WHEN bool_and(r = g AND g = b AND r IN (0, 255)) THEN 'pbm' WHEN bool_and(r = g AND g = b) THEN 'pgm' ELSE 'ppm' END AS pnm_class FROM u GROUP BY image_id",
    "palette_first_n": f"WITH {ORDER}, c AS (SELECT image_id, r, g, b, min(x) AS scan FROM px GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY scan) - 1 AS idx FROM c) SELECT image_id, idx::INT AS idx, r, g, b FROM k WHERE idx < 3",
    "image_means": f"WITH {LINE} SELECT image_id, count(*) AS n_pixels, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, sum(a)::BIGINT AS sum_a, min({GRAY}) AS min_gray, max({GRAY}) AS max_gray FROM px GROUP BY image_id",
    "histogram": f"WITH {LINE} SELECT ({GRAY} * 16 // 256)::INT AS bin, count(*) AS n_pixels FROM px GROUP BY 1",
    "flips": f"WITH {EMB} SELECT image_id, 7 - y AS y, 7 - x AS x, g FROM emb",
    "predictor_forward": f"WITH {ORDER} SELECT image_id, x, " + ", ".join(f"(({c} - lag({c}, 1, 0) OVER w + 256) % 256)::INT AS {c}" for c in "rgba") + " FROM px WINDOW w AS (PARTITION BY image_id ORDER BY x)",
    "predictor_round_trip": f"WITH {ORDER} SELECT image_id, x, r, g, b, a FROM px",
    "rle_runs": f"WITH {ORDER}, n AS (SELECT *, coalesce((a <> lag(a) OVER w)::INT, 1) AS new FROM px WINDOW w AS (PARTITION BY image_id ORDER BY x)), k AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY x) AS run FROM n) SELECT image_id, min(x) AS x, count(*) AS n FROM k GROUP BY image_id, run",
    "composite_keep": f"WITH {EVENT}, s AS (SELECT *, last_value(CASE WHEN a > 0 THEN {{'r': r, 'g': g, 'b': b, 'a': a}} END IGNORE NULLS) OVER (PARTITION BY image_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS k FROM ev) SELECT image_id, frame_idx, coalesce(k.r, 0) AS r, coalesce(k.g, 0) AS g, coalesce(k.b, 0) AS b, coalesce(k.a, 0) AS a FROM s",
    "frame_durations": "SELECT user_id AS image_id, event_id AS frame_idx, (coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) - epoch_us(ts), 0) / 10000.0) AS q, (floor(q) * 10000)::BIGINT AS duration_us FROM events",
    **{f"header_{k}": f"SELECT vec_id AS image_id, '{k}' AS format, 5::BIGINT AS width, 9::BIGINT AS height, {d}::BIGINT AS depth FROM embeddings" for k, d in (("png", 8), ("bmp", 24), ("tga", 24), ("qoi", 32))},
    "icon_directory": """SELECT p_partkey, k AS entry, CASE WHEN k = 0 THEN 256 ELSE k END AS width, CASE WHEN k = 0 THEN 256 ELSE 2 * k END AS height, 0::BIGINT AS colors,
      p_partkey % 200 + k AS x, p_partkey % 100 AS y, k + 256 AS size, (p_size % 4 + 1) * 16 + 6 AS "offset" FROM part, range(4) t(k) WHERE k <= p_size % 4""",
    "tiff_tags": """SELECT p_partkey, (tag > 257)::INT AS directory, tag::BIGINT AS tag, CASE tag WHEN 256 THEN 4 ELSE 3 END::BIGINT AS type, CASE tag WHEN 258 THEN 3 WHEN 259 THEN 2 ELSE 1 END::BIGINT AS count,
      CASE tag WHEN 256 THEN p_partkey WHEN 257 THEN p_size WHEN 258 THEN 68 ELSE CASE p_partkey % 2 WHEN 0 THEN p_size + 65536 * (p_partkey % 999) ELSE p_size * 65536 + p_partkey % 999 END END::BIGINT AS value,
      CASE tag WHEN 256 THEN p_partkey::VARCHAR WHEN 257 THEN p_size::VARCHAR WHEN 258 THEN (p_partkey % 1000) || ',' || p_size || ',7' ELSE p_size || ',' || (p_partkey % 999) END AS values, NULL::VARCHAR AS error FROM part, (VALUES (256), (257), (258), (259)) t(tag)""",
    "reversible_color": lines("((r + 2 * g + b) // 4)::INT AS y, b - g AS u, r - g AS v"),
    "reversible_round_trip": lines("r, g, b"),
    "wavelet53": f"""WITH {EMB}, h AS (SELECT e.image_id, e.y, e.x, (e.g - floor((l.g + coalesce(r.g, l.g)) / 2.0))::INT AS d FROM emb e JOIN emb l ON l.image_id = e.image_id AND l.y = e.y AND l.x = e.x - 1
      LEFT JOIN emb r ON r.image_id = e.image_id AND r.y = e.y AND r.x = e.x + 1 WHERE e.x % 2 = 1)
    SELECT image_id, y, x, d AS coefficient FROM h UNION ALL
    SELECT e.image_id, e.y, e.x, (e.g + floor((coalesce(l.d, r.d) + r.d + 2) / 4.0))::INT FROM emb e LEFT JOIN h l ON l.image_id = e.image_id AND l.y = e.y AND l.x = e.x - 1
      JOIN h r ON r.image_id = e.image_id AND r.y = e.y AND r.x = e.x + 1 WHERE e.x % 2 = 0""",
    "wavelet_round_trip": f"WITH {ORDER} SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY x) - 1)::INT AS x, r FROM px",
    "sending_order": f"""WITH {EMB}, z AS (SELECT x, y, row_number() OVER (ORDER BY x + y, CASE WHEN (x + y) % 2 = 0 THEN x ELSE y END) - 1 AS zigzag FROM range(8) a(x), range(8) b(y))
    SELECT image_id, emb.y, emb.x, [1, 6, 4, 6, 2, 6, 4, 6, 7, 7, 7, 7, 7, 7, 7, 7, 5, 6, 5, 6, 5, 6, 5, 6, 7, 7, 7, 7, 7, 7, 7, 7, 3, 6, 4, 6, 3, 6, 4, 6, 7, 7, 7, 7, 7, 7, 7, 7, 5, 6, 5, 6, 5, 6, 5, 6, 7, 7, 7, 7, 7, 7, 7, 7][emb.y * 8 + emb.x + 1] AS adam7,
      [1, 4, 3, 4, 2, 4, 3, 4][emb.y + 1] AS gif_pass, zigzag::INT AS zigzag, greatest(1, least(255, (g * 20 + 50) // 100))::INT AS q90, greatest(1, least(255, (g * 250 + 50) // 100))::INT AS q20
    FROM emb JOIN z ON z.x = emb.x AND z.y = emb.y""",
    **{f"codec_{k}": EXPLODED for k in ("png", "bmp", "tga", "qoi", "pgm", "ppm")},
}
SQL["frame_durations"] = f"SELECT image_id, frame_idx, duration_us FROM ({SQL['frame_durations']})"

#: The four channels of emb_rgba, each as an image of its own.
EMB4 = EMB.replace("emb AS", "grey AS") + """, emb AS (SELECT image_id * 4 + c AS image_id, y, x, (CASE c WHEN 0 THEN g WHEN 1 THEN 255 - g WHEN 2 THEN g * 7 % 256 ELSE g * 3 % 256 END)::INT AS g FROM grey, range(4) t(c))"""
RGBA = EMB + """, px AS (SELECT image_id, 0 AS frame_idx, y, x, g AS r, 255 - g AS g, (g * 7 % 256)::INT AS b, (g * 3 % 256)::INT AS a FROM emb)"""
GIF = (
    ORDER
    + """, fr AS (SELECT image_id, x AS frame_idx, r, g, b, a, r % 3 AS lft, g % 2 AS top, r % 2 + 1 AS w, b % 4 AS disposal FROM px),
  drawn AS (SELECT fr.*, k.k AS fx, (((((r + k.k * 40) % 256)::BIGINT * 256 + g) * 256 + b) * 256 + a) AS word FROM fr, range(2) k(k) WHERE k.k < w)"""
)
#: Lifting of one row of samples t(image_id, y, x, v): the neighbours are mirrored at the ends.
NEAR = "coalesce(lag(v) OVER w, lead(v) OVER w) + coalesce(lead(v) OVER w, lag(v) OVER w)"


def lifting97(source: str) -> str:
    steps, name = [], source
    for k, step in enumerate(("-1.586134342", "-0.05298011854", "0.8829110762", "0.4435068522")):
        steps.append(f"s{k} AS (SELECT image_id, y, x, CASE WHEN x % 2 = {1 - k % 2} THEN v + {step}::FLOAT * ({NEAR}) ELSE v END AS v FROM {name} WINDOW w AS (PARTITION BY image_id, y ORDER BY x))")
        name = f"s{k}"
    return ", ".join(steps)


def lifted53(source: str, name: str, along: str, other: str) -> str:
    """One level of the 5/3 wavelet of source(image_id, y, x, v) along an axis, as the CTE `name`."""
    w = f"WINDOW w AS (PARTITION BY image_id, {other} ORDER BY {along})"
    return f"""{name}_h AS (SELECT *, CASE WHEN {along} % 2 = 1 THEN v - floor((lag(v) OVER w + coalesce(lead(v) OVER w, lag(v) OVER w)) / 2.0) END AS h FROM {source} {w}),
    {name} AS (SELECT image_id, y, x, (CASE WHEN {along} % 2 = 1 THEN h ELSE v + floor((coalesce(lag(h) OVER w, lead(h) OVER w) + coalesce(lead(h) OVER w, lag(h) OVER w) + 2) / 4.0) END)::INT AS v FROM {name}_h {w})"""


def rgba(cols: str) -> str:
    return f"WITH {RGBA} SELECT image_id, y, x, {cols} FROM px"


def foretold(kind: str, c: str) -> str:
    left, up, corner = f"coalesce(l.{c}, 0)", f"coalesce(u.{c}, 0)", f"coalesce(k.{c}, 0)"
    if kind == "up":
        return up
    if kind == "average":
        return f"(({left} + {up}) // 2)"
    p = f"({left} + {up} - {corner})"
    return f"(CASE WHEN abs({p} - {left}) <= abs({p} - {up}) AND abs({p} - {left}) <= abs({p} - {corner}) THEN {left} WHEN abs({p} - {up}) <= abs({p} - {corner}) THEN {up} ELSE {corner} END)"


def filtered(kind: str) -> str:
    cols = ", ".join(f"((p.{c} - {foretold(kind, c)} + 512) % 256)::INT AS {c}" for c in "rgba")
    near = " ".join(f"LEFT JOIN px {n} ON {n}.image_id = p.image_id AND {n}.y = p.y - {dy} AND {n}.x = p.x - {dx}" for n, dy, dx in (("l", 0, 1), ("u", 1, 0), ("k", 1, 1)))
    return f"WITH {RGBA} SELECT p.image_id, p.y, p.x, {cols} FROM px p {near}"


def studio(y: str, u: str, v: str) -> str:
    """Columns r, g and b of studio YUV."""
    luma = f"({y} * 19077 >> 8)"
    parts = (("r", f"{luma} + ({v} * 26149 >> 8) - 14234"), ("g", f"{luma} - ({u} * 6419 >> 8) - ({v} * 13320 >> 8) + 8708"), ("b", f"{luma} + ({u} * 33050 >> 8) - 17685"))
    return ", ".join(f"greatest(0, least(255, floor(({e}) / 64.0)))::INT AS {n}" for n, e in parts)


CHROMA = "c AS (SELECT image_id, y // 2 AS cy, x // 2 AS cx, greatest(0, least(255, floor((-38 * r - 74 * g + 112 * b + 128) / 256.0)::INT + 128)) AS u, greatest(0, least(255, floor((112 * r - 94 * g - 18 * b + 128) / 256.0)::INT + 128)) AS v FROM px WHERE x % 2 = 0 AND y % 2 = 0)"
BLEND_A = "({sa} + {da} * (255 - {sa}) // 255)"


def blended(c: str, s: str, d: str, sa: str, da: str) -> str:
    """A channel (or alpha, c = 'a') of a pixel s over a pixel d."""
    alpha = BLEND_A.format(sa=sa, da=da)
    if c == "a":
        return f"CASE WHEN {sa} = 255 THEN 255 WHEN {alpha} = 0 THEN {da} ELSE {alpha} END"
    return f"CASE WHEN {sa} = 255 THEN {s} WHEN {alpha} = 0 THEN {d} ELSE (({s} * {sa} + {d} * {da} * (255 - {sa}) // 255) // {alpha}) % 256 END"


def mask(word: str, m: int) -> str:
    if not m:
        return "255"
    low = m & -m
    bits = bin(m // low).count("1")
    return f"least(255, ({word} & {m}) // {low} * {256 >> bits if bits < 8 else 1})::INT"


def scaled(table: list[int]) -> str:
    return f"[greatest(1, least(255, (q * (CASE WHEN k < 50 THEN 5000 // k ELSE 200 - 2 * k END) + 50) // 100)) for q in {table}]"


def estimated(own: str, table: list[int]) -> str:
    mean = f"(list_reduce(list_transform(list_zip({own}, {table}), lambda p: 100.0::DOUBLE * p[1] / p[2]), lambda a, b: a + b) / 64)"
    return f"CASE WHEN list_max({own}) = 1 THEN 100.0::DOUBLE WHEN {mean} <= 100 THEN (200.0::DOUBLE - {mean}) / 2 ELSE 5000.0::DOUBLE / {mean} END"


def srgb(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, {1 / 2.4}::DOUBLE) - 0.055::DOUBLE END)"


def linear(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.04045::DOUBLE THEN {v} / 12.92::DOUBLE ELSE pow(({v} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def of_fixed(v: str) -> str:
    return f"((CASE WHEN {v} >= 32768 THEN {v} - 65536 ELSE {v} END) / 8192.0::DOUBLE)"


def to_fixed(v: str) -> str:
    return f"(round_even(greatest(-4.0::DOUBLE, least(3.99987793::DOUBLE, {v})) * 8192, 0)::INT & 65535)"


FIXED8 = {"r": "(r * 40)", "g": "(g * 40)", "b": "(65536 - b)", "a": "(a * 64)"}
UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"

SQL |= {
    "webp_blend": lines(", ".join(f"({blended(c, c, u, 'a', '100')})::INT AS {c}" for c, u in zip("rgba", (10, 200, 90, 100), strict=True))),
    "fixed_point": lines(f"{to_fixed('(r - 100) / 20.0::DOUBLE')} AS fixed, {of_fixed('(r * 256 + g)')} AS double"),
    "fixed_pixels": lines(", ".join(f"floor({srgb(UNIT.format(of_fixed(v))) if c != 'a' else UNIT.format(of_fixed(v))} * 255 + 0.5::DOUBLE)::INT AS {c}8" for c, v in FIXED8.items()) + ", " + ", ".join(f"{to_fixed(linear(f'({c} / 255.0::DOUBLE)') if c != 'a' else '(a / 255.0::DOUBLE)')} AS {c}16" for c in "rgba")),
    "hotspots_and_rates": """SELECT p_partkey, round_even(p_size * 20 / 48.0::DOUBLE, 0)::INT AS hotspot, coalesce([6, 12, 9][p_partkey % 5 + 1], 10)::BIGINT AS rate, rate * (1000.0::DOUBLE / 60.0::DOUBLE) AS ms,
      floor(p_size * 7.25::DOUBLE * 60 / 1000 + 0.5)::BIGINT AS jiffies, (CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE p_partkey % 5 % 3 END)::INT AS frame FROM part""",
    "mask_565": lines(", ".join(f"{mask('w', m)}::BIGINT AS {n}" for n, m in zip("rgb", (0xF800, 0x07E0, 0x001F), strict=True))).replace("FROM px", "FROM (SELECT *, r::BIGINT * 128 + g * 2 + b // 64 AS w FROM px)"),
    "mask_wide": lines(", ".join(f"{mask('w', m)} AS {n}" for n, m in zip(("ten", "high", "byte", "gaps", "none"), WIDE, strict=True))).replace("FROM px", "FROM (SELECT *, ((r::BIGINT * 256 + g) * 256 + b) * 256 + a AS w FROM px)"),
    "sample_forms": lines("255 - r AS black_is_zero, (r * 256 + g) // 256 AS high"),
    "tiff_luma": lines(
        "greatest(0::FLOAT, least(255::FLOAT, r::FLOAT + (2::FLOAT * (1::FLOAT - 0.2126::FLOAT)) * (b::FLOAT - 128::FLOAT))) AS r0, greatest(0::FLOAT, least(255::FLOAT, r::FLOAT + (2::FLOAT * (1::FLOAT - 0.0722::FLOAT)) * (g::FLOAT - 128::FLOAT))) AS b0, "
        "greatest(0::FLOAT, least(255::FLOAT, r::FLOAT + (-2::FLOAT * 0.2126::FLOAT * (1::FLOAT - 0.2126::FLOAT) / 0.7152::FLOAT) * (b::FLOAT - 128::FLOAT) + (-2::FLOAT * 0.0722::FLOAT * (1::FLOAT - 0.0722::FLOAT) / 0.7152::FLOAT) * (g::FLOAT - 128::FLOAT))) AS g0"
    ),
    "yuv_inverse": lines(studio("r", "g", "b")),
    "chroma_420": f"WITH {RGBA}, {CHROMA} SELECT * FROM c",
    "upsample_simple": f"WITH {RGBA}, {CHROMA} SELECT px.image_id, px.y, px.x, {studio('px.r', 'c.u', 'c.v')}, 255 AS a FROM px JOIN c ON c.image_id = px.image_id AND c.cy = px.y // 2 AND c.cx = px.x // 2",
    "upsample_fancy": f"""WITH {RGBA}, {CHROMA}, n AS (SELECT image_id, y, x, r, y // 2 AS y0, x // 2 AS x0, greatest(0, least(3, y // 2 + CASE y % 2 WHEN 1 THEN 1 ELSE -1 END)) AS y1, greatest(0, least(3, x // 2 + CASE x % 2 WHEN 1 THEN 1 ELSE -1 END)) AS x1 FROM px),
      m AS (SELECT n.image_id, n.y, n.x, n.r AS l, (9 * p.u + 3 * q.u + 3 * s.u + t.u + 8) // 16 AS u, (9 * p.v + 3 * q.v + 3 * s.v + t.v + 8) // 16 AS v FROM n
      {" ".join(f"JOIN c {k} ON {k}.image_id = n.image_id AND {k}.cy = n.{cy} AND {k}.cx = n.{cx}" for k, cy, cx in (("p", "y0", "x0"), ("q", "y0", "x1"), ("s", "y1", "x0"), ("t", "y1", "x1")))})
      SELECT image_id, y, x, {studio("l", "u", "v")}, 255 AS a FROM m""",
    "add_green": lines("(r + g) % 256 AS r, g, (b + g) % 256 AS b"),
    "color_transform": f"WITH {LINE}, s AS (SELECT *, CASE WHEN g > 127 THEN g - 256 ELSE g END AS sg FROM px), t AS (SELECT *, ((r + floor(-56 * sg / 32.0)::INT + 1024) % 256)::INT AS nr FROM s) SELECT image_id, x, nr AS r, g, ((b + floor(17 * sg / 32.0)::INT + floor(-126 * (CASE WHEN nr > 127 THEN nr - 256 ELSE nr END) / 32.0)::INT + 1024) % 256)::INT AS b FROM t",
    **{f"filter_{k}": filtered(k) for k in ("up", "average", "paeth")},
    "filter_up_round_trip": rgba("r, g, b, a"),
    "rle_packets": f"""WITH {ORDER}, n AS (SELECT *, coalesce((a <> lag(a) OVER w)::INT, 1) AS new FROM px WINDOW w AS (PARTITION BY image_id ORDER BY x)), k AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY x) AS run FROM n),
      r AS (SELECT image_id, min(x) AS x, count(*) AS n FROM k GROUP BY image_id, run), i AS (SELECT *, sum((n > 1)::INT) OVER (PARTITION BY image_id ORDER BY x) AS island FROM r)
      SELECT image_id, min(x) AS x, sum(n)::BIGINT AS n, n = 1 AS raw FROM i GROUP BY image_id, island, i.n = 1""",
    "qoi_operations": f"""WITH RECURSIVE {RGBA}, v AS (SELECT image_id, y * 8 + x AS k, CASE image_id % 3 WHEN 0 THEN r WHEN 1 THEN r // 64 ELSE (r // 32 + 252) % 256 END AS r,
      CASE image_id % 3 WHEN 0 THEN g WHEN 1 THEN g // 64 ELSE (g // 32 + 252) % 256 END AS g, CASE image_id % 3 WHEN 0 THEN b WHEN 1 THEN b // 64 ELSE (b // 32 + 252) % 256 END AS b,
      CASE image_id % 3 WHEN 2 THEN 255 ELSE a // 128 * 255 END AS a FROM px),
      w AS (SELECT image_id, list(CASE WHEN k IN (0, 9, 20) THEN [0, 0, 0, 255]::BIGINT[] ELSE [r, g, b, a]::BIGINT[] END ORDER BY k) AS p FROM v GROUP BY image_id),
      s AS (SELECT image_id, p, -1::BIGINT AS k, ''::VARCHAR AS op, [0, 0, 0, 255]::BIGINT[] AS prev, [[0, 0, 0, 0]::BIGINT[] for i in range(64)] AS seen FROM w
        UNION ALL SELECT image_id, p, k + 1,
        CASE WHEN p[k + 2] = prev THEN 'run' WHEN seen[(p[k + 2][1] * 3 + p[k + 2][2] * 5 + p[k + 2][3] * 7 + p[k + 2][4] * 11) % 64 + 1] = p[k + 2] THEN 'index' WHEN p[k + 2][4] <> prev[4] THEN 'rgba'
          WHEN p[k + 2][1] - prev[1] BETWEEN -2 AND 1 AND p[k + 2][2] - prev[2] BETWEEN -2 AND 1 AND p[k + 2][3] - prev[3] BETWEEN -2 AND 1 THEN 'diff'
          WHEN p[k + 2][2] - prev[2] BETWEEN -32 AND 31 AND p[k + 2][1] - prev[1] - p[k + 2][2] + prev[2] BETWEEN -8 AND 7 AND p[k + 2][3] - prev[3] - p[k + 2][2] + prev[2] BETWEEN -8 AND 7 THEN 'luma' ELSE 'rgb' END,
        p[k + 2], CASE WHEN p[k + 2] = prev THEN seen ELSE seen[:(p[k + 2][1] * 3 + p[k + 2][2] * 5 + p[k + 2][3] * 7 + p[k + 2][4] * 11) % 64] || [p[k + 2]] || seen[(p[k + 2][1] * 3 + p[k + 2][2] * 5 + p[k + 2][3] * 7 + p[k + 2][4] * 11) % 64 + 2:] END
        FROM s WHERE k < 63)
      SELECT image_id, (k // 8)::INT AS y, (k % 8)::INT AS x, op FROM s WHERE k >= 0""",
    "gif_canvas": f"""WITH RECURSIVE {GIF}, num AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY frame_idx) AS n FROM fr),
      place AS (SELECT num.*, cy.cy, cx.cx, d.word, (cy = num.top AND cx BETWEEN num.lft AND num.lft + num.w - 1) AS inside FROM num CROSS JOIN range(2) cy(cy) CROSS JOIN range(4) cx(cx)
        LEFT JOIN drawn d ON d.image_id = num.image_id AND d.frame_idx = num.frame_idx AND d.fx = cx.cx - num.lft AND cy.cy = num.top AND d.a > 0),
      s AS (SELECT image_id, n, frame_idx, cy, cx, coalesce(word, 180902655) AS shown, CASE disposal WHEN 2 THEN CASE WHEN inside THEN 180902655 ELSE coalesce(word, 180902655) END WHEN 3 THEN 180902655 ELSE coalesce(word, 180902655) END AS kept FROM place WHERE n = 1
        UNION ALL SELECT p.image_id, p.n, p.frame_idx, p.cy, p.cx, coalesce(p.word, s.kept), CASE p.disposal WHEN 2 THEN CASE WHEN p.inside THEN 180902655 ELSE coalesce(p.word, s.kept) END WHEN 3 THEN s.kept ELSE coalesce(p.word, s.kept) END
        FROM s JOIN place p ON p.image_id = s.image_id AND p.n = s.n + 1 AND p.cy = s.cy AND p.cx = s.cx)
      SELECT image_id, frame_idx, cy::INT AS y, cx::INT AS x, shown::BIGINT AS word FROM s""",
    "webp_canvas": f"""WITH RECURSIVE {GIF}, num AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY frame_idx) AS n FROM fr),
      place AS (SELECT num.image_id, num.n, num.disposal, cy.cy, cx.cx, (cy = top AND cx BETWEEN lft AND lft + w - 1) AS inside, (num.r + (cx - lft) * 40) % 256 AS r, num.g, num.b, num.a FROM num CROSS JOIN range(2) cy(cy) CROSS JOIN range(4) cx(cx)),
      s AS (SELECT image_id, 0::BIGINT AS n, cy::BIGINT AS cy, cx::BIGINT AS cx, 10::BIGINT AS r, 200::BIGINT AS g, 90::BIGINT AS b, 128::BIGINT AS a, false AS clear FROM place WHERE n = 1
        UNION ALL SELECT image_id, n, cy, cx, {", ".join(f"(CASE WHEN NOT inside THEN d{c} WHEN disposal >= 2 THEN s{c} ELSE {blended(c, f's{c}', f'd{c}', 'sa', 'da')} END)::BIGINT" for c in "rgba")}, inside AND disposal % 2 = 1
        FROM (SELECT p.image_id, p.n, p.cy, p.cx, p.disposal, p.inside, p.r AS sr, p.g AS sg, p.b AS sb, p.a AS sa, {", ".join(f"CASE WHEN s.clear THEN {v} ELSE s.{c} END AS d{c}" for c, v in zip("rgba", (10, 200, 90, 128), strict=True))}
          FROM s JOIN place p ON p.image_id = s.image_id AND p.n = s.n + 1 AND p.cy = s.cy AND p.cx = s.cx))
      SELECT image_id, (n - 1)::INT AS n, string_agg({HEX4}, '' ORDER BY cy, cx) AS canvas FROM s WHERE n > 0 GROUP BY image_id, n""",
    "palette_apply": f"WITH {LINE} SELECT image_id, x, px.r % 30 AS idx, (k * 10)::INT AS r, (255 - k)::INT AS g, (k * k % 256)::INT AS b, CASE WHEN k IS NOT NULL THEN 255 END AS a FROM px LEFT JOIN (SELECT n_nationkey::INT AS k FROM nation) ON k = px.r % 30",
    "palette_padded": f"WITH {ORDER}, c AS (SELECT image_id, r, g, b, min(x) AS scan FROM px GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY scan) - 1 AS idx FROM c) SELECT i.image_id, t.t::INT AS idx, coalesce(k.r, 0) AS r, coalesce(k.g, 0) AS g, coalesce(k.b, 0) AS b FROM (SELECT DISTINCT image_id FROM c) i CROSS JOIN range(4) t(t) LEFT JOIN k ON k.image_id = i.image_id AND k.idx = t.t",
    "channel_histogram": f"WITH {LINE} SELECT c AS channel, v AS value, count(*) AS n_pixels FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM px" for c in "rgba") + ") GROUP BY 1, 2",
    "packet_lengths": """WITH t AS (SELECT l_orderkey AS image_id, l_suppkey % 3 AS tile, count(*) AS n, sum(l_quantity::BIGINT) AS size FROM lineitem GROUP BY ALL)
      SELECT image_id, sum(n)::BIGINT AS n_parts, (max(tile) + 1)::BIGINT AS n_tiles, sum(size)::BIGINT AS total_size, min(size)::BIGINT AS min_size, max(size)::BIGINT AS max_size, floor(avg(size))::BIGINT AS mean_size,
      min(n) AS min_parts, max(n) AS max_parts, ceil(avg(n))::BIGINT AS mean_parts FROM t GROUP BY image_id""",
    "pbm_rows": f"WITH {EMB} SELECT image_id, y, upper(lpad(to_hex(sum((g < 128)::INT * (128 >> x::INT))::BIGINT), 2, '0')) AS row FROM emb GROUP BY image_id, y",
    **{f"bits_{k}_round_trip": f"WITH {ORDER} SELECT image_id, x, (r % {1 << k})::INT AS v FROM px WHERE r % {1 << k} > 0" for k in (2, 4)},
    "chunky": """WITH p AS (SELECT p_partkey, p_name AS a, reverse(p_name) AS b, substr(p_name, 1, 9) AS c FROM part), k AS (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p)
      SELECT p_partkey, string_agg(hex(a[i]::BLOB) || hex(b[i]::BLOB) || rpad(hex(c[i]::BLOB), 2, '0'), '' ORDER BY i) AS one,
      string_agg(CASE WHEN i % 2 = 1 AND i < length(a) THEN hex(a[i:i+1]::BLOB) || hex(b[i:i+1]::BLOB) || rpad(hex(c[i:i+1]::BLOB), 4, '0') ELSE '' END, '' ORDER BY i) AS two FROM k GROUP BY p_partkey""",
    "checksums": """WITH RECURSIVE c AS (SELECT p_partkey, p_name, 0 AS k, 4294967295::BIGINT AS c, 1::BIGINT AS a, 0::BIGINT AS b FROM part
        UNION ALL SELECT p_partkey, p_name, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, na, CASE WHEN k % 8 = 0 THEN (b + na) % 65521 ELSE b END
        FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(c, unicode(p_name[k // 8 + 1])::BIGINT) ELSE c END AS v, CASE WHEN k % 8 = 0 THEN (a + unicode(p_name[k // 8 + 1])) % 65521 ELSE a END AS na FROM c WHERE k < 8 * length(p_name)))
      SELECT p_partkey, xor(c, 4294967295) AS crc32, b * 65536 + a AS adler32 FROM c WHERE k = 8 * length(p_name)""",
    "png_legal": "SELECT p_partkey, coalesce((p_size % 8, p_partkey % 17) IN (" + ", ".join(f"({t}, {d})" for t, ds in ((0, (1, 2, 4, 8, 16)), (2, (8, 16)), (3, (1, 2, 4, 8)), (4, (8, 16)), (6, (8, 16))) for d in ds) + "), false) AS legal FROM part",
    "jpeg_quality": f"WITH q AS (SELECT p_partkey, p_partkey % 100 + 1 AS k FROM part), t AS (SELECT p_partkey, {scaled(LUMINANCE)} AS l, {scaled(CHROMINANCE)} AS c FROM q) SELECT p_partkey, list_sum(l)::BIGINT AS sum_l, list_sum(c)::BIGINT AS sum_c, floor(greatest(0, least(100, least({estimated('l', LUMINANCE)}, {estimated('c', CHROMINANCE)}))) * 1000 + 0.5)::BIGINT AS quality FROM t",
    "wavelet_2d": f"WITH {RGBA}, t AS (SELECT image_id, y, x, r AS v FROM px), {lifted53('t', 'a', 'y', 'x')}, {lifted53('a', 'b', 'x', 'y')} SELECT image_id, CASE x % 2 WHEN 1 THEN 'H' ELSE 'L' END || CASE y % 2 WHEN 1 THEN 'H' ELSE 'L' END AS band, (y // 2)::INT AS y, (x // 2)::INT AS x, v FROM b",
    "wavelet_levels_round_trip": rgba("b AS v"),
    "wavelet97": f"WITH {RGBA}, t AS (SELECT image_id, y, x, g::FLOAT AS v FROM px), {lifting97('t')} SELECT image_id, y, x, floor((v * (CASE x % 2 WHEN 1 THEN 1.230174106::FLOAT ELSE 0.8128930655::FLOAT END))::DOUBLE * 100)::BIGINT AS c FROM s3",
    "irreversible_color": lines(", ".join(f"floor(({e})::DOUBLE * 100)::BIGINT AS {n}" for n, e in (("y", "0.299::FLOAT * r::FLOAT + 0.587::FLOAT * g::FLOAT + 0.114::FLOAT * b::FLOAT"), ("u", "-0.16875::FLOAT * r::FLOAT - 0.33126::FLOAT * g::FLOAT + 0.5::FLOAT * b::FLOAT"), ("v", "0.5::FLOAT * r::FLOAT - 0.41869::FLOAT * g::FLOAT - 0.08131::FLOAT * b::FLOAT")))),
    "irreversible_inverse": lines("trunc(r::FLOAT + 1.402::FLOAT * (b - 128)::FLOAT + 0.5::FLOAT)::INT AS r, trunc(r::FLOAT - 0.34413::FLOAT * (g - 128)::FLOAT - 0.71414::FLOAT * (b - 128)::FLOAT + 0.5::FLOAT)::INT AS g, trunc(r::FLOAT + 1.772::FLOAT * (g - 128)::FLOAT + 0.5::FLOAT)::INT AS b"),
    "dead_zone": lines("trunc((r - 128) / 7.5::DOUBLE)::INT AS q, (CASE sign(trunc((r - 128) / 7.5::DOUBLE)) WHEN 1 THEN (trunc((r - 128) / 7.5::DOUBLE) + 0.5::DOUBLE) * 7.5::DOUBLE WHEN -1 THEN (trunc((r - 128) / 7.5::DOUBLE) - 0.5::DOUBLE) * 7.5::DOUBLE ELSE 0.0::DOUBLE END) AS c"),
    "dequantized": lines("(r - 128) * (g % 9 + 1) AS d, greatest(0, least(255, round_even((r - 128) * 1.25::DOUBLE, 0)::INT + 128)) AS s"),
    "tile_grid": """WITH i AS (SELECT p_partkey, p_size * 7 AS iw, p_size + 3 AS ih, p_partkey % 50 + 20 AS tw, p_partkey % 7 + 5 AS th FROM part), t AS (SELECT *, unnest(range((iw + tw - 1) // tw)) AS tx FROM i), u AS (SELECT *, unnest(range((ih + th - 1) // th)) AS ty FROM t)
      SELECT p_partkey, (ty * ((iw + tw - 1) // tw) + tx)::INT AS tile, tx::INT AS tx, ty::INT AS ty, (tx * tw)::INT AS x, (ty * th)::INT AS y, least(tw, iw - tx * tw)::INT AS w, least(th, ih - ty * th)::INT AS h FROM u""",
    "more_headers": "SELECT p_partkey, p_partkey % 65536 AS bmp_width, p_size::BIGINT AS bmp_height, 24::BIGINT AS bmp_depth, p_partkey + 1 AS webp_width, p_size::BIGINT AS webp_height, 'pgm' AS pnm_format, p_partkey AS pnm_width, p_size::BIGINT AS pnm_height, 255 AS pnm_most, p_partkey % 777 AS gif_loops, p_partkey % 1000 AS webp_loops, NULL::BIGINT AS no_loops FROM part",
    "metadata_edits": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN p_name END AS ico_before, p_partkey % 2 = 1 AS had_ico, p_partkey::VARCHAR AS ani, 'new' AS ico, false AS has_ani, 1::BIGINT AS n_left FROM part",
    "hotspot_edits": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || ':7,3:4' WHEN 1 THEN '0:0,3:4' WHEN 2 THEN '0:0,3:4,' || p_size || ':7' ELSE '0:0,3:4,0:0,' || p_size || ':7' END AS spots,
      CASE p_partkey % 4 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '5,' || p_size WHEN 2 THEN '5,10,' || p_size ELSE '5,10,10,' || p_size END AS rates FROM part""",
    "images_resized": f"""WITH {RGBA}, k AS (SELECT image_id, {HEX4} AS h FROM px WHERE x = 0 AND y = 0)
      SELECT image_id, image_id % 5 AS loop_count, t.t::INT AS frame_idx, 3 AS width, 5 AS height, CASE t.t WHEN 0 THEN 70000 ELSE 90000 END::BIGINT AS duration_us, CASE t.t WHEN 0 THEN h ELSE '01020304' END AS first,
      round_even((image_id % 8) * 3 / 8.0::DOUBLE, 0)::INT AS spot_x, round_even(5 * 5 / 8.0::DOUBLE, 0)::INT AS spot_y FROM k, range(2) t(t)""",
    "patched": f"WITH {EMB} SELECT image_id, y, x, CASE WHEN x = y THEN 1 ELSE g END AS r, CASE WHEN x = y THEN x::INT ELSE g END AS g, CASE WHEN x = y THEN 3 ELSE g END AS b, CASE WHEN x = y THEN 4 ELSE 255 END AS a FROM emb",
    "keep_root": f"WITH {EMB} SELECT image_id, 0 AS frame_idx, string_agg(upper(repeat(lpad(to_hex(g), 2, '0'), 3)) || 'FF', '' ORDER BY y, x) AS rgba_hex FROM emb GROUP BY image_id",
    "sql_functions": f"WITH {RGBA} SELECT px.image_id, 'qoi' AS format, 8::BIGINT AS width, 8::BIGINT AS height, ty.ty::INT AS y, tx.tx::INT AS x, r, g, b, a FROM range(2) ty(ty), range(3) tx(tx), px WHERE px.y = ty.ty * 4 AND px.x = trunc(tx.tx * (8::DOUBLE / 3))",
    "files_round_trip": EXPLODED,
    "streamed_files": "SELECT CASE vec_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'bmp' ELSE 'qoi' END AS format, 8 AS width, 8 AS height, count(*) AS n_files, 0::BIGINT AS n_errors FROM embeddings GROUP BY 1",
    **{f"rgba_{n}": q.replace(EMB, EMB4) for n, q in (("nearest", nearest(5, 3)), ("area", area(5, 3)), ("bilinear", taps(11, 13, 0, 2, LINEAR)), ("bicubic", taps(11, 13, -1, 3, CUBIC)))},
    **{f"rgba_{k}": EXPLODED.replace(EMB, EMB4) for k in ("png", "bmp", "tga", "qoi")},
}
SQL["tiff_luma"] = f"SELECT image_id, x, trunc(r0)::INT AS r, trunc(g0)::INT AS g, trunc(b0)::INT AS b FROM ({SQL['tiff_luma']})"
SQL |= containers.SQL | bitmaps.sql(EMB) | coding.sql(EMB) | jpeg2000.sql(EMB, LINE)
SQL["tiff_pixels"] = f"""WITH {RGBA} SELECT image_id, 0 AS directory, y, x, CASE image_id % 7 WHEN 4 THEN 255 - r ELSE r END::INT AS r, CASE image_id % 7 WHEN 4 THEN 255 - r ELSE g END::INT AS g,
  CASE image_id % 7 WHEN 4 THEN 255 - r ELSE b END::INT AS b, CASE image_id % 7 WHEN 4 THEN 255 ELSE a END::INT AS a FROM px WHERE image_id % 7 <> 5"""
SQL |= {f"filter_frames_{k}": SQL[f"filter_{k}"] for k in ("up", "average", "paeth")} | {f"filter_{k}_frames_round_trip": SQL["filter_up_round_trip"] for k in ("sub", "average", "paeth")}
SQL["wavelet97_round_trip"] = f"WITH {RGBA} SELECT image_id, y, x, g::INT AS g FROM px"
