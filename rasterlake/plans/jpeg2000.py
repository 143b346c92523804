"""Queries over what JPEG 2000 decides and sends, on data derived from the tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made
from rasterlake.operators import containers, frames, icc, progression, rate, regions
from rasterlake.plans.containers import big_hex
from rasterlake.plans.tables import emb_frames, line_pixels, table

BUDGETS = [500, 20_000, 300_000, 1_000_000_000]


def tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner of each grey frame, of 2 to 8 rows and 3 to 7 columns, in sixteenths."""
    px = frames.pixels_of(emb_frames(spark, sf_dir))
    own = px.select("image_id", (F.col("image_id") % 7 + 2).cast("int").alias("height"), (F.col("image_id") % 5 + 3).cast("int").alias("width"), "y", "x", F.floor(F.col("r") / 16).cast("int").alias("value"))
    return own.where("y < height and x < width")


def tag_tree_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = rate.tag_tree(tree_leaves(spark, sf_dir), ["image_id"])
    return rate.tag_tree_bits(tree, ["image_id"]).select("image_id", "n_bits", F.hex("content").alias("content"))


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as code blocks, whose lines are passes: bytes so far from quantities, distortion taken away so far from suppliers' keys,
    which may also add some. Every fifth pass is no point."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"), F.max("l_suppkey").alias("s"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "q", (F.col("s") % 11 - 2).cast("double").alias("d"))))
    grouped = one.groupBy("l_orderkey").agg(lines.alias("l"))

    def so_far(value) -> Column:
        return F.transform("l", lambda _, i: F.aggregate(F.slice("l", F.lit(1), i + 1), F.lit(0.0), lambda t, x: t + value(x)))

    sign = F.transform("l", lambda x: F.when(x["l_linenumber"] % 5 == 0, -1).otherwise(1))
    rates = F.zip_with(so_far(lambda x: x["q"].cast("double")), sign, lambda r, s: (r * s).cast("bigint"))
    return grouped.select("l_orderkey", made(rates=rates, dists=so_far(lambda x: x["d"])))


def truncation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = code_blocks(spark, sf_dir).select("l_orderkey", F.explode(rate.truncation_points(F.col("rates"), F.col("dists"))).alias("p"))
    return points.select("l_orderkey", "p.idx", "p.rate", "p.dist", F.col("p.slope").cast("double").alias("slope"))


def layer_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = code_blocks(spark, sf_dir).select("l_orderkey", rate.truncation_points(F.col("rates"), F.col("dists")).alias("points"))
    return rate.layers(points, ["l_orderkey"], BUDGETS)


def packet_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tiles of one to three components, their packets in all five orders."""
    key, size = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    c = table(spark, sf_dir, "part").select(key.alias("tile"), size.alias("s"), F.explode(F.sequence(F.lit(0), size % 3)).alias("component"))
    c = c.select(
        "tile", "component", (F.col("component") % 2 + 1).alias("dx"), (F.col("component") + 1).alias("dy"), ((F.col("tile") + F.col("component")) % 3).alias("levels"), (F.col("s") % 2 + 1).alias("layers"),
        (F.col("tile") % 13).alias("x0"), (F.col("tile") % 5).alias("y0"), (F.col("tile") % 13 + F.col("s") + 1).alias("x1"), (F.col("tile") % 5 + 20).alias("y1"), F.array(F.lit(3), F.lit(4)).alias("ppx"), F.array(F.lit(4)).alias("ppy"),
    )
    sent = progression.packets(c, ["tile"])
    each = [progression.in_order(sent, ["tile"], k).withColumn("progression", F.lit(k)) for k in progression.ORDERS]
    return reduce(DataFrame.unionByName, each).select("tile", "progression", "place", "layer", "resolution", "component", "precinct")


def jp2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG 2000 files of a part, sound but for one thing by its key modulo 8."""
    kind = F.col("p_partkey") % 8
    box = lambda name, data: F.concat(big_hex(F.length(data) / 2 + 8, 4), F.lit(name.encode().hex().upper()), data)
    case = lambda k, then, otherwise: F.when(kind == k, then).otherwise(otherwise)
    nothing, jp2 = F.lit(""), F.lit(b"jp2 ".hex().upper())
    signature = case(1, nothing, box("jP  ", F.lit("0D0A870A")))
    brand = box("ftyp", F.concat(case(2, F.lit(b"jpx ".hex().upper()), jp2), F.lit("00000000"), jp2))
    color = case(3, nothing, box("colr", F.lit("01000000000010")))
    header = box("jp2h", F.concat(box("ihdr", F.concat(big_hex(F.col("p_size"), 4), big_hex(F.col("p_partkey"), 4), F.lit("000307070000"))), color, case(4, box("cmap", F.lit("00000000")), nothing)))
    stream = box("jp2c", F.concat(F.lit("FF4FFF51"), F.hex(F.encode("p_name", "utf-8")), case(6, nothing, F.lit("FFD9"))))
    whole = F.concat(signature, brand, case(5, box("xml ", F.hex(F.encode("p_brand", "utf-8"))), nothing), header, stream)
    files = table(spark, sf_dir, "part").select("p_partkey", made(whole=F.unhex(whole)))
    return files.select("p_partkey", F.substring("whole", F.lit(1), F.length("whole") - F.when(F.col("p_partkey") % 8 == 7, 5).otherwise(0)).alias("content"))


def jp2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = containers.jp2_findings(jp2_files(spark, sf_dir))
    return found.select("p_partkey", F.array_join(F.transform("findings", lambda f: F.concat(f["severity"], F.lit(": "), f["rule"])), "; ").alias("findings"))


def frame_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grey frames' samples, less 128: a quarter of a frame stands for each band of one level."""
    px = frames.pixels_of(emb_frames(spark, sf_dir))
    band = F.concat(F.when(F.col("x") < 4, "L").otherwise("H"), F.when(F.col("y") < 4, "L").otherwise("H"))
    return px.select("image_id", "frame_idx", F.lit(1).alias("level"), band.alias("band"), (F.col("y") % 4).alias("y"), (F.col("x") % 4).alias("x"), (F.col("r") - 128).alias("v"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One or two rectangles of an image, some of them empty, or over its edge."""
    i = F.col("image_id").cast("int")
    rect = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    each = F.explode(F.array(rect(i % 7, i % 5, i % 4, i % 3 + 1), rect(5 - i % 2 * 20, F.lit(6), F.lit(9), F.lit(9))))
    return emb_frames(spark, sf_dir).select("image_id", "frame_idx", "width", "height", each.alias("r")).select("image_id", "frame_idx", "width", "height", "r.*")


def region_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = regions.band_regions(rectangles(spark, sf_dir), 1)
    return regions.scaled_up(frame_bands(spark, sf_dir), area).drop("frame_idx", "level")


def region_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = regions.band_regions(rectangles(spark, sf_dir), 1, "9/7")
    return regions.scaled_down(regions.scaled_up(frame_bands(spark, sf_dir), area)).select("image_id", "band", "y", "x", F.col("v").cast("long").alias("v"))


#: Red's, green's and blue's colorant of the profiles, in 1/65,536, before a nation's key is added.
COLORANTS = ((28578, 14581, 912), (25241, 46981, 6361), (9376, 3973, 46799))


def profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of nations: one curve, of as many points as a nation's key modulo 4, the first of which is its power if it is the only
    one, and colorants from its key; every fifth has no signature."""
    key, start = F.col("n_nationkey").cast("int"), 132 + 12 * 6
    points = [big_hex(v, 2) for v in (key * 20 + 100, key + 20_000, key + 40_000)]
    many = key % 4
    curve = F.concat(F.lit(b"curv".hex() + "00000000"), big_hex(many, 4), *[F.when(many > k, p).otherwise(F.lit("")) for k, p in enumerate(points)])
    xyz = [F.concat(F.lit(b"XYZ ".hex() + "00000000"), *[big_hex(key + v, 4) for v in c]) for c in COLORANTS]
    size = many * 2 + 12
    entry = lambda name, at, length: F.concat(F.lit(name.encode().hex()), big_hex(at, 4), big_hex(length, 4))
    entries = [entry(f"{n}TRC", F.lit(start), size) for n in "rgb"] + [entry(f"{n}XYZ", size + start + 20 * k, F.lit(20)) for k, n in enumerate("rgb")]
    signature = F.when(key % 5 == 0, F.lit("00" * 4)).otherwise(F.lit(b"acsp".hex()))
    whole = F.concat(F.lit("00" * 36), signature, F.lit("00" * 88), big_hex(F.lit(6), 4), *entries, curve, *xyz)
    return table(spark, sf_dir, "nation").select(key.alias("profile_id"), made(content=F.unhex(whole)))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.flatten(c).cast("array<string>"), ",")
    return icc.icc_profiles(profile_files(spark, sf_dir)).select("profile_id", shown("curves").alias("curves"), shown("colorants").alias("colorants"), "error")


def profiled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' pixels, of the profile that an order's key picks."""
    px = line_pixels(spark, sf_dir).select((F.col("image_id") % 25).cast("int").alias("profile_id"), "image_id", "x", "r", "g", "b")
    return icc.profiled_to_srgb(px, icc.icc_profiles(profile_files(spark, sf_dir))).drop("profile_id")


QUERIES = {
    "tag_trees": lambda s, d: rate.tag_tree(tree_leaves(s, d), ["image_id"]),
    "tag_tree_round_trip": lambda s, d: rate.tag_tree_leaves(rate.tag_tree(tree_leaves(s, d), ["image_id"]), ["image_id"]),
    "tag_tree_bits": tag_tree_bits,
    "truncation_points": truncation_points,
    "layer_cuts": layer_cuts,
    "packet_orders": packet_orders,
    "jp2_findings": jp2_findings,
    "region_shifts": region_shifts,
    "region_round_trip": region_round_trip,
    "icc_profiles": profiles,
    "icc_pixels": profiled_pixels,
}

_HULL = """b AS (SELECT l_orderkey, list(rate ORDER BY n) AS rates, list(dist ORDER BY n) AS dists FROM (SELECT l_orderkey, n, (sum(q) OVER w * CASE WHEN n % 5 = 0 THEN -1 ELSE 1 END)::BIGINT AS rate, (sum(s % 11 - 2) OVER w)::DOUBLE AS dist
    FROM (SELECT l_orderkey, l_linenumber AS n, max(l_quantity)::INT AS q, max(l_suppkey) AS s FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY n)) GROUP BY l_orderkey),
  h AS (SELECT l_orderkey, rates, dists, 1::BIGINT AS k, []::STRUCT(idx BIGINT, rate BIGINT, dist DOUBLE, slope FLOAT)[] AS kept FROM b
    UNION ALL SELECT l_orderkey, rates, dists, CASE WHEN pops THEN k ELSE k + 1 END, CASE WHEN pops THEN kept[:-2] WHEN bad THEN kept ELSE kept || [{'idx': k - 1, 'rate': r, 'dist': d, 'slope': (gain / more)::FLOAT}] END
    FROM (SELECT *, bad IS FALSE AND len(kept) > 0 AND (more <= 0 OR (gain / more)::FLOAT >= kept[-1].slope) AS pops FROM (SELECT *, r < 0 OR (len(kept) = 0 AND r <= 0) OR gain < 0 OR (gain = 0 AND more > 0) AS bad
      FROM (SELECT *, rates[k] AS r, dists[k] AS d, rates[k] - CASE WHEN len(kept) > 0 THEN kept[-1].rate ELSE 0 END AS more, dists[k] - CASE WHEN len(kept) > 0 THEN kept[-1].dist ELSE 0 END AS gain FROM h WHERE k <= len(rates))))),
  p AS (SELECT l_orderkey, unnest(kept) AS p FROM h WHERE k > len(rates)), points AS (SELECT l_orderkey, p.idx::INT AS idx, p.rate AS rate, p.dist AS dist, p.slope AS slope FROM p)"""


_BANDS = """{}, b AS (SELECT image_id, CASE WHEN x < 4 THEN 'L' ELSE 'H' END || CASE WHEN y < 4 THEN 'L' ELSE 'H' END AS band, (y % 4)::INT AS y, (x % 4)::INT AS x, g - 128 AS v FROM emb),
  raw AS (SELECT vec_id AS image_id, vec_id % 7 AS x, vec_id % 5 AS y, vec_id % 4 AS w, vec_id % 3 + 1 AS h FROM embeddings UNION ALL SELECT vec_id, 5 - vec_id % 2 * 20, 6, 9, 9 FROM embeddings),
  rect AS (SELECT image_id, greatest(x, 0) AS x0, greatest(y, 0) AS y0, least(x + w, 8) - 1 AS x1, least(y + h, 8) - 1 AS y1 FROM raw WHERE w > 0 AND h > 0 AND x < 8 AND y < 8 AND x + w > 0 AND y + h > 0)"""


def _ranks() -> str:
    return " UNION ALL ".join(f"SELECT tile, {k} AS progression, row_number() OVER (PARTITION BY tile ORDER BY {', '.join(o)}) - 1 AS place, layer, resolution, component, precinct FROM q" for k, o in progression.ORDERS.items())


def _profiled(line: str) -> str:
    most = "255.0::DOUBLE"
    light = lambda c: f"""(CASE n WHEN 0 THEN {c} / {most} WHEN 1 THEN pow({c} / {most}, c0 / 256.0::DOUBLE) ELSE
      (SELECT CASE WHEN floor(t) = ceil(t) THEN points[floor(t)::INT + 1] / 65535.0::DOUBLE ELSE points[floor(t)::INT + 1] / 65535.0::DOUBLE + (points[ceil(t)::INT + 1] / 65535.0::DOUBLE - points[floor(t)::INT + 1] / 65535.0::DOUBLE) * (t - floor(t)) END
        FROM (SELECT {c} * ((n - 1) / {most}) AS t)) END)::FLOAT::DOUBLE"""  # noqa: E731
    factor = lambda row, k: f"({most} * ({' + '.join(f'({v}::DOUBLE) * ((key + {COLORANTS[k][a]}) / 65536.0::DOUBLE)' for a, v in enumerate(row))}))"
    mixed = ", ".join(f"greatest(0, least(255, trunc({factor(row, 0)} * lr + {factor(row, 1)} * lg + {factor(row, 2)} * lb + 0.5::DOUBLE)::BIGINT)) AS m{c}" for c, row in zip("rgb", icc.SRGB, strict=True))
    share = "(m{0} * (1.0::DOUBLE / 255))"
    out = ", ".join(f"(CASE WHEN m{c} <= 0 THEN floor((12.92::DOUBLE * 255) * {share.format(c)} + 0.5::DOUBLE) ELSE floor((1.055::DOUBLE * 255) * pow({share.format(c)}, 1.0::DOUBLE / 2.4::DOUBLE) - (0.055::DOUBLE * 255) + 0.5::DOUBLE) END)::INT AS {c}" for c in "rgb")
    return f"""WITH {line}, p AS (SELECT n_nationkey AS key, n_nationkey % 4 AS n, n_nationkey * 20 + 100 AS c0, [n_nationkey * 20 + 100, n_nationkey + 20000, n_nationkey + 40000] AS points FROM nation WHERE n_nationkey % 5 <> 0),
      l AS (SELECT image_id, x, key, {light("r")} AS lr, {light("g")} AS lg, {light("b")} AS lb FROM px JOIN p ON p.key = px.image_id % 25), m AS (SELECT image_id, x, {mixed} FROM l)
      SELECT image_id, x, {out} FROM m"""


def sql(emb: str, line: str) -> dict[str, str]:
    leaves = f"{emb}, l AS (SELECT image_id, (image_id % 7 + 2)::INT AS height, (image_id % 5 + 3)::INT AS width, y::INT AS y, x::INT AS x, g // 16 AS value FROM emb WHERE y < image_id % 7 + 2 AND x < image_id % 5 + 3)"
    tree = f"""{leaves}, n AS (SELECT image_id, height, width, k::INT AS level, (y // (1 << k))::INT AS y, (x // (1 << k))::INT AS x, min(value) AS value FROM l, range(4) t(k) WHERE k = 0 OR (1 << (k - 1)) < greatest(height, width) GROUP BY ALL),
      tree AS (SELECT n.*, n.value - coalesce(u.value, 0) AS extra FROM n LEFT JOIN n u ON u.image_id = n.image_id AND u.level = n.level + 1 AND u.y = n.y // 2 AND u.x = n.x // 2)"""
    return {
        "tag_trees": f"WITH {tree} SELECT * FROM tree",
        "tag_tree_round_trip": f"WITH {leaves} SELECT image_id, height, width, y, x, value::BIGINT AS value FROM l",
        "tag_tree_bits": f"""WITH {tree}, b AS (SELECT image_id, string_agg(repeat('0', extra::INT) || '1', '' ORDER BY (y << level) * width + (x << level), level DESC) AS bits FROM tree GROUP BY image_id),
          c AS (SELECT image_id, length(bits) AS n_bits, bits || repeat('1', (8 - length(bits) % 8) % 8) AS bits FROM b), y AS (SELECT image_id, n_bits, k, substr(bits, k * 8 + 1, 8) AS byte FROM (SELECT *, unnest(range(length(bits) // 8)) AS k FROM c))
          SELECT image_id, n_bits, string_agg(upper(lpad(to_hex(list_reduce([substr(byte, i, 1)::INT for i in range(1, 9)], lambda a, b: a * 2 + b)), 2, '0')), '' ORDER BY k) AS content FROM y GROUP BY ALL""",
        "truncation_points": f"WITH RECURSIVE {_HULL} SELECT l_orderkey, idx, rate, dist, slope::DOUBLE AS slope FROM points",
        "layer_cuts": f"""WITH RECURSIVE {_HULL}, s AS (SELECT slope, sum(rate - before) AS bytes FROM (SELECT *, lag(rate, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY idx) AS before FROM points) GROUP BY slope),
          t AS (SELECT slope, sum(bytes) OVER (ORDER BY slope DESC) AS total FROM s), layer AS (SELECT layer, [{", ".join(map(str, BUDGETS))}][layer + 1] AS budget FROM range({len(BUDGETS)}) r(layer)),
          least AS (SELECT layer, (SELECT min(slope) FROM t WHERE total <= budget) AS slope FROM layer)
          SELECT l_orderkey, layer::INT AS layer, max(idx) AS idx, max(rate) AS rate FROM points JOIN least ON points.slope >= least.slope GROUP BY l_orderkey, layer""",
        "packet_orders": f"""WITH c AS (SELECT p_partkey::INT AS tile, k::INT AS component, k % 2 + 1 AS dx, k + 1 AS dy, (p_partkey + k) % 3 AS levels, p_size % 2 + 1 AS layers, p_partkey % 13 AS x0, p_partkey % 5 AS y0, p_partkey % 13 + p_size + 1 AS x1, p_partkey % 5 + 20 AS y1
            FROM part, range(3) t(k) WHERE k <= p_size % 3),
          r AS (SELECT c.*, r::INT AS resolution, 1 << (levels - r) AS down, CASE WHEN r = 0 THEN 8 ELSE 16 END AS px, 16 AS py FROM c, range(3) t(r) WHERE r <= levels),
          g AS (SELECT *, ((x0 + dx - 1) // dx + down - 1) // down AS gx0, ((x1 + dx - 1) // dx + down - 1) // down AS gx1, ((y0 + dy - 1) // dy + down - 1) // down AS gy0, ((y1 + dy - 1) // dy + down - 1) // down AS gy1 FROM r),
          k AS (SELECT *, i, j FROM g, range(20) a(i), range(20) b(j) WHERE gx1 > gx0 AND gy1 > gy0 AND i BETWEEN gy0 // py AND (gy1 - 1) // py AND j BETWEEN gx0 // px AND (gx1 - 1) // px),
          q AS (SELECT tile, component, resolution, (i - gy0 // py) * ((gx1 - 1) // px - gx0 // px + 1) + j - gx0 // px AS precinct, l::INT AS layer,
            CASE WHEN j = gx0 // px AND gx0 % (dx * px) <> 0 THEN x0 ELSE j * dx * px * down END AS x, CASE WHEN i = gy0 // py AND gy0 % (dy * py) <> 0 THEN y0 ELSE i * dy * py * down END AS y FROM k, range(2) t(l) WHERE l < layers)
          {_ranks()}""",
        "jp2_findings": """SELECT p_partkey, ['', 'error: no signature box; warning: boxes are not in order', 'error: brand is not jp2', 'error: no colour box', 'warning: component mapping box without a palette box', 'warning: metadata is before the header box',
          'warning: codestream does not end with EOC', 'error: no codestream box'][p_partkey % 8 + 1] AS findings FROM part""",
        "region_shifts": f"""WITH {_BANDS.format(emb)}, r AS (SELECT image_id, band, greatest(0, floor((y0 + CASE WHEN band[2] = 'L' THEN 0 ELSE -2 END) / 2.0)) AS ya, floor((y1 + 1) / 2.0) AS yb, greatest(0, floor((x0 + CASE WHEN band[1] = 'L' THEN 0 ELSE -2 END) / 2.0)) AS xa, floor((x1 + 1) / 2.0) AS xb
            FROM rect, (VALUES ('LL'), ('HL'), ('LH'), ('HH')) b(band)),
          s AS (SELECT image_id, length(bin(max(abs(v)))) * (max(abs(v)) > 0)::INT AS shift FROM b GROUP BY image_id)
          SELECT image_id, band, y, x, (CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.image_id = b.image_id AND r.band = b.band AND b.y BETWEEN ya AND yb AND b.x BETWEEN xa AND xb) THEN v * (1 << shift) ELSE v END)::BIGINT AS v, shift::INT AS shift FROM b JOIN s USING (image_id)""",
        "region_round_trip": f"WITH {_BANDS.format(emb)} SELECT image_id, band, y, x, v::BIGINT AS v FROM b",
        "icc_profiles": """WITH p AS (SELECT n_nationkey::INT AS profile_id, n_nationkey % 5 = 0 AS bad, [n_nationkey * 20 + 100, n_nationkey + 20000, n_nationkey + 40000][:n_nationkey % 4] AS points FROM nation)
          SELECT profile_id, CASE WHEN NOT bad THEN array_to_string(points || points || points, ',') END AS curves, CASE WHEN NOT bad THEN array_to_string([v + profile_id for v in [28578, 14581, 912, 25241, 46981, 6361, 9376, 3973, 46799]], ',') END AS colorants,
            CASE WHEN bad THEN 'no profile' END AS error FROM p""",
        "icc_pixels": _profiled(line),
    }
