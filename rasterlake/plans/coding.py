"""Queries over the blocks of derived images and over what codes them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.samples import LUMINANCE
from rasterlake.operators import blocks, entropy
from rasterlake.plans.tables import emb_frames, table

KEY = ["image_id", "frame_idx", "n"]


def grey_blocks(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """The grey frames in blocks, less 128."""
    each = blocks.frame_blocks(emb_frames(spark, sf_dir), "r", side)
    return each.select(*KEY, F.transform("samples", lambda v: v - 128).alias("s"))


def one_number_a_row(df: DataFrame, column: str) -> DataFrame:
    each = df.select("image_id", "n", F.posexplode(column).alias("k", "v"))
    return each.select("image_id", "n", "k", F.col("v").cast("double").alias("v") if "float" in df.schema[column].dataType.simpleString() else F.col("v").cast("long").alias("v"))


def block_transform(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = grey_blocks(spark, sf_dir, blocks.KINDS[kind][0])
        return one_number_a_row(b.select(*KEY, blocks.transformed(F.col("s"), kind).alias("d")), "d")

    return run


def block_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_number_a_row(blocks.jpeg_blocks(emb_frames(spark, sf_dir), LUMINANCE), "q")


def sparse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grey frames' samples, less 128, in sixty-fourths and cut towards zero, as quantised blocks: four vectors are an image."""
    q = F.transform("s", lambda v: (v / 64).cast("int"))
    return grey_blocks(spark, sf_dir, 8).select(F.floor(F.col("image_id") / 4).alias("image_id"), "frame_idx", (F.col("image_id") % 4).cast("int").alias("n"), q.alias("q"))


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each quantity is ordered, by the way it is shipped and the year."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy("l_returnflag", F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("int").alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


def prefix_code_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = entropy.prefix_codes(line_counts(spark, sf_dir), ["l_returnflag", "supplier"])
    return codes.groupBy("l_returnflag", "supplier").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum(F.col("n") * F.col("length")).alias("n_bits"))


def bit_code(q: Column, line: Column) -> tuple[Column, Column]:
    """(code, length): all ones for some quantities, so that there are bytes to stuff."""
    length = (q % 19 + line % 3).cast("int")
    return F.when(q % 4 == 0, F.call_function("shiftleft", F.lit(1).cast("long"), length) - 1).otherwise(q * 7919 + line), length


def bit_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as codes of the bits that their quantity and number say."""
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    code, length = bit_code(q, line)
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    streams = entropy.bit_streams(t.select("l_orderkey", "l_linenumber", code.alias("code"), length.alias("length")), ["l_orderkey"], ["l_linenumber"])
    return streams.select("l_orderkey", "n_bits", F.hex("content").alias("content"))


QUERIES = {
    **{f"block_{kind}": block_transform(kind) for kind in blocks.KINDS},
    "block_quantised": block_quantised,
    "jpeg_symbols": lambda s, d: entropy.jpeg_symbols(sparse_blocks(s, d)).drop("frame_idx"),
    "prefix_code_cost": prefix_code_cost,
    "bit_streams": bit_streams,
}


def _turned(source: str, vector: str, side: int) -> str:
    """SQL that makes the columns of `source`'s vectors rows."""
    return f"SELECT image_id, n, k.k AS i, list(v[k.k + 1] ORDER BY i) AS x FROM (SELECT image_id, n, i, {vector} AS v FROM {source}) s, range({side}) k(k) GROUP BY ALL"


def _f(v: float) -> str:
    return f"({v})::FLOAT"


def _forward8(name: str, source: str) -> list[str]:
    s = ", ".join(f"x[{k + 1}] + x[{8 - k}] AS s{k}, x[{k + 1}] - x[{8 - k}] AS d{k}" for k in range(4))
    w = {k: [_f(x) for x in v] for k, v in (("even", (0.541196, 1.306563)), ("outer", (1.175876, 0.785695)), ("inner", (1.38704, 0.275899)))}
    u = f"""s0 + s3 AS e0, s0 - s3 AS e3, s1 + s2 AS e1, s1 - s2 AS e2, {w["outer"][0]} * d3 + {w["outer"][1]} * d0 AS c3, {w["outer"][0]} * d0 - {w["outer"][1]} * d3 AS c0,
      {w["inner"][0]} * d2 + {w["inner"][1]} * d1 AS c2, {w["inner"][0]} * d1 - {w["inner"][1]} * d2 AS c1"""
    r = _f(0.707107)
    out = f"[e0 + e1, (c0 + c2) * {r} + (c3 + c1) * {r}, {w['even'][0]} * e2 + {w['even'][1]} * e3, c0 - c2, e0 - e1, c3 - c1, {w['even'][0]} * e3 - {w['even'][1]} * e2, (c0 + c2) * {r} - (c3 + c1) * {r}]"
    return [f"{name}t AS (SELECT image_id, n, i, {s} FROM {source})", f"{name}u AS (SELECT image_id, n, i, {u} FROM {name}t)", f"{name} AS ({_turned(name + 'u', out, 8)})"]


def _back8(name: str, source: str) -> list[str]:
    z = f"x[2] + x[8] AS a0, x[4] + x[6] AS a1, x[4] + x[8] AS a2, x[2] + x[6] AS a3, (x[3] + x[7]) * {_f(0.5411961)} AS b, x[1] + x[5] AS p, x[1] - x[5] AS m, x"
    u = f"a0 * {_f(-0.899976223)} AS z0, a1 * {_f(-2.562915447)} AS z1, a2 * {_f(-1.96157056)} + (a0 + a1) * {_f(1.175875602)} AS z2, a3 * {_f(-0.390180644)} + (a0 + a1) * {_f(1.175875602)} AS z3, b + x[7] * {_f(-1.847759065)} AS lo, b + x[3] * {_f(0.765366865)} AS hi, p, m, x"
    v = f"x[2] * {_f(1.50132111)} + z0 + z3 AS o0, x[4] * {_f(3.072711026)} + z1 + z2 AS o1, x[6] * {_f(2.053119869)} + z1 + z3 AS o2, x[8] * {_f(0.298631336)} + z0 + z2 AS o3, p + hi AS e0, m + lo AS e1, m - lo AS e2, p - hi AS e3"
    out = "[e0 + o0, e1 + o1, e2 + o2, e3 + o3, e3 - o3, e2 - o2, e1 - o1, e0 - o0]"
    return [f"{name}t AS (SELECT image_id, n, i, {z} FROM {source})", f"{name}u AS (SELECT image_id, n, i, {u} FROM {name}t)", f"{name}v AS (SELECT image_id, n, i, {v} FROM {name}u)", f"{name} AS ({_turned(name + 'v', out, 8)})"]


def _cut(v: str, by: int) -> str:
    return f"floor(({v}) / {by}.0)::BIGINT"


def _four(kind: str, second: bool) -> str:
    """SQL for one direction of a transform of 4 x 4, from x[1] to x[4]."""
    if kind in ("wht4", "iwht4"):
        out = ["x[1] + x[4] + x[2] + x[3]", "x[2] - x[3] + x[1] - x[4]", "x[1] + x[4] - x[2] - x[3]", "x[1] - x[4] - x[2] + x[3]"]
        if second:
            out = [f"CASE WHEN {v} > 0 THEN ({v} + 1) // 2 ELSE -((-({v})) // 2) END" if kind == "wht4" else _cut(f"{v} + 3", 8) for v in out]
    elif kind == "idct4":
        grown, held = lambda k: f"(x[{k}] + {_cut(f'x[{k}] * 20091', 65536)})", lambda k: _cut(f"x[{k}] * 35468", 65536)
        c, d = f"({held(2)} - {grown(4)})", f"({grown(2)} + {held(4)})"
        out = [f"x[1] + x[3] + {d}", f"x[1] - x[3] + {c}", f"x[1] - x[3] - {c}", f"x[1] + x[3] - {d}"]
        out = [_cut(f"{v} + 4", 8) for v in out] if second else out
    else:
        a, b, c, d = "(x[1] + x[4])", "(x[2] + x[3])", "(x[2] - x[3])", "(x[1] - x[4])"
        if second:
            out = [_cut(f"{a} + {b} + 7", 16), f"{_cut(f'{c} * 2217 + {d} * 5352 + 12000', 65536)} + CASE WHEN {d} <> 0 THEN 1 ELSE 0 END", _cut(f"{a} - {b} + 7", 16), _cut(f"{d} * 2217 - {c} * 5352 + 51000", 65536)]
        else:
            out = [f"({a} + {b}) * 8", _cut(f"({c} * 2217 + {d} * 5352) * 8 + 14500", 4096), f"({a} - {b}) * 8", _cut(f"({d} * 2217 - {c} * 5352) * 8 + 7500", 4096)]
    return f"[{', '.join(out)}]"


def transform_sql(emb: str, kind: str) -> str:
    """SQL for a transform of the frames' blocks; emb is the frames' SQL."""
    side = blocks.KINDS[kind][0]
    number = "FLOAT" if side == 8 else "BIGINT"
    own = f"SELECT image_id, {'0' if side == 8 else 'y // 4 * 2 + x // 4'} AS n, y % {side} AS y, x % {side} AS x, (g - 128)::{number} AS s FROM emb"
    if side == 8:
        steps = _forward8 if kind == "dct8" else _back8
        ctes = [f"b AS ({own})", "r AS (SELECT image_id, n, y AS i, list(s ORDER BY x) AS x FROM b GROUP BY ALL)", *steps("one", "r"), *steps("two", "one")]
        last = "(x[k.k + 1] * 0.125::FLOAT)::DOUBLE"
    else:
        rows_first = kind in ("dct4", "wht4")
        first = "SELECT image_id, n, y AS i, list(s ORDER BY x) AS x" if rows_first else "SELECT image_id, n, x AS i, list(s ORDER BY y) AS x"
        ctes = [f"b AS ({own})", f"r AS ({first} FROM b GROUP BY ALL)", f"one AS ({_turned('r', _four(kind, False), 4)})", f"two AS ({_turned('one', _four(kind, True), 4)})"]
        last = "(x[k.k + 1])::BIGINT"
        if not rows_first:  # both passes turn the block; this one began with its columns
            return f"WITH {emb}, {', '.join(ctes)} SELECT image_id, n::INT AS n, (k.k * 4 + i)::INT AS k, {last} AS v FROM two, range(4) k(k)"
    return f"WITH {emb}, {', '.join(ctes)} SELECT image_id, n::INT AS n, (i * {side} + k.k)::INT AS k, {last} AS v FROM two, range({side}) k(k)"


def sql(emb: str) -> dict[str, str]:
    order, steps = blocks.zigzag_order(), LUMINANCE
    dct = transform_sql(emb, "dct8")
    return {
        **{f"block_{kind}": transform_sql(emb, kind) for kind in blocks.KINDS},
        "block_quantised": f"""WITH d AS ({dct}), z AS (SELECT unnest({order}) AS place, unnest(range(64)) AS k), t AS (SELECT unnest({steps}) AS step, unnest(range(64)) AS place)
          SELECT image_id, n, z.k::INT AS k, round_even((v::FLOAT / step::FLOAT)::DOUBLE, 0)::BIGINT AS v FROM d JOIN z ON d.k = z.place JOIN t ON t.place = z.place""",
        "jpeg_symbols": f"""WITH {emb}, q AS (SELECT image_id // 4 AS image_id, (image_id % 4)::INT AS n, y * 8 + x AS k, trunc((g - 128) / 64.0)::INT AS v FROM emb),
          dc AS (SELECT image_id, n, v - lag(v, 1, 0) OVER (PARTITION BY image_id ORDER BY n) AS v FROM q WHERE k = 0),
          nz AS (SELECT image_id, n, k, v, k - lag(k, 1, 0) OVER (PARTITION BY image_id, n ORDER BY k) - 1 AS run FROM q WHERE k > 0 AND v <> 0),
          ends AS (SELECT image_id, n, max(CASE WHEN k > 0 AND v <> 0 THEN k ELSE 0 END) AS last FROM q GROUP BY ALL),
          e AS (SELECT image_id, n, 0 AS k, false AS ac, 0 AS run, v FROM dc UNION ALL SELECT image_id, n, k, true, run % 16, v FROM nz),
          z AS (SELECT *, CASE WHEN v = 0 THEN 0 ELSE length(bin(abs(v))) END AS size FROM e)
          SELECT image_id, n, k::INT AS k, ac, (run * 16 + size)::INT AS symbol, (CASE WHEN v < 0 THEN v - 1 + (1 << size) ELSE v END)::INT AS value, size::INT AS size FROM z
          UNION ALL SELECT image_id, n, (k - run + t.i * 16 + 15)::INT, true, 240, 0, 0 FROM nz, range(4) t(i) WHERE t.i < run // 16
          UNION ALL SELECT image_id, n, 64, true, 0, 0, 0 FROM ends WHERE last < 63""",
        "prefix_code_cost": """WITH RECURSIVE c AS (SELECT l_returnflag, l_suppkey AS supplier, l_quantity::INT AS symbol, count(*) AS n FROM lineitem GROUP BY ALL),
          s AS (SELECT l_returnflag, supplier, list_sort(list(n) || [0]) AS w, 0::HUGEINT AS bits, count(*) AS n_symbols FROM c GROUP BY ALL
            UNION ALL SELECT l_returnflag, supplier, list_sort(w[3:] || [w[1] + w[2]]), bits + w[1] + w[2], n_symbols FROM s WHERE len(w) > 1)
          SELECT l_returnflag, supplier, n_symbols, bits::BIGINT AS n_bits FROM s WHERE len(w) = 1""",
        "bit_streams": """WITH t AS (SELECT l_orderkey, l_linenumber AS line, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL), l AS (SELECT *, q % 19 + line % 3 AS size FROM t),
          b AS (SELECT l_orderkey, string_agg(CASE WHEN size = 0 THEN '' WHEN q % 4 = 0 THEN repeat('1', size::INT) ELSE right(lpad(bin(q * 7919 + line), 60, '0'), size::INT) END, '' ORDER BY line) AS bits FROM l GROUP BY l_orderkey),
          p AS (SELECT l_orderkey, length(bits) AS n_bits, bits || repeat('1', (8 - length(bits) % 8) % 8) AS bits FROM b WHERE bits <> ''),
          y AS (SELECT l_orderkey, n_bits, k, substr(bits, k * 8 + 1, 8) AS byte FROM (SELECT *, unnest(range(length(bits) // 8)) AS k FROM p))
          SELECT l_orderkey, n_bits, string_agg(CASE WHEN byte = '11111111' THEN 'FF00' ELSE upper(lpad(to_hex(list_reduce([substr(byte, i, 1)::INT for i in range(1, 9)], lambda a, b: a * 2 + b)), 2, '0')) END, '' ORDER BY k) AS content FROM y GROUP BY ALL""",
    }
