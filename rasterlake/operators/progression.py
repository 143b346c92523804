"""The packets of JPEG 2000 tiles, in each of the five orders in which they may be sent.

Packets are a generated grid of layers, resolutions, components and precincts; an order is a ranking by places on the reference
grid. Only the ranking looks at more than one component, and its window is one tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterlake.functions.rgba import made

#: The columns by which each order ranks packets, by its number in a file.
ORDERS = {
    0: ("layer", "resolution", "component", "precinct"),
    1: ("resolution", "layer", "component", "precinct"),
    2: ("resolution", "y", "x", "component", "precinct", "layer"),
    3: ("y", "x", "component", "resolution", "precinct", "layer"),
    4: ("component", "y", "x", "resolution", "precinct", "layer"),
}


def _power(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _over(a: Column, b: Column) -> Column:
    """a / b, rounded up."""
    return F.ceil(a.cast("long") / b)


def packets(components: DataFrame, keys: list[str]) -> DataFrame:
    """keys, component, resolution, precinct, layer, x, y: the packets of tile components (keys, component, dx, dy, levels, layers, x0, y0, x1,
    y1, ppx, ppy).

    dx and dy are a component's sampling steps, levels its decompositions, x0 to y1 its tile's sides on the reference grid, ppx and
    ppy arrays of the logarithms of precinct sides by resolution (the last one goes on for what is missing; without any they
    are 15). x and y are where a precinct begins on the reference grid, the tile's side where it is cut there. A
    resolution without samples has no packets, nor has a tile component without layers.
    """
    r = components.withColumn("resolution", F.explode(F.sequence(F.lit(0), F.col("levels").cast("int"))))

    def log(c: str) -> Column:
        own = F.coalesce(F.col(c), F.array().cast("array<int>"))
        return F.coalesce(F.get(own, F.least(F.col("resolution"), F.size(own) - 1)), F.lit(15))

    r = r.select("*", made(__down=_power(F.col("levels") - F.col("resolution")), __px=_power(log("ppx")), __py=_power(log("ppy"))))
    side = lambda v, d: _over(_over(F.col(v), F.col(d)), F.col("__down"))
    r = r.select("*", made(__x0=side("x0", "dx"), __x1=side("x1", "dx"), __y0=side("y0", "dy"), __y1=side("y1", "dy"))).where("__x1 > __x0 and __y1 > __y0 and layers > 0")
    cell = lambda v, p: F.floor(F.col(v) / F.col(p))
    r = r.select("*", made(__j0=cell("__x0", "__px"), __j1=F.floor((F.col("__x1") - 1) / F.col("__px")), __i0=cell("__y0", "__py"), __i1=F.floor((F.col("__y1") - 1) / F.col("__py"))))
    r = r.withColumn("__i", F.explode(F.sequence("__i0", "__i1"))).withColumn("__j", F.explode(F.sequence("__j0", "__j1")))

    def begins(i: str, start: str, low: str, size: str, step: str, side: str) -> Column:
        cut = (F.col(i) == F.col(start)) & (F.col(low) % (F.col(step) * F.col(size)) != 0)
        return F.when(cut, F.col(side).cast("long")).otherwise(F.col(i) * F.col(step) * F.col(size) * F.col("__down"))

    number = (F.col("__i") - F.col("__i0")) * (F.col("__j1") - F.col("__j0") + 1) + F.col("__j") - F.col("__j0")
    placed = r.select(*keys, "component", "resolution", number.alias("precinct"), begins("__j", "__j0", "__x0", "__px", "dx", "x0").alias("x"), begins("__i", "__i0", "__y0", "__py", "dy", "y0").alias("y"), "layers")
    return placed.select(*keys, "component", "resolution", "precinct", F.explode(F.sequence(F.lit(0), F.col("layers").cast("int") - 1)).alias("layer"), "x", "y")


def in_order(sent: DataFrame, keys: list[str], order: int) -> DataFrame:
    """packets with place, from 0, where each one stands in its tile (keys) in an order of ORDERS."""
    ranked = Window.partitionBy(*keys).orderBy(*ORDERS[order])
    return sent.withColumn("place", (F.row_number().over(ranked) - 1).cast("long"))
