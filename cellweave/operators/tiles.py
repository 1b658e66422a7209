"""Tiles of about equal numbers of points, however unevenly these lie."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialise

c = F.col


@dataclass
class Tiles:
    """``table`` has sample, tile, x0, y0, x1, y1 and the box bx0, by0, bx1, by1 that its halo adds; all of the plane is covered.

    ``grid`` has for each sample a grid of as many cells as there are tiles, by which points and tiles find each other.
    """

    table: DataFrame
    grid: DataFrame

    def cell(self, value: Column, axis: str) -> Column:
        """The cell along an axis; what lies beyond the sample falls to the cells at its edge."""
        at = (value - c("min" + axis)) / c("step" + axis)
        return F.floor(F.greatest(F.lit(0.0), F.least(at, c("cells") - F.lit(1.0))))

    def spread(self, df: DataFrame, x0: str, y0: str, x1: str, y1: str) -> DataFrame:
        """``df`` for each cell (gx, gy) that the rectangle of these columns touches."""
        met = df.join(F.broadcast(self.grid), "sample")  # a row per sample
        met = met.withColumn("gx", F.explode(F.sequence(self.cell(c(x0), "x"), self.cell(c(x1), "x"))))
        met = met.withColumn("gy", F.explode(F.sequence(self.cell(c(y0), "y"), self.cell(c(y1), "y"))))
        return met.drop(*[k for k in self.grid.columns if k != "sample"])


def balanced_tiles(points: DataFrame, tile_points: int, halo: float = 0.0) -> Tiles:
    """Tiles for points (sample, x, y): strips between quantiles of x, cut at the quantiles of y of each strip.

    A sample of n points has about sqrt(n / tile_points) strips of as many tiles. ``halo`` is the width of the halo in mean
    distances of a tile's points; it is no wider than the tile. What is broadcast are the borders, or a row per sample.
    """
    size = points.groupBy("sample").agg(
        F.count("*").alias("n"), *(f(k).alias(f.__name__ + k) for k in ("x", "y") for f in (F.min, F.max))
    )
    size = size.withColumn("strips", F.greatest(F.lit(1), F.ceil(F.sqrt(c("n") / tile_points))).cast("int"))
    size = materialise(size, "samples")
    rows = []
    for strips in sorted(r.strips for r in size.select("strips").distinct().collect()):
        some = points.join(F.broadcast(size.filter(c("strips") == strips).select("sample", "strips")), "sample")
        shares = [i / strips for i in range(1, strips)]
        cuts = lambda k: F.percentile_approx(k, shares, 10_000) if shares else F.array().cast("array<double>")  # noqa: E731, B023
        xs = materialise(some.groupBy("sample").agg(cuts("x").alias("xs")), "strips")
        put = some.join(F.broadcast(xs), "sample").withColumn("tx", F.size(F.filter("xs", lambda v: v < c("x"))))
        rows.append(put.groupBy("sample", "tx").agg(cuts("y").alias("ys"), F.count("*").alias("held"), F.first("xs").alias("xs")))
    if not rows:
        rows = [points.sparkSession.createDataFrame([], f"sample {points.schema['sample'].dataType.simpleString()}, tx int, "
                                                    "ys array<double>, held long, xs array<double>")]
    edge = F.lit(float("inf"))
    whole = lambda v: F.concat(F.array(-edge), v, F.array(edge))
    strip = materialise(reduce(DataFrame.unionByName, rows), "strips").join(F.broadcast(size), "sample")
    strip = strip.withColumns({"xw": whole(c("xs")), "yw": whole(c("ys"))})
    tiles = strip.select("*", F.posexplode(F.slice("yw", 1, F.size("ys") + 1)).alias("ty", "y0"))
    tiles = tiles.withColumns({"x0": F.get("xw", "tx"), "x1": F.get("xw", c("tx") + 1), "y1": F.get("yw", c("ty") + 1)})
    wide = F.greatest(F.least("x1", "maxx") - F.greatest("x0", "minx"), F.lit(1e-300))
    high = F.greatest(F.least("y1", "maxy") - F.greatest("y0", "miny"), F.lit(1e-300))
    spacing = F.sqrt(wide * high * c("strips") / c("held"))
    tiles = tiles.withColumn("halo", F.least(halo * spacing, F.greatest(wide, high)))
    box = [(c(k) + sign * c("halo")).alias("b" + k) for k, sign in (("x0", -1), ("y0", -1), ("x1", 1), ("y1", 1))]
    tiles = materialise(tiles.select("sample", F.struct("tx", "ty").alias("tile"), "x0", "y0", "x1", "y1", *box), "tiles")
    n = tiles.groupBy("sample").agg(F.ceil(F.sqrt(F.count("*"))).alias("cells"))
    step = lambda k: (F.greatest(c("max" + k) - c("min" + k), F.lit(1e-300)) / c("cells")).alias("step" + k)
    grid = size.join(n, "sample").select("sample", "minx", "miny", step("x"), step("y"), "cells")
    return Tiles(tiles, materialise(grid, "grid"))


def deal(points: DataFrame, tiles: Tiles) -> DataFrame:
    """``points`` (sample, id, x, y, own) for each tile in whose box they lie, ``own`` only in the tile that they belong to."""
    boxes = tiles.spread(tiles.table, "bx0", "by0", "bx1", "by1")
    at = tiles.spread(points.select("sample", "id", "x", "y", "own"), "x", "y", "x", "y")
    met = at.join(boxes, ["sample", "gx", "gy"])
    met = met.filter((c("x") > c("bx0")) & (c("x") <= c("bx1")) & (c("y") > c("by0")) & (c("y") <= c("by1")))
    mine = (c("x") > c("x0")) & (c("x") <= c("x1")) & (c("y") > c("y0")) & (c("y") <= c("y1"))
    return met.select("sample", "tile", "id", "x", "y", (c("own") & mine).alias("own"), "bx0", "by0", "bx1", "by1")
