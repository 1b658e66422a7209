"""Spatial joins over grid buckets: point in polygon, radius, nearest neighbours, distance to borders.

Coordinates meet through an equi-join on grid cells, so no join is a product of two tables, and dense grid cells are ordinary
skewed keys that adaptive execution splits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.scalar import bin_of, euclid
from cellweave.operators.nearest import tile_neighbours
from cellweave.operators.within import nearest_targets
from cellweave.session import materialise

c = F.col


def polygon_rings(polygons: DataFrame, key: str = "region_annotation", x: str = "x", y: str = "y", seq: str = "seq") -> DataFrame:
    """One row per ring: key, place (first-seen order), edges (array of x1, y1, x2, y2) and bounding box. A ring has all
    vertices of its key in order; rings of up to two vertices are left out."""
    v = F.array_sort(F.collect_list(F.struct("poly_id", seq, c(x).alias("x"), c(y).alias("y"))))
    g = polygons.groupBy(key).agg(
        v.alias("v"),
        F.min(F.struct("poly_id", seq)).alias("place"),
        F.min(x).alias("x0"),
        F.max(x).alias("x1"),
        F.min(y).alias("y0"),
        F.max(y).alias("y1"),
    )
    nxt = F.concat(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, 1))
    edges = F.zip_with(
        "v",
        nxt,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )
    return g.filter(F.size("v") > 2).select(key, "place", edges.alias("edges"), "x0", "x1", "y0", "y1")


def strictly_inside(edges: str, x: Column, y: Column) -> Column:
    """Crossing parity, and not on an edge."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    def touches(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        in_box = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        )
        return (cross == 0) & in_box

    return (F.size(F.filter(edges, crosses)) % 2 == 1) & ~F.exists(edges, touches)


def point_in_polygon(
    points: DataFrame,
    polygons: DataFrame,
    ids: list[str],
    x: str,
    y: str,
    key: str = "region_annotation",
    grid: float = 100.0,
) -> DataFrame:
    """``ids`` and the region of each point; 'None' outside all. Of several regions the last in first-seen order wins."""
    rings = polygon_rings(polygons, key)
    cells = rings.withColumn("gx", F.explode(F.sequence(bin_of(c("x0"), grid), bin_of(c("x1"), grid)))).withColumn(
        "gy", F.explode(F.sequence(bin_of(c("y0"), grid), bin_of(c("y1"), grid)))
    )
    at = points.select(*ids, c(x).alias("px"), c(y).alias("py")).withColumns(
        {"gx": bin_of(c("px"), grid), "gy": bin_of(c("py"), grid)}
    )
    met = at.join(cells, ["gx", "gy"]).filter(strictly_inside("edges", c("px"), c("py")))
    best = met.groupBy(*ids).agg(F.max_by(key, "place").alias("region"))
    return points.select(*ids).join(best, ids, "left").na.fill("None", ["region"])


def _neighbour_buckets(df: DataFrame, width: Column, reach: int = 1) -> DataFrame:
    """Rows repeated for the grid cells around their own."""
    offsets = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    return (
        df.withColumn("dx", F.explode(offsets))
        .withColumn("dy", F.explode(offsets))
        .withColumns({"gx": bin_of(c("x2"), width) + c("dx"), "gy": bin_of(c("y2"), width) + c("dy")})
        .drop("dx", "dy")
    )


def radius_pairs(
    left: DataFrame, right: DataFrame, radius: float | Column, sample: str = "sample", own: bool = False
) -> DataFrame:
    """(sample, src, dst, dist) with dist <= radius, for points (sample, id, x, y); ``own`` keeps pairs of one id."""
    r = F.lit(float(radius)) if not isinstance(radius, Column) else radius
    a = left.select(sample, c("id").alias("src"), c("x").alias("x1"), c("y").alias("y1"))
    a = a.withColumns({"gx": bin_of(c("x1"), r), "gy": bin_of(c("y1"), r)})
    b = _neighbour_buckets(right.select(sample, c("id").alias("dst"), c("x").alias("x2"), c("y").alias("y2")), r)
    met = a.join(b, [sample, "gx", "gy"]).withColumn("dist", euclid(c("x1"), c("y1"), c("x2"), c("y2")))
    met = met.filter(c("dist") <= r)
    return (met if own else met.filter("src <> dst")).select(sample, "src", "dst", "dist")


def as_points(cells: DataFrame, x: str = "x_centroid", y: str = "y_centroid", key: str = "cell_id") -> DataFrame:
    return cells.select("sample", c(key).alias("id"), c(x).alias("x"), c(y).alias("y"))


def z_order(x: Column, y: Column, width: float, bits: int = 16) -> Column:
    """A number by which points that lie near each other in the plane sort together: bits of their grid cells by turns."""
    at = [bin_of(v, F.lit(float(width))).cast("long") for v in (x, y)]
    each = [F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), 2 * i + j) for i in range(bits) for j, v in enumerate(at)]
    return reduce(lambda a, b: a + b, each)


def radius_graph(cells: DataFrame, radius: float) -> DataFrame:
    p = as_points(cells)
    return radius_pairs(p, p, radius)


def nearest_within(points: DataFrame, targets: DataFrame, distance: float) -> DataFrame:
    """(sample, src, dst, dist): the nearest target within the distance, the least id on ties; points without one are left out.

    Points and targets meet in blocks of the plane (:mod:`cellweave.operators.within`); no pair becomes a row.
    """
    return nearest_targets(points, targets, distance)


def nearest_neighbours(points: DataFrame, k: int, radius: float | None = None) -> DataFrame:
    """(sample, src, dst, dist, place): the k nearest others of every point, exact, the least id on ties.

    They are found in tiles of about equal numbers of points (:func:`cellweave.operators.nearest.tile_neighbours`). With a first
    ``radius`` r a grid is searched instead: that is exact for the points whose k-th neighbour lies within r, and the others go on
    with 2 r; a sample of up to k points is done when the radius covers it. A grid suits points of about even density.
    """
    if radius is None:
        return tile_neighbours(points, k)
    size = points.groupBy("sample").agg(
        F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")
    )
    extent = [tuple(r) for r in size.select("sample", "n", "w", "h").collect()]  # one row per sample
    wide = max((math.hypot(w, h) for _, _, w, h in extent), default=0.0) or 1.0
    done: list[DataFrame] = []
    todo = points
    w = Window.partitionBy("sample", "src").orderBy("dist", "dst")
    while True:
        last = radius >= wide
        near = radius_pairs(todo, points, radius).withColumn("place", F.row_number().over(w)).filter(c("place") <= k)
        near = materialise(near, "neighbours")
        if last:
            done.append(near)
            break
        full = near.groupBy("sample", "src").agg(F.count("*").alias("got")).filter(c("got") == k).drop("got")
        done.append(near.join(full, ["sample", "src"], "left_semi"))
        todo = materialise(todo.join(full.withColumnRenamed("src", "id"), ["sample", "id"], "left_anti"), "unfinished")
        if todo.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionByName, done)


def border_distance(points: DataFrame, polygons: DataFrame, by: str, inside: Column, mode: str = "exact") -> DataFrame:
    """Distance of each point to the border of its own polygon, negative where ``inside``.

    ``points`` has id, ``by``, x, y; ``polygons`` has ``by``, seq, x, y. Mode 'sampled' takes the vertices and five points inside
    each edge instead of the edges.
    """
    v = F.array_sort(F.collect_list(F.struct("seq", "x", "y")))
    rings = polygons.groupBy(by).agg(v.alias("v"))
    nxt = F.concat(F.slice("v", 2, F.size("v") - 1), F.slice("v", 1, 1))
    edges = F.zip_with(
        "v",
        nxt,
        lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")),
    )
    met = points.join(rings.select(by, edges.alias("edges")), by)
    px, py = c("x"), c("y")

    def gap(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        if mode == "sampled":
            steps = [F.lit(i / 6) for i in range(6)]
            return F.least(*[euclid(px, py, e["ax"] + dx * t, e["ay"] + dy * t) for t in steps])
        length = dx * dx + dy * dy
        t = F.when(length > 0, ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / length).otherwise(0.0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return euclid(px, py, e["ax"] + t * dx, e["ay"] + t * dy)

    d = F.array_min(F.transform("edges", gap))
    return met.select("id", by, F.when(inside, -d).otherwise(d).alias("border_distance"))


def shift_samples(cells: DataFrame, x: str = "x_centroid", y: str = "y_centroid") -> DataFrame:
    """Samples side by side: x moves by (max + int(max / 10)) times the sample's index, y by one."""
    gap = cells.agg((F.max(x) + F.floor(F.max(x) / 10)).alias("gap"))
    order = cells.select("sample").distinct().withColumn("index", F.dense_rank().over(Window.orderBy("sample")) - 1)
    met = cells.join(F.broadcast(order), "sample").join(F.broadcast(gap))
    return met.withColumns({x: c(x) + c("gap") * c("index"), y: c(y) + 1}).drop("gap", "index")
