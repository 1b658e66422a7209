"""Delaunay neighbours of points in the plane, by tiles with halos.

The points of a sample are dealt to tiles of about equal numbers of points (strips in x, then cuts in y, at quantiles), and to the
tiles in whose halo they lie too. In its tile a point gets its star: its neighbours in order around it, each the one whose circle
with the point and the neighbour before it holds no other point. A star is final when it is closed and all its circles lie in the
tile and its halo, where every point is known.

What is left, mostly at the outline of the sample, goes on in tiles of ``GROWTH`` times as many points. Only the points left take
part, with the neighbours that final stars gave them: all true neighbours of a point are among these, and its star among any points
that hold its true neighbours is its true star. The last round is a tile that holds all that is left; there every star is final.

Points on one circle have more than one triangulation; every coordinate is moved by a hash of its point's id, by less than one part
in ``SHIFT`` of the mean distance, so all tiles choose alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.tiles import balanced_tiles, deal
from cellweave.session import materialise

c = F.col

#: Points of a tile of the first round, and how much larger tiles become.
TILE_POINTS, GROWTH = 1024, 16
#: Width of a halo, in mean distances of the tile's points.
HALO = 6.0
SHIFT = 10_000_000
#: Nearest points that are looked at first; a star whose circles reach beyond them is made again from all points of the tile.
FIRST = 40


def _turn(at: np.ndarray, near: np.ndarray, known: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the neighbour ``at`` of each point on to the next one on a side (1: left), until the start or an end is met.

    ``near`` has the candidates of each point, relative to it, and ``known`` says which there are. Gives (point, neighbour, centre
    of their circle with the neighbour before, relative to the point) of all steps, and which points came back to the start.
    """
    n, closed = len(at), np.zeros(len(at), bool)
    start, live = at.copy(), np.arange(n)
    size = (near**2).sum(2)
    who, which, centres = [], [], []
    for _ in range(near.shape[1] + 1):
        a, b = near[live, at[live]][:, None, :], near[live]
        cross = side * (a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0])
        fits = known[live] & (cross > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(fits, (size[live] - (a * b).sum(2)) / (2 * cross), np.inf)
        nxt = s.argmin(1)
        s = s[np.arange(len(live)), nxt]
        fine = np.isfinite(s)
        live, nxt, s, a = live[fine], nxt[fine], s[fine], a[fine, 0]
        if not len(live):
            break
        who.append(live)
        which.append(nxt)
        centres.append(a / 2 + side * s[:, None] * np.stack([-a[:, 1], a[:, 0]], 1))
        at[live] = nxt
        back = nxt == start[live]
        closed[live[back]] = True
        live = live[~back]
        if not len(live):
            break
    none = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2))]
    who, which, centres = (np.concatenate(x) if x else y for x, y in zip((who, which, centres), none))
    return who, which, centres, closed


def _stars(xy: np.ndarray, own: np.ndarray, near: np.ndarray, known: np.ndarray):
    """(point, neighbour, centre, closed) of the points ``own``; ``near`` are places of candidates, nearest first."""
    away = xy[near] - xy[own][:, None, :]
    first = np.zeros(len(own), np.int64)
    who, which, centres, closed = _turn(first, away, known, 1.0)
    # An open star goes on from the nearest neighbour to the other side.
    open_ = np.flatnonzero(~closed & known[:, 0])
    more = _turn(np.zeros(len(open_), np.int64), away[open_], known[open_], -1.0)
    who = np.concatenate([who, open_, open_[more[0]]])
    which = np.concatenate([which, np.zeros(len(open_), np.int64), more[1]])
    centres = np.concatenate([centres, np.zeros((len(open_), 2)), more[2]])
    return who, near[who, which], centres, closed


def tile_stars(xy: np.ndarray, own: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour) pairs of the stars of ``own`` (places in ``xy``) and which of them are final.

    ``box`` is x0, y0, x1, y1 within which every point is in ``xy``; an infinite box makes all stars final.
    """
    edges, final = [], np.zeros(len(own), bool)
    everywhere = bool(np.isinf(box).all())
    for part in np.array_split(np.arange(len(own)), max(1, len(own) * len(xy) // (1 << 21))):
        mine = own[part]
        gap = ((xy[mine][:, None, :] - xy[None]) ** 2).sum(2)
        gap[np.arange(len(mine)), mine] = np.inf
        todo = np.arange(len(mine))
        for k in (min(FIRST, len(xy) - 1), len(xy) - 1):
            if k < 1 or not len(todo):
                final[part[todo]] |= everywhere and k < 1
                break
            near = np.argpartition(gap[todo], k - 1, axis=1)[:, :k]
            order = np.argsort(np.take_along_axis(gap[todo], near, 1), axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            far = np.take_along_axis(gap[todo], near[:, -1:], 1)[:, 0]
            who, nbr, centre, closed = _stars(xy, mine[todo], near, np.ones(near.shape, bool))
            size = (centre**2).sum(1)
            if k == len(xy) - 1:
                done = np.ones(len(todo), bool)
            else:  # a circle through the point lies within twice its radius of it
                done = closed.copy()
                done[who[4 * size > far[who]]] = False
            at, radius = xy[mine[todo]][who] + centre, np.sqrt(size)
            inside = (at - radius[:, None] > box[:2]).all(1) & (at + radius[:, None] < box[2:]).all(1)
            sure = closed | everywhere
            sure[who[~inside]] = False
            if everywhere:
                sure[:] = True
            fine = done & sure
            final[part[todo[fine]]] = True
            keep = fine[who]
            edges.append(np.stack([mine[todo][who[keep]], nbr[keep]], 1))
            todo = todo[~done]
    pairs = np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], final


def _round(dealt: DataFrame) -> DataFrame:
    """(sample, src, dst) of final stars, with dst null in a row for each point that is not final yet."""
    kind = dealt.schema["sample"].dataType
    rows = F.collect_list(F.struct("id", "x", "y", "own")).alias("rows")
    packed = dealt.groupBy("sample", "tile").agg(rows, *(F.first(k).alias(k) for k in ("bx0", "by0", "bx1", "by1")))
    packed = packed.filter(F.exists("rows", lambda r: r["own"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes = np.stack([batch.column(k).to_numpy() for k in ("bx0", "by0", "bx1", "by1")], 1)
            for i, rows in enumerate(batch.column("rows")):
                v = rows.values
                ids = v.field("id").to_numpy()
                xy = np.stack([v.field("x").to_numpy(), v.field("y").to_numpy()], 1)
                own = np.flatnonzero(v.field("own").to_numpy(zero_copy_only=False))
                middle = xy[own].mean(0)  # keeps products small
                src, dst, final = tile_stars(xy - middle, own, boxes[i] - np.tile(middle, 2))
                left = ids[own[~final]]
                sample = batch.column("sample").slice(i, 1).take(pa.array(np.zeros(len(src) + len(left), np.int64)))
                ends = pa.array(np.concatenate([ids[dst], left]), mask=np.arange(len(src) + len(left)) >= len(src))
                yield pa.RecordBatch.from_arrays([sample, pa.array(np.concatenate([ids[src], left])), ends], ["sample", "src", "dst"])

    return packed.mapInArrow(run, f"sample {kind.simpleString()}, src long, dst long")


def triangulation(points: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """(sample, src, dst, dist): the Delaunay neighbours of every point of (sample, id, x, y), each edge in both directions.

    Ids are whole numbers, one per point of a sample. Points at one place are neighbours of each other; a point alone has none, and
    points without a place take no part.
    """
    points = points.select("sample", c("id").cast("long").alias("id"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    points = materialise(points.dropna(subset=["x", "y"]), "points")
    size = points.groupBy("sample").agg(
        F.count("*").alias("n"), F.greatest((F.max("x") - F.min("x")), (F.max("y") - F.min("y"))).alias("wide")
    )
    unit = F.when(c("wide") > 0, c("wide") / F.sqrt("n")).otherwise(1.0) / SHIFT

    def moved(k: str, salt: int):
        return c(k) + unit * (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20) - 0.5)

    at = points.join(F.broadcast(size), "sample").select("sample", "id", moved("x", 1).alias("x"), moved("y", 2).alias("y"))
    todo = materialise(at.withColumn("own", F.lit(True)), "moved")
    every, done = todo.drop("own"), []
    target = tile_points
    most = size.agg(F.max("n")).first()[0] or 0
    for _ in range(1 + math.ceil(math.log(max(most / tile_points, 1), GROWTH)) + 1):
        found = materialise(_round(deal(todo, balanced_tiles(todo, target, HALO))), "stars")
        edges = found.filter("dst is not null")
        done.append(edges)
        left = found.filter("dst is null").select("sample", c("src").alias("id"))
        n = left.groupBy("sample").count().agg(F.max("count")).first()[0]
        if not n:
            break
        # True neighbours of what is left: each other, and the final points that have them as neighbours.
        known = reduce(DataFrame.unionByName, done)
        beside = known.join(left.withColumnRenamed("id", "dst"), ["sample", "dst"], "left_semi").select("sample", c("src").alias("id"))
        part = left.withColumn("own", F.lit(True)).unionByName(beside.distinct().withColumn("own", F.lit(False)))
        todo = materialise(every.join(part, ["sample", "id"]), "left")
        target *= GROWTH
    else:
        raise RuntimeError("the last round left points")
    edges = reduce(DataFrame.unionByName, done)
    a, b = (points.select("sample", c("id").alias(k), c("x").alias(f"x{k}"), c("y").alias(f"y{k}")) for k in ("src", "dst"))
    met = edges.join(a, ["sample", "src"]).join(b, ["sample", "dst"])
    dist = F.hypot(c("xsrc") - c("xdst"), c("ysrc") - c("ydst"))
    return met.select("sample", "src", "dst", dist.alias("dist"))
