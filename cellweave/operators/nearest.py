"""The k nearest points in the plane, by balanced tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.tiles import balanced_tiles, deal
from cellweave.session import arrow_rows, materialise

c = F.col

#: Points of a tile at least, and width of its halo in mean distances of its points.
TILE_POINTS, HALO = 1024, 4.0
#: Tiles that cross to a worker at once.
TILES = 64


def least_of(gap: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k least finite entries of each row, in order, the first column on ties."""
    if k < gap.shape[1]:
        edge = np.partition(gap, k - 1, axis=1)[:, k - 1 : k]
        row, at = np.nonzero((gap <= edge) & np.isfinite(gap))
    else:
        row, at = np.nonzero(np.isfinite(gap))
    d = gap[row, at]
    order = np.lexsort((at, d, row))
    row, at, d = row[order], at[order], d[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], d[keep]


def _sorted(rows: pa.Array, *more: str) -> list[np.ndarray]:
    """id, x, y and more of packed rows, by id."""
    got = [rows.values.field(k).to_numpy(zero_copy_only=False) for k in ("id", "x", "y", *more)]
    order = np.argsort(got[0], kind="stable")
    return [x[order] for x in got]


def _gaps(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    dx, dy = ax[:, None] - bx, ay[:, None] - by
    return np.sqrt(dx * dx + dy * dy)


def tile_neighbours(points: DataFrame, k: int, tile_points: int = TILE_POINTS) -> DataFrame:
    """(sample, src, dst, dist, place): the k nearest others of every point of (sample, id, x, y), exact, the least id on ties.

    Tiles hold about equal numbers of points, so a point is compared with about ``tile_points`` others wherever it lies. If its
    k-th neighbour is nearer than the border of what its tile knows, it is done. Otherwise it is sent to all tiles that reach
    within the distance of its k-th so far, and the least k of them all are its neighbours.
    """
    kinds = {x: points.schema[x].dataType.simpleString() for x in ("sample", "id")}
    points = points.select("sample", "id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    points = materialise(points, "points")
    tiles = balanced_tiles(points, max(tile_points, 2 * (k + 1)), HALO)
    dealt = deal(points.withColumn("own", F.lit(True)), tiles)
    rows = F.collect_list(F.struct("id", "x", "y", "own")).alias("rows")
    packed = dealt.groupBy("sample", "tile").agg(rows, *(F.first(b).alias(b) for b in ("bx0", "by0", "bx1", "by1")))
    found = f"sample {kinds['sample']}, src {kinds['id']}, dst {kinds['id']}, dist double, x double, y double, reach double"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours within the tile; of points that are not done a row without one, with how far to look (null: everywhere)."""
        for batch in batches:
            boxes = np.stack([batch.column(b).to_numpy() for b in ("bx0", "by0", "bx1", "by1")], 1)
            for i, part in enumerate(batch.column("rows")):
                ids, x, y, own = _sorted(part, "own")
                mine = np.flatnonzero(own)
                for some in np.array_split(mine, max(1, len(mine) * len(ids) // (1 << 21))):
                    gap = _gaps(x[some], y[some], x, y)
                    gap[np.arange(len(some)), some] = np.inf
                    row, at, d = least_of(gap, k)
                    x0, y0, x1, y1 = boxes[i]
                    border = np.minimum(np.minimum(x[some] - x0, x1 - x[some]), np.minimum(y[some] - y0, y1 - y[some]))
                    full = np.bincount(row, minlength=len(some)) == k
                    reach = np.full(len(some), np.inf)
                    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) if len(row) else row
                    reach[row[last]] = np.where(full[row[last]], d[last], np.inf)
                    done = (reach < border) | np.isinf(border)
                    left = np.flatnonzero(~done)
                    keep = done[row]
                    n, m = int(keep.sum()), len(left)
                    sample = batch.column("sample").slice(i, 1).take(pa.array(np.zeros(n + m, np.int64)))
                    src = np.concatenate([some[row[keep]], some[left]])
                    none = np.arange(n + m) >= n
                    dst = pa.array(np.concatenate([ids[at[keep]], ids[some[left]]]), mask=none)
                    dist = pa.array(np.concatenate([d[keep], np.zeros(m)]), mask=none)
                    far = np.concatenate([np.zeros(n), reach[left]])
                    columns = [sample, pa.array(ids[src]), dst, dist, pa.array(x[src]), pa.array(y[src]), pa.array(far)]
                    yield pa.RecordBatch.from_arrays(columns, ["sample", "src", "dst", "dist", "x", "y", "reach"])

    with arrow_rows(points.sparkSession, TILES):
        one = materialise(packed.filter(F.exists("rows", lambda r: r["own"])).mapInArrow(first, found), "neighbours")
    near = one.filter("dst is not null").select("sample", "src", "dst", "dist")
    todo = one.filter("dst is null").select("sample", c("src").alias("id"), "x", "y", "reach")
    if not todo.isEmpty():
        with arrow_rows(points.sparkSession, TILES):
            rest = materialise(_asked(todo, dealt, tiles, k, kinds), "neighbours")
        order = Window.partitionBy("sample", "src").orderBy("dist", "dst")  # k rows of each tile that was asked
        rest = rest.withColumn("place", F.row_number().over(order)).filter(c("place") <= k).drop("place")
        near = near.unionByName(rest)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("sample", "src").orderBy("dist", "dst")))  # k rows


def asked_tiles(todo: DataFrame, tiles) -> DataFrame:
    """Points (sample, id, x, y, reach) for each tile that comes within their reach."""
    lows = {"qx0": c("x") - c("reach"), "qy0": c("y") - c("reach"), "qx1": c("x") + c("reach"), "qy1": c("y") + c("reach")}
    asked = tiles.spread(todo.withColumns(lows), "qx0", "qy0", "qx1", "qy1")
    met = asked.join(tiles.spread(tiles.table, "x0", "y0", "x1", "y1"), ["sample", "gx", "gy"])
    off = lambda k: F.greatest(c(k + "0") - c(k), c(k) - c(k + "1"), F.lit(0.0))
    met = met.filter(off("x") * off("x") + off("y") * off("y") <= c("reach") * c("reach") * (1 + 1e-12))
    return met.select("sample", "tile", "id", "x", "y").distinct()


def _asked(todo: DataFrame, dealt: DataFrame, tiles, k: int, kinds: dict[str, str]) -> DataFrame:
    """(sample, src, dst, dist): for each point the k nearest in each tile within its reach."""
    place = F.struct("id", "x", "y")
    queries = asked_tiles(todo, tiles).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(64)))
    queries = queries.groupBy("sample", "tile", "block").agg(F.collect_list(place).alias("qs"))
    rows = dealt.filter("own").groupBy("sample", "tile").agg(F.collect_list(place).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (qs, rs) in enumerate(zip(batch.column("qs"), batch.column("rows"))):
                (qid, qx, qy), (ids, x, y) = _sorted(qs), _sorted(rs)
                for some in np.array_split(np.arange(len(qid)), max(1, len(qid) * len(ids) // (1 << 21))):
                    gap = _gaps(qx[some], qy[some], x, y)
                    gap[qid[some][:, None] == ids[None, :]] = np.inf
                    row, at, d = least_of(gap, k)
                    sample = batch.column("sample").slice(i, 1).take(pa.array(np.zeros(len(row), np.int64)))
                    columns = [sample, pa.array(qid[some][row]), pa.array(ids[at]), pa.array(d)]
                    yield pa.RecordBatch.from_arrays(columns, ["sample", "src", "dst", "dist"])

    met = queries.join(rows, ["sample", "tile"]).select("sample", "qs", "rows")
    return met.mapInArrow(run, f"sample {kinds['sample']}, src {kinds['id']}, dst {kinds['id']}, dist double")
