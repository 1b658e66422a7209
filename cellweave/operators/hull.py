"""Convex hulls: of all points of a group in two stages, and of the reads of each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialise


def chain(points: np.ndarray) -> np.ndarray:
    """Indexes of the hull's vertices, counter-clockwise from the least point; collinear points are left out."""
    order = np.lexsort((points[:, 1], points[:, 0]))
    order = order[np.concatenate([[True], (np.diff(points[order], axis=0) != 0).any(1)])] if len(order) else order
    return np.array(_corners(points.tolist(), order.tolist()), np.int64)


def _corners(points: list[list[float]], order: list[int]) -> list[int]:
    """The hull's vertices of different points in the order of x and y; plain numbers, as most hulls are of few points."""
    if len(order) < 3:
        return order

    def half(ids):
        out: list[int] = []
        for i in ids:
            cx, cy = points[i]
            while len(out) > 1:
                (ax, ay), (bx, by) = points[out[-2]], points[out[-1]]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                out.pop()
            out.append(i)
        return out

    return half(order)[:-1] + half(order[::-1])[:-1]


def area_and_perimeter(points: np.ndarray) -> tuple[float, float]:
    nxt = np.roll(points, -1, axis=0)
    area = abs(float((points[:, 0] * nxt[:, 1] - nxt[:, 0] * points[:, 1]).sum())) / 2
    return area, float(np.hypot(*(nxt - points).T).sum())


def group_hulls(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n_points, area, perimeter): partial hulls in every partition, and one hull over their vertices per group."""
    kind = df.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for b in batches:
            for key, g in b.groupby(by, dropna=False):
                p = g[["x", "y"]].to_numpy(float)
                old = held.get(key)
                p = p if old is None else np.concatenate([old, p])
                held[key] = p[chain(p)]
        for key, p in held.items():
            yield pd.DataFrame({by: key, "x": p[:, 0], "y": p[:, 1]})

    def final(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y"]].to_numpy(float)
        p = p[chain(p)]
        area, around = area_and_perimeter(p)
        return pd.DataFrame({by: [g[by].iloc[0]], "n_vertices": [len(p)], "area": [area], "perimeter": [around]})

    rows = df.select(by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    corners = rows.mapInPandas(partial, f"{by} {kind}, x double, y double")
    return corners.groupBy(by).applyInPandas(final, f"{by} {kind}, n_vertices int, area double, perimeter double")


def cell_hulls(reads: DataFrame, value: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, cell_id, area, edge_value): hull area of each cell's reads, null for up to 3 reads or a hull without area, and
    the mean of ``value`` over the reads at its vertices. A partition is sorted by cell, and its cells are cut from arrays."""
    keys = [*by, "sample", "cell_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = np.logical_and.reduce([_same(b[k], b[k].iloc[-1]) for k in keys])
            rest, b = b[last], b[~last]
            if len(b):
                yield cut(b)
        if rest is not None and len(rest):
            yield cut(rest)

    def cut(b: pd.DataFrame) -> pd.DataFrame:
        new = np.logical_or.reduce([_steps(b[k]) for k in keys])
        begin = np.flatnonzero(np.append(True, new))
        p, v = b[["x", "y"]].to_numpy(float), b["value"].to_numpy(float)
        cell = np.cumsum(np.append(False, new))
        order = np.lexsort((p[:, 1], p[:, 0], cell))
        differ = (np.diff(p[order], axis=0) != 0).any(1) | new  # places of cells are the same in this order
        order = order[np.append(True, differ)]
        ends = np.searchsorted(cell[order], np.arange(len(begin) + 1))
        points, order, sizes = p.tolist(), order.tolist(), np.diff(np.append(begin, len(b))).tolist()
        areas: list[float | None] = []
        edges: list[float | None] = []
        for n, i, j in zip(sizes, ends[:-1].tolist(), ends[1:].tolist()):
            k = _corners(points, order[i:j])
            area = _area(points, k) if len(k) > 2 else 0.0
            fine = area > 0
            areas.append(area if fine and n > 3 else None)
            edges.append((float(v[k].mean()) if value else 0.0) if fine else None)
        return b[keys].iloc[begin].assign(area=pd.Series(areas, b.index[begin], float), edge_value=pd.Series(edges, b.index[begin], float))

    v = F.col(value).cast("double") if value else F.lit(0.0)
    rows = reads.filter(F.col("cell_id").isNotNull()).select(
        *keys, F.col("x_location").alias("x"), F.col("y_location").alias("y"), v.alias("value")
    )
    kinds = dict(rows.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return (
        rows.repartition(*keys).sortWithinPartitions(*keys, "x", "y", "value").mapInPandas(run, f"{head}, area double, edge_value double")
    )


def _same(x: pd.Series, value) -> np.ndarray:
    return (x.isna() if pd.isna(value) else x == value).to_numpy(bool)


def _steps(x: pd.Series) -> np.ndarray:
    """Where a value differs from the one before it; nulls are alike."""
    a, none = x.to_numpy(), x.isna().to_numpy()
    return ((a[1:] != a[:-1]) & ~(none[1:] & none[:-1])).astype(bool)


def _area(points: list[list[float]], corners: list[int]) -> float:
    twice, (ax, ay) = 0.0, points[corners[-1]]
    for i in corners:
        bx, by = points[i]
        twice += ax * by - bx * ay
        ax, ay = bx, by
    return abs(twice) / 2


def cell_areas(reads: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sample, cell_id, area): hull areas, the mean area (of each ``by``) where a cell has none or one under 1."""
    hulls = materialise(cell_hulls(reads, by=by).drop("edge_value"), "hulls")  # read for the means and for the cells
    mean = hulls.groupBy(*by).agg(F.avg("area").alias("mean_area"))
    fine = F.when(F.col("area") >= 1, F.col("area"))
    met = hulls.join(F.broadcast(mean), list(by)) if by else hulls.join(F.broadcast(mean))  # a row for each of ``by``
    return met.select(*by, "sample", "cell_id", F.coalesce(fine, "mean_area").alias("area"))


def edge_distance(distances: DataFrame) -> DataFrame:
    """Median over cells of the mean distance of the reads at the hull's vertices."""
    return cell_hulls(distances, "distance").agg(F.median("edge_value").alias("edge_distance"))
