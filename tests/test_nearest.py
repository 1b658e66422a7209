"""Nearest neighbours in the plane: exact for uneven points, with bounded work."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import nearest
from cellweave.operators.tiles import balanced_tiles, deal

SCHEMA = "sample int, id long, x double, y double"


def uneven(n, seed=0):
    """A dense cluster, some equal points, a spread and one stray point a thousand times as far away as the cluster is wide."""
    rng = np.random.default_rng(seed)
    xy = np.concatenate([rng.normal(0, 1, (n - 60, 2)), rng.random((50, 2)) * 300, np.full((9, 2), 0.25), [[4000.0, -3000.0]]])
    return [(0, 7 * i, float(x), float(y)) for i, (x, y) in enumerate(xy)]


def brute(rows, k):
    out = {}
    for sample in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sample]
        ids, x, y = (np.array(v) for v in list(zip(*mine))[1:])
        for i, r in enumerate(mine):
            dx, dy = x[i] - x, y[i] - y
            d = np.sqrt(dx * dx + dy * dy)
            order = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out[sample, r[1]] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("k", [1, 5, 20])
def test_tiles_equal_brute_force(spark, k):
    rows = uneven(700) + [(1, i, float(i % 4), float(i // 4)) for i in range(16)] + [(2, 5, 1.0, 1.0)]
    got: dict = {}
    for r in nearest.tile_neighbours(spark.createDataFrame(rows, SCHEMA), k, tile_points=50).orderBy("place").collect():
        got.setdefault((r["sample"], r.src), []).append((r.dst, r.dist))
    assert got == {p: n for p, n in brute(rows, k).items() if n}


def test_a_stray_point_costs_no_other_anything(spark):
    """Tiles stay of bounded size, and few points look into further tiles, though one stray point widens the sample a thousandfold."""
    k, size = 5, 60
    points = spark.createDataFrame(uneven(3000), SCHEMA)
    tiles = balanced_tiles(points, size, nearest.HALO)
    dealt = deal(points.withColumn("own", F.lit(True)), tiles)
    held = [r for r in dealt.groupBy("tile").agg(F.count("*").alias("n"), F.count_if("own").alias("own")).collect() if r.own]
    assert sum(r.own for r in held) == 3000 and max(r.own for r in held) <= 3 * size
    # All points of a tile are compared with those of its box: a constant for each point.
    assert sum(r.own * r.n for r in held) <= 40 * size * 3000
    found = nearest.tile_neighbours(points, k, tile_points=size)
    assert found.count() == 3000 * k


def test_text_ids_and_missing_places(spark):
    rows = [("s", f"p{i}", float(i), 0.0) for i in range(12)] + [("s", "lost", None, 1.0)]
    got = nearest.tile_neighbours(spark.createDataFrame(rows, "sample string, id string, x double, y double"), 2).collect()
    assert len(got) == 24 and {r.dst for r in got if r.src == "p3"} == {"p2", "p4"}
    assert nearest.tile_neighbours(spark.createDataFrame([], SCHEMA), 2).count() == 0


def test_domains_search_neighbours_once(spark, monkeypatch):
    """The ten neighbours that smooth the domains are the first of the fifteen that make them."""
    from cellweave import catalog
    from cellweave.operators import spatial as sp

    calls, search = [], sp.nearest_neighbours
    monkeypatch.setattr(sp, "nearest_neighbours", lambda *a: calls.append(a) or search(*a))
    out = catalog.queries()["e7_domains"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1 and "cell_id" in out.columns
