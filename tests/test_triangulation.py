"""Delaunay neighbours against brute force over all pairs, and tiles against one tile."""

import numpy as np
import pytest

from cellweave import catalog
from cellweave.operators import triangulation as tg
from tests.oracle import differences, views

SF = "/root/testdata/sf0.001"
SCHEMA = "sample int, id long, x double, y double"


def brute(xy):
    """Pairs with an empty circle: on their bisector, the centres that keep out the points of either side must leave a place."""
    out = set()
    for i in range(len(xy)):
        away = xy - xy[i]
        for j in range(i + 1, len(xy)):
            a = away[j]
            cross = a[0] * away[:, 1] - a[1] * away[:, 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                s = ((away**2).sum(1) - away @ a) / (2 * cross)
            right, left = s[cross < 0], s[cross > 0]
            if right.max(initial=-np.inf) < left.min(initial=np.inf):
                out |= {(i, j), (j, i)}
    return out


def crowd(n, seed):
    """A dense cluster, a thin line of points, a spread and one far away."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1, (n // 2, 2)), rng.random((n // 3, 2)) * [100, 0.5], rng.random((n - n // 2 - n // 3 - 1, 2)) * 100, [[900.0, -700.0]]]
    return np.concatenate(parts)


def edges_of(spark, rows, **options):
    got = tg.triangulation(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len({(r["sample"], r.src, r.dst) for r in got}) == len(got)
    for r in got[:50]:
        a, b = (next(x for x in rows if x[:2] == (r["sample"], k)) for k in (r.src, r.dst))
        assert r.dist == pytest.approx(np.hypot(a[2] - b[2], a[3] - b[3]))
    return {(r["sample"], r.src, r.dst) for r in got}


def test_kernel_equals_brute_force():
    everywhere = np.array([-np.inf, -np.inf, np.inf, np.inf])
    for seed in range(6):
        xy = crowd(12 * seed + 8, seed)
        src, dst, final = tg.tile_stars(xy, np.arange(len(xy)), everywhere)
        assert final.all() and set(zip(src.tolist(), dst.tolist())) == brute(xy)


def test_tiles_equal_brute_force_and_each_other(spark):
    """Two samples, of 500 and 2,000 points, in tiles of about 40 and in one: no edge is missing or doubled at a border."""
    some, many = crowd(500, 1), crowd(2000, 2)
    rows = [(s, i, float(x), float(y)) for s, xy in ((0, some), (1, many)) for i, (x, y) in enumerate(xy)]
    tiled = edges_of(spark, rows, tile_points=40)
    assert {e[1:] for e in tiled if e[0] == 0} == brute(some)
    assert tiled == edges_of(spark, rows, tile_points=10**6)
    assert all((s, b, a) in tiled for s, a, b in tiled)


def test_lattice_is_a_triangulation(spark):
    """All points of a lattice lie on circles with others: every face must be a triangle all the same (Euler's formula)."""
    rows = [(0, 20 * i + j, float(i), float(j)) for i in range(20) for j in range(20)]
    edges = edges_of(spark, rows, tile_points=30)
    assert all((s, b, a) in edges for s, a, b in edges)
    n, e = 400, len(edges) // 2
    outline = 3 * n - 3 - e  # of a triangulation of n points, h of them on the outline, which has e = 3n - 3 - h edges
    assert 4 <= outline <= 76
    assert all(a == b + d or b == a + d for _, a, b in edges for d in [abs(a - b)]) and {1, 20} <= {abs(a - b) for _, a, b in edges}


def test_few_points(spark):
    rows = [(0, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 2, 5.0, 0.0), (2, 1, 3.0, 3.0), (2, 2, 3.0, 3.0), (2, 3, 3.0, 3.0), (3, 1, None, 1.0)]
    assert {e for e in edges_of(spark, rows) if e[0] < 2} == {(1, 1, 2), (1, 2, 1)}
    assert len([e for e in edges_of(spark, rows) if e[0] == 2]) in (4, 6)
    assert tg.triangulation(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_sql(spark):
    name = "n9_triangulation"
    assert differences(spark, views(SF), name, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""
