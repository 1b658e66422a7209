"""Sums and nearest targets within a radius against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import neighbors, profiles, spatial, within


def crowd(spark, n, seed=0):
    """Points of two samples, of which many lie on a lattice (equal distances and places) and a third in one crowd; ids shuffled."""
    g = np.random.default_rng(seed)
    xy = np.where(g.random((n, 1)) < 0.3, g.normal(20, 1, (n, 2)), g.integers(0, 40, (n, 2)).astype(float))
    rows = [(int(s), int(i), float(x), float(y)) for s, i, (x, y) in zip(g.integers(0, 2, n), g.permutation(n), xy)]
    return rows, spark.createDataFrame(rows, "sample int, id long, x double, y double")


def near(rows, others, radius):
    out = []
    for s, i, x, y in rows:
        for t, j, u, v in others:
            d = float(np.sqrt((x - u) * (x - u) + (y - v) * (y - v)))
            if s == t and d <= radius:
                out.append((s, i, j, d))
    return out


@pytest.mark.parametrize("radius", [0.5, 3.0, 15.0, 100.0])
def test_nearest_target_of_all_pairs(spark, radius, monkeypatch):
    monkeypatch.setattr(within, "SEEKERS", 100)
    rows, points = crowd(spark, 400)
    p, t = rows[:250], rows[150:]
    best = {}
    for s, i, j, d in near(p, t, radius):
        best[s, i] = min(best.get((s, i), (np.inf, 0)), (d, j))
    ids = lambda part: points.join(spark.createDataFrame([(r[1],) for r in part], "id long"), "id")
    got = spatial.nearest_within(ids(p), ids(t), radius).collect()
    assert {(r.sample, r.src): (r.dist, r.dst) for r in got} == best and len(got) == len(best)


def test_nearest_of_a_crowd_is_not_a_join_of_rows(spark):
    """A join of rows would make 10^10 pairs here; crowded cells are cut into blocks."""
    n = 100_000
    p = spark.range(n).select(F.lit(0).alias("sample"), "id", ((F.col("id") % 1000) / 1000).alias("x"), (F.floor(F.col("id") / 1000) / 100).alias("y"))
    got = spatial.nearest_within(p, p, 15.0)
    assert got.filter("dst = src and dist = 0").count() == n


def test_nearest_nucleus_counts_the_reads_of_a_place(spark):
    reads = spark.createDataFrame([(0, 1.0, 1.0)] * 3 + [(0, 9.0, 1.0), (0, None, 1.0), (1, 1.0, 1.0)], "sample int, x_location double, y_location double")
    cells = spark.createDataFrame([(0, 7, 2.0, 1.0, "a"), (0, 3, 0.0, 1.0, "b")], "sample int, cell_id long, x_centroid double, y_centroid double, cell_type string")
    assert [tuple(r) for r in profiles.nearest_nucleus(reads, cells, 5.0).collect()] == [(0, 1.0, 1.0, 3, 3, 1.0)]
    radii = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "cell_type string, radius double")
    assert [tuple(r) for r in profiles.reads_in_own_radius(reads, cells, radii, 5.0).collect()] == [(0, 3, 3)]


def test_nearest_in_small_steps(monkeypatch):
    monkeypatch.setattr(within, "ENTRIES", 16)
    g = np.random.default_rng(1)
    p, t = g.integers(0, 30, (300, 2)).astype(float), g.normal(15, 6, (200, 2)).round()
    d = np.sqrt((p[:, :1] - t[:, 0]) ** 2 + (p[:, 1:] - t[:, 1]) ** 2)
    row, at, dist = within._nearest(*p.T, *t.T, 4.0)
    assert (row == np.flatnonzero(d.min(1) <= 4)).all() and (at == d.argmin(1)[row]).all() and (dist == d.min(1)[row]).all()


@pytest.fixture(params=[(8192, 32768), (40, 60)], ids=["whole", "cut"])
def graph(spark, request, monkeypatch):
    """Cells, their graph of radius 3 as rows, and values; once in whole groups and once in groups cut into blocks."""
    monkeypatch.setattr(within, "POINTS", request.param[0])
    monkeypatch.setattr(within, "TARGETS", request.param[1])
    _, points = crowd(spark, 200)
    label = F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 3))
    cells = points.select("sample", F.col("id").alias("cell_id"), F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), label.alias("cell_type"))
    values = cells.join(spark.createDataFrame([("g",), ("h",), ("i",)], "feature_name string")).select("sample", "cell_id", "feature_name", (F.xxhash64("cell_id", "feature_name") % 5).alias("n"))
    return cells, spatial.radius_graph(cells, 3.0), values.filter("n > 0")


def equal(got, want, keys):
    got, want = ({tuple(r[k] for k in keys): r.asDict() for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and want
    for k in want:
        for name, value in want[k].items():
            assert got[k][name] == (pytest.approx(value, rel=1e-9, abs=1e-12) if isinstance(value, float) else value), (k, name)


def test_sums_over_a_radius_are_those_of_the_edges(graph):
    cells, edges, values = graph
    equal(neighbors.radius_label_pair_counts(cells, 3.0), neighbors.label_pair_counts(edges, cells), "ab")
    equal(neighbors.radius_exact_enrichment(cells, 3.0), neighbors.exact_enrichment(edges, cells), "ab")
    equal(neighbors.radius_enrichment(cells, 3.0, 4), neighbors.enrichment(edges, cells, 4), "ab")


def test_autocorrelation_over_a_radius_is_that_of_the_edges(graph):
    cells, edges, values = graph
    equal(neighbors.radius_autocorrelation(cells, 3.0, values, 200), neighbors.autocorrelation(edges, values, 200), ["feature_name"])
    equal(neighbors.radius_binary_enrichment(cells, 3.0, values), neighbors.binary_enrichment(edges, values, cells), ["feature_name"])
