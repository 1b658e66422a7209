"""Closed forms, invariants and stated deviations."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import scalar as sc
from cellweave.operators import cluster, hull, metrics, neighbors, profiles, qc, regions, spatial, transfer
from cellweave.operators import reads as rd
from cellweave.sources import files
from cellweave.streaming.counts import stream_counts, stream_reads


def test_agreement_of_equal_labels(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "x int, y string")
    row = metrics.agreement(df, "x", "y").first()
    assert row.ari == pytest.approx(1) and row.nmi == pytest.approx(1) and row.vi == pytest.approx(0)


def grid(spark, n):
    return spark.createDataFrame(
        [(0, i * n + j, float(i), float(j), "a") for i in range(n) for j in range(n)],
        "sample int, cell_id long, x_centroid double, y_centroid double, cell_type string",
    )


def test_moran_of_a_checkerboard(spark):
    cells = grid(spark, 6)
    black = cells.filter((F.col("cell_id") + F.floor(F.col("cell_id") / 6)) % 2 == 0)
    values = black.select("sample", "cell_id", F.lit("g").alias("feature_name"), F.lit(1).alias("n"))
    row = neighbors.autocorrelation(spatial.radius_graph(cells, 1.0), values, 36).first()
    assert row.moran == pytest.approx(-1) and row.geary > 1


def test_neighbours_on_a_grid(spark):
    near = spatial.nearest_neighbours(spatial.as_points(grid(spark, 5)), 4)
    middle = [r.dist for r in near.filter("src = 12").collect()]
    assert middle == [1.0] * 4
    assert near.groupBy("src").count().filter("count <> 4").count() == 0


def test_neighbours_of_few_points(spark):
    near = spatial.nearest_neighbours(spatial.as_points(grid(spark, 1)), 3)
    assert near.count() == 0


def test_hull_of_a_square_with_inner_points(spark):
    p = np.array([(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (1, 0)], float)
    k = hull.chain(p)
    assert sorted(k.tolist()) == [0, 1, 2, 3]
    assert hull.area_and_perimeter(p[k]) == (4.0, 8.0)
    df = spark.createDataFrame([(0, *map(float, x)) for x in p], "sample int, x double, y double").repartition(3)
    row = hull.group_hulls(df, "sample", "x", "y").first()
    assert row.area == 4.0 and row.perimeter == 8.0


def test_border_distance_is_signed_once(spark):
    points = spark.createDataFrame([(1, 0, 1.0, 1.0), (2, 0, 5.0, 1.0)], "id long, poly_id int, x double, y double")
    square = [(0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])]
    polygons = spark.createDataFrame(square, "poly_id int, seq int, x double, y double")
    out = {r.id: r.border_distance for r in spatial.border_distance(points, polygons, "poly_id", F.col("id") == 1).collect()}
    assert out == {1: -1.0, 2: 3.0}


def test_last_region_wins_and_edges_are_outside(spark):
    rows = []
    for k, x0 in enumerate((0.0, 1.0)):
        for i, (dx, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)]):
            rows.append((k, f"r{k}", i, x0 + dx, float(y)))
    polygons = spark.createDataFrame(rows, "poly_id int, region_annotation string, seq int, x double, y double")
    points = spark.createDataFrame([(1, 1.5, 1.0), (2, 0.5, 1.0), (3, 0.0, 1.0), (4, 9.0, 9.0)], "id long, x double, y double")
    out = {r.id: r.region for r in spatial.point_in_polygon(points, polygons, ["id"], "x", "y", grid=1.0).collect()}
    assert out == {1: "r1", 2: "r0", 3: "None", 4: "None"}


def test_gene_names_fail_loudly(spark):
    a = spark.createDataFrame([("x",)], "g string")
    with pytest.raises(ValueError):
        transfer.harmonise_genes(a, "g", a, "g")


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a = {r.id for r in rd.fraction_sample(df.repartition(7), 0.1, 3, "id").collect()}
    b = {r.id for r in rd.fraction_sample(df.coalesce(1), 0.1, 3, "id").collect()}
    assert a == b and 50 < len(a) < 150


def test_upper_tail(spark):
    z = [-2.0, 0.0, 1.0, 3.0]
    out = spark.createDataFrame([(x,) for x in z], "z double").select(neighbors.upper_tail(F.col("z")).alias("p")).collect()
    for x, r in zip(z, out):
        assert r.p == pytest.approx(math.erfc(x / 2**0.5) / 2, abs=1e-6)


def test_propagation_finds_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 4) for b in range(base, a)] + [(3, 10, 0.1)]
    e = spark.createDataFrame(edges, "src long, dst long, weight double")
    n = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 10, 11, 12, 13)], "id long")
    labels = {r.id: r.label for r in cluster.propagate_labels(e, n, target=2).collect()}
    assert len({labels[i] for i in range(4)}) == 1 and len({labels[i] for i in range(10, 14)}) == 1
    assert labels[0] != labels[10]


def test_purity_needs_two_classes(spark):
    cells = spark.createDataFrame([(0, i, "a") for i in range(12)], "sample int, cell_id long, cell_type string")
    counts = spark.createDataFrame([(0, i, "g", 1) for i in range(12)], "sample int, cell_id long, feature_name string, n int")
    score, _ = metrics.marker_purity(counts, cells, counts, cells)
    assert score.first().purity is None


def test_run_names(spark):
    row = spark.range(1).select(sc.run_name({"a": F.lit(1), "b": F.lit("x")}).alias("r"))
    assert row.select("r", sc.run_parameter(F.col("r"), "b").alias("b"), sc.run_parameter(F.col("r"), "q").alias("q")).first() == ("a-1_b-x", "x", None)


def test_vote_takes_the_least_on_ties(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "k int, l string")
    assert qc.majority_vote(df, ["k"], "l").first().label == "a"


def test_curve_never_falls(spark):
    d = spark.createDataFrame([(0.4, 1), (2.5, 0), (3.5, 1), (30.0, 0)], "distance double, overlaps_nucleus int")
    n = [r.captured_reads for r in rd.expansion_curve(d).orderBy("expansion_distance").collect()]
    assert n[0] == 1 and n[2] == 2 and n[4] == 3 and n[15] == 3  # halves round to even
    assert profiles.elbow(rd.expansion_curve(d)).count() == 1


def test_readers(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n2 2 2\n1 1 3\n2 2 4\n")
    (tmp_path / "f.tsv").write_text("id1\tG1\nid2\tG2\n")
    (tmp_path / "b.tsv").write_text("c1\nc2\n")
    m = files.read_matrix_market(spark, *(str(tmp_path / x) for x in ("m.mtx", "f.tsv", "b.tsv")))
    assert {tuple(r) for r in m.collect()} == {("c1", "G1", 3.0), ("c2", "G2", 4.0)}
    panel = {"payload": {"targets": [{"type": {"data": {"name": "A", "id": "x"}, "descriptor": "gene"}}, {"type": {"data": {"name": "B"}}}]}}
    (tmp_path / "p.json").write_text(json.dumps(panel))
    got = {tuple(r) for r in files.read_panel_json(spark, str(tmp_path / "p.json")).collect()}
    assert got == {("A", "x", "gene"), ("B", "newid_1", "other")}
    (tmp_path / "r.json").write_text(json.dumps([{"name": "T [1]", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}]))
    r = files.read_regions_json(spark, str(tmp_path / "r.json"))
    assert r.count() == 3 and r.first().region_general == "T"
    (tmp_path / "a.csv").write_text("Gene,x,y,cell\nA,1,1,0\nB,2,2,5\n")
    rows, noise = files.read_assignments(spark, str(tmp_path / "a.csv"))
    assert noise.first().pct_noise == 0.5 and rows.filter("cell_id is null").count() == 1


def test_samples_and_stream(spark, tmp_path):
    from cellweave.schema import READS

    for s in ("one", "two"):
        row = [("5", "g", 1.0, 1.0, 0.0, 30.0, 1, 0.0, "f"), ("-1", "g", 1.0, 1.0, 0.0, 30.0, 0, 2.0, "f")]
        spark.createDataFrame(row, READS).write.parquet(str(tmp_path / s))
    both = files.read_samples(spark, {s: str(tmp_path / s) for s in ("one", "two")})
    assert {r["sample"] for r in both.collect()} == {"one", "two"}
    assert both.filter("cell_id is null").count() == 2
    q = stream_counts(stream_reads(spark, str(tmp_path / "one"))).writeStream.outputMode("complete").format("memory")
    q = q.queryName("streamed").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("5", "g", 1)]
    files.export_matrix(rd.read_counts(both), ["g", "h"], str(tmp_path / "wide"))
    assert spark.read.csv(str(tmp_path / "wide"), header=True).columns == ["cell_id", "g", "h"]


def test_silhouettes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, rng.normal(size=3).tolist(), int(rng.integers(3))) for g in ("a", "b") for i in range(40)]
    rows += [("one", i, [float(i)], 7) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id long, f array<double>, l int")
    got = {r.g: (r.clusters, r.silhouette) for r in cluster.silhouettes(df, ["g", "id"], "f", "l", "g").collect()}
    for g in "ab":
        x = np.array([r[2] for r in rows if r[0] == g])
        l = np.array([r[3] for r in rows if r[0] == g])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        score = []
        for i in range(len(x)):
            own = (l == l[i]) & (np.arange(len(x)) != i)
            a, b = d[i, own].mean(), min(d[i, l == k].mean() for k in set(l) - {l[i]})
            score.append((b - a) / max(a, b))
        assert got[g][0] == 3 and abs(got[g][1] - np.mean(score)) < 1e-6
    assert got["one"] == (1, -1.0)
    small = {r.g: (r.clusters, r.silhouette) for r in cluster.silhouettes(df, ["g", "id"], "f", "l", "g", block=5).collect()}
    assert small == {g: (n, pytest.approx(x)) for g, (n, x) in got.items()}  # every row is scored in blocks of any size


def test_neighbours_of_groups_do_not_meet(spark):
    rows = [(g, i, [float(i), float(g)]) for g in (0, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "g long, id long, features array<double>")
    near = transfer.feature_neighbours(df, df, 2, "euclidean", block=5, sizes=(12, 12), by="g")
    one = transfer.feature_neighbours(df.filter("g = 1"), df.filter("g = 1"), 2, "euclidean", block=5)
    key = lambda r: (r.src, r.dst, r.place)
    got = near.collect()
    assert len(got) == 48
    assert sorted(key(r) for r in got if r.g == 1) == sorted(key(r) for r in got if r.g == 0) == sorted(map(key, one.collect()))


def test_exact_enrichment_equals_all_permutations(spark):
    """The mean and deviation of the edges between labels over every way to deal a sample's labels, summed over two samples."""
    from itertools import permutations

    rng = np.random.default_rng(4)
    labels = {0: list("aaabbcb"), 1: list("abca")}
    edges = {s: [(i, j) for i in range(len(x)) for j in range(len(x)) if i != j and rng.random() < 0.4] for s, x in labels.items()}
    cells = [(s, 10 * s + i, x) for s, v in labels.items() for i, x in enumerate(v)] + [(1, 99, None)]
    rows = [(s, 10 * s + i, 10 * s + j) for s, e in edges.items() for i, j in e] + [(1, 10, 99)]
    df = spark.createDataFrame(cells, "sample int, cell_id long, cell_type string")
    got = neighbors.exact_enrichment(spark.createDataFrame(rows, "sample int, src long, dst long"), df).collect()
    assert len(got) == 9
    for r in got:
        seen, mean, spread = 0, 0.0, 0.0
        for s, v in labels.items():
            n = [sum(p[i] == r.a and p[j] == r.b for i, j in edges[s]) for p in permutations(v)]
            seen += sum(v[i] == r.a and v[j] == r.b for i, j in edges[s])
            mean, spread = mean + np.mean(n), spread + np.var(n)
        assert r.n == seen and r.expected == pytest.approx(mean)
        assert r.z == (pytest.approx((seen - mean) / spread**0.5) if spread > 1e-9 else None)


@pytest.mark.parametrize("tile", [3, 4, None])
def test_density_by_tiles_equals_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    at = {(int(s), int(x), int(y), g): int(rng.integers(1, 5)) for s, x, y, g in zip(rng.integers(0, 2, 90), rng.integers(-9, 12, 90), rng.integers(-5, 9, 90), "ab" * 45)}
    df = spark.createDataFrame([(*k, n) for k, n in at.items()], "sample int, bx long, by long, feature_name string, n long")
    got = {(r["sample"], r.bx, r.by, r.feature_name): r.density for r in regions.kernel_density(df, 10.0, 15.0, tile).collect()}
    want: dict = {}
    for s, x, y in {k[:3] for k in at}:
        for (t, u, v, g), n in at.items():
            d = ((x - u) ** 2 + (y - v) ** 2) * 100
            if t == s and d <= 900:
                want[s, x, y, g] = want.get((s, x, y, g), 0) + n * math.exp(-d / 450)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_density_shuffles_entries_once(spark):
    """One exchange, of entries with their copies at borders and not of their stencils."""
    df = spark.createDataFrame([(0, 1, 1, "g", 1)], "sample int, bx long, by long, feature_name string, n long")
    plan = regions.kernel_density(df, 10.0, 15.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("n,k,want", [(0, 3, 0), (1, 3, 1), (4, 9, 4), (9, 8, 8), (30, 4, 4)])
def test_kmeans_of_few_rows(spark, n, k, want):
    """Fewer different rows than clusters, and rows that repeat."""
    df = spark.createDataFrame([(i, [float(i % n), float(i % n) ** 2]) for i in range(3 * n)], "id long, f array<double>")
    got = cluster.kmeans(df, "f", k).collect()
    assert len(got) == 3 * n and len({r.cluster for r in got}) == want
    assert len({(tuple(r.f), r.cluster) for r in got}) == n


def test_areas_of_all_methods_come_from_one_pass_over_the_reads(spark, tmp_path):
    """The hulls of several methods are those of each method by itself, and no read is passed to Python twice."""
    rng = np.random.default_rng(4)
    rows = [(m, int(i % 2), int(i) if i % 7 else None, *map(float, rng.integers(0, 6, 2))) for m in ("a", "b") for i in rng.integers(0, 30, 300)]
    reads = spark.createDataFrame(rows, "method string, sample int, cell_id int, x_location double, y_location double")
    both = hull.cell_areas(reads, ("method",))
    got = {(r.method, r.sample, r.cell_id): r.area for r in both.collect()}
    for m in ("a", "b"):
        one = {(m, r.sample, r.cell_id): r.area for r in hull.cell_areas(reads.filter(F.col("method") == m)).collect()}
        assert one == pytest.approx({k: v for k, v in got.items() if k[0] == m})
    for (m, s, i), area in got.items():
        p = np.array([x[3:] for x in rows if x[:3] == (m, s, i)])
        k = hull.chain(p)
        if len(p) > 3 and len(k) > 2 and (real := hull.area_and_perimeter(p[k])[0]) >= 1:
            assert area == pytest.approx(real)
    assert "MapInPandas" not in both._jdf.queryExecution().executedPlan().toString()  # written before means and cells meet


def test_sums_of_neighbours_are_dealt_to_partitions_by_their_edges(spark, monkeypatch):
    """Partitions grow with the edges, and no partition adds up rows before they are dealt to the cells they are for."""
    rng = np.random.default_rng(2)
    edges = [(0, int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 40, 600), rng.integers(0, 40, 600), rng.integers(0, 3, 600))]
    counts = [(0, i, f"g{g}", int(rng.integers(1, 9))) for i in range(40) for g in range(5) if (i + g) % 3]
    e = spark.createDataFrame(edges, "sample int, src int, dst int, dist double")
    n = spark.createDataFrame(counts, "sample int, cell_id int, feature_name string, n long")
    want: dict = {}
    for _, src, dst, dist in edges:
        for _, cell, gene, k in counts:
            if cell == src and dist > 0:
                want[dst, gene] = want.get((dst, gene), 0) + k
    monkeypatch.setattr(neighbors, "PART_EDGES", 20)
    out = neighbors.neighbour_expression(e, n)
    assert {(r.cell_id, r.feature_name): r.n for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == -(-sum(x[3] > 0 for x in edges) // 20)
