"""Queries of spatial joins, the cell graph and segmentation-free regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import register
from cellweave.operators import cluster
from cellweave.operators import communities as cm
from cellweave.operators import feature_index as fi
from cellweave.operators import neighbors as nb
from cellweave.operators import qc
from cellweave.operators import reads as rd
from cellweave.operators import regions as rg
from cellweave.operators import spatial as sp
from cellweave.operators import triangulation as tg
from cellweave.plans.fixtures import cells, counts, polygons, reads
from cellweave.plans.read_queries import r6
from cellweave.session import materialise, table

c = F.col

_PIP = """e AS (SELECT poly_id, region_annotation, x AS x1, y AS y1,
  coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2
  FROM f_polygons WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
hit AS (SELECT cell_id, poly_id, region_annotation FROM f_cells, e GROUP BY ALL HAVING
  sum(CASE WHEN (y1 > y_centroid) <> (y2 > y_centroid) AND x_centroid < (x2 - x1) * (y_centroid - y1) / (y2 - y1) + x1
      THEN 1 ELSE 0 END) % 2 = 1
  AND sum(CASE WHEN (x2 - x1) * (y_centroid - y1) - (y2 - y1) * (x_centroid - x1) = 0 AND x_centroid BETWEEN least(x1, x2) AND
      greatest(x1, x2) AND y_centroid BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0),
region AS (SELECT f_cells.cell_id, coalesce(arg_max(region_annotation, poly_id), 'None') AS region
  FROM f_cells LEFT JOIN hit ON f_cells.cell_id = hit.cell_id GROUP BY ALL)"""


@register("j5_point_in_polygon", f"WITH {_PIP} SELECT * FROM region")
def j5(spark, sf):
    return sp.point_in_polygon(cells(spark, sf), polygons(spark, sf), ["cell_id"], "x_centroid", "y_centroid")


_READ_PIP = _PIP.replace("cell_id", "rid").replace("x_centroid", "px").replace("y_centroid", "py").replace("f_cells", "pts")


@register(
    "j6_point_to_segment",
    f"""WITH pts AS (SELECT DISTINCT x_location AS px, y_location AS py, x_location || ':' || y_location AS rid FROM f_reads),
    {_READ_PIP} SELECT region, count(*) AS n FROM region GROUP BY ALL""",
)
def j6(spark, sf):
    p = reads(spark, sf).select(c("x_location").alias("px"), c("y_location").alias("py")).distinct()
    out = sp.point_in_polygon(p.withColumns({"rx": c("px"), "ry": c("py")}), polygons(spark, sf), ["rx", "ry"], "px", "py")
    return out.groupBy("region").agg(F.count("*").alias("n"))


_NEAR = """near AS (SELECT a.sample, a.cell_id AS src, b.cell_id AS dst, sqrt((a.x_centroid - b.x_centroid) ** 2
  + (a.y_centroid - b.y_centroid) ** 2) AS dist FROM f_cells a JOIN f_cells b ON a.sample = b.sample AND a.cell_id <> b.cell_id)"""
_RADIUS = f"{_NEAR}, edges AS (SELECT * FROM near WHERE dist <= 50)"


@register(
    "j7_nearest_cell",
    f"WITH {_NEAR} SELECT sample, src, arg_min(dst, (dist, dst)) AS dst, round(min(dist), 6) AS dist FROM near "
    "WHERE src % 2 = 1 AND dst % 2 = 0 AND dist <= 80 GROUP BY ALL",
)
def j7(spark, sf):
    p = sp.as_points(cells(spark, sf))
    out = sp.nearest_within(p.filter("id % 2 = 1"), p.filter("id % 2 = 0"), 80)
    return out.withColumn("dist", F.round("dist", 6))


@register("j8_radius_join", f"WITH {_RADIUS} SELECT sample, src, dst, round(dist, 6) AS dist FROM edges")
def j8(spark, sf):
    return sp.radius_graph(cells(spark, sf), 50).withColumn("dist", F.round("dist", 6))


_KNN = f"""{_NEAR}, knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM near
  QUALIFY place <= 10)"""


@register("j9_knn", f"WITH {_KNN} SELECT sample, src, dst, round(dist, 6) AS dist, place FROM knn")
def j9(spark, sf):
    out = sp.nearest_neighbours(sp.as_points(cells(spark, sf)), 10)
    return out.withColumn("dist", F.round("dist", 6))


_COS = """SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist
  FROM embeddings a, embeddings b"""


@register(
    "j10_feature_knn",
    f"""WITH d AS ({_COS} WHERE a.vec_id <> b.vec_id AND a.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY src
    ORDER BY round(dist, 9), dst) AS place FROM d QUALIFY place <= 10) SELECT src, dst, place, round(dist, 6) AS dist FROM k""",
)
def j10(spark, sf):
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("features"))
    out = fi.indexed_neighbours(e.filter("id % 100 = 0"), e, 10, exact=True)
    return out.withColumn("dist", F.round("dist", 6))


@register(
    "j11_cross_knn",
    f"""WITH d AS ({_COS} WHERE a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY src
    ORDER BY round(dist, 9), dst) AS place FROM d QUALIFY place <= 15) SELECT src, dst, place, round(dist, 6) AS dist FROM k""",
)
def j11(spark, sf):
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("features"))
    out = fi.indexed_neighbours(e.filter("id % 10 = 0"), e.filter("id % 10 <> 0"), 15, exact=True)
    return out.withColumn("dist", F.round("dist", 6))


@register(
    "j16_border_distance",
    """WITH e AS (SELECT poly_id, x AS ax, y AS ay, coalesce(lead(x) OVER w, first(x) OVER w) AS bx,
      coalesce(lead(y) OVER w, first(y) OVER w) AS by_ FROM f_polygons WINDOW w AS (PARTITION BY poly_id ORDER BY seq)),
    t AS (SELECT cell_id, sample, ax, ay, bx, by_, x_centroid AS px, y_centroid AS py, greatest(0, least(1, ((x_centroid - ax) *
      (bx - ax) + (y_centroid - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) AS t FROM f_cells JOIN e
      ON sample = poly_id)
    SELECT cell_id AS id, sample AS poly_id, round(min(sqrt((px - ax - t * (bx - ax)) ** 2 + (py - ay - t * (by_ - ay)) ** 2))
      * CASE WHEN cell_id % 2 = 0 THEN -1 ELSE 1 END, 6) AS border_distance FROM t GROUP BY cell_id, sample""",
)
def j16(spark, sf):
    p = cells(spark, sf).select(
        c("cell_id").alias("id"), c("sample").alias("poly_id"), c("x_centroid").alias("x"), c("y_centroid").alias("y")
    )
    out = sp.border_distance(p, polygons(spark, sf), "poly_id", c("id") % 2 == 0)
    return out.withColumn("border_distance", F.round("border_distance", 6))


@register(
    "w8_polygon_edges",
    "SELECT poly_id, round(sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS perimeter FROM (SELECT poly_id, x AS x1, y AS y1, "
    "coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM f_polygons WINDOW w "
    "AS (PARTITION BY poly_id ORDER BY seq)) GROUP BY ALL",
)
def w8(spark, sf):
    rings = sp.polygon_rings(polygons(spark, sf), "poly_id")
    length = F.aggregate(
        "edges",
        F.lit(0.0),
        lambda s, e: s + F.sqrt(F.pow(e["x2"] - e["x1"], 2) + F.pow(e["y2"] - e["y1"], 2)),
    )
    return rings.select("poly_id", r6(length, "perimeter"))


# ---- the cell graph ----


@register(
    "n1_neighbour_classes",
    f"WITH {_KNN} SELECT knn.sample, dst AS cell_id, cell_type, count(*) AS n FROM knn JOIN f_cells ON src = cell_id WHERE dist > 0 "
    "GROUP BY ALL",
)
def n1(spark, sf):
    at = cells(spark, sf)
    return nb.neighbour_classes(sp.nearest_neighbours(sp.as_points(at), 10), at)


@register(
    "n2_neighbour_expression",
    f"WITH {_KNN} SELECT knn.sample, dst AS cell_id, feature_name, sum(n)::BIGINT AS n FROM knn JOIN f_counts ON src = cell_id "
    "WHERE dist > 0 GROUP BY ALL",
)
def n2(spark, sf):
    return nb.neighbour_expression(sp.nearest_neighbours(sp.as_points(cells(spark, sf)), 10), counts(spark, sf))


@register(
    "n3_label_pairs",
    f"WITH {_RADIUS} SELECT x.cell_type AS a, y.cell_type AS b, count(*) AS n FROM edges JOIN f_cells x ON src = x.cell_id "
    "JOIN f_cells y ON dst = y.cell_id GROUP BY ALL",
)
def n3(spark, sf):
    at = cells(spark, sf)
    return nb.radius_label_pair_counts(at, 50)


@register(
    "n3_enrichment",
    f"""WITH {_RADIUS}, perms AS (SELECT unnest(range(1, 21)) AS perm),
    r AS (SELECT sample, cell_id, cell_type, perm, row_number() OVER (PARTITION BY sample, perm ORDER BY cell_id) AS i,
      row_number() OVER (PARTITION BY sample, perm ORDER BY md5(concat_ws('|', cell_id, perm, '0')), cell_id) AS j FROM f_cells, perms),
    dealt AS (SELECT a.perm, a.cell_id, b.cell_type FROM r a JOIN r b ON a.sample = b.sample AND a.perm = b.perm AND a.i = b.j),
    drawn AS (SELECT x.cell_type AS a, y.cell_type AS b, x.perm, count(*) AS n FROM edges JOIN dealt x ON src = x.cell_id
      JOIN dealt y ON dst = y.cell_id AND x.perm = y.perm GROUP BY ALL),
    s AS (SELECT a, b, sum(n) / 20 AS mean, sum(n * n) / 20 AS square FROM drawn GROUP BY ALL),
    seen AS (SELECT x.cell_type AS a, y.cell_type AS b, count(*) AS n FROM edges JOIN f_cells x ON src = x.cell_id
      JOIN f_cells y ON dst = y.cell_id GROUP BY ALL)
    SELECT a, b, n, round((n - coalesce(mean, 0)) / nullif(sqrt(greatest(coalesce(square - mean * mean, 0), 0)), 0), 6) AS z
    FROM seen LEFT JOIN s USING (a, b)""",
)
def n3_enrichment(spark, sf):
    at = cells(spark, sf)
    return nb.radius_enrichment(at, 50).withColumn("z", F.round("z", 6))


@register(
    "n3_exact_enrichment",
    f"""WITH {_RADIUS}, e AS (SELECT edges.sample, src, dst, x.cell_type AS a, y.cell_type AS b FROM edges
      JOIN f_cells x ON src = x.cell_id JOIN f_cells y ON dst = y.cell_id),
    g AS (SELECT sample, id, sum(o) AS o, sum(i) AS i FROM (SELECT sample, src AS id, 1.0::DOUBLE AS o, 0.0::DOUBLE AS i FROM e
      UNION ALL SELECT sample, dst, 0.0, 1.0 FROM e) GROUP BY ALL),
    s AS (SELECT sample, sum(o) AS m, sum(o * (o - 1)) + sum(i * (i - 1)) AS st, sum(o * (o - 1)) AS s, sum(i * (i - 1)) AS t,
      sum(o * i) AS meet FROM g GROUP BY ALL),
    r AS (SELECT x.sample, count(*)::DOUBLE AS back FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src GROUP BY ALL),
    k AS (SELECT sample, cell_type, count(*)::DOUBLE AS n FROM f_cells GROUP BY ALL),
    n AS (SELECT sample, sum(n) AS n FROM k GROUP BY ALL),
    q AS (SELECT p.cell_type AS a, q.cell_type AS b, p.n AS x, q.n AS y, n.n AS n, m, s, t, coalesce(back, 0) AS back,
      meet - coalesce(back, 0) AS chain, m * m - m - coalesce(back, 0) - st - 2 * (meet - coalesce(back, 0)) AS apart
      FROM k p JOIN k q USING (sample) JOIN n USING (sample) JOIN s USING (sample) LEFT JOIN r USING (sample)),
    v AS (SELECT a, b, m * CASE WHEN a = b THEN x * (x - 1) ELSE x * y END / (n * (n - 1)) AS mean, CASE WHEN a = b THEN
      (m + back) * x * (x - 1) / (n * (n - 1)) + (s + t + 2 * chain) * x * (x - 1) * (x - 2) / (n * (n - 1) * (n - 2))
      + apart * x * (x - 1) * (x - 2) * (x - 3) / (n * (n - 1) * (n - 2) * (n - 3))
      ELSE m * x * y / (n * (n - 1)) + (s * x * y * (y - 1) + t * x * (x - 1) * y) / (n * (n - 1) * (n - 2))
      + apart * x * (x - 1) * y * (y - 1) / (n * (n - 1) * (n - 2) * (n - 3)) END AS square FROM q),
    w AS (SELECT a, b, sum(mean) AS expected, sum(square - mean * mean) AS spread FROM v GROUP BY ALL),
    seen AS (SELECT a, b, count(*) AS n FROM e GROUP BY ALL)
    SELECT a, b, coalesce(n, 0) AS n, round(expected, 6) AS expected, round((coalesce(n, 0) - expected) / CASE WHEN spread > 1e-9 * (1 + expected * expected) THEN sqrt(spread) END, 6) AS z
    FROM w LEFT JOIN seen USING (a, b)""",
)
def n3_exact(spark, sf):
    at = cells(spark, sf)
    out = nb.radius_exact_enrichment(at, 50)
    return out.withColumns({"expected": F.round("expected", 6), "z": F.round("z", 6)})


@register(
    "n4_cooccurrence",
    f"""WITH {_NEAR}, p AS (SELECT CASE WHEN dist <= 25 THEN 0 WHEN dist <= 50 THEN 1 ELSE 2 END AS bin, x.cell_type AS a,
      y.cell_type AS b FROM near JOIN f_cells x ON src = x.cell_id JOIN f_cells y ON dst = y.cell_id WHERE dist <= 80),
    n AS (SELECT bin, a, b, count(*) AS n FROM p GROUP BY ALL)
    SELECT bin, a, b, round(n / sum(n) OVER (PARTITION BY bin, b) / (sum(n) OVER (PARTITION BY bin, a)
      / sum(n) OVER (PARTITION BY bin)), 6) AS score FROM n""",
)
def n4(spark, sf):
    return nb.cooccurrence(cells(spark, sf), [25.0, 50.0, 80.0]).withColumn("score", F.round("score", 6))


_DENSE = f"""{_RADIUS}, w AS (SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS w FROM edges),
d AS (SELECT cell_id, feature_name, coalesce(n, 0) AS x FROM f_cells CROSS JOIN (SELECT DISTINCT feature_name FROM f_counts)
  LEFT JOIN f_counts USING (sample, cell_id, feature_name)),
m AS (SELECT feature_name, avg(x) AS m, sum((x - (SELECT avg(x) FROM d d2 WHERE d2.feature_name = d.feature_name)) ** 2) AS z2,
  count(*) AS n FROM d GROUP BY ALL), w0 AS (SELECT sum(w) AS w0 FROM w),
p AS (SELECT a.feature_name, sum(w * (a.x - m) * (b.x - m)) AS num, sum(w * (a.x - b.x) ** 2) AS gap FROM w
  JOIN d a ON src = a.cell_id JOIN d b ON dst = b.cell_id AND a.feature_name = b.feature_name
  JOIN m ON m.feature_name = a.feature_name GROUP BY ALL)"""


@register(
    "n5_n6_autocorrelation",
    f"WITH {_DENSE} SELECT feature_name, round(n / w0 * num / z2, 6) AS moran, round((n - 1) * gap / (2 * w0 * z2), 6) AS geary "
    "FROM p JOIN m USING (feature_name), w0",
)
def n5(spark, sf):
    at = cells(spark, sf)
    out = nb.radius_autocorrelation(at, 50, counts(spark, sf), at.count())
    return out.select("feature_name", r6(c("moran"), "moran"), r6(c("geary"), "geary"))


@register(
    "n5_moran_test",
    f"""WITH {_DENSE}, out_w AS (SELECT src AS k, sum(w) AS r FROM w GROUP BY ALL), in_w AS (SELECT dst AS k, sum(w) AS q FROM w GROUP BY ALL),
    w2 AS (SELECT sum((coalesce(r, 0) + coalesce(q, 0)) ** 2) AS w2 FROM out_w FULL JOIN in_w USING (k)),
    w1 AS (SELECT sum(a.w * a.w + a.w * coalesce(b.w, 0)) AS w1 FROM w a LEFT JOIN w b ON a.src = b.dst AND a.dst = b.src),
    i AS (SELECT feature_name, n / w0 * num / z2 AS moran, -1 / (n - 1) AS e, n::DOUBLE AS n, w0, w1, w2
      FROM p JOIN m USING (feature_name), w0, w1, w2),
    y AS (SELECT feature_name, moran, (moran - e) / sqrt((n * n * w1 - n * w2 + 3 * w0 * w0) / ((n * n - 1) * w0 * w0) - e * e) AS z FROM i),
    u AS (SELECT *, abs(z) / sqrt(2) AS u, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM y),
    h AS (SELECT *, 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-u * u)
      AS half FROM u),
    v AS (SELECT feature_name, moran, z, CASE WHEN z >= 0 THEN half ELSE 1 - half END AS pval FROM h),
    f AS (SELECT *, pval * count(*) OVER () / row_number() OVER (ORDER BY pval) AS raw FROM v)
    SELECT feature_name, round(moran, 6) AS moran, round(z, 6) AS z, round(pval, 6) AS pval,
      round(least(min(raw) OVER (ORDER BY pval DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS fdr,
      (rank() OVER (ORDER BY moran) + (count(*) OVER (PARTITION BY moran) - 1) / 2)::DOUBLE AS place FROM f""",
)
def n5_test(spark, sf):
    at = cells(spark, sf)
    out = nb.rank_by_moran(nb.radius_autocorrelation(at, 50, counts(spark, sf), at.count()))
    return out.select("feature_name", *[r6(c(x), x) for x in ("moran", "z", "pval", "fdr")], "place")


@register(
    "n7_binary_enrichment",
    f"""WITH {_RADIUS}, h AS (SELECT sample, cell_id, feature_name FROM f_counts QUALIFY row_number() OVER (PARTITION BY feature_name
      ORDER BY n DESC, sample, cell_id) <= (SELECT floor(count(*) * 0.3) FROM f_cells)),
    g AS (SELECT DISTINCT feature_name FROM h), f AS (SELECT g.feature_name, count(*) AS n,
      sum(CASE WHEN a.cell_id IS NOT NULL AND b.cell_id IS NOT NULL THEN 1 ELSE 0 END) AS n11,
      sum(CASE WHEN a.cell_id IS NOT NULL AND b.cell_id IS NULL THEN 1 ELSE 0 END) AS n10,
      sum(CASE WHEN a.cell_id IS NULL AND b.cell_id IS NOT NULL THEN 1 ELSE 0 END) AS n01
      FROM edges CROSS JOIN g LEFT JOIN h a ON a.cell_id = src AND a.feature_name = g.feature_name
      LEFT JOIN h b ON b.cell_id = dst AND b.feature_name = g.feature_name GROUP BY ALL)
    SELECT feature_name, round((n11 + 0.5) * (n - n11 - n10 - n01 + 0.5) / ((n10 + 0.5) * (n01 + 0.5)), 6) AS odds FROM f
    WHERE n11 + n10 > 0 AND n11 + n01 > 0""",
)
def n7(spark, sf):
    at = cells(spark, sf)
    out = nb.radius_binary_enrichment(at, 50, counts(spark, sf))
    return out.withColumn("odds", F.round("odds", 6))


@register(
    "n8_shift_samples",
    """WITH g AS (SELECT max(x_centroid) + floor(max(x_centroid) / 10) AS gap FROM f_cells)
    SELECT cell_id, x_centroid + gap * (dense_rank() OVER (ORDER BY sample) - 1) AS x_centroid, y_centroid + 1 AS y_centroid
    FROM f_cells, g""",
)
def n8(spark, sf):
    return sp.shift_samples(cells(spark, sf)).select("cell_id", "x_centroid", "y_centroid")


_SIG = """z AS (SELECT cell_type, count(*) AS size FROM f_cells GROUP BY ALL), s AS (SELECT cell_type, feature_name,
sum(n) / any_value(size) AS mean FROM f_counts JOIN f_cells USING (sample, cell_id) JOIN z USING (cell_type) GROUP BY ALL)"""


def _pairs(spark):
    return spark.createDataFrame([("Brand#11", "Brand#22"), ("Brand#33", "Brand#41")], "ligand string, receptor string")


@register(
    "n10_ligand_receptor",
    f"""WITH {_SIG}, p AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#22'), ('Brand#33', 'Brand#41')) v(ligand, receptor))
    SELECT ligand, receptor, a.cell_type AS a, b.cell_type AS b, round(CASE WHEN a.mean > 0 AND b.mean > 0 THEN (a.mean + b.mean) / 2
      ELSE 0 END, 6) AS score FROM p JOIN s a ON a.feature_name = ligand JOIN s b ON b.feature_name = receptor""",
)
def n10(spark, sf):
    out = nb.ligand_receptor(qc.signatures(counts(spark, sf), cells(spark, sf)), _pairs(spark))
    return out.withColumn("score", F.round("score", 6))


@register(
    "n10_ligand_receptor_test",
    f"""WITH {_SIG}, p AS (SELECT * FROM (VALUES ('Brand#11', 'Brand#22'), ('Brand#33', 'Brand#41')) v(ligand, receptor)),
    perms AS (SELECT unnest(range(1, 21)) AS perm),
    ranked AS (SELECT sample, cell_id, cell_type, perm, row_number() OVER (PARTITION BY sample, perm ORDER BY cell_id) AS i,
      row_number() OVER (PARTITION BY sample, perm ORDER BY md5(concat_ws('|', cell_id, perm, '0')), cell_id) AS j FROM f_cells, perms),
    dealt AS (SELECT x.sample, x.perm, x.cell_id, y.cell_type FROM ranked x JOIN ranked y
      ON x.sample = y.sample AND x.perm = y.perm AND x.i = y.j),
    sizes AS (SELECT cell_type, count(*) AS size FROM f_cells GROUP BY ALL),
    means AS (SELECT d.perm, d.cell_type, f.feature_name, sum(f.n) / any_value(size) AS mean FROM f_counts f
      JOIN dealt d ON f.sample = d.sample AND f.cell_id = d.cell_id JOIN sizes ON sizes.cell_type = d.cell_type GROUP BY ALL),
    seen AS (SELECT ligand, receptor, a.cell_type AS a, b.cell_type AS b, CASE WHEN a.mean > 0 AND b.mean > 0
      THEN (a.mean + b.mean) / 2 ELSE 0 END AS score FROM p JOIN s a ON a.feature_name = ligand JOIN s b ON b.feature_name = receptor),
    drawn AS (SELECT ligand, receptor, a.cell_type AS a, b.cell_type AS b, (a.mean + b.mean) / 2 AS drawn
      FROM p JOIN means a ON a.feature_name = ligand JOIN means b ON b.feature_name = receptor AND a.perm = b.perm)
    SELECT ligand, receptor, a, b, round(any_value(score), 6) AS score, round(coalesce(sum((drawn >= score)::INT), 0) / 20, 6) AS pval
    FROM seen LEFT JOIN drawn USING (ligand, receptor, a, b) GROUP BY ligand, receptor, a, b""",
)
def n10_test(spark, sf):
    out = nb.ligand_receptor_test(counts(spark, sf), cells(spark, sf), _pairs(spark))
    return out.withColumns({"score": F.round("score", 6), "pval": F.round("pval", 6)})


@register(
    "n14_region_levels",
    "SELECT sample, count(DISTINCT cell_type) AS types, count(DISTINCT cell_id % 5) AS level2 FROM f_cells GROUP BY ALL",
)
def n14(spark, sf):
    return cells(spark, sf).groupBy("sample").agg(
        F.countDistinct("cell_type").alias("types"), F.countDistinct(c("cell_id") % 5).alias("level2")
    )


_SPREAD = [f"((CAST(cell_id AS BIGINT) * cell_id * {a}) % {b}) / 40.0" for a, b in ((7, 1009), (11, 1013))]


@register(
    "n9_triangulation",
    f"""WITH p AS (SELECT sample, cell_id AS id, x_centroid + {_SPREAD[0]} AS x, y_centroid + {_SPREAD[1]} AS y FROM f_cells),
    v AS (SELECT a.sample, a.id AS src, b.id AS dst, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS dist, b.x - a.x AS ax, b.y - a.y AS ay,
      k.x - a.x AS kx, k.y - a.y AS ky FROM p a JOIN p b ON a.sample = b.sample AND a.id < b.id
      JOIN p k ON k.sample = a.sample AND k.id <> a.id AND k.id <> b.id),
    s AS (SELECT sample, src, dst, dist, ax * ky - ay * kx AS side, (kx * kx + ky * ky - ax * kx - ay * ky) / (2 * (ax * ky - ay * kx)) AS s
      FROM v),
    e AS (SELECT sample, src, dst, any_value(dist) AS dist FROM s GROUP BY sample, src, dst
      HAVING coalesce(max(CASE WHEN side < 0 THEN s END), -1e300) < coalesce(min(CASE WHEN side > 0 THEN s END), 1e300))
    SELECT sample, src, dst, round(dist, 6) AS dist FROM e UNION ALL SELECT sample, dst, src, round(dist, 6) FROM e""",
)
def n9(spark, sf):
    """Triangulation neighbours of the cells, which are moved a little off their lattice, where it is not unique."""
    at = cells(spark, sf).withColumns({k: c(k) + F.expr(v) for k, v in zip(("x_centroid", "y_centroid"), _SPREAD)})
    return tg.triangulation(sp.as_points(at)).withColumn("dist", F.round("dist", 6))


@register("c2_label_propagation")
def c2(spark, sf):
    at = cells(spark, sf)
    edges = sp.nearest_neighbours(sp.as_points(at), 10).select("src", "dst", F.lit(1.0).alias("weight"))
    return cluster.propagate_labels(edges, at.select(c("cell_id").alias("id")), target=50)


@register(
    "c2_modularity",
    f"""WITH {_KNN}, e AS (SELECT sample, src, dst FROM knn UNION ALL SELECT sample, dst, src FROM knn),
    m AS (SELECT e.sample, a.cell_type AS a, b.cell_type AS b FROM e JOIN f_cells a ON a.cell_id = src JOIN f_cells b
      ON b.cell_id = dst), d AS (SELECT sample, a, count(*) AS d, sum((a = b)::INT) AS i FROM m GROUP BY ALL)
    SELECT sample, round(sum(i) / sum(d) - 1.4 * sum(d * d) / (sum(d) * sum(d)), 9) AS modularity FROM d GROUP BY sample""",
)
def c2_modularity(spark, sf):
    """Modularity of the cells' classes on each sample's neighbour graph at the resolution of the communities."""
    at = cells(spark, sf)
    edges = sp.nearest_neighbours(sp.as_points(at), 10).select("src", "dst", F.lit(1.0).alias("weight"))
    labels = at.select(c("cell_id").alias("id"), "sample", c("cell_type").alias("label"))
    return cluster.modularity(edges, labels, by=["sample"], resolution=1.4).withColumn("modularity", F.round("modularity", 9))


def _tiled(at):
    return at.withColumn("tile", sp.z_order(c("x_centroid"), c("y_centroid"), 4.0))


@register("c2_communities")
def c2_communities(spark, sf):
    """(cell_id, sample, label): communities of each sample's neighbour graph by modularity."""
    at = cells(spark, sf)
    edges = sp.nearest_neighbours(sp.as_points(at), 10).select("src", "dst", F.lit(1.0).alias("weight"))
    return cm.modularity_communities(edges, _tiled(at), "cell_id", "sample", 1.4, near=["tile"])


@register("c3_communities_near")
def c3_communities_near(spark, sf):
    """(cell_id, sample, label, communities, resolution): the resolution of each sample that gives nearest 20 communities."""
    at = cells(spark, sf)
    edges = sp.nearest_neighbours(sp.as_points(at), 10).select("src", "dst", F.lit(1.0).alias("weight"))
    targets = at.select("sample").distinct().withColumn("target", F.lit(20))
    found = cm.communities_near(materialise(edges, "edges"), _tiled(at), targets, "cell_id", "sample", near=["tile"])
    return found.withColumn("resolution", F.round("resolution", 9))


@register(
    "c4_smooth_labels",
    f"""WITH {_KNN}, v AS (SELECT src, cell_type AS t, count(*) AS n FROM knn JOIN f_cells ON dst = cell_id GROUP BY ALL),
    b AS (SELECT src, arg_min(t, (-n, t)) AS t, max(n) AS n, sum(n) AS k FROM v GROUP BY ALL)
    SELECT cell_id, CASE WHEN 2 * n > k AND t <> cell_type THEN t ELSE cell_type END AS cell_type FROM f_cells LEFT JOIN b
      ON cell_id = src""",
)
def c4(spark, sf):
    at = cells(spark, sf)
    edges = sp.nearest_neighbours(sp.as_points(at), 10)
    return cluster.smooth_labels(at, edges, "cell_id", "cell_type")


# ---- segmentation-free regions ----

_BIN = """o AS (SELECT sample, min(x_location) AS x0, min(y_location) AS y0 FROM f_reads GROUP BY ALL),
b AS (SELECT f_reads.*, floor((x_location - x0) / 10)::BIGINT AS bx, floor((y_location - y0) / 10)::BIGINT AS by_ FROM f_reads
  JOIN o USING (sample)), bc AS (SELECT sample, bx, by_, feature_name, count(*) AS n FROM b GROUP BY ALL)"""


@register("g1_g3_bin_counts", f'WITH {_BIN} SELECT sample, bx, by_ AS "by", feature_name, n FROM bc')
def g1(spark, sf):
    return rg.bin_counts(rg.bin_reads(reads(spark, sf), 10))


@register(
    "g2_square_bins",
    "SELECT (floor(floor(y_centroid) / 50) * ceil(1000 / 50) + floor(floor(x_centroid) / 50) + 1)::BIGINT AS bin, count(*) AS n "
    "FROM f_cells GROUP BY ALL",
)
def g2(spark, sf):
    at = cells(spark, sf).withColumns({"px": F.floor("x_centroid"), "py": F.floor("y_centroid")})
    return at.groupBy(rg.linear_bin(1000, 1000, 50).cast("long").alias("bin")).agg(F.count("*").alias("n"))


_KDE = f"""{_BIN}, kd AS (SELECT a.sample, a.bx, a.by_, f.feature_name, sum(f.n * exp(-((a.bx - f.bx) ** 2 + (a.by_ - f.by_) ** 2)
  * 100 / (2 * 225))) AS density FROM (SELECT DISTINCT sample, bx, by_ FROM bc) a JOIN bc f ON a.sample = f.sample AND
  ((a.bx - f.bx) ** 2 + (a.by_ - f.by_) ** 2) * 100 <= 900 AND f.bx BETWEEN a.bx - 3 AND a.bx + 3 GROUP BY ALL)"""


@register("g4_kernel_density", f'WITH {_KDE} SELECT sample, bx, by_ AS "by", feature_name, round(density, 6) AS density FROM kd')
def g4(spark, sf):
    n = rg.bin_counts(rg.bin_reads(reads(spark, sf), 10))
    return rg.kernel_density(n, 10.0, 15.0).withColumn("density", F.round("density", 6))


@register(
    "g5_bin_features",
    f"""WITH {_KDE}, t AS (SELECT sample, bx, by_, sum(density) AS total FROM kd GROUP BY ALL)
    SELECT sample, bx, by_ AS "by", feature_name, round(density / total, 6) AS share, total >= 4.2 AS good FROM kd
    JOIN t USING (sample, bx, by_)""",
)
def g5(spark, sf):
    n = rg.bin_counts(rg.bin_reads(reads(spark, sf), 10))
    out = rg.bin_features(rg.kernel_density(n, 10.0, 15.0), 4.2)
    return out.select("sample", "bx", "by", "feature_name", r6(c("share"), "share"), "good")


@register("g6_read_regions")
def g6(spark, sf):
    out = rg.read_regions(reads(spark, sf), 15.0, 8, 3.0, 10.0)
    return out.groupBy("sample", "region").agg(F.count("*").alias("n"))


@register(
    "g7_pixel_values",
    """WITH p AS (SELECT DISTINCT (x_centroid * 0.5)::INT AS ix, (y_centroid * 0.5)::INT AS iy FROM f_cells WHERE x_centroid % 2 = 0
      AND y_centroid % 2 = 0)
    SELECT count(*) AS n, sum(CASE WHEN p.ix IS NULL THEN 0 ELSE 1 END)::BIGINT AS lit FROM f_reads LEFT JOIN p
      ON trunc(x_location * 0.5)::INT = ix AND trunc(y_location * 0.5)::INT = iy""",
)
def g7(spark, sf):
    even = cells(spark, sf).filter("x_centroid % 2 = 0 and y_centroid % 2 = 0")
    px = even.select(
        (c("x_centroid") * 0.5).cast("int").alias("ix"), (c("y_centroid") * 0.5).cast("int").alias("iy"), F.lit(1).alias("value")
    ).distinct()
    out = rg.pixel_values(reads(spark, sf), px, 0.5)
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("lit"))


_COH = f"""{_BIN}, z AS (SELECT sample, bx, by_, avg(z_location) AS zm, count(*) AS reads FROM b GROUP BY ALL HAVING count(*) >= 5),
g AS (SELECT b.sample, b.bx, b.by_, feature_name, any_value(reads) AS reads, count(*) FILTER (WHERE z_location > zm) AS t,
  count(*) FILTER (WHERE z_location <= zm) AS l FROM b JOIN z ON b.sample = z.sample AND b.bx = z.bx AND b.by_ = z.by_
  GROUP BY b.sample, b.bx, b.by_, feature_name),
co AS (SELECT sample, bx, by_, any_value(reads) AS reads, coalesce(sum(t * l) / nullif(sqrt(sum(t * t)) * sqrt(sum(l * l)), 0), 0)
  AS coherence FROM g GROUP BY ALL)"""


@register(
    "g9_vertical_coherence",
    f'WITH {_COH} SELECT sample, bx, by_ AS "by", reads, round(coherence, 6) AS coherence FROM co',
)
def g9(spark, sf):
    out = rg.vertical_coherence(reads(spark, sf), 10, 5)
    return out.withColumn("coherence", F.round("coherence", 6))


@register(
    "g10_region_coherence",
    f"""WITH {_COH} SELECT bx % 4 AS region, round(avg(coherence), 6) AS mean, round(max(coherence), 6) AS max,
    round(median(coherence), 6) AS median, round(avg(CASE WHEN coherence < 0.2 THEN 1 ELSE 0 END), 6) AS low_share FROM co
    GROUP BY ALL""",
)
def g10(spark, sf):
    co = rg.vertical_coherence(reads(spark, sf), 10, 5)
    at = co.select("sample", "bx", "by", (c("bx") % 4).alias("region"))
    out = rg.coherence_summary(co, at)
    return out.select("region", *[r6(c(x), x) for x in ("mean", "max", "median", "low_share")])


@register(
    "g11_signature_weights",
    f"""WITH {_BIN}, {_SIG}, k AS (SELECT count(DISTINCT feature_name) AS k FROM s),
    x AS (SELECT sample, bx, by_, sum(n) AS sx, sum(n * n) AS sxx FROM bc GROUP BY ALL),
    y AS (SELECT cell_type, sum(mean) AS sy, sum(mean * mean) AS syy FROM s GROUP BY ALL),
    q AS (SELECT sample, bx, by_, cell_type, sum(n * mean) AS sxy FROM bc JOIN s USING (feature_name) GROUP BY ALL),
    r AS (SELECT sample, bx, by_, cell_type, greatest((k * sxy - sx * sy) / sqrt((k * sxx - sx * sx) * (k * syy - sy * sy)), 0) ** 15
      AS w FROM q JOIN x USING (sample, bx, by_) JOIN y USING (cell_type), k)
    SELECT cell_type, round(sum(w / t), 3) AS weight FROM (SELECT *, nullif(sum(w) OVER (PARTITION BY sample, bx, by_), 0) AS t
      FROM r) GROUP BY ALL""",
)
def g11(spark, sf):
    n = rg.bin_counts(rg.bin_reads(reads(spark, sf), 10))
    out = rg.signature_weights(n, qc.signatures(counts(spark, sf), cells(spark, sf)))
    return out.groupBy("cell_type").agg(F.round(F.sum("weight"), 3).alias("weight"))
