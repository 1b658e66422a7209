"""Queries of matrix transforms, markers, hulls and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.catalog import register
from cellweave.operators import cluster, hull
from cellweave.operators import markers as mk
from cellweave.operators import reads as rd
from cellweave.operators import transform as tf
from cellweave.plans.fixtures import cells, counts, reads
from cellweave.plans.read_queries import r6
from cellweave.session import table

c = F.col

_NORM = """t AS (SELECT sample, cell_id, sum(n) AS total FROM f_counts GROUP BY ALL),
x AS (SELECT f_counts.*, n * 100.0::DOUBLE / total AS norm, ln(1 + n * 100.0::DOUBLE / total) AS lognorm
      FROM f_counts JOIN t USING (sample, cell_id)), nc AS (SELECT count(*) AS n_cells FROM f_cells)"""


@register(
    "x1_normalise",
    f"WITH {_NORM} SELECT sample, cell_id, feature_name, round(n * (SELECT median(total) FROM t) / total, 6) AS norm "
    "FROM f_counts JOIN t USING (sample, cell_id)",
)
def x1(spark, sf):
    return tf.normalise(counts(spark, sf), None).select("sample", "cell_id", "feature_name", r6(c("norm"), "norm"))


@register("x2_lognorm", f"WITH {_NORM} SELECT sample, cell_id, feature_name, round(lognorm, 6) AS lognorm FROM x")
def x2(spark, sf):
    out = tf.log_normalise(counts(spark, sf))
    return out.select("sample", "cell_id", "feature_name", r6(c("lognorm"), "lognorm"))


@register(
    "x3_area_normalise",
    """WITH a AS (SELECT sample, cell_id, nullif((max(x_location) - min(x_location)) * (max(y_location) - min(y_location)), 0)
      AS area FROM f_reads WHERE cell_id IS NOT NULL GROUP BY ALL), m AS (SELECT avg(area) AS mean_area FROM a)
    SELECT feature_name, round(sum(n / coalesce(area, mean_area)), 6) AS norm FROM f_counts JOIN a USING (sample, cell_id), m
    GROUP BY ALL""",
)
def x3(spark, sf):
    r = reads(spark, sf).filter("cell_id is not null")
    box = (F.max("x_location") - F.min("x_location")) * (F.max("y_location") - F.min("y_location"))
    a = r.groupBy("sample", "cell_id").agg(F.nullif(box, F.lit(0.0)).alias("area"))
    out = tf.area_normalise(counts(spark, sf), a)
    return out.groupBy("feature_name").agg(r6(F.sum("norm"), "norm"))


@register(
    "x4_scale",
    """WITH nc AS (SELECT count(*) AS k FROM f_cells), m AS (SELECT feature_name, sum(n) / any_value(k) AS mean,
      sqrt((sum(n * n) - sum(n) * sum(n) / any_value(k)) / (any_value(k) - 1)) AS sd FROM f_counts, nc GROUP BY ALL)
    SELECT sample, cell_id, feature_name, round(least((n - mean) / sd, 10), 6) AS z, round(-mean / sd, 6) AS z0
    FROM f_counts JOIN m USING (feature_name)""",
)
def x4(spark, sf):
    n = cells(spark, sf).count()
    out = tf.scale(counts(spark, sf), n, max_value=10.0)
    return out.select("sample", "cell_id", "feature_name", r6(c("z"), "z"), r6(c("z0"), "z0"))


@register(
    "x5_pearson_residuals",
    """WITH r AS (SELECT sample, cell_id, sum(n) AS a FROM f_counts GROUP BY ALL),
    g AS (SELECT feature_name, sum(n) AS b FROM f_counts GROUP BY ALL), t AS (SELECT sum(n) AS t FROM f_counts),
    nc AS (SELECT count(*) AS k FROM f_cells),
    q AS (SELECT feature_name, coalesce(n, 0) AS n, a * b / t AS mu, sqrt(k) AS lim FROM r CROSS JOIN g CROSS JOIN t CROSS JOIN nc
      LEFT JOIN f_counts USING (sample, cell_id, feature_name))
    SELECT feature_name, round(var_samp(greatest(-lim, least(lim, (n - mu) / sqrt(mu + mu * mu / 100)))), 6) AS variance
    FROM q GROUP BY ALL""",
)
def x5(spark, sf):
    out = tf.pearson_residuals(counts(spark, sf), cells(spark, sf))
    return out.groupBy("feature_name").agg(r6(F.var_samp("residual"), "variance"))


@register(
    "x6_variable_genes",
    f"""WITH {_NORM}, m AS (SELECT feature_name, sum(norm) / any_value(n_cells) AS mean,
      (sum(norm * norm) - sum(norm) * sum(norm) / any_value(n_cells)) / (any_value(n_cells) - 1) AS v FROM x, nc GROUP BY ALL),
    g AS (SELECT feature_name, ln(1 + mean) AS mean, ln(v / mean) AS d FROM m),
    l AS (SELECT min(mean) AS low, max(mean) AS high FROM g),
    b AS (SELECT g.*, least(floor((mean - low) / ((high - low) / 20)), 19) AS bin FROM g, l),
    z AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY bin) > 1 THEN (d - avg(d) OVER (PARTITION BY bin))
      / stddev_samp(d) OVER (PARTITION BY bin) ELSE 1 END AS z FROM b)
    SELECT feature_name, round(mean, 6) AS mean, round(z, 6) AS dispersion_norm FROM z""",
)
def x6(spark, sf):
    out = tf.variable_genes(tf.log_normalise(counts(spark, sf)), cells(spark, sf).count())
    return out.select("feature_name", r6(c("mean"), "mean"), r6(c("dispersion_norm"), "dispersion_norm"))


@register(
    "x7_s13_wide_rows",
    "WITH g AS (SELECT feature_name, dense_rank() OVER (ORDER BY feature_name) - 1 AS idx FROM (SELECT DISTINCT feature_name "
    "FROM f_counts)) SELECT sample, cell_id, string_agg(idx || ':' || n, ' ' ORDER BY idx) AS entries FROM f_counts JOIN g "
    "USING (feature_name) GROUP BY ALL",
)
def x7(spark, sf):
    n = counts(spark, sf)
    genes = n.select("feature_name").distinct()
    genes = genes.withColumn("idx", F.dense_rank().over(Window.orderBy("feature_name")) - 1)  # a panel
    out = tf.sparse_rows(n, genes)
    pairs = F.zip_with("idx", "val", lambda i, v: F.concat(i.cast("string"), F.lit(":"), v.cast("string")))
    return out.select("sample", "cell_id", F.array_join(pairs, " ").alias("entries"))


@register("x8_pca")
def x8(spark, sf):
    out, _ = tf.principal_components(table(spark, sf, "embeddings"), "embedding", 10)
    return out.select("vec_id", F.transform("pca", lambda x: F.round(x, 6)).alias("pca"))


_SUMS = """z AS (SELECT cell_type, count(*) AS n1 FROM f_cells GROUP BY ALL), na AS (SELECT count(*) AS k FROM f_cells),
g AS (SELECT cell_type, feature_name, sum(n) AS s1, sum(n * n) AS q1 FROM f_counts JOIN f_cells USING (sample, cell_id) GROUP BY ALL),
a AS (SELECT feature_name, sum(s1) AS s, sum(q1) AS q FROM g GROUP BY ALL),
f AS (SELECT cell_type, feature_name, n1, coalesce(s1, 0) AS s1, coalesce(q1, 0) AS q1, k - n1 AS n2, s - coalesce(s1, 0) AS s2,
      q - coalesce(q1, 0) AS q2 FROM a CROSS JOIN z CROSS JOIN na LEFT JOIN g USING (cell_type, feature_name))"""


@register(
    "x9_rank_genes_t",
    f"""WITH {_SUMS}, m AS (SELECT *, s1 / n1 AS m1, s2 / n2 AS m2, (q1 - s1 * s1 / n1) / (n1 - 1) / n1 AS v1,
      (q2 - s2 * s2 / n2) / (n2 - 1) / n2 AS v2 FROM f)
    SELECT cell_type, feature_name, round((m1 - m2) / sqrt(v1 + v2), 6) AS t,
      round((v1 + v2) ** 2 / (v1 ** 2 / (n1 - 1) + v2 ** 2 / (n2 - 1)), 4) AS df FROM m""",
)
def x9(spark, sf):
    out = mk.rank_genes_t(counts(spark, sf), cells(spark, sf))
    return out.select("cell_type", "feature_name", r6(c("t"), "t"), F.round("df", 4).alias("df"))


@register(
    "x10_rank_genes_wilcoxon",
    """WITH d AS (SELECT cell_type, feature_name, coalesce(n, 0) AS n FROM f_cells CROSS JOIN (SELECT DISTINCT feature_name FROM
      f_counts) LEFT JOIN f_counts USING (sample, cell_id, feature_name)),
    r AS (SELECT *, rank() OVER (PARTITION BY feature_name ORDER BY n) + (count(*) OVER (PARTITION BY feature_name, n) - 1) / 2
      AS place, count(*) OVER (PARTITION BY feature_name) AS k FROM d)
    SELECT cell_type, feature_name, round((sum(place) - count(*) * (any_value(k) + 1) / 2)
      / sqrt(count(*) * (any_value(k) - count(*)) * (any_value(k) + 1) / 12), 6) AS z FROM r GROUP BY ALL""",
)
def x10(spark, sf):
    return mk.rank_genes_wilcoxon(counts(spark, sf), cells(spark, sf)).withColumn("z", F.round("z", 6))


_SETS = {"first": ["Brand#11", "Brand#12", "none"], "second": ["Brand#41", "Brand#53"]}


@register(
    "x11_set_scores",
    f"""WITH {_NORM}, m AS (SELECT feature_name, sum(lognorm) AS total FROM x GROUP BY ALL),
    b AS (SELECT *, ntile(5) OVER (ORDER BY total, feature_name) AS bin FROM m),
    sets(s, feature_name) AS (VALUES {", ".join(f"('{k}', '{g}')" for k, v in _SETS.items() for g in v)}),
    p AS (SELECT s, b.feature_name, bin FROM sets JOIN b USING (feature_name)),
    w AS (SELECT s, bin, count(*) AS k FROM p GROUP BY ALL),
    o AS (SELECT w.s, k, b.feature_name, row_number() OVER (PARTITION BY w.s, w.bin
        ORDER BY md5(concat_ws('|', b.feature_name, '0')), b.feature_name) AS place
      FROM w JOIN b ON w.bin = b.bin LEFT JOIN p ON p.s = w.s AND p.feature_name = b.feature_name WHERE p.s IS NULL),
    roles AS (SELECT s, feature_name, 1 AS role FROM p UNION ALL SELECT s, feature_name, 0 FROM o WHERE place <= 5 * k),
    size AS (SELECT s, sum(role) AS n_in, sum(1 - role) AS n_out FROM roles GROUP BY ALL),
    sums AS (SELECT sample, cell_id, s, sum(lognorm * role) AS a, sum(lognorm * (1 - role)) AS b FROM x JOIN roles USING (feature_name)
      GROUP BY ALL),
    scored AS (SELECT f_cells.sample, f_cells.cell_id, size.s,
      round(coalesce(coalesce(a, 0) / nullif(n_in, 0), 0) - coalesce(coalesce(b, 0) / nullif(n_out, 0), 0), 6) AS score
      FROM f_cells CROSS JOIN size LEFT JOIN sums ON f_cells.sample = sums.sample AND f_cells.cell_id = sums.cell_id AND size.s = sums.s)
    SELECT sample, cell_id, s AS "set", score FROM scored
    QUALIFY row_number() OVER (PARTITION BY sample, cell_id ORDER BY score DESC, s) = 1""",
)
def x11(spark, sf):
    at = cells(spark, sf)
    scores = mk.set_scores(tf.log_normalise(counts(spark, sf)), at, _SETS).withColumn("score", F.round("score", 6))
    return mk.label_hints(scores)


@register(
    "x12_positive_reads",
    "SELECT method, sample, cell_id, count(*) AS reads, count(DISTINCT feature_name) AS genes FROM f_reads WHERE cell_id IS NOT "
    "NULL GROUP BY ALL",
)
def x12(spark, sf):
    r = reads(spark, sf).filter("cell_id is not null")
    n = r.groupBy("method", "sample", "cell_id", "feature_name").agg(F.count("*").alias("n"))
    return mk.positive_reads(n)


_SIG = """z AS (SELECT cell_type, count(*) AS size FROM f_cells GROUP BY ALL), s AS (SELECT cell_type, feature_name,
sum(n) / any_value(size) AS mean FROM f_counts JOIN f_cells USING (sample, cell_id) JOIN z USING (cell_type) GROUP BY ALL)"""


@register(
    "x13_marker_cluster",
    f"WITH {_SIG}, b AS (SELECT arg_min(cell_type, (-mean, cell_type)) AS cell_type FROM s WHERE feature_name = 'Brand#11') "
    "SELECT cell_type, feature_name, round(mean, 6) AS mean FROM s SEMI JOIN b USING (cell_type) WHERE feature_name IN "
    "('Brand#11', 'Brand#22', 'Brand#33')",
)
def x13(spark, sf):
    out = mk.marker_cluster(counts(spark, sf), cells(spark, sf), ["Brand#11", "Brand#22", "Brand#33"])
    return out.withColumn("mean", F.round("mean", 6)).select("cell_type", "feature_name", "mean")


@register(
    "x14_name_clusters",
    """WITH n AS (SELECT qv % 8 AS k, feature_name AS l, count(*) AS n, sum(overlaps_nucleus) AS u FROM f_reads GROUP BY ALL)
    SELECT k, k || '_' || arg_min(l, (-n, l)) || '_' || CASE WHEN sum(u) / sum(n) > 0.5 THEN 'nuclei' ELSE 'cyto' END AS name
    FROM n GROUP BY k""",
)
def x14(spark, sf):
    return mk.name_clusters(reads(spark, sf).withColumn("k", c("qv") % 8), "k", "feature_name")


@register("a8_sample_hull")
def a8(spark, sf):
    r, at = reads(spark, sf), cells(spark, sf)
    h = hull.group_hulls(r, "sample", "x_location", "y_location")
    n = at.groupBy("sample").agg(F.count("*").alias("n_cells"))
    out = h.join(n, "sample")
    return out.select(
        "sample",
        "n_vertices",
        r6(c("area"), "area"),
        r6(c("perimeter"), "perimeter"),
        F.round(c("n_cells") / c("area"), 9).alias("density"),
        F.round(c("n_cells") / c("perimeter"), 9).alias("density_ref"),
    )


@register("a15_edge_distance")
def a15(spark, sf):
    out = hull.edge_distance(rd.centroid_distance(reads(spark, sf), cells(spark, sf)))
    return out.select(r6(c("edge_distance"), "edge_distance"))


@register("a16_cell_area")
def a16(spark, sf):
    return hull.cell_areas(reads(spark, sf)).withColumn("area", F.round("area", 6))


@register("c1_kmeans")
def c1(spark, sf):
    return cluster.kmeans(table(spark, sf, "embeddings"), "embedding", 10).select("vec_id", "cluster")


@register("c3_kmeans_search")
def c3(spark, sf):
    return cluster.kmeans_by_silhouette(table(spark, sf, "embeddings"), "embedding", [8, 10, 12]).select("vec_id", "cluster")
