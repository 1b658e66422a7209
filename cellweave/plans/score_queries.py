"""Queries of agreement, purity, efficiency, imputation, transfer and distance profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.catalog import register
from cellweave.functions.ranking import average_rank, false_discovery
from cellweave.operators import cluster
from cellweave.operators import metrics as mt
from cellweave.operators import profiles as pf
from cellweave.operators import qc
from cellweave.operators import reads as rd
from cellweave.operators import spatial as sp
from cellweave.operators import transfer as tr
from cellweave.plans.fixtures import cells, counts, polygons, reads
from cellweave.plans.read_queries import _DISTANCE_SQL, r6
from cellweave.plans.space_queries import _PIP
from cellweave.session import table

c = F.col


def _r(df, *names):
    return df.select(*[r6(c(n), n) if n in names else n for n in df.columns])


def agreement_sql(source: str, a: str, b: str) -> str:
    return f"""n AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
  ra AS (SELECT a, sum(n) AS n FROM n GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM n GROUP BY b),
  s AS (SELECT (SELECT sum(n) FROM n) AS t, (SELECT -sum(n / t * ln(n / t)) FROM ra, (SELECT sum(n) AS t FROM n)) AS ha,
    (SELECT -sum(n / t * ln(n / t)) FROM rb, (SELECT sum(n) AS t FROM n)) AS hb,
    (SELECT -sum(n / t * ln(n / t)) FROM n, (SELECT sum(n) AS t FROM n)) AS hab,
    (SELECT sum(n * (n - 1) / 2) FROM n) AS pab, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa,
    (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb)"""


@register(
    "v1_v2_agreement",
    f"""WITH {agreement_sql('f_cells', 'cell_type', 'cell_id % 5')} SELECT round(ha, 6) AS entropy_a, round(hb, 6) AS entropy_b,
    round(ha + hb - hab, 6) AS mutual_information, round(2 * hab - ha - hb, 6) AS vi,
    round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, round(pab / sqrt(pa * pb), 6) AS fmi,
    round((pab - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM s""",
)
def v1(spark, sf):
    out = mt.agreement(cells(spark, sf).withColumn("k", c("cell_id") % 5), "cell_type", "k")
    return _r(out, *out.columns)


_ARI = "round((pab - pa * pb / (t * (t - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (t * (t - 1) / 2)), 6) AS ari FROM s"


@register(
    "v3_read_assignment_ari",
    f"WITH {agreement_sql('f_reads', 'coalesce(cell_id, -1)', 'CASE WHEN qv > 10 THEN coalesce(cell_id, -1) ELSE -1 END')} "
    f"SELECT 'first' AS a, 'second' AS b, {_ARI}",
)
def v3(spark, sf):
    d = reads(spark, sf).select(c("cell_id").alias("first"), F.when(c("qv") > 10, c("cell_id")).alias("second"))
    return _r(mt.pairwise_ari(d, ["first", "second"]), "ari")


@register(
    "v4_silhouette",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS f FROM embeddings),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.f, b.f)) AS d, count(*) AS n FROM e a, e b GROUP BY ALL),
    s AS (SELECT vec_id, max(d / (n - 1)) FILTER (own = other AND n > 1) AS a, min(d / n) FILTER (own <> other) AS b FROM d GROUP BY ALL)
    SELECT (SELECT count(DISTINCT label) FROM e) AS clusters, round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0
      ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def v4(spark, sf):
    return _r(cluster.silhouette(table(spark, sf, "embeddings"), ["vec_id"], "embedding", "label"), "silhouette")


def _side(spark, sf, dataset: str):
    r = reads(spark, sf).filter(c("dataset") == dataset)
    return rd.read_counts(r)


_TWO = """ca AS (SELECT sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE dataset = 'O' AND cell_id IS NOT NULL GROUP BY ALL),
cb AS (SELECT sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE dataset = 'F' AND cell_id IS NOT NULL GROUP BY ALL),
z AS (SELECT cell_type, count(*) AS size FROM f_cells GROUP BY ALL HAVING count(*) >= 10),
gg AS (SELECT feature_name FROM ca INTERSECT SELECT feature_name FROM cb),
ma AS (SELECT z.cell_type, gg.feature_name, coalesce(sum(n), 0) / any_value(size) AS mean, count(n) / any_value(size) AS share
  FROM z CROSS JOIN gg LEFT JOIN (SELECT ca.*, cell_type FROM ca JOIN f_cells USING (sample, cell_id)) q
  ON q.cell_type = z.cell_type AND q.feature_name = gg.feature_name GROUP BY ALL),
mb AS (SELECT z.cell_type, gg.feature_name, coalesce(sum(n), 0) / any_value(size) AS mean, count(n) / any_value(size) AS share
  FROM z CROSS JOIN gg LEFT JOIN (SELECT cb.*, cell_type FROM cb JOIN f_cells USING (sample, cell_id)) q
  ON q.cell_type = z.cell_type AND q.feature_name = gg.feature_name GROUP BY ALL)"""


@register(
    "v5_marker_purity_cells",
    f"WITH {_TWO} SELECT round(1 - greatest(avg(ma.share) - avg(mb.share), 0), 6) AS purity FROM ma JOIN mb USING (cell_type, "
    "feature_name) WHERE mb.share < 0.6",
)
def v5(spark, sf):
    at = cells(spark, sf)
    score, _ = mt.marker_purity(_side(spark, sf, "O"), at, _side(spark, sf, "F"), at, "cells", limit=0.6)
    return _r(score, "purity")


@register(
    "v6_marker_purity_reads",
    f"""WITH {_TWO}, xa AS (SELECT *, mean / nullif(sum(mean) OVER (PARTITION BY feature_name), 0) AS v FROM ma),
    xb AS (SELECT *, mean / nullif(sum(mean) OVER (PARTITION BY feature_name), 0) AS v,
      mean / nullif(avg(mean) OVER (PARTITION BY feature_name), 0) AS m FROM mb)
    SELECT round(1 - greatest(avg(xa.v) - avg(xb.v), 0), 6) AS purity FROM xa JOIN xb USING (cell_type, feature_name) WHERE xb.m < 1""",
)
def v6(spark, sf):
    at = cells(spark, sf)
    score, _ = mt.marker_purity(_side(spark, sf, "O"), at, _side(spark, sf, "F"), at, "reads", limit=1.0)
    return _r(score, "purity")


@register(
    "v8_purity_per_gene",
    f"""WITH {_TWO} SELECT feature_name, round(1 - greatest(avg(ma.share) - avg(mb.share), 0), 6) AS purity FROM ma JOIN mb USING
    (cell_type, feature_name) WHERE mb.share < 0.6 GROUP BY ALL""",
)
def v8(spark, sf):
    at = cells(spark, sf)
    _, entries = mt.marker_purity(_side(spark, sf, "O"), at, _side(spark, sf, "F"), at, "cells", limit=0.6)
    return _r(mt.purity_by(entries, "feature_name"), "purity")


def _coexpression_sql(source: str, tag: str) -> str:
    return f"""p{tag} AS (SELECT sample, cell_id, feature_name FROM {source}),
b{tag} AS (SELECT a.feature_name AS g, b.feature_name AS h, count(*) AS n FROM p{tag} a JOIN p{tag} b USING (sample, cell_id) GROUP BY ALL),
s{tag} AS (SELECT feature_name AS g, count(*) AS n_g FROM p{tag} GROUP BY ALL),
c{tag}x AS (SELECT x.g, y.g AS h, coalesce(n, 0) / x.n_g AS p FROM s{tag} x CROSS JOIN s{tag} y LEFT JOIN b{tag} ON b{tag}.g = x.g
  AND b{tag}.h = y.g)"""


@register(
    "v7_coexpression_purity",
    f"WITH {_TWO}, {_coexpression_sql('ca', '1')}, {_coexpression_sql('cb', '2')} SELECT round(1 - avg(greatest(x.p - y.p, 0)), 6) "
    "AS purity FROM c1x x JOIN c2x y USING (g, h) WHERE y.p < 0.6",
)
def v7(spark, sf):
    return _r(mt.coexpression_purity(_side(spark, sf, "O"), _side(spark, sf, "F"), 0.6), "purity")


_METHOD = """mc AS (SELECT method, sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE cell_id IS NOT NULL GROUP BY ALL)"""


def _by_method(spark, sf):
    r = reads(spark, sf).filter("cell_id is not null")
    return r.groupBy("method", "sample", "cell_id", "feature_name").agg(F.count("*").alias("n"))


@register(
    "v9_v10_efficiency",
    f"""WITH {_METHOD}, f AS (SELECT feature_name, median(n) AS ref FROM mc WHERE n > 1 AND method = 'N' GROUP BY ALL)
    SELECT method, feature_name, round(avg(n) / any_value(ref), 6) AS ratio FROM mc JOIN f USING (feature_name) WHERE n > 1 AND
    method <> 'N' GROUP BY ALL""",
)
def v9(spark, sf):
    return _r(mt.efficiency(_by_method(spark, sf), "method", "N"), "ratio")


@register(
    "v11_pairwise_efficiency",
    f"""WITH {_METHOD}, k AS (SELECT method, count(DISTINCT (sample, cell_id)) AS cells FROM mc GROUP BY ALL),
    m AS (SELECT method, feature_name, sum(n) / any_value(cells) * 100 AS v FROM mc JOIN k USING (method) GROUP BY ALL)
    SELECT a.method AS a, b.method AS b, round(avg(b.v / a.v), 6) AS mean, round(median(b.v / a.v), 6) AS median
    FROM m a JOIN m b USING (feature_name) WHERE a.method < b.method GROUP BY ALL""",
)
def v11(spark, sf):
    n = _by_method(spark, sf)
    k = n.groupBy("method").agg(F.countDistinct("sample", "cell_id").alias("cells"))
    return _r(mt.pairwise_efficiency(n, k, "method"), "mean", "median")


@register(
    "v12_probe_correlation",
    "WITH k AS (SELECT p_brand AS g, count(*) AS probes FROM part GROUP BY ALL), n AS (SELECT feature_name AS g, sum(n)::DOUBLE AS n "
    "FROM f_counts GROUP BY ALL) SELECT round(corr(probes, n), 6) AS r FROM k JOIN n USING (g) WHERE probes > 0 AND n > 0",
)
def v12(spark, sf):
    k = table(spark, sf, "part").groupBy(c("p_brand").alias("feature_name")).agg(F.count("*").alias("probes"))
    n = counts(spark, sf).groupBy("feature_name").agg(F.sum("n").alias("n"))
    return k.join(n, "feature_name").filter("n > 0").agg(r6(F.corr("probes", "n"), "r"))


@register(
    "v13_ks_two_sample",
    """WITH t AS (SELECT event_type, count(*) AS t FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
    n AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS na, count(*) FILTER (WHERE event_type = 'view') AS nb FROM
      events WHERE event_type IN ('click', 'view') GROUP BY ALL),
    g AS (SELECT abs(sum(na) OVER w / (SELECT t FROM t WHERE event_type = 'click') - sum(nb) OVER w / (SELECT t FROM t WHERE
      event_type = 'view')) AS gap FROM n WINDOW w AS (ORDER BY value ROWS UNBOUNDED PRECEDING))
    SELECT round(max(gap), 6) AS d FROM g""",
)
def v13(spark, sf):
    out = mt.ks_two_sample(table(spark, sf, "events"), "value", "event_type", "click", "view")
    return _r(out.select("d"), "d")


_KEYS = "(sample, cell_id, feature_name)"


@register(
    "v14_imputation_scores",
    f"""WITH {_TWO}, d AS (SELECT feature_name, coalesce(x.n, 0)::DOUBLE AS x, coalesce(y.n, 0)::DOUBLE AS y FROM f_cells
      CROSS JOIN gg LEFT JOIN ca x USING {_KEYS} LEFT JOIN cb y USING {_KEYS}),
    s AS (SELECT feature_name, sum(x) AS sx, sum(y) AS sy, max(x) AS mx, max(y) AS my, avg(x) AS ax, avg(y) AS ay,
      var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS cov, corr(x, y) AS pcc FROM d GROUP BY ALL),
    j AS (SELECT feature_name, sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q)
      / 2)) ELSE 0 END) AS js2 FROM (SELECT feature_name, x / sx AS p, y / sy AS q FROM d JOIN s USING (feature_name)) GROUP BY ALL)
    SELECT feature_name, round(pcc, 6) AS pcc, round(((2 * ax / mx * ay / my + 0.0001) * (2 * cov / mx / my + 0.0009)) / (((ax / mx) ** 2
      + (ay / my) ** 2 + 0.0001) * (vx / mx ** 2 + vy / my ** 2 + 0.0009)), 6) AS ssim, round(sqrt(js2 / 2), 6) AS js,
      round(sqrt(2 - 2 * pcc), 6) AS rmse FROM s JOIN j USING (feature_name)""",
)
def v14(spark, sf):
    out = mt.imputation_scores(_side(spark, sf, "O"), _side(spark, sf, "F"), cells(spark, sf).count())
    return _r(out, "pcc", "ssim", "js", "rmse")


@register(
    "v15_spearman",
    """WITH g AS (SELECT sample, feature_name, sum(n) AS x, count(*) AS y FROM f_counts GROUP BY ALL),
    r AS (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY x) + (count(*) OVER (PARTITION BY sample, x) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY sample ORDER BY y) + (count(*) OVER (PARTITION BY sample, y) - 1) / 2 AS ry FROM g)
    SELECT sample, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY ALL""",
)
def v15(spark, sf):
    g = counts(spark, sf).groupBy("sample", "feature_name").agg(F.sum("n").alias("x"), F.count("*").alias("y"))
    return _r(mt.spearman(g, ["sample"], "x", "y"), "spearman")


@register(
    "v16_w2_tool_ranking",
    """WITH g AS (SELECT method AS tool, round(avg(qv), 6) AS pcc, round(avg(z_location), 6) AS ssim, round(avg(nucleus_distance), 6) AS js,
      round(avg(overlaps_nucleus), 6) AS rmse FROM f_reads GROUP BY ALL), k AS (SELECT count(*) AS k FROM g)
    SELECT tool, round((row_number() OVER (ORDER BY pcc, tool) + row_number() OVER (ORDER BY ssim, tool) + row_number() OVER (ORDER BY js
      DESC, tool) + row_number() OVER (ORDER BY rmse DESC, tool)) / k / 4, 6) AS score FROM g, k""",
)
def v16(spark, sf):
    g = reads(spark, sf).groupBy(c("method").alias("tool")).agg(
        r6(F.avg("qv"), "pcc"),
        r6(F.avg("z_location"), "ssim"),
        r6(F.avg("nucleus_distance"), "js"),
        r6(F.avg("overlaps_nucleus"), "rmse"),
    )
    return _r(mt.tool_ranking(g), "score")


@register(
    "v17_diffusion",
    f"""WITH {_DISTANCE_SQL}, m AS (SELECT method, feature_name, avg(distance) AS mean FROM d GROUP BY ALL),
    s AS (SELECT method, feature_name, count(cell_id) / count(*) AS in_cell FROM f_reads GROUP BY ALL)
    SELECT method, feature_name, round(mean, 6) AS mean, round(in_cell, 6) AS in_cell FROM m JOIN s USING (method, feature_name)""",
)
def v17(spark, sf):
    r = reads(spark, sf)
    m = rd.centroid_distance(r, cells(spark, sf)).groupBy("method", "feature_name").agg(r6(F.avg("distance"), "mean"))
    s = r.groupBy("method", "feature_name").agg(r6(F.count("cell_id") / F.count("*"), "in_cell"))
    return m.join(s, ["method", "feature_name"])


@register(
    "v18_k8_replicate_correlation",
    """WITH g AS (SELECT sample, feature_name, sum(n)::DOUBLE AS n FROM f_counts GROUP BY ALL) SELECT x.sample AS a, y.sample AS b,
    round(corr(x.n, y.n), 6) AS r FROM g x JOIN g y USING (feature_name) WHERE x.sample < y.sample GROUP BY ALL""",
)
def v18(spark, sf):
    g = counts(spark, sf).groupBy("sample", "feature_name").agg(F.sum("n").alias("n"))
    return _r(pf.replicate_correlation(g, "sample", "feature_name", "n"), "r")


@register(
    "v21_ground_truth",
    f"WITH j AS (SELECT a.cell_type AS x, b.l AS y FROM f_cells a JOIN (SELECT cell_id, sample % 2 AS l FROM f_cells WHERE cell_id % 3 "
    f"<> 0) b USING (cell_id)), {agreement_sql('j', 'x', 'y')} SELECT {_ARI}",
)
def v21(spark, sf):
    at = cells(spark, sf)
    other = at.filter("cell_id % 3 <> 0").select("cell_id", (c("sample") % 2).alias("l"))
    return _r(mt.agreement(at.join(other, "cell_id"), "cell_type", "l").select("ari"), "ari")


@register(
    "w9_false_discovery",
    """WITH g AS (SELECT feature_name, round(abs(sin(sum(n))), 9) AS p FROM f_counts GROUP BY ALL),
    q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature_name) AS v FROM g)
    SELECT feature_name, p, round(least(min(v) OVER (ORDER BY p DESC, feature_name DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS fdr FROM q""",
)
def w9(spark, sf):
    g = counts(spark, sf).groupBy("feature_name").agg(F.round(F.abs(F.sin(F.sum("n"))), 9).alias("p"))
    return g.select("feature_name", "p", r6(false_discovery("p"), "fdr"))


# ---- domains ----


@register("n11_read_domains")
def n11(spark, sf):
    from cellweave.plans.pipeline import read_domains

    return read_domains(counts(spark, sf), cells(spark, sf), 20, 5)


@register("n12_class_domains")
def n12(spark, sf):
    from cellweave.plans.pipeline import class_domains

    return class_domains(cells(spark, sf), 20, 5)


@register(
    "n13_compare_domains",
    "WITH "
    + agreement_sql("f_cells", "cell_type", "sample")
    + f" SELECT 'cell_type' AS a, 'sample' AS b, {_ARI}",
)
def n13(spark, sf):
    return _r(mt.pairwise_ari(cells(spark, sf).select("cell_type", "sample"), ["cell_type", "sample"]), "ari")


# ---- transfer and imputation ----


def _embedding(spark, sf):
    return table(spark, sf, "embeddings").select(c("vec_id").alias("id"), c("embedding").alias("features"), "label")


@register("i1_label_transfer")
def i1(spark, sf):
    e = _embedding(spark, sf)
    q, r = e.filter("id % 3 = 0"), e.filter("id % 3 <> 0")
    return tr.transfer_labels(q, r).withColumn("certainty", F.round("certainty", 6))


@register("i2_i3_i5_impute")
def i2(spark, sf):
    e = _embedding(spark, sf)
    out = tr.impute(e.filter("id % 3 = 0"), e.filter("id % 3 <> 0"), list(range(32)), list(range(32, 64)))
    return out.select("id", "gene", r6(c("value"), "value"))


@register("i4_leave_one_out")
def i4(spark, sf):
    e = _embedding(spark, sf)
    out = tr.leave_one_out(e.filter("id % 3 = 0"), e.filter("id % 3 <> 0"), list(range(32)), 8)
    return _r(out, "spearman")


# ---- distance profiles ----

_PROFILE = f"""{_DISTANCE_SQL}, nu AS (SELECT cell_type, feature_name, count(*)::DOUBLE AS x FROM d WHERE overlaps_nucleus = 1 GROUP BY ALL),
ri AS (SELECT cell_type, round_even(distance, 0)::INT AS ring, feature_name, count(*)::DOUBLE AS y FROM d WHERE
  round_even(distance, 0) <= 15 GROUP BY ALL), ke AS (SELECT DISTINCT cell_type, ring FROM ri),
pr AS (SELECT ke.cell_type, ke.ring, corr(x, coalesce(y, 0)) AS r FROM ke JOIN nu USING (cell_type) LEFT JOIN ri ON ri.cell_type =
  ke.cell_type AND ri.ring = ke.ring AND ri.feature_name = nu.feature_name GROUP BY ALL),
de AS (SELECT *, r - lag(r) OVER (PARTITION BY cell_type ORDER BY ring) AS delta FROM pr)"""


@register(
    "k1_profile_correlation",
    f"WITH {_PROFILE} SELECT cell_type, ring, round(r, 6) AS r, round(delta, 6) AS delta, coalesce(abs(delta) < 0.1, false) AS crossover "
    "FROM de",
)
def k1(spark, sf):
    at = cells(spark, sf)
    out = pf.profile_correlation(rd.centroid_distance(reads(spark, sf), at), at)
    return _r(out, "r", "delta")


@register("k3_best_radius", f"WITH {_PROFILE} SELECT cell_type, min(ring) AS radius FROM de WHERE abs(delta) < 0.1 GROUP BY ALL")
def k3(spark, sf):
    at = cells(spark, sf)
    return pf.best_radius(pf.profile_correlation(rd.centroid_distance(reads(spark, sf), at), at))


@register(
    "k2_elbow",
    f"""WITH {_DISTANCE_SQL}, g AS (SELECT unnest(range(0, 16))::INT AS k), e AS (SELECT k, count(d.cell_id)::DOUBLE AS n FROM g
      LEFT JOIN d ON round_even(distance, 0) <= k GROUP BY k), s AS (SELECT k, n / max(n) OVER () AS s FROM e),
    b AS (SELECT k, round(2 * s - lag(s) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k), 9) AS bend FROM s)
    SELECT k AS expansion_distance, bend FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1""",
)
def k2(spark, sf):
    return pf.elbow(rd.expansion_curve(rd.centroid_distance(reads(spark, sf), cells(spark, sf))))


@register(
    "k4_distance_classes",
    """WITH s AS (SELECT feature_name, CASE WHEN overlaps_nucleus = 1 THEN -nucleus_distance ELSE nucleus_distance END AS v FROM f_reads),
    n AS (SELECT feature_name, CASE WHEN v < 0 THEN '-5-0' WHEN v < 5 THEN '0-5' WHEN v < 15 THEN '5-15' ELSE '15+' END AS class,
      count(*) AS n FROM s GROUP BY ALL)
    SELECT *, round(n / sum(n) OVER (PARTITION BY feature_name), 6) AS share FROM n""",
)
def k4(spark, sf):
    return _r(pf.distance_classes(reads(spark, sf)), "share")


@register(
    "k5_distance_percentiles",
    f"WITH {_DISTANCE_SQL} SELECT feature_name, round(quantile_cont(distance, 0.1), 6) AS p10, round(quantile_cont(distance, 0.9), 6) AS "
    "p90 FROM d GROUP BY ALL",
)
def k5(spark, sf):
    return _r(pf.distance_percentiles(rd.centroid_distance(reads(spark, sf), cells(spark, sf))), "p10", "p90")


@register(
    "k6_welch_between_genes",
    f"""WITH {_DISTANCE_SQL}, s AS (SELECT feature_name AS g, avg(distance) AS m, var_samp(distance) / count(*) AS v, count(*) AS n FROM d
      GROUP BY ALL HAVING count(*) > 1)
    SELECT a.g AS g, b.g AS h, round((a.m - b.m) / sqrt(a.v + b.v), 6) AS t, round((a.v + b.v) ** 2 / (a.v ** 2 / (a.n - 1) + b.v ** 2 /
      (b.n - 1)), 4) AS df FROM s a JOIN s b ON a.g < b.g""",
)
def k6(spark, sf):
    d = rd.gene_distances(rd.centroid_distance(reads(spark, sf), cells(spark, sf)))
    return pf.welch_between_genes(d).select("g", "h", r6(c("t"), "t"), F.round("df", 4).alias("df"))


_NEAREST = """q AS (SELECT DISTINCT sample, x_location, y_location FROM f_reads),
nn AS (SELECT q.sample, x_location, y_location, arg_min(cell_id, (sqrt((x_location - x_centroid) ** 2 + (y_location - y_centroid) ** 2),
  cell_id)) AS cell, min(sqrt((x_location - x_centroid) ** 2 + (y_location - y_centroid) ** 2)) AS dist FROM q JOIN f_cells ON
  q.sample = f_cells.sample AND abs(x_location - x_centroid) <= 15 AND abs(y_location - y_centroid) <= 15
  WHERE sqrt((x_location - x_centroid) ** 2 + (y_location - y_centroid) ** 2) <= 15 GROUP BY ALL)"""


@register(
    "k7_nearest_nucleus",
    f"WITH {_NEAREST} SELECT sample, cell, count(*) AS places, round(max(dist), 6) AS farthest FROM nn GROUP BY ALL",
)
def k7(spark, sf):
    out = pf.nearest_nucleus(reads(spark, sf), cells(spark, sf), 15.0)
    return out.groupBy("sample", "cell").agg(F.count("*").alias("places"), r6(F.max("dist"), "farthest"))


@register(
    "k13_reads_in_radius",
    f"""WITH {_NEAREST}, ra AS (SELECT DISTINCT cell_type, 3 + length(cell_type) % 5 AS radius FROM f_cells),
    ok AS (SELECT nn.* FROM nn JOIN f_cells ON nn.cell = f_cells.cell_id JOIN ra USING (cell_type) WHERE dist <= radius)
    SELECT ok.sample, cell, count(*) AS n FROM f_reads JOIN ok USING (sample, x_location, y_location) GROUP BY ALL""",
)
def k13(spark, sf):
    at = cells(spark, sf)
    radii = at.select("cell_type", (3 + F.length("cell_type") % 5).alias("radius")).distinct()
    return pf.reads_in_own_radius(reads(spark, sf), at, radii, 15.0)


@register(
    "k9_region_fallback",
    f"""WITH {_PIP}, nb AS (SELECT a.cell_id, arg_min(b.cell_id, (sqrt((a.x_centroid - b.x_centroid) ** 2 + (a.y_centroid - b.y_centroid)
      ** 2), b.cell_id)) AS dst FROM f_cells a JOIN region ra ON a.cell_id = ra.cell_id AND ra.region = 'None' JOIN f_cells b ON a.sample =
      b.sample JOIN region rb ON b.cell_id = rb.cell_id AND rb.region <> 'None' WHERE sqrt((a.x_centroid - b.x_centroid) ** 2 +
      (a.y_centroid - b.y_centroid) ** 2) <= 100 GROUP BY ALL)
    SELECT region.cell_id, coalesce(r2.region, region.region) AS region FROM region LEFT JOIN nb ON region.cell_id = nb.cell_id LEFT JOIN
      region r2 ON r2.cell_id = nb.dst""",
)
def k9(spark, sf):
    at = cells(spark, sf)
    inside = sp.point_in_polygon(at, polygons(spark, sf), ["cell_id"], "x_centroid", "y_centroid")
    return pf.assign_with_fallback(inside, sp.as_points(at), 100.0)


@register(
    "k10_region_composition",
    f"""WITH {_PIP}, n AS (SELECT region, cell_type, count(*) AS n FROM region JOIN f_cells USING (cell_id) GROUP BY ALL)
    SELECT region, cell_type, n, round(sum(n) OVER (PARTITION BY region) * sum(n) OVER (PARTITION BY cell_type) / sum(n) OVER (), 6)
    AS expected FROM n""",
)
def k10(spark, sf):
    at = cells(spark, sf)
    inside = sp.point_in_polygon(at, polygons(spark, sf), ["cell_id"], "x_centroid", "y_centroid")
    return _r(pf.composition_against_expected(inside.join(at, "cell_id"), "region", "cell_type"), "expected")


def _regions(spark, sf):
    at = cells(spark, sf)
    inside = sp.point_in_polygon(at, polygons(spark, sf), ["cell_id"], "x_centroid", "y_centroid")
    return inside.join(at.select("sample", "cell_id"), "cell_id")


@register(
    "k10_region_cohesion",
    f"""WITH {_PIP}, k AS (SELECT region, cell_id, sample FROM region JOIN f_cells USING (cell_id)),
    g AS (SELECT DISTINCT feature_name FROM f_counts),
    d AS (SELECT region, sample, cell_id, feature_name, coalesce(n, 0)::DOUBLE AS n FROM k CROSS JOIN g LEFT JOIN f_counts USING (sample,
      cell_id, feature_name)),
    m AS (SELECT *, avg(n) OVER (PARTITION BY region, feature_name) AS m FROM d),
    r AS (SELECT region, CASE WHEN stddev_pop(n) > 1e-6 AND stddev_pop(m) > 1e-6 THEN corr(n, m) END AS r FROM m
      GROUP BY region, sample, cell_id)
    SELECT region, count(r) AS cells, round(avg(r), 6) AS r FROM r GROUP BY ALL""",
)
def k10_cohesion(spark, sf):
    return _r(pf.region_cohesion(counts(spark, sf), _regions(spark, sf)), "r")


@register(
    "k10_region_welch",
    f"""WITH {_PIP}, k AS (SELECT region, cell_id, sample FROM region JOIN f_cells USING (cell_id)),
    g AS (SELECT DISTINCT feature_name FROM f_counts SEMI JOIN k USING (sample, cell_id)),
    d AS (SELECT region, feature_name, coalesce(n, 0)::DOUBLE AS n FROM k CROSS JOIN g LEFT JOIN f_counts USING (sample, cell_id,
      feature_name)),
    m AS (SELECT region, feature_name, avg(n) AS m, count(*) AS k, var_samp(n) / count(*) AS v FROM d GROUP BY ALL HAVING count(*) > 1)
    SELECT a.feature_name, a.region AS a, b.region AS b, CASE WHEN a.v + b.v > 0 THEN round((a.m - b.m) / sqrt(a.v + b.v), 6) END AS t,
      CASE WHEN a.v + b.v > 0 THEN round((a.v + b.v) ** 2 / (a.v ** 2 / (a.k - 1) + b.v ** 2 / (b.k - 1)), 4) END AS df
    FROM m a JOIN m b ON a.feature_name = b.feature_name AND a.region < b.region""",
)
def k10_welch(spark, sf):
    out = pf.welch_between_regions(counts(spark, sf), _regions(spark, sf))
    return _r(out, "t").withColumn("df", F.round("df", 4))


@register(
    "k11_domain_purity",
    "WITH n AS (SELECT sample, cell_type, count(*) AS n FROM f_cells GROUP BY ALL) SELECT sample, round(max(n) / sum(n), 6) AS purity, "
    "sum(n)::BIGINT AS n FROM n GROUP BY ALL",
)
def k11(spark, sf):
    return _r(pf.domain_purity(cells(spark, sf), "sample", "cell_type"), "purity")
