"""Queries of filters, joins by key, aggregates, windows, samples, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.catalog import register
from cellweave.functions import ranking as rk
from cellweave.functions import scalar as sc
from cellweave.operators import qc
from cellweave.operators import reads as rd
from cellweave.plans.fixtures import cells, counts, reads
from cellweave.session import table

c = F.col


def r6(x, name: str):
    return F.round(x, 6).alias(name)


# ---- the flagship: filter, join, aggregate ----

_DISTANCE_SQL = """d AS (
  SELECT f_reads.*, sqrt((x_location - x_centroid) * (x_location - x_centroid)
         + (y_location - y_centroid) * (y_location - y_centroid)) AS distance, cell_type
  FROM f_reads JOIN f_cells ON f_reads.sample = f_cells.sample AND f_reads.cell_id = f_cells.cell_id
)"""


@register(
    "flagship",
    f"""WITH {_DISTANCE_SQL} SELECT feature_name, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median,
    round(stddev_samp(distance), 6) AS std, count(distance) AS count FROM d
    WHERE qv > 20 AND NOT regexp_matches(feature_name, '(?i)BLANK|NegControl') GROUP BY feature_name""",
)
def flagship(spark, sf):
    good = rd.drop_controls(reads(spark, sf).filter("qv > 20"))
    out = rd.gene_distances(rd.centroid_distance(good, cells(spark, sf)))
    return out.select("feature_name", r6(c("mean"), "mean"), r6(c("median"), "median"), r6(c("std"), "std"), "count")


@register(
    "a12_gene_distance",
    f"""WITH {_DISTANCE_SQL} SELECT feature_name, round(avg(distance), 6) AS mean, round(median(distance), 6) AS median,
    round(stddev_samp(distance), 6) AS std, count(distance) AS count FROM d GROUP BY feature_name""",
)
def a12(spark, sf):
    out = rd.gene_distances(rd.centroid_distance(reads(spark, sf), cells(spark, sf)))
    return out.select("feature_name", r6(c("mean"), "mean"), r6(c("median"), "median"), r6(c("std"), "std"), "count")


# ---- projections and filters ----


@register(
    "p1_nuclear_counts",
    "SELECT sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE overlaps_nucleus = 1 AND cell_id IS NOT NULL "
    "GROUP BY ALL",
)
def p1(spark, sf):
    return rd.read_counts(rd.keep_overlap(reads(spark, sf)))


@register(
    "p2_distance_quality",
    "SELECT sample, cell_id, feature_name, count(*) AS n FROM f_reads WHERE nucleus_distance < 1 AND qv > 20 "
    "AND cell_id IS NOT NULL GROUP BY ALL",
)
def p2(spark, sf):
    return rd.read_counts(rd.keep_near_nucleus(reads(spark, sf), 1, 20))


@register(
    "p3_flag_quality",
    "SELECT feature_name, count(*) AS n FROM f_reads WHERE qv > 25 GROUP BY ALL",
)
def p3(spark, sf):
    return rd.keep_flag_and_quality(reads(spark, sf), 0, 25).groupBy("feature_name").agg(F.count("*").alias("n"))


_TOTALS_SQL = """t AS (SELECT sample, cell_id, sum(n)::BIGINT AS total_counts, count(*) AS expressed_genes FROM f_counts
  GROUP BY ALL)"""


@register(
    "p4_cell_filter",
    f"WITH {_TOTALS_SQL} SELECT f_counts.* FROM f_counts SEMI JOIN (SELECT * FROM t WHERE total_counts >= 10 AND "
    "expressed_genes >= 3) k ON f_counts.sample = k.sample AND f_counts.cell_id = k.cell_id",
)
def p4(spark, sf):
    return rd.filter_cells(counts(spark, sf)).select("sample", "cell_id", "feature_name", "n")


@register(
    "p5_cell_cap",
    f"WITH {_TOTALS_SQL} SELECT * FROM t WHERE total_counts >= 10 AND expressed_genes >= 3 AND total_counts <= "
    "(SELECT quantile_cont(total_counts, 0.99) * 1.2 FROM t)",
)
def p5(spark, sf):
    return rd.filter_cells_capped(rd.cell_totals(counts(spark, sf)), 10, 3, 1.2)


@register(
    "p6_gene_min_cells",
    "WITH k AS (SELECT feature_name FROM f_counts GROUP BY ALL HAVING count(*) >= 30) SELECT feature_name, "
    "sum(n)::BIGINT AS n_counts, count(*) AS n_cells FROM f_counts SEMI JOIN k USING (feature_name) GROUP BY ALL",
)
def p6(spark, sf):
    return rd.gene_totals(rd.filter_genes(counts(spark, sf), 30))


@register(
    "p7_gene_total",
    "WITH k AS (SELECT feature_name FROM f_counts GROUP BY ALL HAVING sum(n) > 10) SELECT feature_name, "
    "sum(n)::BIGINT AS n_counts, count(*) AS n_cells FROM f_counts SEMI JOIN k USING (feature_name) GROUP BY ALL",
)
def p7(spark, sf):
    return rd.gene_totals(rd.filter_genes(counts(spark, sf), above_total=10))


@register(
    "p8_drop_controls",
    "SELECT feature_name, count(*) AS n FROM f_reads WHERE NOT regexp_matches(feature_name, '(?i)BLANK|NegControl') "
    "GROUP BY ALL",
)
def p8(spark, sf):
    return rd.drop_controls(reads(spark, sf)).groupBy("feature_name").agg(F.count("*").alias("n"))


@register(
    "p9_panel_only",
    "SELECT feature_name, count(*) AS n FROM f_reads WHERE feature_name IN (SELECT DISTINCT p_brand FROM part) GROUP BY ALL",
)
def p9(spark, sf):
    panel = table(spark, sf, "part").select(c("p_brand").alias("feature_name")).distinct()
    kept = reads(spark, sf).join(panel, "feature_name", "left_semi")
    return kept.groupBy("feature_name").agg(F.count("*").alias("n"))


@register(
    "p10_crop",
    "SELECT cell_id, x_centroid - 100 AS x_centroid, y_centroid - 50 AS y_centroid FROM f_cells "
    "WHERE x_centroid >= 100 AND x_centroid < 600 AND y_centroid >= 50 AND y_centroid < 700",
)
def p10(spark, sf):
    box = rd.crop(cells(spark, sf), "x_centroid", "y_centroid", (100, 600, 50, 700))
    return box.select("cell_id", "x_centroid", "y_centroid")


@register(
    "p11_rescale",
    "SELECT method, round(avg(x_location / f), 6) AS x, round(avg(y_location / f), 6) AS y FROM (SELECT *, CASE method "
    "WHEN 'A' THEN 8.3333 WHEN 'N' THEN 4.70588 WHEN 'R' THEN 9.20586 ELSE 1 END::DOUBLE AS f FROM f_reads) GROUP BY method",
)
def p11(spark, sf):
    out = rd.rescale(reads(spark, sf), rd.PIXELS_PER_UM, "method", "x_location", "y_location")
    return out.groupBy("method").agg(r6(F.avg("x_location"), "x"), r6(F.avg("y_location"), "y"))


_GROUPS = {"west": ["AUTOMOBILE", "BUILDING"], "east": ["BUILDING", "MACHINERY"]}


@register(
    "p12_region_names",
    "SELECT CASE WHEN cell_type IN ('BUILDING', 'MACHINERY') THEN 'east' WHEN cell_type IN ('AUTOMOBILE', 'BUILDING') THEN "
    "'west' END AS region, count(*) AS n FROM f_cells GROUP BY ALL",
)
def p12(spark, sf):
    return rd.name_regions(cells(spark, sf), "cell_type", _GROUPS).groupBy("region").agg(F.count("*").alias("n"))


@register("p13_nonempty", f"WITH {_TOTALS_SQL} SELECT sample, cell_id, total_counts FROM t WHERE total_counts > 3")
def p13(spark, sf):
    return rd.cell_totals(counts(spark, sf)).filter("total_counts > 3").select("sample", "cell_id", "total_counts")


@register(
    "p14_drop_label",
    "SELECT dataset, count(*) AS n, count(*) FILTER (WHERE cell_id IS NULL) / count(*) AS noise FROM f_reads "
    "WHERE method <> 'R' GROUP BY ALL",
)
def p14(spark, sf):
    noise = F.sum(c("cell_id").isNull().cast("int")) / F.count("*")
    return reads(spark, sf).filter("method <> 'R'").groupBy("dataset").agg(F.count("*").alias("n"), noise.alias("noise"))


@register(
    "p15_row_max",
    "WITH k AS (SELECT feature_name FROM f_counts GROUP BY ALL HAVING max(n) > 5) SELECT feature_name, sum(n)::BIGINT AS "
    "total FROM f_counts SEMI JOIN k USING (feature_name) GROUP BY ALL",
)
def p15(spark, sf):
    kept = rd.filter_genes_by_peak(counts(spark, sf), 5)
    return kept.groupBy("feature_name").agg(F.sum("n").alias("total"))


# ---- joins by key ----


@register(
    "j1_centroid_distance",
    f"WITH {_DISTANCE_SQL} SELECT sample, cell_id, count(*) AS n, round(max(distance), 6) AS farthest FROM d GROUP BY ALL",
)
def j1(spark, sf):
    d = rd.centroid_distance(reads(spark, sf), cells(spark, sf))
    return d.groupBy("sample", "cell_id").agg(F.count("*").alias("n"), r6(F.max("distance"), "farthest"))


@register(
    "j2_map_lookup",
    "WITH m AS (SELECT p_brand, arg_max(p_name, p_partkey) AS name FROM part GROUP BY p_brand) "
    "SELECT feature_name, name, count(*) AS n FROM f_reads LEFT JOIN m ON feature_name = p_brand GROUP BY ALL",
)
def j2(spark, sf):
    last = table(spark, sf, "part").groupBy("p_brand").agg(F.max_by("p_name", "p_partkey").alias("name"))
    n = reads(spark, sf).groupBy("feature_name").agg(F.count("*").alias("n"))
    return n.join(last, c("feature_name") == c("p_brand"), "left").select("feature_name", "name", "n")


@register(
    "j3_semi_join",
    "SELECT sample, cell_id FROM f_cells WHERE EXISTS (SELECT 1 FROM f_reads r WHERE r.sample = f_cells.sample AND "
    "r.cell_id = f_cells.cell_id AND r.qv > 35)",
)
def j3(spark, sf):
    good = reads(spark, sf).filter("qv > 35")
    return cells(spark, sf).join(good, ["sample", "cell_id"], "left_semi").select("sample", "cell_id")


@register(
    "j4_anti_join",
    "SELECT sample, cell_id FROM f_cells WHERE NOT EXISTS (SELECT 1 FROM f_reads r WHERE r.sample = f_cells.sample AND "
    "r.cell_id = f_cells.cell_id AND method = 'A' AND qv > 35)",
)
def j4(spark, sf):
    """Cells without a read of one method and high quality."""
    good = reads(spark, sf).filter("method = 'A' and qv > 35")
    return cells(spark, sf).join(good, ["sample", "cell_id"], "left_anti").select("sample", "cell_id")


@register(
    "j12_key_merge",
    "WITH a AS (SELECT method || '_' || feature_name AS id, count(*) AS n FROM f_reads WHERE dataset = 'F' GROUP BY ALL), "
    "b AS (SELECT method || '_' || feature_name AS id, count(*) AS m FROM f_reads WHERE dataset = 'O' GROUP BY ALL) "
    "SELECT id, n, m FROM a JOIN b USING (id)",
)
def j12(spark, sf):
    r = reads(spark, sf).withColumn("id", sc.composed_id(c("method"), c("feature_name")))
    a = r.filter("dataset = 'F'").groupBy("id").agg(F.count("*").alias("n"))
    b = r.filter("dataset = 'O'").groupBy("id").agg(F.count("*").alias("m"))
    return a.join(b, "id")


@register(
    "j13_gene_intersection",
    "SELECT feature_name FROM f_reads WHERE method = 'A' INTERSECT SELECT feature_name FROM f_reads WHERE method = 'R'",
)
def j13(spark, sf):
    g = reads(spark, sf).select("method", "feature_name")
    a, b = (g.filter(c("method") == m).select("feature_name") for m in "AR")
    return a.intersect(b)


@register(
    "j14_gene_harmonise",
    "WITH a AS (SELECT DISTINCT feature_name FROM f_reads), b AS (SELECT DISTINCT lower(p_brand) AS name FROM part) "
    "SELECT a.feature_name, b.name FROM a JOIN b ON upper(a.feature_name) = upper(b.name)",
)
def j14(spark, sf):
    from cellweave.operators.transfer import harmonise_genes

    a = reads(spark, sf).select("feature_name").distinct()
    b = table(spark, sf, "part").select(F.lower("p_brand").alias("name")).distinct()
    return harmonise_genes(a, "feature_name", b, "name")


@register(
    "j15_symbol_resolution",
    "WITH alias AS (SELECT p_brand AS symbol, p_partkey AS gene, 1 AS priority FROM part UNION ALL SELECT p_type, p_partkey, 2 "
    "FROM part), best AS (SELECT symbol, arg_min(gene, (priority, gene)) AS gene, min(priority) AS priority FROM alias "
    "GROUP BY symbol) SELECT * FROM best",
)
def j15(spark, sf):
    from cellweave.operators.transfer import resolve_symbols

    part = table(spark, sf, "part")
    return resolve_symbols(part, "p_partkey", ["p_brand", "p_type"])


# ---- aggregations ----


@register("a1_read_counts", "SELECT sample, cell_id, feature_name, n FROM f_counts")
def a1(spark, sf):
    return counts(spark, sf)


@register("a2_cell_totals", f"WITH {_TOTALS_SQL} SELECT * FROM t")
def a2(spark, sf):
    return rd.cell_totals(counts(spark, sf))


@register(
    "a3_gene_totals", "SELECT feature_name, sum(n)::BIGINT AS n_counts, count(*) AS n_cells FROM f_counts GROUP BY ALL"
)
def a3(spark, sf):
    return rd.gene_totals(counts(spark, sf))


_ALL_SQL = """t AS (
  SELECT f_cells.sample, f_cells.cell_id, coalesce(sum(n), 0) AS total_counts, count(n) AS expressed_genes
  FROM f_cells LEFT JOIN f_counts ON f_cells.sample = f_counts.sample AND f_cells.cell_id = f_counts.cell_id GROUP BY ALL
)"""
_SUMMARY_SQL = ", ".join(
    f"round(avg({v}), 6) AS mean_{t}_cells, round(quantile_cont({v}, 0.5), 6) AS median_{t}_cells, "
    f"round(quantile_cont({v}, 0.05), 6) AS percentile_5th_{t}_cells, "
    f"round(quantile_cont({v}, 0.95), 6) AS percentile_95th_{t}_cells"
    for t, v in (("reads", "total_counts"), ("genes", "expressed_genes"))
)


@register(
    "a4_a5_a6_per_cell_summary",
    f"WITH {_ALL_SQL} SELECT sample, count(*) AS number_of_cells, {_SUMMARY_SQL} FROM t GROUP BY sample",
)
def a456(spark, sf):
    out = qc.per_cell_summary(qc.totals_of_all_cells(counts(spark, sf), cells(spark, sf)))
    return out.select("sample", "number_of_cells", *[r6(c(n), n) for n in out.columns[2:]])


@register(
    "a7_assigned_share",
    "SELECT sample, round(count(cell_id) / count(*), 6) AS proportion_of_assigned_reads FROM f_reads GROUP BY ALL",
)
def a7(spark, sf):
    out = qc.assigned_share(reads(spark, sf))
    return out.select("sample", r6(c("proportion_of_assigned_reads"), "proportion_of_assigned_reads"))


_REPORT = ["number_of_cells"] + [
    f"{m}_{t}_cells" for t in ("reads", "genes") for m in ("mean", "median", "percentile_5th", "percentile_95th")
]


@register(
    "a9_report",
    f"""WITH {_ALL_SQL}, s AS (SELECT sample, count(*)::DOUBLE AS number_of_cells, {_SUMMARY_SQL} FROM t GROUP BY sample),
    w AS (SELECT s.*, p, (SELECT count(DISTINCT p_brand) FROM part)::DOUBLE AS number_of_genes FROM s JOIN
      (SELECT sample, round(count(cell_id) / count(*), 6) AS p FROM f_reads GROUP BY ALL) USING (sample))
    {' UNION ALL '.join(f"SELECT sample, '{m}' AS metric, {m}::DOUBLE AS value FROM w" for m in [*_REPORT, 'number_of_genes'])}
    UNION ALL SELECT sample, 'proportion_of_assigned_reads', p FROM w""",
)
def a9(spark, sf):
    size = table(spark, sf, "part").agg(F.countDistinct("p_brand")).first()[0]
    out = qc.report(reads(spark, sf), counts(spark, sf), cells(spark, sf), size)
    return out.select("sample", "metric", r6(c("value"), "value"))


@register(
    "a10_extras",
    f"""WITH {_ALL_SQL}, k AS (SELECT DISTINCT p_brand FROM part),
    a AS (SELECT sample, round(avg(CASE WHEN qv > 20 THEN 1 ELSE 0 END), 6) AS reads_prop_qv, count(*) AS total_reads,
      round(count(p_brand) / count(*), 6) AS prop_reads_in_panel, round(count(cell_id) / count(*), 6) AS prop_reads_assigned
      FROM f_reads LEFT JOIN k ON feature_name = p_brand GROUP BY sample),
    b AS (SELECT sample, round(avg(CASE WHEN total_counts > 5 THEN 1 ELSE 0 END), 6) AS proportion_cells FROM t GROUP BY ALL)
    SELECT * FROM a JOIN b USING (sample)""",
)
def a10(spark, sf):
    panel = table(spark, sf, "part").select(c("p_brand").alias("feature_name")).distinct()
    totals = qc.totals_of_all_cells(counts(spark, sf), cells(spark, sf))
    out = qc.extras(reads(spark, sf), totals, panel)
    return out.select(*[r6(c(n), n) if t == "double" else n for n, t in out.dtypes])


@register(
    "a11_group_mean",
    f"WITH {_ALL_SQL}, s AS (SELECT sample, avg(total_counts) AS m FROM t GROUP BY sample) SELECT sample % 2 AS grp, "
    "round(avg(m), 6) AS mean FROM s GROUP BY ALL",
)
def a11(spark, sf):
    s = qc.totals_of_all_cells(counts(spark, sf), cells(spark, sf)).groupBy("sample").agg(F.avg("total_counts").alias("m"))
    return s.groupBy((c("sample") % 2).alias("grp")).agg(r6(F.avg("m"), "mean"))


@register(
    "a13_mean_peak_distance",
    f"WITH {_DISTANCE_SQL} SELECT round(avg(peak), 6) AS mean_peak FROM (SELECT max(distance) AS peak FROM d WHERE "
    "overlaps_nucleus = 1 GROUP BY sample, cell_id)",
)
def a13(spark, sf):
    out = rd.mean_peak_distance(rd.centroid_distance(reads(spark, sf), cells(spark, sf)))
    return out.select(r6(c("mean_peak"), "mean_peak"))


@register(
    "a14_z_spread",
    "SELECT sample, cell_id, min(z_location) AS z_min, max(z_location) AS z_max, round(stddev_samp(z_location), 6) AS z_std, "
    "max(z_location) - min(z_location) AS z_range FROM f_reads WHERE cell_id IS NOT NULL GROUP BY ALL",
)
def a14(spark, sf):
    return rd.z_spread(reads(spark, sf)).withColumn("z_std", F.round("z_std", 6))


@register(
    "a17_expansion_curve",
    f"""WITH {_DISTANCE_SQL}, g AS (SELECT unnest(range(0, 16)) AS k)
    SELECT k::INT AS expansion_distance, count(d.cell_id) AS captured_reads,
      round(CASE WHEN count(d.cell_id) > 0 THEN sum(overlaps_nucleus) / count(d.cell_id) ELSE 0 END, 6) AS purity
    FROM g LEFT JOIN d ON round_even(distance, 0) <= k GROUP BY k""",
)
def a17(spark, sf):
    out = rd.expansion_curve(rd.centroid_distance(reads(spark, sf), cells(spark, sf)))
    return out.withColumn("purity", F.round("purity", 6))


@register(
    "a18_contingency",
    "WITH n AS (SELECT sample, cell_type, count(*) AS n FROM f_cells GROUP BY ALL) SELECT *, "
    "round(n / sum(n) OVER (PARTITION BY sample), 6) AS share FROM n",
)
def a18(spark, sf):
    return qc.contingency(cells(spark, sf), "sample", "cell_type").withColumn("share", F.round("share", 6))


@register(
    "a19_majority_vote",
    """WITH n AS (SELECT sample, cell_id, feature_name AS l, count(*) AS n FROM f_reads WHERE cell_id IS NOT NULL GROUP BY ALL),
    b AS (SELECT sample, cell_id, arg_min(l, (-n, l)) AS label, max(n) / sum(n) AS certainty FROM n GROUP BY ALL)
    SELECT sample, cell_id, CASE WHEN certainty >= 0.2 THEN label ELSE 'Unknown' END AS label,
      round(certainty, 6) AS certainty FROM b""",
)
def a19(spark, sf):
    r = reads(spark, sf).filter("cell_id is not null")
    out = qc.majority_vote(r, ["sample", "cell_id"], "feature_name", 0.2)
    return out.withColumn("certainty", F.round("certainty", 6))


@register(
    "a20_class_mean_distance",
    f"WITH {_DISTANCE_SQL} SELECT feature_name, cell_type, round(avg(distance), 6) AS mean, count(*) AS n FROM d GROUP BY ALL "
    "HAVING count(*) > 10",
)
def a20(spark, sf):
    at = cells(spark, sf)
    out = rd.class_mean_distance(rd.centroid_distance(reads(spark, sf), at), at)
    return out.withColumn("mean", F.round("mean", 6))


@register(
    "a21_signatures",
    """WITH s AS (SELECT cell_type, count(*) AS size FROM f_cells GROUP BY ALL)
    SELECT cell_type, feature_name, round(sum(n) / any_value(size), 6) AS mean FROM f_counts JOIN f_cells USING
      (sample, cell_id) JOIN s USING (cell_type) GROUP BY ALL""",
)
def a21(spark, sf):
    return qc.signatures(counts(spark, sf), cells(spark, sf)).withColumn("mean", F.round("mean", 6))


@register(
    "a22_k12_composition",
    """WITH p AS (SELECT sample, cell_id, max(n) AS peak, sum(n) AS total FROM f_counts GROUP BY ALL),
    t AS (SELECT count(*) AS k FROM f_cells GROUP BY cell_type), g AS (SELECT sum(n) AS g FROM f_counts GROUP BY feature_name),
    nc AS (SELECT count(*) AS n_cells FROM f_cells)
    SELECT n_cells, (SELECT count(*) FROM g) AS n_genes, (SELECT count(*) FROM t) AS n_types,
      round((SELECT min(k) / sum(k) FROM t), 6) AS smallest_type, round((SELECT max(k) / sum(k) FROM t), 6) AS largest_type,
      round((SELECT sum(peak) FROM p) / n_cells, 6) AS mean_max, round((SELECT sum(total) FROM p) / n_cells, 6) AS mean_total,
      round(1 - (SELECT count(*) FROM f_counts) / (n_cells * (SELECT count(*) FROM g)), 6) AS sparsity,
      round((SELECT max(g) / sum(g) FROM g), 6) AS top_gene_share FROM nc""",
)
def a22(spark, sf):
    out = qc.composition_profile(counts(spark, sf), cells(spark, sf))
    return out.select(*[r6(c(n), n) if t == "double" else n for n, t in out.dtypes])


@register(
    "a23_grid_density",
    """WITH l AS (SELECT min(x_location) AS x0, max(x_location) AS x1, min(y_location) AS y0, max(y_location) AS y1 FROM f_reads)
    SELECT least(floor((x_location - x0) / ((x1 - x0) / 50)), 49)::INT AS ix,
      least(floor((y_location - y0) / ((y1 - y0) / 50)), 49)::INT AS iy, count(*) AS n FROM f_reads, l GROUP BY ALL""",
)
def a23(spark, sf):
    return rd.grid_density(reads(spark, sf), "x_location", "y_location", 50)


@register("a24_value_counts", "SELECT cell_type, count(*) AS n FROM f_cells GROUP BY ALL")
def a24(spark, sf):
    return cells(spark, sf).groupBy("cell_type").agg(F.count("*").alias("n"))


@register(
    "a25_gene_datasets",
    "SELECT feature_name, count(DISTINCT method) AS datasets FROM f_reads GROUP BY ALL HAVING count(DISTINCT method) > 2",
)
def a25(spark, sf):
    return qc.gene_datasets(reads(spark, sf), "method", 2)


@register(
    "a26_coexpression",
    """WITH p AS (SELECT sample, cell_id, feature_name FROM f_counts WHERE n > 0),
    b AS (SELECT a.feature_name AS g, b.feature_name AS h, count(*) AS n FROM p a JOIN p b USING (sample, cell_id) GROUP BY ALL),
    s AS (SELECT feature_name AS g, count(*) AS n_g FROM p GROUP BY ALL),
    q AS (SELECT x.feature_name AS g, y.feature_name AS h FROM (SELECT DISTINCT feature_name FROM f_counts) x,
      (SELECT DISTINCT feature_name FROM f_counts) y)
    SELECT g, h, round(CASE WHEN n_g IS NULL THEN 1 ELSE coalesce(n, 0) / n_g END, 6) AS p
    FROM q LEFT JOIN b USING (g, h) LEFT JOIN s USING (g)""",
)
def a26(spark, sf):
    return qc.coexpression(counts(spark, sf)).withColumn("p", F.round("p", 6))


# ---- windows and ranks ----


@register(
    "w1_average_rank",
    "WITH g AS (SELECT sample, feature_name, sum(n) AS n FROM f_counts GROUP BY ALL) SELECT sample, feature_name, "
    "rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2 AS place FROM g",
)
def w1(spark, sf):
    g = counts(spark, sf).groupBy("sample", "feature_name").agg(F.sum("n").alias("n"))
    return g.select("sample", "feature_name", rk.average_rank(c("n").asc(), "sample", ties=c("n")).alias("place"))


@register(
    "w3_top_genes",
    "WITH g AS (SELECT sample, feature_name, sum(n)::BIGINT AS n FROM f_counts GROUP BY ALL) SELECT sample, feature_name, n, "
    "row_number() OVER (PARTITION BY sample ORDER BY n DESC, feature_name) AS place FROM g QUALIFY place <= 7",
)
def w3(spark, sf):
    g = counts(spark, sf).groupBy("sample", "feature_name").agg(F.sum("n").alias("n"))
    return rk.top_n(g, 7, ["sample"], c("n").desc(), c("feature_name"))


@register(
    "w4_shares",
    "WITH g AS (SELECT sample, cell_type, count(*) AS n FROM f_cells GROUP BY ALL) SELECT sample, cell_type, "
    "round(n / sum(n) OVER (PARTITION BY sample), 6) AS share, round(n / max(n) OVER (PARTITION BY cell_type), 6) AS of_max FROM g",
)
def w4(spark, sf):
    g = cells(spark, sf).groupBy("sample", "cell_type").agg(F.count("*").alias("n"))
    return g.select(
        "sample", "cell_type", r6(rk.share(c("n"), "sample"), "share"), r6(rk.share_of_max(c("n"), "cell_type"), "of_max")
    )


@register(
    "w5_arg_max",
    "WITH g AS (SELECT sample, feature_name, sum(n)::BIGINT AS n FROM f_counts GROUP BY ALL) SELECT sample, "
    "arg_min(feature_name, (-n, feature_name)) AS feature_name, max(n) AS n FROM g GROUP BY sample",
)
def w5(spark, sf):
    g = counts(spark, sf).groupBy("sample", "feature_name").agg(F.sum("n").alias("n"))
    return rk.arg_max(g, ["sample"], "feature_name", "n")


@register(
    "w6_group_median",
    f"WITH {_DISTANCE_SQL}, m AS (SELECT feature_name, median(distance) AS med FROM d GROUP BY ALL) SELECT feature_name, "
    "round(med, 6) AS med, row_number() OVER (ORDER BY round(med, 6), feature_name) AS place FROM m",
)
def w6(spark, sf):
    d = rd.centroid_distance(reads(spark, sf), cells(spark, sf))
    m = d.groupBy("feature_name").agg(F.round(F.median("distance"), 6).alias("med"))  # one row per gene
    return m.withColumn("place", F.row_number().over(Window.orderBy("med", "feature_name")))


@register(
    "w7_running_count",
    f"WITH {_DISTANCE_SQL}, g AS (SELECT sample, round_even(distance, 0) AS ring, count(*) AS n FROM d GROUP BY ALL) SELECT "
    "sample, ring, sum(n) OVER (PARTITION BY sample ORDER BY ring ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM g",
)
def w7(spark, sf):
    d = rd.centroid_distance(reads(spark, sf), cells(spark, sf))
    g = d.groupBy("sample", sc.half_even(c("distance")).alias("ring")).agg(F.count("*").alias("n"))
    return g.select("sample", "ring", rk.running_total(c("n"), c("ring"), "sample").alias("running"))


@register(
    "w10_run_rank",
    """WITH g AS (SELECT method, dataset, feature_name, count(*) AS n FROM f_reads GROUP BY ALL),
    r AS (SELECT *, rank() OVER (PARTITION BY method, dataset ORDER BY n DESC)
      + (count(*) OVER (PARTITION BY method, dataset, n) - 1) / 2 AS place FROM g)
    SELECT feature_name, median(place) AS median_rank FROM r GROUP BY ALL""",
)
def w10(spark, sf):
    g = reads(spark, sf).groupBy("method", "dataset", "feature_name").agg(F.count("*").alias("n"))
    r = g.withColumn("place", rk.average_rank(c("n").desc(), "method", "dataset", ties=c("n")))
    return r.groupBy("feature_name").agg(F.median("place").alias("median_rank"))


# ---- order, limits, samples ----


@register(
    "o1_o2_extremes",
    f"""WITH {_DISTANCE_SQL}, g AS (SELECT feature_name, round(avg(distance), 6) AS mean FROM d GROUP BY ALL)
    (SELECT 'top' AS side, * FROM g ORDER BY mean DESC, feature_name LIMIT 5) UNION ALL
    (SELECT 'bottom' AS side, * FROM g ORDER BY mean, feature_name LIMIT 5)""",
)
def o2(spark, sf):
    d = rd.centroid_distance(reads(spark, sf), cells(spark, sf))
    g = d.groupBy("feature_name").agg(r6(F.avg("distance"), "mean"))
    top = g.orderBy(c("mean").desc(), "feature_name").limit(5).withColumn("side", F.lit("top"))
    low = g.orderBy("mean", "feature_name").limit(5).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


@register(
    "o3_o6_fraction_sample",
    f"SELECT sample, cell_id FROM f_cells WHERE substr(md5(concat_ws('|', sample, cell_id, '0')), 1, 10) < '{int(0.1 * (1 << 40)):010x}'",
)
def o3(spark, sf):
    return rd.fraction_sample(cells(spark, sf), 0.1, 0, "sample", "cell_id").select("sample", "cell_id")


@register(
    "o4_o5_fixed_sample",
    "SELECT sample, cell_id FROM f_cells ORDER BY md5(concat_ws('|', sample, cell_id, '0')), sample, cell_id LIMIT 500",
)
def o4(spark, sf):
    return rd.fixed_sample(cells(spark, sf), 500, 0, "sample", "cell_id").select("sample", "cell_id")


@register(
    "o7_gene_folds",
    "SELECT feature_name, ntile(10) OVER (ORDER BY md5(concat_ws('|', feature_name, '0')), feature_name)::INT AS fold "
    "FROM (SELECT DISTINCT feature_name FROM f_counts)",
)
def o7(spark, sf):
    genes = counts(spark, sf).select("feature_name").distinct()  # a panel
    order = Window.orderBy(rd.seeded_order(0, "feature_name"), "feature_name")
    return genes.select("feature_name", F.ntile(10).over(order).alias("fold"))


# ---- set operations ----


@register(
    "u1_outer_concat",
    "SELECT sample, feature_name, sum(n)::BIGINT AS n, count(extra)::BIGINT AS extras FROM (SELECT sample, feature_name, n, "
    "NULL AS extra FROM f_counts WHERE sample = 0 UNION ALL SELECT sample, feature_name, n, 1 FROM f_counts WHERE sample = 1) "
    "GROUP BY ALL",
)
def u1(spark, sf):
    n = counts(spark, sf)
    both = rd.union_all([n.filter("sample = 0"), n.filter("sample = 1").withColumn("extra", F.lit(1))])
    return both.groupBy("sample", "feature_name").agg(F.sum("n").alias("n"), F.count("extra").alias("extras"))


@register(
    "u2_u3_concat",
    "SELECT source, count(*) AS n FROM (SELECT 'cells' AS source, cell_id FROM f_cells UNION ALL SELECT 'reads', cell_id "
    "FROM f_reads) GROUP BY ALL",
)
def u2(spark, sf):
    a = cells(spark, sf).select(F.lit("cells").alias("source"), "cell_id")
    b = reads(spark, sf).select(F.lit("reads").alias("source"), "cell_id")
    return a.unionByName(b).groupBy("source").agg(F.count("*").alias("n"))


@register(
    "u4_distinct",
    "SELECT feature_name, count(DISTINCT cell_id) AS cells, count(*) FILTER (WHERE k = 1) AS singles FROM (SELECT "
    "feature_name, cell_id, count(*) AS k FROM f_reads WHERE cell_id IS NOT NULL GROUP BY ALL) GROUP BY ALL",
)
def u4(spark, sf):
    k = reads(spark, sf).filter("cell_id is not null").groupBy("feature_name", "cell_id").agg(F.count("*").alias("k"))
    return k.groupBy("feature_name").agg(
        F.count("cell_id").alias("cells"), F.sum((c("k") == 1).cast("long")).alias("singles")
    )


@register(
    "u5_set_difference",
    "SELECT DISTINCT feature_name FROM f_reads EXCEPT SELECT DISTINCT p_brand FROM part",
)
def u5(spark, sf):
    return reads(spark, sf).select("feature_name").subtract(table(spark, sf, "part").select("p_brand"))


@register(
    "u6_mirror_union",
    "SELECT round(sum(v), 6) AS total, count(*) AS n FROM (SELECT nucleus_distance AS v FROM f_reads UNION ALL SELECT "
    "-nucleus_distance FROM f_reads)",
)
def u6(spark, sf):
    v = reads(spark, sf).select(c("nucleus_distance").alias("v"))
    both = v.unionByName(v.select((-c("v")).alias("v")))
    return both.agg(F.abs(F.round(F.sum("v"), 6)).alias("total"), F.count("*").alias("n"))


# ---- scalar functions ----


@register(
    "f1_f14_scalars",
    """SELECT cell_id, round(sqrt(x_centroid * x_centroid + y_centroid * y_centroid), 6) AS radius,
    round_even(x_centroid / 4, 0) AS rounded, floor((x_centroid - 3) / 7.5)::BIGINT AS bin, round(ln(1 + x_centroid), 6) AS logged,
    greatest(x_centroid - 500, 0) AS clipped, lower(trim(cell_type)) AS gene,
    cell_id || '_' || sample AS uid, CASE WHEN cell_id % 7 <> 0 THEN round(x_centroid / (cell_id % 7), 6) END AS ratio,
    'a-' || sample || '_b-' || cell_type AS run, cell_type AS b,
    dense_rank() OVER (ORDER BY cell_type) AS code FROM f_cells""",
)
def f_all(spark, sf):
    d = cells(spark, sf)
    types = d.select("cell_type").distinct()  # factor levels
    coded = types.withColumn("code", F.dense_rank().over(Window.orderBy("cell_type")))
    x, y = c("x_centroid"), c("y_centroid")
    out = d.join(F.broadcast(coded), "cell_type").withColumn(
        "run", sc.run_name({"a": c("sample"), "b": c("cell_type")})
    )
    return out.select(
        "cell_id",
        r6(sc.euclid(x, y, F.lit(0.0), F.lit(0.0)), "radius"),
        sc.half_even(x / 4).alias("rounded"),
        sc.bin_of(x, 7.5, 3.0).alias("bin"),
        r6(F.log1p(x), "logged"),
        sc.clip_low(x - 500).alias("clipped"),
        sc.gene_key(c("cell_type")).alias("gene"),
        sc.composed_id(c("cell_id"), c("sample")).alias("uid"),
        r6(sc.ratio(x, c("cell_id") % 7), "ratio"),
        "run",
        sc.run_parameter(c("run"), "b").alias("b"),
        "code",
    )


@register(
    "f12_vectors",
    """SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 4) AS dot, round(list_cosine_similarity(a.v, b.v), 6)
    AS cosine FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) a
    JOIN (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings) b ON b.id = a.id + 1""",
)
def f12(spark, sf):
    e = table(spark, sf, "embeddings").select(c("vec_id").alias("a"), c("embedding").alias("v"))
    f = e.select((c("a") - 1).alias("a"), c("a").alias("b"), c("v").alias("w"))
    met = e.join(f, "a")
    return met.select("a", "b", F.round(sc.dot(c("v"), c("w")), 4).alias("dot"), r6(sc.cosine(c("v"), c("w")), "cosine"))
